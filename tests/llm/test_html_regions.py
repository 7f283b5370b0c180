"""Main text of pages whose article is short at its ends, has no region of its own, or is named like furniture."""

from wavelake.llm import html_paths


POST = ["A heading of twenty c", *["One, two. Three: four; five! Six " + "words of a long paragraph " * 11] * 3, "first closing item 1", "second closing item2", "third closing item 3"]


def test_main_text_keeps_the_ends_of_an_article_without_region():
    h, *ps, a, b, c = [" ".join(x.split()) for x in POST]
    body = f"<h1>{h}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"<ul><li>{a}</li><li>{b}</li><li>{c}</li></ul>"
    nav = "<div><a href=/>Home of all pages</a></div>"
    assert html_paths.main_text(f"<body>{nav}<div class=post>{body}</div>{nav}</body>").split("\n") == [h, *ps, a, b, c]
    for end in ("<blockquote>Short end</blockquote>", "<pre>Short end</pre>", "<table><tr><td>Short end</td></tr></table>", "<dl><dt>Short end</dt></dl>"):
        page = f"<body>{nav}<div class=post><div>Lead in</div>{body}{end}</div>{nav}</body>"
        assert html_paths.main_text(page).split("\n") == ["Lead in", h, *ps, a, b, c, "Short end"]
    quoted = f"<body>{nav}<div><p>Before</p><blockquote>" + "".join(f"<div>{p}</div>" for p in ps) + "</blockquote><p>After</p></div></body>"
    assert html_paths.main_text(quoted).split("\n") == ["Before", *ps, "After"]
    titled = f"<body>{nav}<div><h1>Title</h1><div>{body}</div></div></body>"
    assert html_paths.main_text(titled).split("\n") == ["Title", h, *ps, a, b, c]


def test_main_text_overrules_slugs_and_names():
    h, *ps, a, b, c = [" ".join(x.split()) for x in POST]
    body = "".join(f"<p>{p}</p>" for p in ps)
    slugs = [f'<h2 id="related-work">{h}</h2>', f'<h2 class=heading id="social-impact">{h}</h2>', f'<h2 id="toc">{h}</h2>', f'<p id="notice">{h}</p>', f'<section id="search-algorithms"><h2>{h}</h2></section>', f'<section class="legal-basis"><h2>{h}</h2></section>']
    for slug in slugs:
        for page in (f"<article>{body}{slug}{body}</article>", f"<main><h1>{a}</h1>{slug}{body}</main>"):
            assert h in html_paths.main_text(page).split("\n"), page
    for slug in (*slugs[:4], f'<section id="search-algorithms"><h2>{h}</h2>{body}</section>'):
        assert h in html_paths.main_text(f"<body><div class=post>{body}{slug}{body}</div></body>").split("\n"), slug
    for section in ('id="legal"', 'class="legal"', 'id="search"', 'id="login"', 'class="notice"', 'id="cookies"'):
        assert html_paths.main_text(f"<article>{body}<section {section}><h2>{h}</h2>{body}</section></article>").split("\n") == [*ps, h, *ps], section
        assert html_paths.main_text(f"<article><section {section}><h2>{h}</h2>{body}</section></article>").split("\n") == [h, *ps], section


def test_main_text_still_drops_furniture():
    ps = [" ".join(p.split()) for p in POST[1:4]]
    body = "".join(f"<p>{p}</p>" for p in ps)
    links = "<ul><li><a href=/a>Another story</a></li><li><a href=/b>One more story, too</a></li></ul>"
    for part in ("class=ad", "class=related", "id=related-posts", 'class="share-buttons"', "class=social-links", "id=newsletter-form", "class=tags", "class=toc", "id=sidebar"):
        assert html_paths.main_text(f"<article>{body}<div {part}>{links}</div>{body}</article>").split("\n") == [*ps, *ps], part
        assert html_paths.main_text(f"<body><div>{body}<div {part}>{links}</div>{body}</div></body>").split("\n") == [*ps, *ps], part
    for part in ("class=ad", "class=comments", "id=comments", 'class="post-comments"'):
        assert html_paths.main_text(f"<article>{body}<div {part}>{body}</div></article>").split("\n") == ps, part
