"""Reader comments, hidden parts of lines and adverts in them aren't the article's text; articles about them are."""

import pytest

from wavelake.llm.html_paths import main_text

TEXT = [f"Paragraph {k} says something of length, with commas, and ends; it goes on for a while so that it counts." for k in range(6)]
ARTICLE = "".join(f"<p>{t}</p>" for t in TEXT)
SAID = "".join(f"<li><p>Reader {k}: I think this is, all in all, a very good text. Thank you, and more of it!</p></li>" for k in range(18))


@pytest.mark.parametrize(
    "comments",
    [
        f'<ol id="comments">{SAID}</ol>',
        f'<ul class="comment-list">{SAID}</ul>',
        f'<div class="discussion-thread"><ul>{SAID}</ul></div>',
        f'<div class="user-responses"><ul>{SAID}</ul></div>',
        f'<section aria-label="Comments"><ul>{SAID}</ul></section>',
        "".join(f'<article class="comment"><p>Reader {k}: I think, well, this is a good text. Really!</p></article>' for k in range(9)),
        f'<div itemprop="comment"><ul>{SAID}</ul></div>',
    ],
)
@pytest.mark.parametrize("page", ["<article><h1>Title here</h1>{a}{c}</article>", "<div><div class='story'><h1>Title here</h1>{a}</div>{c}</div>", "<main><article><h1>Title here</h1>{a}</article>{c}</main>"])
def test_comments_go_wherever_they_stand(page, comments):
    got = main_text(f"<html><body>{page.format(a=ARTICLE, c=comments)}</body></html>")
    assert got == "\n".join(["Title here", *TEXT])


def test_a_short_article_with_many_comments():
    page = f'<html><body><div><p>A short note, no more.</p></div><div id="comments"><ul>{SAID}</ul></div></body></html>'
    assert main_text(page) == "A short note, no more."


@pytest.mark.parametrize("part", ["<span hidden>gone</span>", '<span style="display: none">gone</span>', '<span class="ad">gone</span>', '<b class="sr-only">gone <b>too</b> gone</b>', '<em class="sponsored-link">gone <span>gone</span></em>', '<span style="visibility:hidden">gone</span>'])
def test_parts_of_a_line(part):
    page = f"<article>{ARTICLE}<p>Before {part}after, and on.</p><p>Next one, with text.</p></article>"
    assert main_text(page).split("\n")[-2:] == ["Before after, and on.", "Next one, with text."]


def test_a_hidden_part_without_an_end_ends_with_its_block():
    page = f'<article>{ARTICLE}<p>Before <span hidden>gone</p><p>Next one, with text.</p></article>'
    assert main_text(page).split("\n")[-2:] == ["Before", "Next one, with text."]


@pytest.mark.parametrize("part", ['<h2 id="comments">On comments</h2>', '<section id="discussion"><p>Discussion of results, at length, as papers have it.</p></section>', '<p id="comment">A comment on law, as a text.</p>', '<span class="highlight">Shown</span>', '<div class="commentary"><p>Commentary by the author, on all of it.</p></div>'])
def test_what_only_sounds_alike_stays(part):
    import re

    words = re.sub("<[^>]*>", "", part)
    assert words in main_text(f"<article>{ARTICLE}{part}{ARTICLE}</article>")
