"""Pages that are wrapped in elements named like furniture, broken pages, and ratios against a plain version."""

import math
import random
import time

import pytest

from wavelake.llm import html_paths

SENTENCES = [
    "The river rose quickly in the night, and by morning the lower fields were under water.",
    "People moved their animals to the hill, where an old barn gave some shelter.",
    "Nobody was hurt, although two bridges were lost and the road was closed.",
    "The council met at noon; it asked the county for pumps, boats and food.",
    "By evening the rain had stopped, and the water began to fall slowly.",
    "Repairs will take months, the engineer said, but the mill can be saved.",
]
BODY = "".join(f"<p>{s}</p>" for s in SENTENCES)
TEXT = "\n".join(SENTENCES)
TITLE = "The flood of the river valley"


@pytest.mark.parametrize("start", ['<div class="site has-sidebar">', '<div id="content" class="comments-open">', '<div class="legal">', "<form id=aspnet>", '<div class="search-results"><div>', '<div class="tags">', '<div class="page js-hidden-nav">', "<article><object data=x>", "<article><video src=x>", "<article><svg><path d=x>", "<head><title>T</title><body>", '<a name="top">'])
def test_wrapped_and_unclosed(start):
    assert html_paths.main_text(f"<body>{start}{BODY}</body>") == TEXT


@pytest.mark.parametrize("head", ['<div class="post-header"><h1>{}</h1></div>', '<div class="entry-header"><h1>{}</h1></div>', "<header><h1>{}</h1></header>"])
def test_titles_of_articles(head):
    assert html_paths.main_text(f"<body><nav><a href=/>Home</a></nav><article>{head.format(TITLE)}{BODY}</article></body>") == f"{TITLE}\n{TEXT}"


def test_furniture_in_a_form_page_still_goes():
    page = f"<body><form id=aspnet><div class=menu><a href=/>Home</a> <a href=/x>News</a></div>{BODY}<div class=comments><p>Well said, I think.</p></div><form><label>Mail</label><input></form></form></body>"
    assert html_paths.main_text(page) == TEXT


def test_time_is_in_proportion():
    took = {}
    for n in (2_000, 32_000):
        began = time.perf_counter()
        for page in ("<div>" * n + "</p>" * n + "text, here.", "<div>x" * n, "<svg>" * n, "<a href=x>" * n + "t", "<div><p>a, b." * n):
            html_paths.main_text(page)
        took[n] = time.perf_counter() - began
    assert took[32_000] < 60 * max(took[2_000], 0.02)


@pytest.mark.parametrize("seed", range(10))
def test_ratios_equal_a_plain_version(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["div/p", "div/ul/li", "section/p", "td"]), " ".join(rng.choice(["word", "end,", "stop.", "x"]) for _ in range(rng.randint(1, 30)))) for _ in range(60)]
    page = "".join("".join(f"<{t}>" for t in path.split("/")) + text + "".join(f"</{t}>" for t in reversed(path.split("/"))) for path, text in rows)
    found = html_paths.blocks(page)
    assert [b.text for b in found] == [t for _, t in rows]
    fused, least = html_paths._ratios(found)
    of = {p: [t for q, t in rows if q == p] for p, _ in rows}
    length = [sum(map(len, of[p])) / len(of[p]) for p, _ in rows]
    marks = [sum(sum(c in ".,;:!?" for c in t) for t in of[p]) / len(of[p]) for p, _ in rows]

    def smooth(x, i):
        near = [(x[j], math.exp(-0.5 * (i - j) ** 2)) for j in range(max(0, i - 2), min(len(x), i + 3))]
        return sum(v * w for v, w in near) / sum(w for _, w in near)

    want = [math.sqrt(smooth(length, i) * (smooth(marks, i) + 0.1)) for i in range(len(rows))]
    assert fused.tolist() == pytest.approx(want)
    assert least == pytest.approx(0.6 * sum(f * len(t) for f, (_, t) in zip(want, rows, strict=True)) / sum(len(t) for _, t in rows))


def test_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", f"<body>{BODY}</body>", "x", 7), (2, None, None, None, None), (2, "u", "", None, None)], "page_id bigint, url string, html string, text string, n_chars int")
    got = html_paths.extract(pages).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (2, "u", "", 0)]
    assert html_paths.extract(pages.limit(0)).count() == 0
