"""Operators that look at one text at a time, against brute force and on the cases their docstrings define."""

import hashlib
import html
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wavelake.llm import bpe_chunks, fm_quality, html_paths, license_diagonals, pii_anchors, trie_counts
from wavelake.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, score double"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, "x", 1.0) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "\n", "a", "word " * 20_000, "x" * 50_000, "same", "same", "日本語 テキスト", "\x00\x01", "MIT License"]


# -- encoding
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


PIECES = ["a", "b", "é", "日", " ", "  ", "\n", " \n", "'s", "'", "1", "23", ".", ",", "%", "<|endoftext|>", "<|", " ", "the", " the", "😀", "\t", "\x1c", "\x85", "​", "!?"]


@pytest.mark.parametrize("longest", [3, 5, 8, 20, 1 << 14])
def test_encoding_equals_the_library(library, longest):
    rng, codec = random.Random(longest), bpe_chunks.Codec(tokenizer_path(), longest)
    for _ in range(600):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode([text]) == [(len(ids), ",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))], text


def test_caches_may_overflow(library, monkeypatch):
    monkeypatch.setattr(bpe_chunks, "CHUNKS", 3)
    monkeypatch.setattr(bpe_chunks, "PIECES", 3)
    codec = bpe_chunks.Codec(tokenizer_path())
    for text in ("one two, three four. " * 30, "five six seven", "one two, three"):
        for _ in range(3):
            assert codec.encode([text])[0][1] == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_round_trip(spark, library):
    got = {r.doc_id: r for r in bpe_chunks.round_trip(docs(spark, ODD), tokenizer_path()).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_chunks.round_trip(docs(spark, []), tokenizer_path()).count() == 0
    row = bpe_chunks.encode(docs(spark, ["Hello world"]), tokenizer_path()).first()
    assert library.decode(row.ids) == "Hello world" == row.decoded


def test_shared_passages_share_chunks():
    passage = " ".join(f"word{i} of the passage" for i in range(200))
    a, b = bpe_chunks.cuts(["An opening. " + passage, "Quite another, longer opening here. " + passage])
    chunks = lambda text, ends: {text[i:j] for i, j in zip([0, *ends], ends, strict=False)}
    one, two = chunks("An opening. " + passage, a), chunks("Quite another, longer opening here. " + passage, b)
    assert len(one & two) >= len(one) - 3


# -- token counts
def test_counts_equal_brute_force(spark):
    counter = trie_counts.counter(tokenizer_path("byte_bpe_50k.tiktoken"))

    def brute(word):
        best = [(0, 0)]
        for end in range(1, len(word) + 1):
            best.append(min((best[s][0] + (counter.costs[word[s:end]] >> 20), best[s][1] + 1) for s in range(end) if word[s:end] in counter.costs))
        return best[-1][1]

    texts = [*[t for t in ODD if t is None or len(t) < 1000], "Unbelievable internationalisation, isn't it? 12345 ééé " * 3]
    got = {r.doc_id: r for r in trie_counts.token_counts(docs(spark, texts), tokenizer_path("byte_bpe_50k.tiktoken")).collect()}
    for i, t in enumerate(texts):
        parts = counter.split.findall(t or "")
        assert got[i].n_pretokens == len(parts) and got[i].n_tokens == sum(brute(p.encode()) for p in parts)
    assert counter.long(b"internationalisation") == brute(b"internationalisation")


def test_prefixes_are_scored_once():
    class Costs(dict):
        asked = 0

        def get(self, key, default=None):
            Costs.asked += 1
            return super().get(key, default)

    costs = Costs({bytes([b]): (1000 << 20) + 1 for b in range(256)})
    counter = trie_counts.Counter(costs)
    assert counter.walk([b"abcdef", b"abcdefg", b"abcdefh"]) == {b"abcdef": 6, b"abcdefg": 7, b"abcdefh": 7}
    assert Costs.asked == 8


# -- personal data
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 14 <= len(digits(m)) <= 19 and pii_anchors.luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15}
    found = [(k, m.start(), m.end()) for k, p in BASE.items() for m in p.finditer(text) if good[k](m[0])]
    return sorted(found, key=lambda s: (s[1], pii_anchors.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    bits = [*"01259a.Z@+- ()%é\n_", "192.168.1.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "a.b@c-d.e", "255.", "256", "١"]
    for _ in range(8000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert [s for s in pii_anchors.find(text) if s[0] in BASE] == base_spans(text), text


def test_added_spans():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, mailto:a@b.c, http://u:p@h.org/x; SSN 123-45-6789. See http://example.org and ribbon"
    added = [(k, text[a:b]) for k, a, b in pii_anchors.find(text) if k not in BASE]
    assert added == [("account", "GB82 WEST 1234 5698 7654 32"), ("uri", "mailto:a@b.c"), ("uri", "http://u:p@h.org/x"), ("account", "123-45-6789")]


def test_personal_data_rows(spark):
    got = {r.doc_id: r for r in pii_anchors.scan(docs(spark, [*ODD, "é a@b.c 10.0.0.1"])).collect()}
    assert got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[len(ODD)].spans == "email:2:7,ip:8:16" and (got[len(ODD)].n_email, got[len(ODD)].n_ip) == (1, 1)
    assert pii_anchors.scan(docs(spark, [])).count() == 0


# -- licenses
def test_license_base_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "by", "nc", "x", "é"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += ["under the mit license " * 500, "Released under the MIT License.", "apache license version 2 under the mit license", *ODD]
    got = {r.doc_id: r for r in license_diagonals.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        places = [(p, label) for phrase, label in license_diagonals.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        starts = [p for p, _ in places]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None)), t
        assert got[i].base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, got[i].base_labels.split(","))) <= set(filter(None, got[i].labels.split(","))) and 0 <= got[i].score <= 1


def test_license_texts_with_edits(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it, under all of the terms of the GNU General Public License"
    texts = [gpl, "permission to use copy modify", "This program is a story about free software that you can like."]
    got = [r.labels for r in license_diagonals.scan(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["gpl", "", ""]
    assert license_diagonals.scan(docs(spark, [])).count() == 0


def test_licenses_stay_in_the_jvm(spark):
    plan = license_diagonals.scan(docs(spark, ["a"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- pages
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site, home.</a></header><nav><ul><li><a href=a>One</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, as all do.</p></div>
<div class="ad">Buy this, now.</div><article><h1>Title &amp; more</h1><p><b>First,  with
space.<br><p>Second &#8212; part.</p><ul><li>Item one, of two.</li><li>Item</li></ul><p>Short.</p></article>
<aside><p>Aside text, which is long, has commas, and goes on and on for a while, longer than all.</p></aside>
<section id="comments"><p>Nice post, thanks!</p></section><form><p>Search here, please.</p></form><footer>&copy; site</footer>"""


def test_main_text(spark):
    want = "Title & more\nFirst, with space.\nSecond — part.\nItem one, of two.\nItem\nShort."
    assert html_paths.main_text(PAGE) == want
    bare = PAGE.replace("<article>", '<div id="content">').replace("</article>", "</div>")
    assert html_paths.main_text(bare) == want
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain, text"), (5, "u", "<p>cut <b"), (5, "u", "<p>cut <b")]
    got = html_paths.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got if r.url) == sorted([(1, "u", want, len(want)), (3, "u", "", 0), (4, "u", "plain, text", 11), (5, "u", "cut", 3), (5, "u", "cut", 3)])
    assert [r.text for r in got if r.url is None] == [""]


def test_long_pages_are_whole():
    body = "".join(f"<p>Sentence {i}, with text.</p>" for i in range(5000))
    assert html_paths.main_text(f"<article>{body}</article>").count("\n") == 4999
    assert html.unescape("&amp;") == "&"


# -- quality
def quality_rows(n=400):
    rng, rows = random.Random(6), []
    for i in range(n):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        good = i % 3 > 0
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" if i % 2 else w + "###" for w in words)
        rows.append((i, text, int(good)))
    return rows


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    size = fm_quality.STATS + fm_quality.BUCKETS
    m = fm_quality.Machine(rng.normal(size=size), rng.normal(size=(size, 4)))
    at, x = fm_quality.inputs("one two two three, FOUR!! 5")
    pairs = sum(float(m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert m.raw(at, x) == pytest.approx(float(m.w[at] @ x) + pairs)


def test_held_out_accuracy(spark):
    rows = quality_rows()
    d = spark.createDataFrame([(i, t, "label", 1.0) for i, t, _ in rows], "doc_id bigint, text string, y string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5000, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    m = fm_quality.learn(d, labels, sample=250)
    got = fm_quality.scores(d, m).collect()
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r.held_out]
    assert 0.1 < len(held) / len(got) < 0.3
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    again = fm_quality.scores(d, fm_quality.learn(d, labels, sample=250)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert fm_quality.keep_good(d, m).columns == d.columns


def test_odd_texts_have_scores(spark):
    m = fm_quality.fit([])
    got = fm_quality.scores(docs(spark, ODD), m).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 for r in got)
    assert fm_quality.scores(docs(spark, []), m).count() == 0
    assert docs(spark, ["a"]).where(fm_quality.held_out(F.col("doc_id"))).count() in (0, 1)


def test_public_files_are_outside_the_repository():
    assert "public_tokenizers" in public_tokenizers.path("byte_bpe_50k.json")
