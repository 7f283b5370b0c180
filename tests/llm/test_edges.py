"""Cases that docstrings define: empty tables, long texts, repeated and null keys, clashing columns."""

import random

import numpy as np
import pytest

from wavelake.llm import embed_tiles, fm_quality, trie_counts
from wavelake.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, component string, kept boolean, target double, digest string, wavelake_uid int"


def rows_of(*texts):
    return [(i, t, "en", f"s{i % 2}", 0, "c", True, 0.5, "d", 9) for i, t in enumerate(texts)]


def stages(spark, tmp_path, rows, labels):
    import corpus_pipeline as P

    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, out = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in P.STAGES:
        found = stage(spark, d, str(tmp_path))
        if name != P.STAGES[-1][0]:
            assert found.columns == d.columns, name
        found.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        out[name] = d.collect()
    return out


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert {k: len(v) for k, v in stages(spark, tmp_path, [], []).items()} == dict.fromkeys(("quality", "exact_dedup", "near_dedup", "mixing", "encoding"), 0)


def test_pipeline_with_clashing_columns_and_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(150_000))
    rows = [*rows_of(*[f"A text of number {i}, and more of {i * 7} it." for i in range(30)]), (100, long, None, None, None, None, None, None, None, None), (101, long + " end", None, None, None, None, None, None, None, None), (102, None, "en", None, 0, "c", True, 0.5, "d", 9), (103, "", "en", "", 0, "c", True, 0.5, "d", 9), (None, "no number, but a text", "en", "s0", 0, "c", True, 0.5, "d", 9), (7, "A text of number 7, and more of 49 it.", "en", "s1", 0, "other", True, 0.5, "d", 9)]
    out = stages(spark, tmp_path, rows, [])  # without labels every score is 0.5 and all stay
    ids = {k: [r.doc_id for r in v] for k, v in out.items()}
    assert len(ids["quality"]) == len(rows)
    assert sorted(map(str, ids["exact_dedup"])) == sorted(map(str, [*range(30), 100, 101, 103, None]))  # of null and empty the larger number
    assert {100, 101} - set(ids["near_dedup"]) == {101} and None in ids["near_dedup"] and len(ids["near_dedup"]) == 33
    assert 103 not in ids["mixing"] and set(ids["mixing"]) <= set(ids["near_dedup"])
    assert sorted(map(str, ids["encoding"])) == sorted(map(str, ids["mixing"]))


def test_vectors_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=8), rng.normal(size=8)
    rows = [(1, a.tolist(), "x"), (1, a.tolist(), "x"), (2, (a * 3).tolist(), "x"), (None, a.tolist(), "x"), (4, b.tolist(), "x"), (5, None, "x"), (6, [0.0] * 8, "x"), (7, [float("nan")] * 8, "x"), (8, [], "x"), (9, [1.0, None], "x")]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embed_tiles.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n_links string")).collect())
    assert got == sorted([("1", 2, "1", True), ("1", 2, "1", True), ("2", 2, "1", False), ("None", 0, "None", True), *[(str(i), 0, str(i), True) for i in range(4, 10)]])


@pytest.mark.parametrize("single", [True, False])
def test_vectors_packed_in_either_width(spark, monkeypatch, single):
    monkeypatch.setattr(embed_tiles, "LEAST", 30)
    monkeypatch.setattr(embed_tiles, "MOST", 50)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(30, 12)), 5, 0) + rng.normal(size=(150, 12)) * 0.15
    x[:60, :] = np.abs(x[:60, :]) * 0 + x[:60, :].round(1) if not single else x[:60, :]
    x = x.astype(np.float32).astype(np.float64) if single else x
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.9).sum(1) - 1).tolist()
    got = {r.vec_id: r.n_links for r in embed_tiles.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()}
    assert [got[i] for i in range(150)] == want


def test_places_that_fill_a_slab(spark, monkeypatch):
    """Vectors that lie at one place of the first axis are dealt to several tiles."""
    monkeypatch.setattr(embed_tiles, "LEAST", 20)
    monkeypatch.setattr(embed_tiles, "MOST", 25)
    rng = np.random.default_rng(7)
    x = np.zeros((120, 6))
    x[:, 0] = 4.0
    x[:, 1 + np.arange(120) % 5] = 0.0
    for i in range(120):
        x[i, 1 + i % 5] = rng.choice([-3.0, 3.0]) + (i // 10) * 1e-9
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.vec_id: r.n_links for r in embed_tiles.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()}
    assert [got[i] for i in range(120)] == ((u @ u.T >= 0.9).sum(1) - 1).tolist()


def test_token_counts_of_long_texts_and_no_rows(spark):
    counter = trie_counts.counter(tokenizer_path("byte_bpe_50k.tiktoken"))
    texts = ["word " * 20_000, "x" * 50_000, "ab1," * 20_000, "é" * 3_000]

    def brute(word):
        best = [(0, 0)]
        for end in range(1, len(word) + 1):
            best.append(min((best[s][0] + (counter.costs[word[s:end]] >> 20), best[s][1] + 1) for s in range(max(0, end - counter.longest), end) if word[s:end] in counter.costs))
        return best[-1][1]

    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    for r in trie_counts.token_counts(frame, tokenizer_path("byte_bpe_50k.tiktoken")).collect():
        parts = counter.split.findall(texts[r.doc_id])
        known = {p: brute(p.encode()) for p in set(parts)}
        assert (r.n_pretokens, r.n_tokens) == (len(parts), sum(known[p] for p in parts))
    assert trie_counts.token_counts(frame.limit(0), tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


def test_odd_texts_on_a_fitted_model(spark):
    rows = [(fm_quality.inputs(("good, plain words here. " if y else "BUY!! NOW### ") * (1 + i % 5)), y) for i in range(60) for y in (0, 1)]
    machine = fm_quality.fit([(at, x, y) for (at, x), y in rows])
    texts = [None, "", " ", "x" * 200_000, "word " * 50_000, "good, plain words here.", "BUY!! NOW### BUY!!", "\ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace")]
    got = {r.doc_id: r.score for r in fm_quality.scores(spark.createDataFrame([(i, t, 2.0) for i, t in enumerate(texts)], "doc_id bigint, text string, score double"), machine).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert got[5] > 0.5 > got[6] and got[0] == got[1]
