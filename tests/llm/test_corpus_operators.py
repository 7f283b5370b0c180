"""Operators over a whole corpus, against brute force and on the cases their docstrings define."""

import random
import re

import numpy as np
import pytest

from wavelake.llm import embed_tiles, exact_dedup, minhash, mixing
from wavelake.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, kept boolean, component string, target double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "x", False, "c", 1.0) for i, t, s in rows], DOCS)


def closed(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7), (1, 2), (1, 2)]
    want = {n: c for n, c in closed({x for e in edges for x in e}, edges).items()}
    alone = {n for n in want if not any(a != b and n in (a, b) for a, b in edges)}
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {n: c for n, c in want.items() if n not in alone}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- exact copies
ROWS = [(1, "Same Text", "a"), (2, "same text", None), (9, "SAME TEXT", "b"), (3, None, "a"), (4, "", "a"), (5, "É", "a"), (6, "é", "a"), (7, "word " * 50_000, "a"), (8, "WORD " * 50_000, "a"), (8, "WORD " * 50_000, "a"), (None, "lonely", "a"), (None, "same text", "a")]


def test_exact_labels(spark):
    got = exact_dedup.label(docs(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is not None}
    assert by == {1: (9, 4, False), 2: (9, 4, False), 9: (9, 4, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True), 6: (6, 1, True), 7: (8, 3, False), 8: (8, 3, True)}
    assert {r.kept for r in got if r.doc_id is None} == {True, False}
    plan = exact_dedup.label(docs(spark, ROWS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert exact_dedup.label(docs(spark, [])).count() == 0


def test_exact_survivors_and_batches(spark):
    index = exact_dedup.DigestIndex(spark)
    first = exact_dedup.deduplicate(docs(spark, ROWS), index)
    assert first.columns == docs(spark, []).columns
    assert sorted(str(r.doc_id) for r in first.collect()) == ["4", "5", "6", "8", "9", "None"]
    index.commit()
    second = exact_dedup.deduplicate(docs(spark, [(20, "same TEXT", "a"), (21, "new", "a"), (22, "NEW", "a")]), index)
    assert [r.doc_id for r in second.collect()] == [22]
    index.commit()
    third = exact_dedup.label(docs(spark, [(30, "new", "a"), (31, "newer", "a")]), index).orderBy("doc_id").collect()
    assert [(r.keep_id, r.kept) for r in third] == [(22, False), (31, True)]
    index.commit()
    again = exact_dedup.DigestIndex(spark, index.path, index.buckets)
    assert again.batch == 2 and again.entries().count() == 8
    assert [r.doc_id for r in exact_dedup.deduplicate(docs(spark, [(40, "NEWER", "a"), (41, "newest", "a")]), again).collect()] == [41]


# -- near copies
def shingle_sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def near_corpus(seed, n_bases=25, hot=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for b in range(n_bases):
        base = rng.choices(vocabulary, k=rng.randint(20, 300)) + (passage if b % 3 == 0 else [])
        for _ in range(hot if b == 0 and hot else rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 18))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    return [*texts, texts[0], texts[0].upper(), None, "", " ", "one", "ONE", "one two", " "]


def near_truth(texts, n, percent):
    sets = shingle_sets(texts, n)
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return closed(range(len(texts)), links), [len(s) for s in sets]


@pytest.mark.parametrize(("seed", "n", "percent", "hot"), [(1, 3, 85, 0), (2, 5, 80, 0), (3, 3, 85, 260)])
def test_near_copies_equal_brute_force(spark, monkeypatch, seed, n, percent, hot):
    monkeypatch.setattr(minhash, "TILE", 40)
    monkeypatch.setattr(minhash, "FAMILY_TILE", 30)
    texts = near_corpus(seed, hot=hot)
    want, sizes = near_truth(texts, n, percent)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), words=n, percent=percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_copies_dropped(spark):
    d = docs(spark, [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "", "z"), (None, "a b c d e f g", "z")])
    out = minhash.drop_near_copies(d)
    assert out.columns == d.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "None"]
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(d, percent=50)


def test_circular_shifts():
    first, second = minhash._permutations()
    size = 1 << minhash.UNIVERSE_BITS
    assert sorted(first.tolist()) == list(range(size)) and sorted(second[:, -1].tolist()) == list(range(size))
    for k in (1, 5, minhash.LENGTH - 1):
        assert (second[:, -1 - k] == np.roll(second[:, -1], k)).all()


# -- mixing
def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 50.0, "b": 100.0, None: 150.0}
    got = mixing.targets({"a": 100, "b": 1, "c": 10})
    assert got["b"] == 3 and got["c"] == 30 and got["a"] == 78
    assert mixing.targets({}) == {} and mixing.targets({"a": 0, "b": 10})["a"] == 0


def test_fit_reaches_every_reachable_budget():
    rng = random.Random(3)
    for _ in range(150):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 6) for _ in lengths])
        reach = {0}
        for size, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            reach = {r + k * size for r in reach for k in range(n + 1)}
        budget = rng.randint(0, int((lengths * counts).sum()))
        take = mixing.fit(lengths, counts, budget)
        got = int((take * lengths).sum())
        assert (take >= 0).all() and (take <= counts).all() and got in reach
        assert abs(budget - got) <= lengths.max()
    # Beyond the long ones 457 words are missing: the short ones make 330 of them, one long one more makes 500, which is nearer.
    for budget, best in ((123_457, 123_500), (123_257, 123_257)):
        assert int((mixing.fit(np.array([1, 7, 500]), np.array([50, 40, 400]), budget) * np.array([1, 7, 500])).sum()) == best


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED_TOGETHER", 16)
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 2, 3, 5, 40]), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(600)] + [(600, None, "b"), (601, "w " * 3000, "zz"), (602, "x", "zz")] + [(i, "same five words of text", "hot") for i in range(700, 1100)]
    d = docs(spark, rows)
    plan = mixing.plan(d).collect()
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    assert {r.doc_id: r.size for r in plan} == sizes and len(plan) == len(rows)
    sources = {i: s for i, _, s in rows}
    totals = {}
    for i, s in sources.items():
        totals[s] = totals.get(s, 0) + sizes[i]
    goal, taken = mixing.targets(totals), dict.fromkeys(totals, 0)
    for r in plan:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size and r.source_size == totals[sources[r.doc_id]] and r.target == goal[sources[r.doc_id]]
        taken[sources[r.doc_id]] += r.taken
    for s in totals:
        assert abs(taken[s] - goal[s]) <= max(3, 0.001 * goal[s]) or s == "zz"
    assert sorted(map(str, mixing.plan(d).collect())) == sorted(map(str, plan))
    out = mixing.mix(d)
    assert out.columns == d.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert {r.doc_id: r.taken // r.size for r in plan if r.taken} == counts
    assert mixing.plan(docs(spark, [])).count() == 0


# -- vectors
def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_tiles, "LEAST", 40)
    monkeypatch.setattr(embed_tiles, "MOST", 60)
    monkeypatch.setattr(embed_tiles, "BLOCK", 16)
    rng = np.random.default_rng(4)
    bases = rng.normal(size=(12, 16))
    x = np.concatenate([b + rng.normal(scale=0.13, size=(rng.integers(1, 25), 16)) for b in bases] + [rng.normal(size=(60, 16))])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, [2 * a for a in rows[0][1]]), (n + 3, None), (n + 4, []), (n + 5, [0.0] * 16), (n + 6, [float("nan")] * 16), (n + 7, [None] * 16), (n + 8, [float("inf")] + [0.0] * 15), (n + 9, [1.0, 2.0]), (n + 10, [1.0, 2.0]), (n + 11, [1e-30] * 16), (n + 12, [1e30] * 16)]
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    cos = lambda a, b: len(a) == len(b) and a / np.abs(a).max() @ (b / np.abs(b).max()) / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max()) >= 0.9
    links = [(i, j) for i in good for j in good if i < j and cos(good[i], good[j])]
    want = closed([i for i, _ in rows], links)
    degree = {i: sum(i in e for e in links) for i, _ in rows}
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id bigint, embedding array<float>, label string, n_links int")
    got = {r.vec_id: r for r in embed_tiles.near_duplicates(frame).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == degree
    assert embed_tiles.near_duplicates(frame.limit(0)).count() == 0


# -- pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randint(20, 60))]
        good = i % 4 > 0
        rows.append((i, " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words), "en", f"s{i % 3}", 0))
        labels.append((i, int(good), 0))
    rows += [(500, rows[1][1].upper(), "en", "s0", 0), (501, rows[1][1], "en", "s0", 0), (502, rows[2][1] + " more", "en", "s1", 0), (503, None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        d = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append([r.doc_id for r in d.select("doc_id").collect()])
    bad = {i for i in range(240) if i % 4 == 0}
    assert not bad & set(seen[0]) and {i for i in range(240)} - bad <= set(seen[0])
    assert 1 not in seen[1] and 501 in seen[1] and len(seen[1]) == len(set(seen[1]))
    assert 502 not in seen[2] and 2 in seen[2] and set(seen[2]) <= set(seen[1])
    assert set(seen[3]) <= set(seen[2]) and sorted(seen[4]) == sorted(seen[3])
    assert P.run(spark, str(tmp_path)).count() == len(seen[4])
