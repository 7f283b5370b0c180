"""The prefix trie of conversations against a plain one, however the conversations fall into shards and bands."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from wavelake.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, rebuild=True):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        made[c] = tuple(own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + s[h:])
    nodes = {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].split()) for q in under if q)
        ends = ",".join(str(c) for c in sorted(members) if made[c] == p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(n, seed, longest=6, words=3):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * n), n):
        s = [(r.choice(["user", "bot", None]), " ".join("ab"[r.randrange(2)] for _ in range(r.randrange(words))) or None) for _ in range(r.randrange(1, longest))]
        if r.random() < 0.4:
            s = [("user", "same start"), ("bot", "same answer")][: r.randrange(1, 3)] + s[:1]
        rows += [(c, t, *x) for t, x in enumerate(s)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("shards", [1, 3, 40, 150])
def test_whole_trie(spark, shards):
    rows = conversations(120, shards)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        assert got(prefix_trie.trie(prefix_trie.with_shared_heads(frame(spark, rows)))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_fan_and_narrow_bands(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    rows = conversations(60, 5) + [(1000 + k, t, "user", f"turn {t}") for k in range(30) for t in range(70)]
    rows += [(2000 + k, t, "user", "common" if t < 40 + k % 3 else f"own {k}") for k in range(200) for t in range(45)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert got(prefix_trie.trie(prefix_trie.sequences(frame(spark, rows)))) == plain(rows, rebuild=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bands_of_any_width(monkeypatch):
    r = np.random.default_rng(3)
    lengths = r.integers(0, 90, 60)
    ids, conv = r.integers(0, 2, lengths.sum()), r.permutation(60)
    words = 2 * ids + 1
    shapes = []
    for width in (1, 7, 32, 1000):
        monkeypatch.setattr(prefix_trie, "BAND", width)
        found, _ = prefix_trie.levels(conv, lengths, ids, words)
        shapes.append([(x.first.tolist(), x.n.tolist(), x.leaves.tolist(), x.saved.tolist(), {k: v.tolist() for k, v in x.ends.items()}, x.at_first, x.at_last) for x in found])
    assert all(s == shapes[0] for s in shapes)


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(0, None, None, "last comes first"), (0, 0, "user", None), (0, 0, "bot", "b"), (0, 0, "bot", "b"), (None, 0, "user", "x"), (20, 1, "user", "q"), (21, 0, "user", "only"), (-3, 0, "user", "z")]
    df = frame(spark, rows).selectExpr("*", "text AS key", "conv_id AS family", "turn AS words")
    assert got(prefix_trie.trie(prefix_trie.with_shared_heads(df))) == plain(rows)
    assert got(prefix_trie.trie(prefix_trie.with_shared_heads(df.where("false")))) == []


def test_one_conversation_that_most_are_copies_of(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 8000, 20) for t in range(3)] + [(c, 0, "user", "alone") for c in range(1, 40, 20)]
    found = got(prefix_trie.trie(prefix_trie.with_shared_heads(frame(spark, rows))))
    assert found == plain(rows)
    assert max(r[3] for r in found if r[1] == 3) >= 400
