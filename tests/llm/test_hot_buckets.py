"""Large buckets of one frequent passage: dealt into sub-buckets that keep every near pair; tiles by bytes; scratch tables go."""

import os
import random

import numpy as np
import pytest
from test_corpus_operators import near_truth
from test_near_groups import DOCS

from wavelake.llm import minhash
from wavelake.llm.common import shared_dir, written

ROWS = "band bigint, doc_id bigint, component bigint, n_shingles bigint, slots bigint, sketch binary"


def rows_of(sketches, band, first=0):
    return [(band, first + i, first + i, 100, 1, bytearray(s.tobytes())) for i, s in enumerate(sketches)]


def test_sub_buckets_keep_near_pairs_and_send_less(spark):
    rng = np.random.default_rng(3)
    n, size = 2000, 16
    loose = rng.integers(0, 256, (n, minhash.LENGTH), dtype=np.uint8)
    for i in range(0, n, 2):
        agree = rng.permutation(minhash.LENGTH)[: minhash.LENGTH * 4 // 5]
        loose[i + 1, agree] = loose[i, agree]
    tight = np.tile(rng.integers(0, 256, minhash.LENGTH, dtype=np.uint8), (n, 1))
    for i in range(n):
        tight[i, rng.permutation(minhash.LENGTH)[:2]] = rng.integers(0, 256, 2)
    few = rng.integers(0, 256, (30, minhash.LENGTH), dtype=np.uint8)
    given = rows_of(loose, 1) + rows_of(tight, 2, 10_000) + rows_of(few, 3, 20_000)
    out = minhash._sub_buckets(written(spark.createDataFrame(given, ROWS), "given"), size).select("band", "doc_id").collect()
    groups = {}
    for r in out:
        groups.setdefault(r.band, set()).add(r.doc_id)
    # Members that agree nearly everywhere would send more by sub-buckets; small buckets stay as they are.
    assert groups.pop(2) == set(range(10_000, 10_000 + n)) and groups.pop(3) == set(range(20_000, 20_030))
    assert 1 not in groups
    pairs = {(a, a + 1) for g in groups.values() for a in g if a % 2 == 0 and a + 1 in g}
    assert pairs == {(i, i + 1) for i in range(0, n, 2)}
    assert sum(len(g) * -(-len(g) // size) for g in groups.values()) <= minhash.SUB_BANDS * n


def test_one_large_component_isnt_dealt(spark):
    rng = np.random.default_rng(4)
    given = [(1, i, 0 if i else -5, 100, 1, bytearray(rng.bytes(minhash.LENGTH))) for i in range(3000)]
    rows = written(spark.createDataFrame(given, ROWS), "given")
    assert minhash._sub_buckets(rows, 16) is rows


@pytest.fixture
def splits(monkeypatch):
    counts = []
    real = minhash.written

    def counting(df, name):
        out = real(df, name)
        if name == "split":
            counts.append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", counting)
    return counts


def test_a_frequent_passage_equals_brute_force(spark, monkeypatch, splits):
    monkeypatch.setattr(minhash, "TILE", 2)
    monkeypatch.setattr(minhash, "FAMILY_TILE", 4)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    passage, texts = rng.choices(words, k=40), []
    for _ in range(500):
        own = rng.choices(words, k=40)
        texts.append(" ".join(passage + own))
        if rng.random() < 0.3:
            own[rng.randrange(40)] = "other"
            texts.append(" ".join(passage + own))
    want, _ = near_truth(texts, 3, 85)
    docs = spark.createDataFrame([(i, t, "c", False) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}
    assert got == want
    assert sum(splits) > 0


def test_chance_of_sub_bands():
    """Pairs right at 80 per cent that would share no sub-bucket: none of 1500."""
    rng = np.random.default_rng(5)
    for _ in range(1500):
        union = rng.integers(0, 1 << 63, 400, dtype=np.uint64) << np.uint64(1)
        a, b = (minhash.signature(np.concatenate([union[:320], union[320 + k * 40 : 360 + k * 40]])).reshape(minhash.SUB_ROWS, minhash.SUB_BANDS) for k in (0, 1))
        assert (a == b).all(0).any()


def test_tiles_are_measured_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SLOT_BYTES", 1000)
    sets = minhash._sets([1, 2, 3], ["one two three", " ".join(f"w{i}" for i in range(1000)), ""], 3)
    assert sets["slots"] == [1, 8, 1] and [len(x) for x in sets["items"]] == [8, 7984, 0]
    given = [(1, i, i, 100, 8, bytearray(8)) for i in range(64)]
    paired, _ = minhash._tile_pairs(spark.createDataFrame(given, ROWS), "band", 64)
    assert paired.groupBy("pair", "side").count().agg({"count": "max"}).first()[0] <= 24


def test_scratch_tables_are_removed(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = [(i, " ".join([*base[: 120 - i % 7], f"x{i % 9}"]), "c", False) for i in range(60)]
    root = shared_dir(spark).split("file:")[-1]
    before = set(os.listdir(root))
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS))
    assert out.where("kept").count() < 60
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before)
    assert set(left) <= {"labelled", "components", "joined", "small", "edges"} and len(left) <= 3
