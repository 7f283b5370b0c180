"""Near copies in large groups: written edges grow in proportion; repeated ids, null ids and long texts."""

import random

import numpy as np
import pytest

from wavelake.llm import minhash

DOCS = "doc_id bigint, text string, component string, kept boolean"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "c", False) for i, t in rows], DOCS)


def loose_group(n):
    """n copies of one text that keep about three quarters of its shingles: many candidates, hardly a link."""
    rng = random.Random(n)
    base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    out = []
    for i in range(n):
        words = list(base)
        for k in rng.sample(range(0, 200, 5), rng.choice([3, 5, 6])):
            words[k] = f"x{i}-{k}"
        out.append(" ".join(words))
    return out


@pytest.fixture
def edges_written(monkeypatch):
    counts = []
    real = minhash.written

    def counting(df, name):
        out = real(df, name)
        if name in ("joins", "links"):
            counts.append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", counting)
    return counts


def test_edges_grow_in_proportion(spark, monkeypatch, edges_written):
    monkeypatch.setattr(minhash, "TILE", 64)
    monkeypatch.setattr(minhash, "FAMILY_TILE", 64)
    totals = {}
    for n in (256, 1024):
        edges_written.clear()
        found = minhash.near_duplicates(docs(spark, enumerate(loose_group(n))), words=5, percent=80).collect()
        assert len(found) == n
        totals[n] = sum(edges_written)
        assert max(edges_written) <= n
    assert totals[1024] <= 6 * max(totals[256], 256)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(60))
    other = " ".join(f"b{i}" for i in range(60))
    third = " ".join(f"c{i}" for i in range(60))
    near = other + " tail"
    rows = [(5, text), (5, other), (7, text), (9, near), (11, third), (3, third), (None, text), (None, None), (20, third + " end")]
    got = {}
    for r in minhash.near_duplicates(docs(spark, rows), words=5, percent=80).collect():
        got.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert got == {5: {(5, True)}, 7: {(5, False)}, 9: {(5, False)}, 11: {(3, False)}, 3: {(3, True)}, 20: {(3, False)}, None: {(None, True)}}
    left = [r.doc_id for r in minhash.drop_near_copies(docs(spark, rows)).collect()]
    assert sorted(map(str, left)) == ["3", "5", "5", "None", "None"]


def test_long_texts(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-500])), (3, "w" * 5_000_000), (4, "v" + "w" * 5_000_000)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("percent", [80, 85])
def test_chances_of_bands_and_sketches(percent):
    """Pairs right at the threshold: how many share no band, and how many the sketch filter would drop."""
    rng = np.random.default_rng(percent)
    pairs, no_band, filtered = 1500, 0, 0
    least = int(minhash.LENGTH * (percent / 100 - minhash.SKETCH_SLACK))
    for _ in range(pairs):
        union = rng.integers(0, 1 << 63, 400, dtype=np.uint64) << np.uint64(1)
        both, each = union[: 4 * percent], (400 - 4 * percent) // 2
        signed = [minhash.signature(np.concatenate([both, union[4 * percent + k * each : 4 * percent + (k + 1) * each]])) for k in (0, 1)]
        keys = [minhash._band_keys(s) for s in signed]
        no_band += not any(x == y for x, y in zip(*keys, strict=True))
        filtered += (signed[0] == signed[1]).sum() < least
    assert no_band == 0 and filtered == 0
