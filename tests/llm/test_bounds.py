"""Bounds that once cut results: buckets of a reopened index, long secrets, repeated labels, many axes."""

import time

import numpy as np
import pandas as pd
import pytest

from wavelake.llm import embed_tiles, exact_dedup, fm_quality, pii_anchors


def test_an_index_keeps_its_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id bigint, text string")
    path, before = str(tmp_path / "index"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k, partitions in enumerate(("8", "4", "16", "211", "8")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            index = exact_dedup.DigestIndex(spark, path)
            more = docs.union(spark.createDataFrame([(1000 + k, f"new {k}")], docs.schema))
            left = exact_dedup.deduplicate(more, index)
            assert index.buckets == 8
            assert left.count() == (201 if k == 0 else 1)
            index.commit()
            index.forget()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="8 buckets, not 5"):
        exact_dedup.DigestIndex(spark, path, buckets=5)


@pytest.mark.parametrize("size", [800, 10_000])
def test_secrets_reach_the_end_of_their_value(size):
    value = "aB3" * (size // 3)
    for text in (f"token = {value}", f"Bearer {value}", f'password: "{value}" rest'):
        (found,) = pii_anchors.find(text)
        assert found == ("secret", text.index(value), text.index(value) + len(value))


@pytest.mark.parametrize("word", ["mailto:", "https://", "tel:", "token=", "password:", "b.", "sip:a@", "secret=a1://"])
def test_ten_mebibytes_of_one_anchor(word):
    began = time.process_time()
    pii_anchors.find("a@" + word * ((10 << 20) // len(word)))
    assert time.process_time() - began < 60


def test_repeated_ids_stay_within_the_sample(spark, monkeypatch):
    """Many rows share a doc_id: no more than the sample is learned from, and the order of rows changes nothing."""
    rows = [(k % 20, f"{'good clear words' if k % 20 < 10 else 'bad $$$ junk'} {k}") for k in range(2000)]
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(20)] * 2, "doc_id bigint, quality int")
    seen = []
    fit = fm_quality.fit
    monkeypatch.setattr(fm_quality, "fit", lambda rows: seen.append(len(rows)) or fit(rows))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, two = (fm_quality.learn(d, labels, sample=30) for d in (docs, docs.orderBy("text", ascending=False).repartition(7)))
    assert seen == [30, 30]
    assert np.array_equal(one.w, two.w) and np.array_equal(one.v, two.v)


def test_pairs_at_the_threshold_with_a_thousand_axes(spark):
    """Vectors right above 0.9, whose products lose most in single precision."""
    random = np.random.default_rng(1)
    base = random.normal(size=(12, 1536))
    rows = []
    for k, v in enumerate(base):
        v /= np.linalg.norm(v)
        side = random.normal(size=1536)
        side -= side @ v * v
        side /= np.linalg.norm(side)
        for j, c in enumerate((0.9 + 1e-7, 0.9 - 1e-7)):
            rows += [(4 * k + 2 * j, v.tolist()), (4 * k + 2 * j + 1, (c * v + np.sqrt(1 - c * c) * side).tolist())]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["vec_id", "embedding"]), "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_tiles.near_duplicates(df).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    said = (x @ x.T >= 0.9).sum(1) - 1
    assert got == {i: int(n) for (i, _), n in zip(rows, said, strict=True)}
