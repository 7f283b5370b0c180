"""Digest batches whose output was never written; mixes that reach their budget and favour no length."""

import itertools

import numpy as np
import pytest

from wavelake.llm import exact_dedup, mixing

DOCS = "doc_id bigint, text string, source string"


def survivors(df):
    return sorted(r.doc_id for r in df.collect())


def test_an_open_batch_loses_nothing(spark):
    rows = spark.createDataFrame([(1, "one", "a"), (2, "two", "a"), (3, "ONE", "a")], DOCS)
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.deduplicate(rows, index)  # the job dies before its output is written
    again = exact_dedup.DigestIndex(spark, index.path, index.buckets)
    assert survivors(exact_dedup.deduplicate(rows, again)) == [2, 3]
    again.commit()
    after = exact_dedup.DigestIndex(spark, index.path, index.buckets)
    assert after.committed() == [1]
    assert survivors(exact_dedup.deduplicate(rows, after)) == []
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.label(rows, after).collect()} == {(1, 3, False), (2, 2, False), (3, 3, False)}


def test_no_table_stays_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(1, "one", "a"), (2, "One", "a")], DOCS)
    found, labels = exact_dedup.deduplicate(docs), exact_dedup.label(docs)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert survivors(found) == [2] and labels.count() == 2


@pytest.mark.parametrize("seed", range(40))
def test_nearest_total_of_all_subsets(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 60, rng.integers(1, 6))) * rng.choice([1, 1, 4])
    counts = rng.integers(1, 5, len(lengths))
    sums = {sum(k * n for k, n in zip(take, lengths.tolist(), strict=True)) for take in itertools.product(*[range(c + 1) for c in counts.tolist()])}
    budget = int(rng.integers(0, (lengths * counts).sum() + 1))
    take = mixing.fit(lengths, counts, budget, seed)
    assert (take >= 0).all() and (take <= counts).all()
    assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_no_length_is_favoured():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(5, 20_000, 3000))
    counts = np.ones(len(lengths), np.int64)
    budget = int(lengths.sum()) // 2
    shares = np.zeros(4)
    for seed in range(5):
        take = mixing.fit(lengths, counts, budget, seed)
        assert int((take * lengths).sum()) == budget
        shares += [part.mean() / 5 for part in np.array_split(take, 4)]
    assert (abs(shares - 0.5) < 0.05).all()
    assert not np.array_equal(mixing.fit(lengths, counts, budget, 1), mixing.fit(lengths, counts, budget, 2))


def test_the_same_documents_however_the_input_is_cut(spark, tmp_path):
    rows = [(i // 2, "w " * (1 + i % 5) + f"x{i % 3}", "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    one = sorted(map(tuple, mixing.mix(docs.repartition(1)).collect()))
    many = sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert one == many
