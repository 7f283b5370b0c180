"""A training-corpus pipeline over `documents`, as stages that each read what the one before has written.

Quality filter, exact deduplication, near deduplication, mixing of the sources, and encoding. All but the last
return the columns of documents. A document that the mix takes more than once stands in its result as often.

Defined results. A null text counts as empty: it is scored as an empty text is, is an exact copy of empty texts,
near to nothing, and not taken by the mix, as it has no words. Of exact copies the largest doc_id stays, of near ones
the smallest. Rows that share a doc_id are texts of their own for the exact stage and the mix, and one document for the
near stage, which keeps or drops them together. Rows with a null doc_id are never learned from, are exact copies like
others (and stay only without another), near to nothing, and mixed like others. Null sources are one source. Texts are
read whole, whatever their length. Further columns, also with names that the stages use themselves, come through
unchanged up to the mix. An empty table gives empty stages; without labels every document passes the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavelake.llm import bpe_chunks, exact_dedup, fm_quality, minhash, mixing
from wavelake.llm.common import read_table, written
from wavelake.llm.queries import tokenizer_path
from wavelake.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels beside the corpus."""
    ship(spark)
    return fm_quality.keep_good(docs, fm_quality.learn(docs, read_table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    ship(spark)
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8 or more."""
    ship(spark)
    return minhash.drop_near_copies(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source in proportion to the sources' weights."""
    ship(spark)
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, a row for each time a document is taken."""
    ship(spark)
    return bpe_chunks.round_trip(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("encoding", encoded)]
#: The classifier, the near copies and the encoding have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
