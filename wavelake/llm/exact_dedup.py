"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, with one row for each distinct normalised text. A batch is
first reduced to one row for each digest (map-side combining, so a hot group of copies shrinks before it is
shuffled); a sort-merge anti-join with the index finds the new digests, and those are appended. Only built-in
functions run.

Recovery. Appended digests belong to an open batch until `commit`, which is called once the batch's output is
written. Digests of a batch that was never committed count as unknown to all later batches, so a job that dies
between the two writes loses nothing: its rerun finds the same documents new.

Defined results. Text: null counts as empty; texts are equal when identical after lower-casing A-Z. Ties and
repeated rows: of equal texts the largest doc_id stays, a null doc_id only if there is no other; rows that
repeat the doc_id that stays count in group_size, and `deduplicate` returns one of them, the one whose
remaining columns are largest. Very long texts are hashed whole. An empty table gives an empty result. Other
columns, whatever their names, are returned untouched by `deduplicate` and ignored by `label`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, lower_ascii, scratch_path, written


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """Digests seen so far, with the document that stays for each and the batch that brought it."""

    SCHEMA = "digest binary, keep_id bigint, group_size bigint, batch int"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """path: where the index lives, in a folder that all executors share; an existing index there is opened.

        The number of buckets belongs to the index: it is written beside it when it is made, and read when it is
        opened, whatever the session's settings are. Another number than that raises ValueError.
        """
        self.spark = spark
        self.path = path or scratch_path(spark, "digests")
        known = self._known_buckets()
        if known and buckets and buckets != known:
            raise ValueError(f"the index at {self.path} has {known} buckets, not {buckets}")
        self.buckets = known or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not known:
            store, file = self._at(f"{self.path}_buckets/{self.buckets}")
            store.create(file, True).close()
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch INT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        last = self.entries().agg(F.max("batch")).first()[0]
        self.batch = -1 if last is None else last

    def _at(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _known_buckets(self) -> int | None:
        """The number of buckets of an existing index; it is the name of an empty file beside it."""
        store, folder = self._at(f"{self.path}_buckets")
        names = sorted(int(f.getPath().getName()) for f in store.listStatus(folder)) if store.exists(folder) else []
        if len(names) > 1 or (not names and store.exists(self._at(self.path)[1])):
            raise ValueError(f"the index at {self.path} doesn't say how many buckets it has: {names}")
        return names[0] if names else None

    def committed(self) -> list[int]:
        """Numbers of the committed batches; each is an empty file beside the index."""
        store, folder = self._at(f"{self.path}_committed")
        return sorted(int(f.getPath().getName()) for f in store.listStatus(folder)) if store.exists(folder) else []

    def commit(self, batch: int | None = None) -> None:
        """Makes the digests of a batch, the latest by default, known to later ones. To be called when its output is written."""
        store, file = self._at(f"{self.path}_committed/{self.batch if batch is None else batch}")
        store.create(file, True).close()

    def indexed(self, batches: list[int]) -> DataFrame:
        """The index by its buckets: joins on digest move no row of it."""
        return self.spark.table(self.table).where(F.col("batch").isin(batches))

    def entries(self) -> DataFrame:
        """The index as plain files: adaptive execution may split a hot digest on the other side of a join."""
        store, folder = self._at(self.path)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if store.exists(folder) else self.spark.createDataFrame([], self.SCHEMA)

    def append(self, digests: DataFrame) -> int:
        """Adds the digests (digest, doc_id) that committed batches lack as an open batch, and returns its number."""
        self.batch += 1
        # Written, because the optimiser would move the anti-join before the aggregation, to rows that a hot digest gathers.
        groups = written(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "digest-groups")
        new = groups.join(self.indexed(self.committed()).select("digest").hint("merge"), "digest", "left_anti")
        new.withColumn("batch", F.lit(self.batch)).repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        drop_written(groups)
        return self.batch

    def forget(self) -> None:
        """Drops the catalogue's entry; the files stay, for DataFrames made of them and for a later session."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def label(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With an index of earlier batches, keep_id may name a document of an earlier batch, and group_size counts
    the rows of the batch that brought the digest. Call index.commit() when the result is written; without an
    index the batch is the only one.
    """
    own = index or DigestIndex(docs.sparkSession)
    rows = written(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), digest_of(F.col(text)).alias("digest")), "digested")
    earlier = own.committed()
    batch = own.append(rows)
    known = own.entries().where(F.col("batch").isin([*earlier, batch])).withColumnRenamed("batch", "known_batch")
    out = rows.join(known, "digest").select("doc_id", "keep_id", "group_size", ((F.col("known_batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    if index is None:
        own.forget()
    return out


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents whose text is new, one for each text, with the columns of docs.

    One row for each digest leaves each map task; the whole row travels as one struct. Call index.commit() when
    the result is written; without an index the batch is the only one.
    """
    own = index or DigestIndex(docs.sparkSession)
    columns = docs.columns
    named = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(columns)))}
    digested = named.withColumn("digest", digest_of(F.col(at[text])))
    digests = written(digested.select("digest", F.col(at[doc_id]).cast("bigint").alias("doc_id")), "digested")
    batch = own.append(digests)
    drop_written(digests)
    sortable = [f"c{i}" for i, field in enumerate(docs.schema.fields) if not field.dataType.simpleString().count("map<") and f"c{i}" not in (at[doc_id], at[text])]
    order = F.struct(F.col(at[doc_id]), *[F.col(c) for c in sortable])
    whole = digested.groupBy("digest").agg(F.max_by(F.struct(*named.columns), order).alias("row"))
    fresh = own.indexed([batch]).select("digest")
    # An inner join stays after the aggregation; a batch has each digest once.
    out = whole.join(fresh.hint("merge"), "digest").select("row.*").toDF(*columns)
    if index is None:
        own.forget()
    return out
