"""Min/max envelopes: buckets over contiguous runs of samples, as mergeable aggregates.

`samples` has path, run_id, signal_index, position (0 at the start of the run) and digital. `fold_blocks` does the
same from sample blocks: positions of a block ascend, so a bucket holds a slice of it, and a block is reduced to
one row for each bucket it touches before anything is shuffled; no sample becomes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BudgetError
from ..functions.ticks import WIDE, ceil_div, ceil_div_col, div, floor_div_col

KEY = ("path", "run_id", "signal_index")


def even_count(buckets: int, densest: int) -> int:
    """Buckets of a run: as many as asked for, but not more than its densest signal has samples."""
    if isinstance(buckets, bool) or not isinstance(buckets, int) or buckets < 1:
        raise ValueError(f"buckets must be a positive integer, not {buckets!r}")
    return max(1, min(buckets, densest))


def even_bucket(position: Column, total: Column | int, buckets: int) -> Column:
    whole = F.lit(total) if isinstance(total, int) else total
    return F.least(div(position.cast("bigint") * buckets, whole), F.lit(buckets - 1)).cast("int")


def resolution(run_ticks: int, bucket_ticks: int, densest: int) -> tuple[int, bool]:
    """Number of buckets of a fixed width, and whether the width can be kept (else the even rule holds)."""
    if bucket_ticks <= 0 or run_ticks <= 0:
        return even_count(max(1, run_ticks), densest), False
    return max(1, ceil_div(run_ticks, bucket_ticks)), True


def resolution_bucket(position: Column, samples_per_record: int, duration_ticks: int, bucket_ticks: int, buckets: int) -> Column:
    wide = floor_div_col(position.cast(WIDE) * duration_ticks, F.lit(str(bucket_ticks * samples_per_record)).cast("decimal(38,0)"))
    return F.least(wide, F.lit(buckets - 1)).cast("int")


def fold(samples: DataFrame, bucket: Column) -> DataFrame:
    return samples.groupBy(*KEY, bucket.alias("bucket")).agg(F.min("digital").alias("min"), F.max("digital").alias("max"), F.count("*").alias("count"))


def fold_blocks(blocks: DataFrame, num: Column, den: Column, buckets: Column) -> DataFrame:
    """The envelope of blocks with run_id and first_position, where position p is in bucket p * num // den, at most buckets - 1.

    num and den are exact and positive; products are taken in decimals, so no recording is too long.
    """
    wide = blocks.where(F.size("digital") > 0).withColumn("_num", num.cast(WIDE)).withColumn("_den", den.cast(WIDE)).withColumn("_buckets", buckets.cast("bigint"))
    bucket_of = lambda p: F.least(floor_div_col(p.cast(WIDE) * F.col("_num"), F.col("_den")), F.col("_buckets") - 1)
    size = F.size("digital").cast("bigint")
    rows = wide.withColumn("bucket", F.explode(F.sequence(bucket_of(F.col("first_position")), bucket_of(F.col("first_position") + size - 1))))
    first_in = lambda b: ceil_div_col(b.cast(WIDE) * F.col("_den"), F.col("_num")) - F.col("first_position")
    low = F.greatest(first_in(F.col("bucket")), F.lit(0))
    high = F.when(F.col("bucket") == F.col("_buckets") - 1, size).otherwise(F.least(first_in(F.col("bucket") + 1), size))
    parts = rows.select(*KEY, F.col("bucket").cast("int").alias("bucket"), F.slice("digital", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias("part")).where(F.size("part") > 0)
    return parts.groupBy(*KEY, "bucket").agg(F.min(F.array_min("part")).alias("min"), F.max(F.array_max("part")).alias("max"), F.sum(F.size("part")).cast("bigint").alias("count"))


def of_blocks(blocks: DataFrame, buckets: int) -> DataFrame:
    """Even buckets over the samples in hand of each path, run and signal, however many records they are from."""
    sizes = blocks.groupBy(*KEY).agg(F.min("first_sample_index").alias("_first"), F.sum(F.size("digital")).alias("total"))
    placed = blocks.join(sizes, list(KEY)).withColumn("first_position", F.col("first_sample_index") - F.col("_first"))
    return fold_blocks(placed, F.lit(buckets), F.col("total"), F.lit(buckets))


def with_empty(envelope: DataFrame, buckets: int) -> DataFrame:
    """Every bucket of every run and signal; those without samples are 0, 0 with count 0."""
    keys = envelope.select(*KEY).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    joined = keys.join(envelope, [*KEY, "bucket"], "left")
    return joined.select(*KEY, "bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("min", "max")], F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def physical(envelope: DataFrame, bit_value: float, offset: float) -> DataFrame:
    """Adds phys_min and phys_max: swapped for a negative gain, NaN for empty buckets."""
    value = lambda c: F.when(F.col("count") == 0, F.lit(float("nan"))).otherwise(F.lit(bit_value) * (F.lit(offset) + F.col(c)))
    low, high = ("max", "min") if bit_value < 0 else ("min", "max")
    return envelope.withColumn("phys_min", value(low)).withColumn("phys_max", value(high))


def check_budget(buckets: int, signals: int, max_bytes: int, with_physical: bool = False) -> None:
    need = buckets * (20 if with_physical else 12) * signals
    if need > max_bytes:
        raise BudgetError(f"{buckets} buckets of {signals} signals are {need} bytes, above the budget of {max_bytes}", need, max_bytes)
