"""Segments, gaps and point lookups over DataFrames of record starts.

`records` has path, record_index and onset_ticks (see the source's mode "records"). Windows run within a path;
points meet intervals of any length by dyadic cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ticks import WIDE, ceil_div_col, div, floor_div_col, from_seconds_col
from .intervals import points_in

#: Records that are put in order together; a longer recording is cut at these boundaries and joined up again.
BLOCK = 1 << 20
#: Width of the buckets by which records meet runs of records.
RECORDS = 4096


def steps(records: DataFrame, duration_ticks: Column | int) -> DataFrame:
    """Each record with the start of the one before it, and whether a new segment begins at it.

    Blocks of BLOCK records are ordered in different tasks; the first of a block meets the last of the block
    before by an equi-join on the block's number, so no task orders more than one block.
    """
    d = F.lit(duration_ticks) if isinstance(duration_ticks, int) else duration_ticks
    blocked = records.withColumn("block", div(F.col("record_index"), F.lit(BLOCK)))
    inside = Window.partitionBy("path", "block").orderBy("record_index")
    ends = blocked.where(F.col("record_index") % BLOCK == BLOCK - 1).select("path", (F.col("block") + 1).alias("block"), F.col("onset_ticks").alias("carried"))
    before = F.coalesce(F.lag("onset_ticks").over(inside), F.when(F.col("record_index") % BLOCK == 0, F.col("carried")))
    joined = blocked.join(ends, ["path", "block"], "left").withColumn("before", before)
    return joined.withColumn("breaks", F.col("before").isNull() | (F.col("onset_ticks") != F.col("before") + d)).drop("carried")


def check_monotonic(records: DataFrame) -> DataFrame:
    """The records, raising when one starts before the record it follows."""
    found = steps(records, 0)
    bad = F.col("onset_ticks") < F.col("before")
    said = F.concat(F.lit("TIMELINE_NOT_MONOTONIC: record "), F.col("record_index"), F.lit(" of "), F.col("path"))
    return found.where(F.when(bad, F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).drop("block", "before", "breaks")


def segments(records: DataFrame, duration_ticks: int | Column, origin_ticks: int | Column = 0) -> DataFrame:
    """path, segment_index, record_start, record_count, start_ticks, duration_ticks, end_ticks on the recording's axis.

    Columns for duration and origin are columns of the records, so each file may have its own.
    Only the records at which a segment begins are numbered, and the last record of each path closes the last.
    """
    origin, each = (F.lit(x).cast("bigint") if isinstance(x, int) else x for x in (origin_ticks, duration_ticks))
    found = steps(records, duration_ticks)
    starts = found.where("breaks").select("path", "record_index", (F.col("onset_ticks") - origin).alias("_start"), each.alias("_each"))
    totals = records.groupBy("path").agg((F.max("record_index") + 1).alias("stop"))
    along = Window.partitionBy("path").orderBy("record_index")
    numbered = starts.join(totals, "path").select("path", (F.row_number().over(along) - 1).cast("int").alias("segment_index"), F.col("record_index").alias("record_start"), (F.coalesce(F.lead("record_index").over(along), F.col("stop")) - F.col("record_index")).alias("record_count"), F.col("_start").alias("start_ticks"), "_each")
    length = F.col("record_count") * F.col("_each")
    return numbered.withColumn("duration_ticks", length).withColumn("end_ticks", F.col("start_ticks") + length).drop("_each")


def gaps(found: DataFrame) -> DataFrame:
    """One row between each two segments; a negative duration is an overlap."""
    along = Window.partitionBy("path").orderBy("segment_index")
    after, at = F.lead("segment_index").over(along), F.lead("start_ticks").over(along)
    rows = found.select("path", F.col("segment_index").alias("before_segment_index"), after.alias("after_segment_index"), F.col("end_ticks").alias("start_ticks"), at.alias("end_ticks"))
    return rows.where("after_segment_index IS NOT NULL").withColumn("duration_ticks", F.col("end_ticks") - F.col("start_ticks"))


def summary(records: DataFrame, duration_ticks: int) -> DataFrame:
    """path, record_count, start_offset_ticks, span_ticks, covered_ticks, drift_ticks."""
    found = records.groupBy("path").agg(F.count("*").alias("record_count"), F.min_by("onset_ticks", "record_index").alias("start_offset_ticks"), F.max_by("onset_ticks", "record_index").alias("last"))
    span = F.col("last") + duration_ticks - F.col("start_offset_ticks")
    covered = F.col("record_count") * duration_ticks
    return found.select("path", "record_count", "start_offset_ticks", span.alias("span_ticks"), covered.alias("covered_ticks"), (span - covered).alias("drift_ticks"))


def contiguity(found: DataFrame, complete: bool = True) -> DataFrame:
    """path, contiguity: contiguous, discontinuous, or unknown without a complete index."""
    many = F.when(F.count("*") > 1, "discontinuous").otherwise("contiguous") if complete else F.lit("unknown")
    return found.groupBy("path").agg(many.alias("contiguity"))


def intervals_at(points: DataFrame, intervals: DataFrame, ticks: str = "ticks") -> DataFrame:
    """Each point with the half-open intervals [start_ticks, end_ticks) of its path that hold it, met by dyadic cells."""
    return points_in(points, intervals, ticks)


def first_interval_at(points: DataFrame, intervals: DataFrame, key: str, index: str, ticks: str = "ticks") -> DataFrame:
    """At most one interval for each point: where intervals overlap, the earliest by `index`."""
    found = intervals_at(points, intervals, ticks)
    columns = [c for c in found.columns if c not in points.columns]
    best = found.groupBy(key).agg(F.min_by(F.struct(*columns), index).alias("_hit"))
    return points.join(best, key, "left").select(*points.columns, "_hit.*")


def locate(points: DataFrame, records: DataFrame, duration_ticks: int, origin_ticks: int = 0, seconds: str = "seconds") -> DataFrame:
    """Each point with the record that holds it: record_index, record_start_ticks, offset_in_record_ticks, or nulls.

    A point is held by the last record that starts at or before it, if that record reaches it. Points and record
    starts are merged by one ordered pass over each path and block of time; a block without a record start
    before the point looks at the last start of the blocks before.
    """
    target = from_seconds_col(F.col(seconds)) + origin_ticks
    width = max(1, duration_ticks) * (1 << 16)
    left = points.withColumn("_t", target).withColumn("_block", floor_div_col(F.col("_t"), width))
    marks = records.select(F.col("path"), F.col("onset_ticks").alias("_t"), F.col("record_index").alias("_r"), floor_div_col(F.col("onset_ticks"), width).alias("_block"))
    closing = marks.groupBy("path", "_block").agg(F.max(F.struct("_t", "_r")).alias("_last"))
    blocks = closing.select("path", "_block", "_last").unionByName(left.select("path", "_block").distinct().withColumn("_last", F.lit(None).cast(closing.schema["_last"].dataType)))
    chain = Window.partitionBy("path").orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carried", F.last("_last", ignorenulls=True).over(chain)).groupBy("path", "_block").agg(F.max("_carried").alias("_carried"))
    mixed = left.withColumn("_r", F.lit(None).cast("bigint")).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("path", "_block").orderBy(F.col("_t"), F.col("_r").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    seen = mixed.withColumn("_hit", F.last(F.when(F.col("_r").isNotNull(), F.struct("_t", "_r")), ignorenulls=True).over(order)).where("_r IS NULL")
    hit = F.coalesce("_hit", "_carried")
    joined = seen.join(carried, ["path", "_block"], "left").withColumn("_hit", hit)
    start = F.col("_hit._t")
    held = (F.col("_t") < start + duration_ticks) if duration_ticks else (F.col("_t") == start)
    return joined.select(*points.columns, F.when(held, F.col("_hit._r")).alias("record_index"), F.when(held, start - origin_ticks).alias("record_start_ticks"), F.when(held, F.col("_t") - start).alias("offset_in_record_ticks"))


def grid_index(ticks: Column, samples_per_record: int, duration_ticks: int) -> Column:
    """Number of the sample that covers a time on the gapless grid; negative before the start."""
    return floor_div_col(ticks.cast(WIDE) * samples_per_record, duration_ticks)


def grid_start_ticks(sample_index: Column, samples_per_record: int, duration_ticks: int) -> Column:
    """Tick at which a sample of the gapless grid begins, rounded up."""
    return ceil_div_col(sample_index.cast(WIDE) * duration_ticks, samples_per_record)


def sample_at(located: DataFrame, samples_per_record: int, duration_ticks: int) -> DataFrame:
    """sample_index and sample_within_record of points that `locate` has placed; null in gaps."""
    within = F.least(grid_index(F.col("offset_in_record_ticks"), samples_per_record, duration_ticks), F.lit(samples_per_record - 1)) if duration_ticks else F.lit(0)
    return located.withColumn("sample_within_record", F.when(F.col("record_index").isNotNull(), within)).withColumn("sample_index", F.col("record_index") * samples_per_record + F.col("sample_within_record"))


def with_run(rows: DataFrame, runs: DataFrame, record: Column, first: str = "run_first", count: str = "run_count") -> DataFrame:
    """Each row with the run of records [first, first + count) that holds its record; rows outside all runs go.

    Both meet by buckets of RECORDS records, and by path if both have one, so neither many runs nor a long one
    make a join of all with all.
    """
    last = F.col(first) + F.col(count) - 1
    placed = runs.where(F.col(count) > 0).withColumn("_bucket", F.explode(F.sequence(floor_div_col(F.col(first), RECORDS), floor_div_col(last, RECORDS))))
    keys = ["_bucket", *(["path"] if "path" in runs.columns else [])]
    met = rows.withColumn("_record", record).withColumn("_bucket", floor_div_col(F.col("_record"), RECORDS)).join(placed, keys)
    return met.where((F.col("_record") >= F.col(first)) & (F.col("_record") < F.col(first) + F.col(count))).drop("_bucket", "_record")


def onset_ticks(points: DataFrame, records: DataFrame) -> DataFrame:
    """Each (path, record_index) with the start of that record; null where there is no such record."""
    return points.join(records.select("path", "record_index", "onset_ticks"), ["path", "record_index"], "left")


def gap_before(points: DataFrame, found: DataFrame) -> DataFrame:
    """Each (path, record_index) with the gap that ends where that record starts; null where none does."""
    ends = gaps(found).join(found.select("path", F.col("segment_index").alias("after_segment_index"), F.col("record_start").alias("record_index")), ["path", "after_segment_index"])
    return points.join(ends, ["path", "record_index"], "left")


def sample_start_ticks(samples: DataFrame, found: DataFrame, samples_per_record: int, duration_ticks: int) -> DataFrame:
    """start_ticks of (path, sample_index) on the recording's axis, from the true start of its segment."""
    runs = found.select("path", F.col("record_start").alias("run_first"), F.col("record_count").alias("run_count"), F.col("start_ticks").alias("_begin"))
    joined = with_run(samples, runs, div(F.col("sample_index"), F.lit(samples_per_record)))
    relative = F.col("sample_index") - F.col("run_first") * samples_per_record
    return joined.withColumn("start_ticks", F.col("_begin") + grid_start_ticks(relative, samples_per_record, duration_ticks)).select(*samples.columns, "start_ticks")
