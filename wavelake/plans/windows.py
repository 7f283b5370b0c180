"""Many windows at once, as a table: which records each needs, each record read once, whatever number of windows want it.

A window is a row (path, window_id, start_ticks, end_ticks), half-open, on its recording's axis. Windows meet the
segments of their file by dyadic cells; the records that a window touches in a segment follow by arithmetic. What
windows of a file want is merged to ranges without overlaps, which tasks read, and each window finds its records by
an equi-join. Nothing of it comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.ticks import WIDE, ceil_div_col, div, floor_div_col
from ..operators.intervals import overlaps
from ..operators.timeline import check_monotonic, segments
from ..recording import register
from ..sources.datasource import SCHEMAS, Known, open_with, scan, to_batch
from ..sources.decode import timeline
from ..sources.header import read_header

#: Ranges are cut at multiples of this many records, so that a long file is merged and read by many tasks.
CUT = 1 << 14


def index(records: DataFrame, headers: DataFrame) -> DataFrame:
    """Segments of every file, each by its own record duration: the columns of `segments` and record_duration_ticks.

    records and headers: the modes of the source of those names. Starts that go back raise.
    """
    axes = headers.where("ok").select("path", F.col("record_duration_ticks").alias("_d"), F.col("start_offset_ticks").alias("_o"))
    found = check_monotonic(records.join(axes, "path"))
    return segments(found, F.col("_d"), F.col("_o")).join(axes.select("path", F.col("_d").alias("record_duration_ticks")), "path")


def plan(windows: DataFrame, found: DataFrame) -> DataFrame:
    """path, window_id, run_id, first, count: the contiguous runs of records that each window touches, numbered in order.

    found: the complete index, as `index` gives it. Windows without length, or in a gap, have no rows. In files whose
    records have no duration a window has the segments that start in it, whole.
    """
    asked = windows.where("end_ticks > start_ticks").select("path", "window_id", F.col("start_ticks").alias("_begin"), F.col("end_ticks").alias("_end_at"))
    # The join gives no bounds of the segments, so their start is carried under another name.
    met = overlaps(asked, found.withColumn("_from", F.col("start_ticks")), ("_begin", "_end_at"), ("start_ticks", "end_ticks"))
    d, n = F.col("record_duration_ticks"), F.col("record_count")
    since, till = (F.col(c).cast(WIDE) - F.col("_from") for c in ("_begin", "_end_at"))
    first = F.when(d > 0, F.greatest(F.lit(0).cast("bigint"), floor_div_col(since, F.greatest(d, F.lit(1))))).otherwise(0)
    last = F.when(d > 0, F.least(n - 1, ceil_div_col(till, F.greatest(d, F.lit(1))) - 1)).otherwise(n - 1)
    runs = met.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    along = Window.partitionBy("path", "window_id").orderBy("segment_index")
    return runs.select("path", "window_id", (F.row_number().over(along) - 1).alias("run_id"), (F.col("record_start") + F.col("_first")).alias("first"), (F.col("_last") - F.col("_first") + 1).alias("count"))


def records_of(runs: DataFrame) -> DataFrame:
    """path, window_id, run_id, record_index: each record of each run, as many rows as windows have records; no array is longer than CUT."""
    stop = F.col("first") + F.col("count")
    pieces = runs.withColumn("_cut", F.explode(F.sequence(div(F.col("first"), F.lit(CUT)), div(stop - 1, F.lit(CUT)))))
    return pieces.select("path", "window_id", "run_id", F.explode(F.sequence(F.greatest("first", F.col("_cut") * CUT), F.least(stop, (F.col("_cut") + 1) * CUT) - 1)).alias("record_index"))


def merged(runs: DataFrame) -> DataFrame:
    """path, first, stop: what the runs (path, first, count) want, without overlaps, cut at multiples of CUT records."""
    stop = F.col("first") + F.col("count")
    pieces = runs.withColumn("_cut", F.explode(F.sequence(div(F.col("first"), F.lit(CUT)), div(stop - 1, F.lit(CUT)))))
    pieces = pieces.select("path", "_cut", F.greatest("first", F.col("_cut") * CUT).alias("first"), F.least(stop, (F.col("_cut") + 1) * CUT).alias("stop")).distinct()
    along = Window.partitionBy("path", "_cut").orderBy("first", "stop")
    before = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parted = pieces.withColumn("_new", (before.isNull() | (F.col("first") > before)).cast("int"))
    numbered = parted.withColumn("_range", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("path", "_cut", "_range").agg(F.min("first").alias("first"), F.max("stop").alias("stop")).drop("_cut", "_range")


def read_ranges(ranges: DataFrame, signals: str | None = None, options: dict | None = None) -> DataFrame:
    """Sample blocks of the ranges (path, first, stop). A task opens a file once for the ranges it holds of it, and reads nothing between them."""
    schema, given = SCHEMAS["blocks"], dict(options or {})
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = source = known = None
        try:
            for batch in batches:
                for at, first, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if at != path:
                        if source is not None:
                            source.close()
                        path, source = at, open_with(at, given)
                        header = read_header(source)
                        known = Known(header, timeline(source, header), ())
                    for columns in scan(source, path, "blocks", 0, 1, first, stop, signals, known=known):
                        if columns:
                            yield to_batch(columns, arrow)
        finally:
            if source is not None:
                source.close()

    dealt = ranges.select("path", "first", "stop").withColumn("_cut", div(F.col("first"), F.lit(CUT)))
    return dealt.repartition("path", "_cut").sortWithinPartitions("path", "first").drop("_cut").mapInArrow(run, schema)


def read_windows(spark: SparkSession, path: str, windows: DataFrame, signals: str | None = None, found: DataFrame | None = None, then: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """Sample blocks of all windows: window_id, run_id and the columns of the source's mode blocks.

    path: the archive (a file, folder or glob). found: its index, if it is kept somewhere; otherwise the archive is
    indexed first. signals: indices or labels joined by commas. then: what is done with the blocks that were read, before
    windows that share one have it each.
    """
    register(spark)
    if found is None:
        read = lambda mode: spark.read.format("biosignal").options(path=path, mode=mode, **options).load()
        found = index(read("records"), read("headers"))
    runs = plan(windows, found)
    blocks = read_ranges(merged(runs), signals, options)
    blocks = then(blocks) if then else blocks
    return blocks.join(records_of(runs), ["path", "record_index"]).select("window_id", "run_id", *blocks.columns)
