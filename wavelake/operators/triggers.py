"""Trigger events of BDF status channels: the first sample of a window in each run, then every change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.status import status_col
from .samples import in_window

#: Samples that are put in order together.
BLOCK = 1 << 22


def triggers(samples: DataFrame, start_seconds: float | None = None, duration_seconds: float | None = None) -> DataFrame:
    """path, run_id, sample_index, ticks, trigger, raw, new_epoch, cms_in_range, battery_low, first_of_run.

    samples: path, run_id, sample_index, start_ticks and digital of the status channel. A change is against the
    sample before in the same run, in or out of the window; runs begin afresh. Samples are ordered in blocks of
    BLOCK; the first of a block meets the last of the one before by an equi-join.
    """
    words = samples.select("path", "run_id", "sample_index", F.col("start_ticks").alias("ticks"), status_col(F.col("digital")).alias("s"), F.call_function("div", F.col("sample_index"), F.lit(BLOCK)).alias("_block"))
    inside = Window.partitionBy("path", "run_id", "_block").orderBy("sample_index")
    ends = words.where(F.col("sample_index") % BLOCK == BLOCK - 1).select("path", "run_id", (F.col("_block") + 1).alias("_block"), F.col("s.trigger").alias("_carried"))
    before = F.coalesce(F.lag("s.trigger").over(inside), F.when(F.col("sample_index") % BLOCK == 0, F.col("_carried")))
    seen = words.join(ends, ["path", "run_id", "_block"], "left").withColumn("before", before)
    if start_seconds is not None:
        seen = seen.where(in_window(F.col("ticks"), start_seconds, duration_seconds))
    firsts = seen.groupBy("path", "run_id").agg(F.min("sample_index").alias("_first"))
    joined = seen.where(F.col("before").isNull() | (F.col("s.trigger") != F.col("before"))).select("path", "run_id", "sample_index", "ticks", "s")
    opening = seen.join(firsts.withColumnRenamed("_first", "sample_index"), ["path", "run_id", "sample_index"], "left_semi").select("path", "run_id", "sample_index", "ticks", "s")
    events = joined.union(opening).dropDuplicates(["path", "run_id", "sample_index"])
    return events.join(firsts, ["path", "run_id"]).select("path", "run_id", "sample_index", "ticks", "s.trigger", "s.raw", "s.new_epoch", "s.cms_in_range", "s.battery_low", (F.col("sample_index") == F.col("_first")).alias("first_of_run"))
