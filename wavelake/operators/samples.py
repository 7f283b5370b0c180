"""Samples as blocks and rows: scaling, clamping, counting, windows and merging, all in the JVM.

A block is a row of mode "blocks": the samples of one signal in one record. Blocks are exploded late, and only
for operators that need single samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ScalingError
from ..functions.ticks import WIDE, ceil_div_col, floor_div_col, from_seconds
from ..sources.decode import budget
from ..sources.header import Signal


def scale_col(low: Column, high: Column, digital_low: Column, digital_high: Column, dimension: Column) -> Column:
    """struct<bit_value, offset>, null where the ranges define no linear scale."""
    gain = (high - low) / (digital_high - digital_low)
    offset = high / gain - digital_high
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    usable = finite(low) & finite(high) & (digital_low < digital_high) & (low != high) & (F.trim(dimension, F.lit(" \x00")) != "Filtered")
    pair = F.struct(gain.alias("bit_value"), offset.alias("offset"))
    return F.when(usable, F.when(F.coalesce(finite(gain) & finite(offset) & (gain != 0), F.lit(False)), pair))


def physical(digital: Column, bit_value: Column | float, offset: Column | float) -> Column:
    """bit_value * (offset + digital), in this order of operations."""
    b, o = (F.lit(float(x)) if isinstance(x, int | float) else x for x in (bit_value, offset))
    return b * (o + digital.cast("double"))


def physical_of(signal: Signal, digital: Column) -> Column:
    if signal.scale is None:
        raise scaling_error(signal)
    return physical(digital, signal.scale.bit_value, signal.scale.offset)


def scaling_error(s: Signal) -> ScalingError:
    reasons = (
        ("SCALE_UNAVAILABLE", s.kind == "annotations"),
        ("DEGENERATE_DIGITAL_RANGE", s.digital_minimum == s.digital_maximum),
        ("DEGENERATE_PHYSICAL_RANGE", s.physical_minimum == s.physical_maximum),
        ("INVERTED_DIGITAL_RANGE", s.digital_minimum > s.digital_maximum),
        ("LOG_TRANSFORMED_CHANNEL", s.physical_dimension == "Filtered"),
    )
    code = next((c for c, holds in reasons if holds), "SCALE_UNAVAILABLE")
    return ScalingError(code, f"signal {s.index} ({s.label!r}) has no physical values", s.index)


def physical_range(signal: Signal) -> tuple[float, float]:
    """Lowest and highest declared physical value, in order."""
    ends = (signal.physical_minimum, signal.physical_maximum)
    if any(x != x or abs(x) == float("inf") for x in ends):
        raise ValueError(f"the physical range {ends} isn't finite")
    return min(ends), max(ends)


def clamp(digital: Column, low: Column | int, high: Column | int) -> Column:
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return F.least(F.greatest(digital, F.least(a, b)), F.greatest(a, b))


def out_of_range_count(digital: Column, low: Column | int, high: Column | int) -> Column:
    """Values of an array outside a range, whichever end comes first; nothing is changed."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return F.size(F.filter(digital, lambda x: (x < F.least(a, b)) | (x > F.greatest(a, b)))).cast("bigint")


def explode(blocks: DataFrame, samples_per_record: dict[int, int], duration_ticks: int) -> DataFrame:
    """One row per sample: path, signal_index, sample_index, record_index, sample_within_record, start_ticks, digital."""
    n = F.create_map(*[F.lit(x) for pair in samples_per_record.items() for x in pair])[F.col("signal_index")]
    rows = blocks.select("path", "signal_index", "record_index", "first_sample_index", F.col("start_ticks").alias("_start"), F.posexplode("digital").alias("_at", "digital"))
    at = F.col("_at").cast("bigint")
    ticks = F.col("_start") + ceil_div_col(at.cast(WIDE) * duration_ticks, n)
    return rows.select("path", "signal_index", (F.col("first_sample_index") + at).alias("sample_index"), "record_index", at.alias("sample_within_record"), ticks.alias("start_ticks"), "digital")


def in_window(start_ticks: Column, start_seconds: float, duration_seconds: float) -> Column:
    """Whether a published start tick lies in a half-open window. With records of no duration this is the block's start."""
    begin = from_seconds(start_seconds)
    return (start_ticks >= begin) & (start_ticks < begin + from_seconds(duration_seconds))


def trim(blocks: DataFrame, begin_ticks: int, end_ticks: int, signals: dict[int, tuple[int, int, int]], duration_ticks: int) -> DataFrame:
    """Blocks cut to the samples that start in [begin, end), with first sample, start and out-of-range count of what is left.

    signals: samples of a record and the two ends of the digital range, by signal_index. Blocks without such a sample go.
    """
    by = lambda i: F.create_map(*[F.lit(x) for k, v in signals.items() for x in (k, v[i])])[F.col("signal_index")] if signals else F.lit(0)
    n, size = by(0), F.size("digital")
    ahead = lambda t: F.lit(t) - F.col("start_ticks")
    first_at = lambda t: F.greatest(F.least(floor_div_col((ahead(t) - 1).cast(WIDE) * n, F.lit(duration_ticks)) + 1, size), F.lit(0)) if duration_ticks else F.when(ahead(t) > 0, size).otherwise(0)
    cut = blocks.withColumn("_low", first_at(begin_ticks)).withColumn("_high", first_at(end_ticks)).where("_high > _low")
    kept = F.slice("digital", (F.col("_low") + 1).cast("int"), (F.col("_high") - F.col("_low")).cast("int"))
    ticks = F.col("start_ticks") + (ceil_div_col(F.col("_low").cast(WIDE) * duration_ticks, n) if duration_ticks else F.lit(0))
    trimmed = cut.withColumn("digital", kept).withColumn("start_ticks", ticks).withColumn("first_sample_index", F.col("first_sample_index") + F.col("_low"))
    return trimmed.withColumn("out_of_range_count", out_of_range_count(F.col("digital"), by(1), by(2))).drop("_low", "_high")


def merge(blocks: DataFrame, duration_ticks: int, max_bytes: float | None = None) -> DataFrame:
    """One row per path and signal with all samples of its blocks, which must follow one another without a break.

    Raises where records aren't neighbours, where a block doesn't start when the one before ends, where the
    samples' numbers don't join up, or before a row would hold more than max_bytes (256 MiB by default).
    """
    most = budget(max_bytes)
    along = Window.partitionBy("path", "signal_index").orderBy("record_index")
    before = F.lag(F.struct("record_index", "start_ticks", (F.col("first_sample_index") + F.size("digital")).alias("next"))).over(along)
    joined = blocks.withColumn("_b", before)
    wrong = F.col("_b").isNotNull() & ((F.col("record_index") != F.col("_b.record_index") + 1) | (F.col("start_ticks") != F.col("_b.start_ticks") + duration_ticks) | (F.col("first_sample_index") != F.col("_b.next")))
    said = F.concat(F.lit("blocks cannot be merged at record "), F.col("record_index"), F.lit(" of signal "), F.col("signal_index"))
    held = 4 * F.sum(F.size("digital")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    heavy = F.concat(F.lit(f"merging needs more than the budget of {most} bytes at record "), F.col("record_index"), F.lit(" of signal "), F.col("signal_index"))
    joined = joined.withColumn("_held", held)
    raised = F.when(wrong, F.raise_error(said).cast("array<int>")).when(F.col("_held") > most, F.raise_error(heavy).cast("array<int>"))
    checked = joined.withColumn("digital", raised.otherwise(F.col("digital")))
    parts = F.array_sort(F.collect_list(F.struct("record_index", "digital")))
    merged = checked.groupBy("path", "signal_index").agg(F.min("record_index").alias("record_start"), F.count("*").alias("record_count"), F.min("first_sample_index").alias("first_sample_index"), F.min("start_ticks").alias("start_ticks"), parts.alias("_parts"), F.sum("out_of_range_count").alias("out_of_range_count"))
    return merged.withColumn("digital", F.flatten(F.transform("_parts", lambda p: p["digital"]))).drop("_parts")


def signal_stats(blocks: DataFrame) -> DataFrame:
    """Lowest and highest sample, values outside the declared range and number of samples, by path and signal."""
    per = blocks.select("path", "signal_index", F.array_min("digital").alias("lo"), F.array_max("digital").alias("hi"), "out_of_range_count", F.size("digital").alias("n"))
    return per.groupBy("path", "signal_index").agg(F.coalesce(F.min("lo"), F.lit(0)).alias("observed_digital_min"), F.coalesce(F.max("hi"), F.lit(0)).alias("observed_digital_max"), F.sum("out_of_range_count").alias("out_of_range_count"), F.sum("n").cast("bigint").alias("sample_count"))
