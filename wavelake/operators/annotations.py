"""Queries over annotations; times are ticks on the recording's axis unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ticks import from_seconds, saturate, saturate_col
from .intervals import end_of, overlap_counts, overlaps

ORDER = ("onset_ticks", "signal_index", "byte_offset_in_record", "record_index")


def rebase(annotations: DataFrame, origin_ticks: Column | int) -> DataFrame:
    """Adds onset_ticks_from_first_record: the header's axis less the start of record 0, held within 64 bits."""
    origin = F.lit(origin_ticks) if isinstance(origin_ticks, int) else origin_ticks
    return annotations.withColumn("onset_ticks_from_first_record", saturate_col(F.col("onset_ticks").cast("decimal(38,0)") - origin))


def _overlaps(begin: Column, end: Column, onset: Column, duration: Column) -> Column:
    stop = end_of(onset, duration)
    return (onset < end) & ((stop > begin) | ((stop == onset) & (onset >= begin)))


def in_window(annotations: DataFrame, start_seconds: float, duration_seconds: float) -> DataFrame:
    """Annotations that overlap a half-open window; instants at its start are in, at its end out."""
    begin, length = from_seconds(start_seconds), from_seconds(duration_seconds)
    if length <= 0:
        return annotations.where(F.lit(False))
    return annotations.where(_overlaps(F.lit(saturate(begin)), F.lit(saturate(begin + length)), F.col("onset_ticks_from_first_record"), F.col("duration_ticks")))


def in_windows(annotations: DataFrame, windows: DataFrame) -> DataFrame:
    """Every pair of a window (path, start_ticks, end_ticks) and an annotation of its path that overlaps it.

    They meet by dyadic cells, each in a few rows whatever its length; windows without length hold nothing.
    """
    found = annotations.withColumn("_stop", end_of(F.col("onset_ticks_from_first_record"), F.col("duration_ticks")))
    return overlaps(found, windows.where("end_ticks > start_ticks"), ("onset_ticks_from_first_record", "_stop"), ("start_ticks", "end_ticks")).drop("_stop")


def count_in_windows(annotations: DataFrame, windows: DataFrame) -> DataFrame:
    """windows and n, the number of annotations that `in_windows` gives for each; no pair is listed, so its cost grows with the rows of both."""
    found = annotations.withColumn("_stop", end_of(F.col("onset_ticks_from_first_record"), F.col("duration_ticks")))
    return overlap_counts(found, windows, ("onset_ticks_from_first_record", "_stop"), ("start_ticks", "end_ticks"))


def by_text(annotations: DataFrame, match: str | Column | Callable[[str], bool], regex: bool = False) -> DataFrame:
    """Annotations whose text equals a string, matches a regular expression, or satisfies a Column or a Python predicate."""
    if isinstance(match, str):
        return annotations.where(F.col("text").rlike(match) if regex else F.col("text") == match)
    if isinstance(match, Column):
        return annotations.where(match)
    import pandas as pd

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(match(t)))

    return annotations.where(holds("text"))


def counts_by_text(annotations: DataFrame) -> DataFrame:
    """text and count, most frequent first; of equal counts, the text that comes first in the recordings."""
    first = F.min(F.struct("path", *ORDER)).alias("_first")
    return annotations.groupBy("text").agg(F.count("*").alias("count"), first).orderBy(F.desc("count"), "_first").drop("_first")


def at(annotations: DataFrame, seconds: float) -> DataFrame:
    """Annotations in force at an instant; those without duration only exactly then."""
    t = saturate(from_seconds(seconds))
    onset, length = F.col("onset_ticks_from_first_record"), F.coalesce("duration_ticks", F.lit(0))
    return annotations.where(F.when(length == 0, onset == t).otherwise((onset <= t) & (end_of(onset, length) > t)))
