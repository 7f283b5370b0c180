"""Tables as recordings: adapters that give tables the canonical schemas, and archives written from a table.

Adapter X reads `events` as a recording of 100 samples a record and a second a record. Adapter Y writes such
recordings to files, one for each FILE_RECORDS records and each by a task of its own, to be read by the source.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..testing import writer as Wr

S, D = 100, 10_000_000
MINUTE = 600_000_000
FILE_RECORDS = 2_000
EPOCH = "2024-01-01 00:00:00"
_written: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks_of(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts) * 10


def kind_number() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ticks, k and digital, path and run_id; sample_index is event_id."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", ticks_of(F.col("ts")).alias("ticks"), "user_id", "event_type", "value", kind_number().alias("k"), F.round(F.col("value") * 100).cast("int").alias("digital"), F.lit("events").alias("path"), F.lit(0).alias("run_id"), F.col("event_id").alias("sample_index"))


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct minutes with events, numbered in blocks by time, as records of a minute."""
    at = events(spark, sf_dir).select(F.call_function("div", F.col("ticks"), F.lit(MINUTE)).alias("minute")).distinct()
    return numbered(at, "minute").select(F.lit("minutes").alias("path"), F.col("number").alias("record_index"), (F.col("minute") * MINUTE).alias("onset_ticks"))


def numbered(df: DataFrame, column: str, width: int = 1 << 12) -> DataFrame:
    """Adds number: the rank of distinct values of a column, counted within blocks of values and added up over blocks."""
    from pyspark.sql.window import Window

    blocked = df.withColumn("_b", F.call_function("div", F.col(column), F.lit(width)))
    totals = blocked.groupBy("_b").agg(F.count("*").alias("_n"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(column)) - 1
    return blocked.join(before.select("_b", "_before"), "_b").withColumn("number", F.col("_before") + within).drop("_b", "_before")


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors can open as files: in spark.wavelake.archive.dir or spark.checkpoint.dir;
    where executors run in the driver's process, a temporary one if neither is a mounted path."""
    for name in ("spark.wavelake.archive.dir", "spark.checkpoint.dir"):
        shared = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name)
        if shared and (shared.startswith("/") or shared.startswith("file:")):
            return tempfile.mkdtemp(prefix="archive-", dir=shared.removeprefix("file://").removeprefix("file:"))
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.wavelake.archive.dir must name a mounted folder that all executors share")
    return tempfile.mkdtemp(prefix="wavelake-archive-")


def archive(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[pd.DataFrame, int], Wr.Spec], where: str = "true") -> str:
    """Folder of recordings written from the events that where holds for; once for each session, table and kind."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _written:
        folder = _folder(ship(spark))

        def write(rows: pd.DataFrame) -> pd.DataFrame:
            part = int(rows["part"].iloc[0])
            spec = build(rows.sort_values("event_id"), part)
            path = os.path.join(folder, f"{part:09d}.{spec.family.lower()}")
            with open(path, "wb") as file:
                file.write(Wr.write(spec))
            return pd.DataFrame({"path": [path]})

        rows = events(spark, sf_dir).where(where).withColumn("part", F.call_function("div", F.col("event_id"), F.lit(S * FILE_RECORDS))).withColumn("place", F.col("event_id") % (S * FILE_RECORDS))
        rows.groupBy("part").applyInPandas(write, "path string").write.format("noop").mode("overwrite").save()
        _written[key] = folder
    return _written[key]


def _grid(values: np.ndarray) -> np.ndarray:
    return np.pad(values, (0, -len(values) % S)).reshape(-1, S)


def upper_words(spark: SparkSession, sf_dir: str) -> str | None:
    """Folder of what 16 bits leave of edf's values, with a file for each file of edf that has such values; None if none has."""
    folder = archive(spark, sf_dir, "upper", edf_upper, "digital NOT BETWEEN 0 AND 65535")
    return folder if os.listdir(folder) else None


def edf_upper(rows: pd.DataFrame, part: int) -> Wr.Spec:
    """The words above edf's values, up to the last record that has one: a value less 32768 is edf's sample and 65536 times this."""
    place = rows["place"].to_numpy()
    words = np.zeros((place.max() // S + 1, S), np.int64)
    words.ravel()[place] = rows["digital"].to_numpy() >> 16
    return Wr.Spec(record_count=len(words), start_date="01.01.24", signals=[Wr.SignalSpec("EEG upper", S, -32768, 32767, samples=words)])


def edf(rows: pd.DataFrame, part: int) -> Wr.Spec:
    """Two signals in 16 bits: value in hundredths less 32768, of which these hold the lower word (see edf_upper), and the user's number."""
    value, user = _grid(rows["digital"].to_numpy() - 32768), _grid((rows["user_id"] % 30_000).to_numpy())
    return Wr.Spec(record_count=len(value), patient_id="P001 F 02-MAY-1951 Doe_Jane", recording_id="Startdate 01-JAN-2024 X X X", start_date="01.01.24", signals=[Wr.SignalSpec("EEG value", S, 0, 655.35, samples=value), Wr.SignalSpec("EEG user", S, -100, 200, -32000, 32000, samples=user)])


def edf_gaps(rows: pd.DataFrame, part: int) -> Wr.Spec:
    """As edf, plus and discontinuous: ten seconds are missing after every twenty records."""
    spec = edf(rows, part)
    spec.plus, spec.record_onset = "D", lambda r: r + 10 * (r // 20)
    return spec


def bdf(rows: pd.DataFrame, part: int) -> Wr.Spec:
    """24 bits: the value, and a status word of k and three flags."""
    k = rows["k"].to_numpy().astype(np.int64)
    word = k // 10 | (k % 2) << 16 | (k % 3 == 0).astype(np.int64) << 20 | (k % 5 == 0).astype(np.int64) << 22
    return Wr.Spec("BDF", record_count=-(-len(k) // S), signals=[Wr.SignalSpec("A1", S, samples=_grid(rows["digital"].to_numpy())), Wr.SignalSpec("Status", S, physical_dimension="Boolean", samples=_grid(word))])


def edf_notes(rows: pd.DataFrame, part: int) -> Wr.Spec:
    """As edf, plus and continuous, with an annotation for each event: its type at its place, k seconds long unless it is a view."""
    spec = edf(rows, part)
    kinds, k, first = rows["event_type"].to_numpy(), rows["k"].to_numpy(), int(rows["event_id"].iloc[0])

    def notes(r: int) -> list[Wr.Tal]:
        own = range(r * S, min((r + 1) * S, len(kinds)))
        return [Wr.Tal(f"{i // S}.{i % S:02d}", None if kinds[i] == "view" else int(k[i]), (f"{kinds[i]}@@E{(first + i) % 7}" if (first + i) % 2 else str(kinds[i]),)) for i in own]

    spec.plus, spec.annotations = "C", [Wr.AnnotationSpec(2400, tals=notes)]
    return spec


def edf_late(rows: pd.DataFrame, part: int) -> Wr.Spec:
    """As edf_notes, with a first record that starts a quarter of a second after the header's time."""
    spec = edf_notes(rows, part)
    spec.start_offset = 0.25
    return spec


def file_part(path: Column) -> Column:
    """Number of the file in its archive."""
    return F.regexp_extract(path, r"(\d{9})\.[a-z]+$", 1).cast("bigint")
