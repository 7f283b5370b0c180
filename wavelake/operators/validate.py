"""Validation: rules over the header without reading, and one traversal for what only the records can tell."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import RECOMMENDED_RECORD_BYTES, signal_field_offset
from ..diagnostics import Diagnostic, severity_of
from ..functions import text as T
from ..functions.ticks import WIDE
from ..shared import held
from ..sources.decode import bounded, check_monotonic
from ..sources.header import Header
from . import timeline as L

#: Types that a label of the form "<type> <sensor>" begins with (fixed values).
LABEL_TYPES = {"EEG", "ECG", "EOG", "ERG", "EMG", "MEG", "MCG", "EP", "Temp", "Resp", "SaO2", "Light", "Sound", "Event"}
FILTER_TERMS = ("HP:", "LP:", "N:", "G:")
#: What a finding or a segment is worth in bytes on the driver.
FINDING_BYTES = 1024
NO_FILTER = {"None", "none", "NONE", "No filtering"}


def header_rules(h: Header) -> list[Diagnostic]:
    """Conventions a header breaks: record size, then each data signal, identification, dates. Nothing is read."""
    out: list[Diagnostic] = []
    add = lambda code, message, **more: out.append(Diagnostic(code, message, **more))
    if h.record_byte_length > RECOMMENDED_RECORD_BYTES:
        add("RECORD_SIZE_ABOVE_RECOMMENDED", f"a record has {h.record_byte_length} bytes", field="record_byte_length", actual=f"{h.record_byte_length} bytes")
    for s in (h.signals[i] for i in h.data_signals):
        at = lambda name, s=s: {"field": name, "byte_offset": signal_field_offset(name, len(h.signals), s.index), "byte_length": 16 if name == "label" else 80, "raw": s.raw[name], "signal_index": s.index}
        kind = s.label.split(" ")[0]
        if kind not in LABEL_TYPES or len(s.label) == len(kind):
            add("LABEL_CONVENTION_NONCONFORMANT", f"label {s.label!r} isn't of the form type, space, sensor", actual=s.label, **at("label"))
        if s.prefiltering and s.prefiltering not in NO_FILTER and not all(t.startswith(FILTER_TERMS) for t in re.split(r"\s+", s.prefiltering) if t):
            add("PREFILTERING_NONCONFORMANT", f"prefiltering {s.prefiltering!r} isn't made of {' '.join(FILTER_TERMS)} terms", actual=s.prefiltering, **at("prefiltering"))
        if not s.transducer_type:
            add("TRANSDUCER_TYPE_BLANK", f"signal {s.index} doesn't name its transducer", **at("transducer_type"))
    if "+" in h.variant:
        for code, name, parsed in (("PATIENT_ID_NONCONFORMANT", "patient_id", h.patient), ("RECORDING_ID_NONCONFORMANT", "recording_id", h.recording)):
            if not parsed["conformant"]:
                add(code, f"{name} doesn't follow the EDF+ grammar", field=name, raw=parsed["raw"], actual=T.trim_field(parsed["raw"]))
    start, read = h.start_time, T.parse_start_date(h.raw["start_date"])
    rescue = start.recording_id_date
    date = {"field": "start_date", "byte_offset": 168, "byte_length": 8, "raw": h.raw["start_date"]}
    if read.status == "unparseable" or (read.status == "yearEscape" and not rescue):
        add("DATE_UNPARSEABLE", f"the start date is {T.trim_field(h.raw['start_date'])!r}" + (", the recording identification gives one" if rescue else ""), **date)
    if start.clock_source == "none":
        add("STARTTIME_UNPARSEABLE", f"the start time is {T.trim_field(h.raw['start_time'])!r}", field="start_time", byte_offset=176, byte_length=8, raw=h.raw["start_time"])
    if rescue and ((start.header_date and start.header_date != rescue) or (read.status == "yearEscape" and (read.day, read.month) != (rescue.day, rescue.month))):
        add("DATE_FIELDS_DISAGREE", f"the start date isn't the {rescue} of the recording identification", expected=str(rescue), actual=str(start.header_date or f"day {read.day}, month {read.month}"), **date)
    day, born = start.resolved_date, h.patient["birth_date"]
    if day and not T.is_valid_day(day):
        add("DATE_IMPLAUSIBLE", f"the start date {day} doesn't exist", **date)
    if born and day and (born.year, born.month, born.day) > (day.year, day.month, day.day):
        add("DATE_IMPLAUSIBLE", f"the birth date {born} is after the start date {day}", field="patient_id", byte_offset=8, byte_length=80, raw=h.patient["raw"], actual=str(born))
    return out


def structure_rules(h: Header, segments: list[dict]) -> list[Diagnostic]:
    """What the complete index says against the header."""
    out, gaps = [], [(a, b, b["start_ticks"] - a["end_ticks"]) for a, b in zip(segments, segments[1:], strict=False)]
    if h.continuity == "continuous" and len(segments) > 1:
        out.append(Diagnostic("DISCONTINUITY_IN_CONTINUOUS_FILE", f"a continuous file has {len(segments)} segments", field="timekeeping TAL", expected="1 segment", actual=f"{len(segments)} segments"))
    for a, b, ticks in gaps:
        if ticks < 0:
            out.append(Diagnostic("RECORD_ONSET_SPACING_VIOLATION", f"segment {b['segment_index']} starts {-ticks} ticks before segment {a['segment_index']} ends", field="timekeeping TAL", expected=f">= {a['end_ticks']}", actual=str(b["start_ticks"])))
    return out


def once_per_call(diagnostics: DataFrame) -> DataFrame:
    """Findings of all tasks with those a call reports once reduced to their first."""
    once = F.coalesce("once", F.lit(False))
    rank = F.row_number().over(Window.partitionBy("path", "code").orderBy("record_index", "signal_index", "byte_offset"))
    return diagnostics.where(~once).unionByName(diagnostics.where(once).withColumn("_n", rank).where("_n = 1").drop("_n"))


def joined_runs(runs: DataFrame) -> DataFrame:
    """Segments of each path from the runs that parts of its file saw: the columns of `segments`, continuity, and whether starts go back (backwards)."""
    along = Window.partitionBy("path").orderBy("record_index")
    ends = F.col("start_ticks").cast(WIDE) + F.col("record_count") * F.col("record_duration_ticks").cast(WIDE)
    before, last = F.lag(ends).over(along), F.lag(ends - F.col("record_duration_ticks")).over(along)
    marked = runs.withColumn("_new", (before.isNull() | (before != F.col("start_ticks"))).cast("int")).withColumn("_back", F.coalesce(F.col("start_ticks") < last, F.lit(False)))
    numbered = marked.withColumn("segment_index", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1)
    found = numbered.groupBy("path", "segment_index", "continuity", "record_duration_ticks").agg(F.min("record_index").alias("record_start"), F.sum("record_count").alias("record_count"), F.min_by("start_ticks", "record_index").alias("start_ticks"), F.max("_back").alias("backwards"))
    length = F.col("record_count") * F.col("record_duration_ticks")
    return found.withColumn("duration_ticks", length).withColumn("end_ticks", F.col("start_ticks") + length)


def statistics(rows: DataFrame) -> DataFrame:
    """path, signal_index, observed_digital_min and _max, out_of_range_count, sample_count of an audit's rows."""
    found = rows.where("kind = 'stats'").groupBy("path", "signal_index")
    return found.agg(F.min("observed_digital_min").alias("observed_digital_min"), F.max("observed_digital_max").alias("observed_digital_max"), F.sum("out_of_range_count").alias("out_of_range_count"), F.sum("sample_count").alias("sample_count"))


def validate(recording, scan_samples: bool = False, use_index: bool = True, max_bytes: float | None = None, abort=None, on_progress=None) -> dict:
    """Report of a recording: ok, diagnostics, records_scanned, bytes_read, signal_stats.

    Without samples to scan, records are read only if their starts aren't known: neither by arithmetic nor by a
    complete index. One traversal by tasks gives findings, starts and statistics; they come to the driver within
    max_bytes. `validate_files` gives them as rows of a table, however many there are. abort ends the traversal;
    on_progress is told records done and all records.
    """
    h, known = recording.header, recording._index if use_index else None
    found = [*h.diagnostics, *header_rules(h), *recording.timeline["diagnostics"]]
    timed = bool(h.annotation_signals)
    reads = scan_samples or (timed and known is None)
    segments, stats = known, []
    if reads:
        seen = recording.scan("audit", max_bytes=max_bytes, signals=None if scan_samples else "")
        rows = [r.asDict() for r in recording.run(lambda: bounded(seen, FINDING_BYTES, max_bytes, "findings"), abort, on_progress)]
        told, said = set(), [r for r in rows if r["kind"] == "finding"]
        for r in sorted(said, key=lambda r: tuple((r[k] is not None, r[k] or 0) for k in ("record_index", "signal_index", "byte_offset"))):
            if not r["once"] or r["code"] not in told:
                found.append(Diagnostic(**{k: r[k] for k in Diagnostic.__dataclass_fields__}))
            told.add(r["code"])
        if segments is None and timed:
            segments = _segments_of([r for r in rows if r["kind"] == "run"], h.record_duration_ticks)
        if scan_samples:
            by: dict[int, list[dict]] = {}
            for r in rows:
                if r["kind"] == "stats":
                    by.setdefault(r["signal_index"], []).append(r)
            for i in h.data_signals:
                parts = by.get(i, [])
                row = {name: f((r[name] for r in parts), default=0) for name, f in (("observed_digital_min", min), ("observed_digital_max", max))}
                stats.append({"signal_index": i} | row | {name: sum(r[name] for r in parts) for name in ("out_of_range_count", "sample_count")})
    found += structure_rules(h, segments or [])
    return {"ok": all(d.severity != "error" for d in found), "diagnostics": found, "records_scanned": h.record_count if reads else 0, "bytes_read": h.data_byte_length if reads else 0, "signal_stats": stats}


def _segments_of(runs: list[dict], duration: int) -> list[dict]:
    """Segments of the runs of one recording; starts that go back raise."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: r["record_index"]):
        if out and r["start_ticks"] == out[-1]["end_ticks"]:
            out[-1]["record_count"] += r["record_count"]
        else:
            if out:
                check_monotonic([out[-1]["end_ticks"] - duration, r["start_ticks"]], r["record_index"] - 1)
            out.append({"segment_index": len(out), "record_start": r["record_index"], "record_count": r["record_count"], "start_ticks": r["start_ticks"]})
        out[-1]["duration_ticks"] = out[-1]["record_count"] * duration
        out[-1]["end_ticks"] = out[-1]["start_ticks"] + out[-1]["duration_ticks"]
    return out


def findings_of(rows: DataFrame) -> DataFrame:
    """path, code, severity of the findings that an audit's rows show; nothing comes to the driver."""
    columns = ["path", "code", "severity"]
    said = rows.where("kind = 'finding'")
    records = once_per_call(said.where("stage = 'records'")).select(columns)
    found = joined_runs(rows.where("kind = 'run'"))
    counted = found.groupBy("path", "continuity").agg(F.count("*").alias("n"), F.max("backwards").alias("backwards"))
    coded = lambda df, code: df.select("path", F.lit(code).alias("code"), F.lit(severity_of(code)).alias("severity"))
    parts = [
        said.where("stage <> 'records'").select(columns),
        coded(counted.where("n > 1 AND continuity = 'continuous'"), "DISCONTINUITY_IN_CONTINUOUS_FILE"),
        coded(L.gaps(found).where("duration_ticks < 0"), "RECORD_ONSET_SPACING_VIOLATION"),
        coded(counted.where("backwards"), "TIMELINE_NOT_MONOTONIC"),
    ]
    for part in parts:
        records = records.unionByName(part)
    return records


def audited(read: Callable[[str], DataFrame]) -> DataFrame:
    """The audit of an archive as a table in the shared folder: every record is read once, whatever is asked of it later."""
    return held(read("audit"), "audit")


def validate_files(read: Callable[[str], DataFrame]) -> DataFrame:
    """path, code, severity of the findings in every file of an archive; `read` gives the archive in a mode of the source.

    The rules are those of `validate`, except that starts that go back are a finding of their file. Files are looked
    at by tasks, in one traversal of headers, findings, starts and samples.
    """
    return findings_of(audited(read))
