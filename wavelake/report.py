"""Text for people. What identifies a patient is withheld unless asked for."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import TICKS_PER_SECOND
from .diagnostics import Diagnostic, redacted, summarize
from .functions.text import escape_controls, printable, printable_col
from .functions.ticks import WIDE, floor_div_col, to_seconds
from .sources.header import Header

PRIVATE = ("patient_id", "recording_id")
_COLORS = {"error": "31", "warning": "33", "info": "36"}


def clock(ticks: int) -> str:
    """[-]HH:MM:SS.mmm, milliseconds cut off towards the past."""
    ms = ticks // 10_000
    sign, ms = ("-" if ms < 0 else ""), abs(ms)
    return f"{sign}{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def clock_col(ticks: Column) -> Column:
    ms = floor_div_col(ticks, 10_000)
    at = F.abs(ms)
    part = lambda by, of: F.call_function("div", at, F.lit(by)) % F.lit(of)
    said = F.format_string("%02d:%02d:%02d.%03d", F.call_function("div", at, F.lit(3_600_000)), part(60_000, 60), part(1000, 60), at % F.lit(1000))
    return F.concat(F.when(ms < 0, "-").otherwise(""), said)


def seconds_text(ticks: int) -> str:
    """Ticks as seconds in decimals, exactly, without zeros at the end."""
    whole, rest = divmod(abs(ticks), TICKS_PER_SECOND)
    return f"{'-' if ticks < 0 else ''}{whole}" + f".{rest:07d}".rstrip("0") * bool(rest)


def seconds_text_col(ticks: Column) -> Column:
    wide = F.abs(ticks.cast(WIDE))
    rest = (wide % F.lit(TICKS_PER_SECOND)).cast("int")
    whole = ((wide - rest) / F.lit(TICKS_PER_SECOND)).cast(WIDE).cast("string")
    part = F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(rest.cast("string"), 7, "0"), F.lit("0"))))
    return F.concat(F.when(ticks < 0, "-").otherwise(""), whole, part)


def annotation_lines(annotations: DataFrame) -> DataFrame:
    """The rows with line, the text that `format_annotations` gives for each; by built-in functions."""
    length = F.when(F.col("duration_ticks").isNull(), "").otherwise(F.concat(F.lit(" +"), seconds_text_col(F.col("duration_ticks")), F.lit("s")))
    channel = F.when(F.coalesce("channel_label", F.lit("")) == "", "").otherwise(F.concat(F.lit(" @ "), printable_col(F.col("channel_label"))))
    return annotations.withColumn("line", F.concat(clock_col(F.col("onset_ticks_from_first_record")), length, F.lit("  "), printable_col(F.col("text")), channel))


def write_annotations(annotations: DataFrame, path: str) -> None:
    """A text file for each partition, a line for each annotation, written by tasks; to be ordered by who calls."""
    annotation_lines(annotations).select("line").write.text(path)


def hex_dump(data: bytes, most: int = 24) -> str:
    shown = data[:most]
    return shown.hex(" ") + (" ..." if len(data) > most else "") + "  |" + "".join(chr(b) if 32 <= b < 127 else "." for b in shown) + "|"


def format_diagnostics(found: Sequence[Diagnostic], color: bool = False, max_items: int | None = None, redact_fields: Iterable[str] = ()) -> str:
    if max_items is not None and (max_items != max_items or max_items < 0):
        raise ValueError("max_items must be a non-negative number")
    shown = found if max_items is None else found[: int(max_items)]
    hide, lines = set(redact_fields), []
    for d in shown:
        d = redacted(d) if d.field in hide else d
        head = f"{d.severity.upper()} {d.code}"
        where = ", ".join(x for x in (d.field, d.signal_index is not None and f"signal {d.signal_index}", d.record_index is not None and f"record {d.record_index}", d.byte_offset is not None and f"byte {d.byte_offset}") if x)
        lines.append((f"\x1b[{_COLORS[d.severity]}m{head}\x1b[0m" if color else head) + (f" ({where})" if where else ""))
        lines.append("  " + escape_controls(d.message))
        lines += [f"  {name}: {escape_controls(value)}" for name, value in (("expected", d.expected), ("actual", d.actual)) if value is not None]
        if d.raw_bytes:
            lines.append("  bytes: " + hex_dump(d.raw_bytes))
    if len(shown) < len(found):
        lines.append(f"... and {len(found) - len(shown)} more")
    return "\n".join(lines) or "no diagnostics"


def format_header(h: Header, patient: bool = False) -> str:
    start = h.start_time.naive() or "unknown"
    lines = [f"{h.variant}, {h.continuity}", f"start      {start}", f"duration   {to_seconds(h.record_count * h.record_duration_ticks)} s in {h.record_count} records of {to_seconds(h.record_duration_ticks)} s", f"record     {h.record_byte_length} bytes", f"signals    {len(h.data_signals)} of data, {len(h.annotation_signals)} of annotations"]
    if patient:
        lines += [f"patient    {printable(h.patient['raw'].strip())}", f"recording  {printable(h.recording['raw'].strip())}"]
    table = [("#", "label", "rate", "unit", "physical", "digital")]
    for s in h.signals:
        rate = "-" if s.sample_rate_hz is None else f"{s.sample_rate_hz:g} Hz"
        table.append((str(s.index), printable(s.label), "annotations" if s.kind == "annotations" else rate, printable(s.unit), f"{s.physical_minimum:g}..{s.physical_maximum:g}", f"{s.digital_minimum}..{s.digital_maximum}"))
    widths = [max(len(row[i]) for row in table) for i in range(6)]
    return "\n".join([*lines, *("  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in table)])


def format_annotations(rows: Sequence, limit: int | None = None) -> str:
    """rows: annotations in order, with onset_ticks_from_first_record, duration_ticks, text, channel_label."""
    shown = rows if limit is None else rows[:limit]
    lines = []
    for a in shown:
        length = "" if a["duration_ticks"] is None else f" +{seconds_text(a['duration_ticks'])}s"
        channel = f" @ {printable(a['channel_label'])}" if a["channel_label"] else ""
        lines.append(f"{clock(a['onset_ticks_from_first_record'])}{length}  {printable(a['text'])}{channel}")
    if len(shown) < len(rows):
        lines.append(f"... and {len(rows) - len(shown)} more")
    return "\n".join(lines) or "no annotations"


def format_validation(report: dict, color: bool = False, max_items: int | None = None, redact_fields: Iterable[str] = PRIVATE) -> str:
    found = summarize(report["diagnostics"])
    count = lambda n, noun: f"{n} {noun}{'' if n == 1 else 's'}"
    lines = [f"{'PASS' if report['ok'] else 'FAIL'}: {count(found['error'], 'error')}, {count(found['warning'], 'warning')}, {found['info']} info; {count(report['records_scanned'], 'record')} scanned, {count(report['bytes_read'], 'byte')} read"]
    lines += [f"  {n} x {code} ({severity})" for code, severity, n in found["by_code"]]
    lines += [f"  signal {s['signal_index']}: {s['observed_digital_min']}..{s['observed_digital_max']}, {count(s['out_of_range_count'], 'sample')} out of range of {s['sample_count']}" for s in report["signal_stats"]]
    return "\n".join([*lines, format_diagnostics(report["diagnostics"], color, max_items, redact_fields)])
