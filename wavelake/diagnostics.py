"""Diagnostic codes, their severity, and the sink that collects or raises."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

from .errors import FormatError

#: Disposition of each code (fixed values). A code that isn't here is a warning.
FATAL = """NOT_AN_EDF_FILE SOURCE_TOO_SMALL SIGNAL_COUNT_INVALID NUMERIC_FIELD_INVALID COMMA_DECIMAL_SEPARATOR
RECORD_SIZE_ZERO EDFPLUS_WITHOUT_ANNOTATION_SIGNAL TIMELINE_NOT_MONOTONIC RECORDING_SPAN_UNREPRESENTABLE""".split()
DEFERRED = "DEGENERATE_DIGITAL_RANGE DEGENERATE_PHYSICAL_RANGE INVERTED_DIGITAL_RANGE LOG_TRANSFORMED_CHANNEL SCALE_UNAVAILABLE".split()
WARNING = """HEADER_SIZE_MISMATCH RECORD_COUNT_RECOVERED TRUNCATED_FILE PARTIAL_FINAL_RECORD TRAILING_BYTES
RECORD_SIZE_ABOVE_RECOMMENDED NONSTANDARD_RESERVED_FIELD NON_ASCII_HEADER_FIELD NUMERIC_FIELD_NOT_LEFT_JUSTIFIED
DATE_FIELDS_DISAGREE DATE_UNPARSEABLE STARTTIME_UNPARSEABLE PATIENT_ID_NONCONFORMANT RECORDING_ID_NONCONFORMANT
DUPLICATE_SIGNAL_LABEL DIGITAL_RANGE_EXCEEDS_FORMAT ZERO_SAMPLES_PER_RECORD ZERO_RECORD_DURATION
ANNOTATION_SIGNAL_HEADER_NONCONFORMANT MISSING_EDFPLUS_MARKER TIMEKEEPING_TAL_MISSING TIMEKEEPING_TAL_NONCONFORMANT
START_OFFSET_OUT_OF_RANGE TAL_MALFORMED TAL_TRUNCATED_AT_REGION_END TAL_REGION_NOT_NUL_TERMINATED
ANNOTATION_TEXT_NOT_UTF8 RECORD_ONSET_SPACING_VIOLATION DISCONTINUITY_IN_CONTINUOUS_FILE""".split()
INFO = "DATE_CLIPPED_TO_1985_2084 INVERTED_PHYSICAL_RANGE NEGATIVE_ANNOTATION_ONSET".split()
_SEVERITY = dict.fromkeys(FATAL + DEFERRED, "error") | dict.fromkeys(WARNING, "warning") | dict.fromkeys(INFO, "info")
SEVERITIES = ("error", "warning", "info")
SCHEMA = """code string, severity string, message string, field string, byte_offset bigint, byte_length bigint, raw_bytes binary,
raw string, expected string, actual string, signal_index int, record_index bigint, spec_reference string,
once boolean"""


def severity_of(code: str) -> str:
    return _SEVERITY.get(code, "warning")


def disposition_of(code: str) -> str:
    return "fatal" if code in FATAL else "deferred" if code in DEFERRED else "info" if code in INFO else "warning"


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    severity: str = ""
    field: str | None = None
    byte_offset: int | None = None
    byte_length: int | None = None
    raw_bytes: bytes | None = None
    raw: str | None = None
    expected: str | None = None
    actual: str | None = None
    signal_index: int | None = None
    record_index: int | None = None
    spec_reference: str | None = None
    #: Reported once for a whole call, however the call is cut into tasks.
    once: bool = False

    def __post_init__(self):
        if not self.severity:
            object.__setattr__(self, "severity", severity_of(self.code))

    def row(self) -> dict:
        return asdict(self)


class Sink:
    """Collects diagnostics. Codes that are always fatal raise; strict raises on the first that isn't just information."""

    def __init__(self, strict: bool = False):
        self.strict, self.found = strict, []

    def report(self, code: str, message: str, **more) -> Diagnostic:
        d = Diagnostic(code, message, **more)
        if code in FATAL or (self.strict and d.severity != "info"):
            raise FormatError(d, self.found)
        self.found.append(d)
        return d


def summarize(diagnostics: Iterable[Diagnostic]) -> dict:
    """Totals by severity, the worst severity, and (code, severity, count) by count, then as first seen."""
    totals, by_code = dict.fromkeys(SEVERITIES, 0), {}
    for d in diagnostics:
        totals[d.severity] += 1
        by_code[d.code, d.severity] = by_code.get((d.code, d.severity), 0) + 1
    worst = next((s for s in SEVERITIES if totals[s]), None)
    return {**totals, "total": sum(totals.values()), "worst": worst, "by_code": [(c, s, n) for (c, s), n in sorted(by_code.items(), key=lambda x: -x[1])]}


def redacted(d: Diagnostic) -> Diagnostic:
    """The same finding without what the file holds."""
    return replace(d, message=f"{d.code} in {d.field} (content withheld)", raw="(withheld)" if d.raw is not None else None, actual="(withheld)" if d.actual is not None else None, raw_bytes=None)
