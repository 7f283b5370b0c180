"""Header text, numbers in fields, dates, identification subfields and TAL text parts, as scalars and Columns."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ticks import WIDE

PAD = " \x00"
#: EDF+ month names (fixed values).
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
PIVOT_YEAR = 85
CHANNEL_MARK = "@@"


# -- text ------------------------------------------------------------------------------------------------------
def latin1(data: bytes) -> str:
    return data.decode("iso-8859-1")


def trim_field(text: str) -> str:
    return text.strip(PAD)


def latin1_col(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def trim_field_col(text: Column) -> Column:
    return F.trim(text, F.lit(PAD))


def has_non_printable(data: bytes) -> bool:
    return any(b < 0x20 or b > 0x7E for b in data)


def has_non_printable_col(text: Column) -> Column:
    return text.rlike(r"[^\x20-\x7e]")


def normalise_unit(dimension: str) -> str:
    return trim_field(dimension).replace("µ", "u").replace("μ", "u")


def normalise_unit_col(dimension: Column) -> Column:
    return F.translate(trim_field_col(dimension), "µμ", "uu")


def printable(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", ".", text)


def printable_col(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", ".")


def escape_controls(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f-\x9f]", lambda m: f"\\x{ord(m[0]):02x}", text)


def escape_controls_col(text: Column) -> Column:
    """Runs in the JVM: characters are handled one by one only where a control character is present."""
    one = lambda c: F.when(c.rlike(r"[\x00-\x1f\x7f-\x9f]"), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(c)
    return F.when(text.rlike(r"[\x00-\x1f\x7f-\x9f]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def split_channel(run: str) -> tuple[str, str | None]:
    """Text and channel label: what follows the last @@, if anything does."""
    head, mark, tail = run.rpartition(CHANNEL_MARK)
    return (head, tail) if mark and tail else (run, None)


def split_channel_col(run: Column) -> tuple[Column, Column]:
    tail = F.substring_index(run, CHANNEL_MARK, -1)
    there = run.contains(CHANNEL_MARK) & (F.length(tail) > 0)
    return F.when(there, F.left(run, F.length(run) - F.length(tail) - 2)).otherwise(run), F.when(there, tail)


# -- numbers ---------------------------------------------------------------------------------------------------
_DECIMAL = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?"
_COMMAS = r"[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:e[+-]?\d+)?"
#: What a number field is made of: padding, then a decimal, a decimal with commas, or anything else, then padding.
_PARTS = ("before", "decimal", "commas", "other", "after")
_FIELD_TEXT = rf"([ \x00]*)(?:({_DECIMAL})|({_COMMAS})|(.*?))([ \x00]*)"
_FIELD = re.compile(_FIELD_TEXT, re.ASCII | re.IGNORECASE | re.DOTALL)


@dataclass(frozen=True)
class Number:
    """value is None unless the field could be read; problem: none, empty, comma-decimal, not-left-justified or malformed."""

    value: float | int | None
    problem: str


def _exact(decimal: str | None, integral: bool) -> float | int | None:
    """The value of a decimal that a double holds as it is meant: finite, or a safe integer."""
    if decimal is None or (integral and not decimal.lstrip("+-").isdigit()):
        return None
    value = int(decimal) if integral else float(decimal)
    return value if abs(value) <= (2**53 - 1 if integral else sys.float_info.max) else None


def parse_number(raw: str, integral: bool = False) -> Number:
    field = dict(zip(_PARTS, _FIELD.fullmatch(raw).groups(), strict=True))
    value = _exact(field["decimal"], integral)
    tidy = not field["before"] and "\x00" not in field["after"]
    rejected = {"commas": "comma-decimal", "decimal": "malformed", "other": "malformed" if field["other"] else "empty"}
    kind = next(k for k in rejected if field[k] is not None)
    return Number(None, rejected[kind]) if value is None else Number(value, "none" if tidy else "not-left-justified")


def parse_number_col(raw: Column, integral: bool = False) -> Column:
    """struct<value double (bigint if integral), problem string> by the same pattern; a null is an empty field."""
    field = {k: F.regexp_extract(raw, rf"(?is)\A{_FIELD_TEXT}\z", i + 1) for i, k in enumerate(_PARTS)}
    if integral:
        number = F.when(~F.lower(field["decimal"]).rlike("[.e]"), field["decimal"]).try_cast(WIDE)
        value = F.when(F.abs(number) < 2**53, number.cast("bigint"))
    else:
        number = field["decimal"].try_cast("double")
        value = F.when(F.abs(number) <= sys.float_info.max, number)
    tidy = (field["before"] == "") & ~field["after"].contains("\x00")
    accepted = F.when(value.isNotNull(), F.when(tidy, "none").otherwise("not-left-justified"))
    rejected = F.when(field["commas"] != "", "comma-decimal").when(F.concat(field["decimal"], field["other"]) != "", "malformed").otherwise("empty")
    return F.struct(value.alias("value"), F.coalesce(accepted, rejected).alias("problem"))


# -- dates -----------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Day:
    year: int
    month: int
    day: int

    def __str__(self) -> str:
        return f"{self.year:04d}-{self.month:02d}-{self.day:02d}"


@dataclass(frozen=True)
class StartDate:
    """status: parsed, yearEscape or unparseable."""

    status: str
    date: Day | None = None
    day: int | None = None
    month: int | None = None
    clipped: bool = False


def is_leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def days_in_month(year: int, month: int) -> int:
    return 0 if not 1 <= month <= 12 else 29 if month == 2 and is_leap(year) else 28 if month == 2 else 30 if month in (4, 6, 9, 11) else 31


def is_valid_day(d: Day) -> bool:
    return 1 <= d.year <= 9999 and 1 <= d.day <= days_in_month(d.year, d.month)


def resolve_year(two_digits: int) -> int:
    return (1900 if two_digits >= PIVOT_YEAR else 2000) + two_digits


def resolve_year_col(two_digits: Column) -> Column:
    return F.when(two_digits >= PIVOT_YEAR, two_digits + 1900).otherwise(two_digits + 2000)


_BETWEEN = r"[\s.:/-]"
#: Three parts with separators between them, and perhaps around them.
_DATE = re.compile(rf"{_BETWEEN}*(?P<day>[0-9]{{1,2}}){_BETWEEN}+(?:(?P<month>[0-9]{{1,2}})|(?P<name>{'|'.join(MONTHS)})){_BETWEEN}+(?:(?P<escape>yy)|(?P<year>[0-9]{{4}})|(?P<short>[0-9]{{1,2}})){_BETWEEN}*", re.IGNORECASE)
_CLOCK = re.compile(rf"{_BETWEEN}*([01]?[0-9]|2[0-3]){_BETWEEN}+([0-5]?[0-9]){_BETWEEN}+([0-5]?[0-9]){_BETWEEN}*")
#: Any leap year: the day of a date without a year need only exist in some year.
LEAP_YEAR = 2000


def parse_start_date(raw: str) -> StartDate:
    found = _DATE.fullmatch(trim_field(raw))
    if not found or found["name"]:
        return StartDate("unparseable")
    year = LEAP_YEAR if found["escape"] else int(found["year"]) if found["year"] else resolve_year(int(found["short"]))
    day = Day(year, int(found["month"]), int(found["day"]))
    if not is_valid_day(day):
        return StartDate("unparseable")
    return StartDate("yearEscape", None, day.day, day.month) if found["escape"] else StartDate("parsed", day, day.day, day.month, bool(found["short"]))


def parse_start_date_col(raw: Column) -> Column:
    """The date as DATE, or null for the year escape and what cannot be read."""
    parts = F.array_remove(F.split(trim_field_col(raw), r"[\s.:/-]+"), "")
    d, m, y = (F.get(parts, i) for i in range(3))
    plain = (F.size(parts) == 3) & d.rlike(r"^[0-9]{1,2}$") & m.rlike(r"^[0-9]{1,2}$") & y.rlike(r"^([0-9]{1,2}|[0-9]{4})$")
    year = F.when(F.length(y) <= 2, resolve_year_col(y.try_cast("int"))).otherwise(y.try_cast("int"))
    text = F.format_string("%04d-%02d-%02d", year, m.try_cast("int"), d.try_cast("int"))
    return F.when(plain & (year >= 1), F.try_to_date(text, "yyyy-MM-dd"))


def parse_start_time(raw: str) -> tuple[int, int, int] | None:
    found = _CLOCK.fullmatch(trim_field(raw))
    return tuple(map(int, found.groups())) if found else None


def parse_start_time_col(raw: Column) -> Column:
    """Seconds since midnight, or null."""
    parts = F.array_remove(F.split(trim_field_col(raw), r"[\s.:/-]+"), "")
    h, m, s = (F.when(F.get(parts, i).rlike(r"^[0-9]{1,2}$"), F.get(parts, i).try_cast("int")) for i in range(3))
    return F.when((F.size(parts) == 3) & (h <= 23) & (m <= 59) & (s <= 59), h * 3600 + m * 60 + s)


def parse_subfield_date(text: str) -> tuple[Day | None, bool]:
    """The date of a subfield, and whether it is written dd-MMM-yyyy."""
    found = _DATE.fullmatch(trim_field(text))
    if not found or not found["year"]:
        return None, False
    day = Day(int(found["year"]), MONTHS.index(found["name"].upper()) + 1 if found["name"] else int(found["month"]), int(found["day"]))
    return (day, bool(re.fullmatch(r"[0-9]{2}-[A-Z]{3}-[0-9]{4}", text))) if is_valid_day(day) else (None, False)


def naive_start(day: Day | None, clock: tuple[int, int, int] | None) -> str | None:
    return None if day is None or clock is None else f"{day}T{clock[0]:02d}:{clock[1]:02d}:{clock[2]:02d}.000"


def naive_start_col(day: Column, seconds: Column) -> Column:
    return F.when(day.isNotNull() & seconds.isNotNull(), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.format_string("%02d:%02d:%02d.000", (seconds / 3600).cast("int"), (seconds % 3600 / 60).cast("int"), (seconds % 60).cast("int"))))


# -- identification --------------------------------------------------------------------------------------------
def subfields(raw: str) -> list[str]:
    return [p for p in trim_field(raw).split(" ") if p]


def _known(parts: list[str], i: int) -> str | None:
    return parts[i] if i < len(parts) and parts[i] != "X" else None


def parse_patient(raw: str) -> dict:
    parts = subfields(raw)
    born = _known(parts, 2)
    day, written = parse_subfield_date(born) if born else (None, True)
    sex_ok = len(parts) > 1 and parts[1] in ("F", "M", "X")
    return {"raw": raw, "conformant": len(parts) >= 4 and sex_ok and written, "code": _known(parts, 0), "sex": parts[1] if len(parts) > 1 and parts[1] in ("F", "M") else None, "birth_date": day, "name": _known(parts, 3), "extra_subfields": parts[4:]}


def parse_recording(raw: str) -> dict:
    parts = subfields(raw)
    start = _known(parts, 1)
    day, written = parse_subfield_date(start) if start else (None, True)
    prefix = parts[0] if parts else ""
    return {"raw": raw, "conformant": len(parts) >= 5 and prefix == "Startdate" and written, "start_date": day if prefix.lower() == "startdate" else None, "investigation_code": _known(parts, 2), "technician_code": _known(parts, 3), "equipment_code": _known(parts, 4), "extra_subfields": parts[5:]}


def _subfield_date_col(text: Column) -> tuple[Column, Column]:
    """The date of a subfield, and whether it is written dd-MMM-yyyy."""
    bits = F.array_remove(F.split(text, r"[\s.:/-]+"), "")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(F.get(bits, 1))).cast("int")
    month = F.when(month > 0, month).otherwise(F.when(F.get(bits, 1).rlike("^[0-9]{1,2}$"), F.get(bits, 1).try_cast("int")))
    plain = (F.size(bits) == 3) & F.get(bits, 0).rlike("^[0-9]{1,2}$") & F.get(bits, 2).rlike("^[0-9]{4}$")
    day = F.when(plain, F.try_to_date(F.format_string("%s-%02d-%02d", F.get(bits, 2), month, F.get(bits, 0).try_cast("int")), "yyyy-MM-dd"))
    return day, day.isNotNull() & text.rlike("^[0-9]{2}-[A-Z]{3}-[0-9]{4}$")


def _subfields_col(raw: Column) -> tuple[Column, Callable[[int], Column]]:
    parts = F.array_remove(F.split(trim_field_col(raw), " "), "")
    return parts, lambda i: F.when(F.get(parts, i) != "X", F.get(parts, i))


def patient_col(raw: Column) -> Column:
    """struct<code, sex, birth_date, name, conformant> of a patient field."""
    parts, known = _subfields_col(raw)
    born = known(2)
    day, written = _subfield_date_col(born)
    sex = F.get(parts, 1)
    good = (F.size(parts) >= 4) & F.coalesce(sex.isin("F", "M", "X"), F.lit(False)) & (born.isNull() | F.coalesce(written, F.lit(False)))
    return F.struct(known(0).alias("code"), F.when(sex.isin("F", "M"), sex).alias("sex"), day.alias("birth_date"), known(3).alias("name"), good.alias("conformant"))


def recording_col(raw: Column) -> Column:
    """struct<start_date, investigation_code, technician_code, equipment_code, extra_subfields, conformant> of a recording field."""
    parts, known = _subfields_col(raw)
    start, prefix = known(1), F.get(parts, 0)
    day, written = _subfield_date_col(start)
    good = (F.size(parts) >= 5) & F.coalesce(prefix == "Startdate", F.lit(False)) & (start.isNull() | F.coalesce(written, F.lit(False)))
    return F.struct(F.when(F.lower(prefix) == "startdate", day).alias("start_date"), known(2).alias("investigation_code"), known(3).alias("technician_code"), known(4).alias("equipment_code"), F.slice(parts, 6, F.greatest(F.size(parts), F.lit(1))).alias("extra_subfields"), good.alias("conformant"))
