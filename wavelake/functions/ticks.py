"""Exact 100-nanosecond ticks: Python scalars for the driver and readers, Column expressions for DataFrames.

The scalar and the Column of one function agree on every value. Products that can leave 64 bits go through
decimal(38,0); ANSI mode raises on overflow instead of inventing a number.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import INT64_MAX, INT64_MIN, TICKS_PER_SECOND

_MAGNITUDE = re.compile(r"([0-9]+)(?:\.([0-9]+))?", re.A)
WIDE = "decimal(38,0)"


def parse_unsigned(text: str) -> int | None:
    """Ticks of 1*DIGIT [. 1*DIGIT]; digits past the seventh are cut off. None if it isn't that."""
    m = _MAGNITUDE.fullmatch(text)
    return int(m[1]) * TICKS_PER_SECOND + int((m[2] or "")[:7].ljust(7, "0")) if m else None


def parse_signed(text: str) -> int | None:
    """The same after a sign that must be there."""
    ticks = parse_unsigned(text[1:]) if text[:1] in ("+", "-") and text else None
    return ticks if ticks is None or text[0] == "+" else -ticks


def to_seconds(ticks: int) -> float:
    whole, rest = divmod(abs(ticks), TICKS_PER_SECOND)
    sign = -1 if ticks < 0 else 1
    return float(sign * whole) + sign * rest / TICKS_PER_SECOND


def from_seconds(seconds: float) -> int:
    """Rounded half up, towards positive infinity."""
    if not math.isfinite(seconds):
        raise ValueError(f"a finite number of seconds is needed, not {seconds}")
    scaled = seconds * TICKS_PER_SECOND
    low = math.floor(scaled)
    return low + (scaled - low >= 0.5)


def floor_div(n: int, d: int) -> int:
    return n // d


def ceil_div(n: int, d: int) -> int:
    return -(-n // d)


def saturate(ticks: int) -> int:
    return max(INT64_MIN, min(INT64_MAX, ticks))


def div(n: Column, d: Column) -> Column:
    """Quotient cut off towards zero, as bigint."""
    return F.call_function("div", n, d)


def to_seconds_col(ticks: Column) -> Column:
    unit = F.lit(TICKS_PER_SECOND)
    return div(ticks, unit).cast("double") + (ticks % unit) / F.lit(float(TICKS_PER_SECOND))


def from_seconds_col(seconds: Column) -> Column:
    scaled = seconds * F.lit(float(TICKS_PER_SECOND))
    low = F.floor(scaled)
    return (low + (scaled - low >= 0.5).cast("bigint")).cast("bigint")


def floor_div_col(n: Column, d: Column | int) -> Column:
    """For positive d, and n of any exact type; the quotient is bigint."""
    d = F.lit(d) if isinstance(d, int) else d
    return div(n, d) - (n % d < 0).cast("bigint")


def ceil_div_col(n: Column, d: Column | int) -> Column:
    return -floor_div_col(-n, d)


def saturate_col(ticks: Column) -> Column:
    wide = ticks.cast(WIDE)
    return F.least(F.greatest(wide, F.lit(str(INT64_MIN)).cast(WIDE)), F.lit(str(INT64_MAX)).cast(WIDE)).cast("bigint")


def parse_unsigned_col(text: Column) -> Column:
    """decimal(38,0) ticks, or null; at most 30 integer digits."""
    good = text.rlike(r"^[0-9]{1,30}(\.[0-9]+)?$")
    whole = F.regexp_extract(text, r"^([0-9]+)", 1)
    part = F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]+)$", 1), 1, 7), 7, "0")
    return F.when(good, F.concat(whole, part).cast(WIDE))


def parse_signed_col(text: Column) -> Column:
    magnitude = parse_unsigned_col(F.substring(text, 2, 1 << 20))
    return F.when(text.startswith("+"), magnitude).when(text.startswith("-"), -magnitude)
