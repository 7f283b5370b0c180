"""Scalars against their Columns, and worked values of the format."""

import math
import random
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelake.functions import text as T
from wavelake.functions import ticks as K
from wavelake.functions.status import decode_status


@given(st.integers(-(2**62), 2**62), st.integers(1, 2**31))
def test_floor_and_ceil_division(n, d):
    assert K.floor_div(n, d) == math.floor(Fraction(n, d)) and K.ceil_div(n, d) == math.ceil(Fraction(n, d))


def test_ticks_are_cut_after_seven_digits():
    assert K.parse_signed("+1.123456789") == 11_234_567
    assert K.parse_signed("-0.5") == -5_000_000
    assert [K.parse_signed(x) for x in ("1.5", "+", "+1.", "+.5", "", "+1e3")] == [None] * 6
    assert K.parse_unsigned("007.1") == 71_000_000


def test_seconds_round_half_up():
    assert K.from_seconds(-2.5e-7) == -2 and K.from_seconds(2.5e-7) == 3
    with pytest.raises(ValueError):
        K.from_seconds(float("nan"))


def test_saturation():
    assert K.saturate(2**70) == 2**63 - 1 and K.saturate(-(2**70)) == -(2**63)


NUMBERS = ["5", " 5", "5 ", "5\x00", "", "  ", "0,5", "1,024", "1,0,0", "+3", "-3.25", ".5", "1e2", "1e400", "x", "99999999999999999999", "12 3"]
DATES = ["01.02.03", "31.02.20", "29.02.00", "29.02.84", "1.2.85", "01.13.20", "01.02.2020", "01.02.020", "01/02/20", "01.02.yy", "", "32.01.20"]
CLOCKS = ["10.20.30", "23.59.60", "24.00.00", "1:2:3", "1.2", "x"]


def test_columns_agree_with_scalars(spark):
    df = spark.createDataFrame([(x,) for x in NUMBERS], "raw string")
    for integral in (False, True):
        for row in df.select("raw", T.parse_number_col(F.col("raw"), integral).alias("n")).collect():
            want = T.parse_number(row.raw, integral)
            assert (row.n.value, row.n.problem) == (want.value, want.problem), row.raw
    rng = random.Random(7)
    made = ["".join(rng.choices(" \x00+-0917.,eEx\n", k=rng.randrange(9))) for _ in range(4000)]
    df = spark.createDataFrame([(x,) for x in made], "raw string")
    for integral in (False, True):
        for row in df.select("raw", T.parse_number_col(F.col("raw"), integral).alias("n")).collect():
            want = T.parse_number(row.raw, integral)
            assert (row.n.value, row.n.problem) == (want.value, want.problem), repr(row.raw)
    df = spark.createDataFrame([(x,) for x in DATES], "raw string")
    for row in df.select("raw", T.parse_start_date_col(F.col("raw")).cast("string").alias("d")).collect():
        want = T.parse_start_date(row.raw).date
        assert row.d == (str(want) if want else None), row.raw
    df = spark.createDataFrame([(x,) for x in CLOCKS], "raw string")
    for row in df.select("raw", T.parse_start_time_col(F.col("raw")).alias("s")).collect():
        want = T.parse_start_time(row.raw)
        assert row.s == (want[0] * 3600 + want[1] * 60 + want[2] if want else None), row.raw
    times = ["+1.5", "-3", "7", "+1.", "+", "+12.123456789", ""]
    df = spark.createDataFrame([(x,) for x in times], "raw string")
    for row in df.select("raw", K.parse_signed_col(F.col("raw")).cast("bigint").alias("t")).collect():
        assert row.t == K.parse_signed(row.raw), row.raw


def test_years_and_months():
    assert T.resolve_year(85) == 1985 and T.resolve_year(84) == 2084
    assert T.parse_subfield_date("02-AUG-1951") == (T.Day(1951, 8, 2), True)
    assert T.parse_subfield_date("2-aug-1951") == (T.Day(1951, 8, 2), False)
    assert T.parse_subfield_date("30-FEB-1951") == (None, False)


def test_channel_labels():
    assert T.split_channel("Spike@@C3") == ("Spike", "C3")
    assert T.split_channel("x@@") == ("x@@", None)
    assert T.split_channel("a@@b@@c") == ("a@@b", "c")


def test_status_word():
    assert decode_status(0x2A | 1 << 16 | 1 << 22) == {"raw": 0x41002A, "trigger": 42, "new_epoch": True, "cms_in_range": False, "battery_low": True}


def test_unit_and_text():
    assert T.normalise_unit(" µV \x00") == "uV" and T.normalise_unit("μV") == "uV"
    assert T.escape_controls("a\x07\x85") == "a\\x07\\x85" and T.printable("a\x07\x7f") == "a.."
