"""The 24-bit status word of BDF recordings: 16 trigger bits and three flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_status(sample: int) -> dict:
    raw = sample & 0xFFFFFF
    return {"raw": raw, "trigger": raw & 0xFFFF, "new_epoch": bool(raw >> 16 & 1), "cms_in_range": bool(raw >> 20 & 1), "battery_low": bool(raw >> 22 & 1)}


def status_col(sample: Column) -> Column:
    raw = sample.cast("int").bitwiseAND(F.lit(0xFFFFFF))
    flag = lambda bit: F.getbit(raw, F.lit(bit)) == 1
    return F.struct(raw.alias("raw"), raw.bitwiseAND(F.lit(0xFFFF)).alias("trigger"), flag(16).alias("new_epoch"), flag(20).alias("cms_in_range"), flag(22).alias("battery_low"))
