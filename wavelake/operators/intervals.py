"""Joins of points and intervals of time by dyadic cells.

An interval of a length up to 2^k ticks, k as small as may be, touches at most two cells of 2^k ticks, and stands in
those alone; so it takes two rows, whether it lasts a tick or as long as 64 bits can say. A point stands in one cell
of each k that some interval has, of which there are at most 64. Both meet by equi-joins on path, k and cell.

Intervals are half-open [start, end); one whose end isn't after its start is the instant at its start. Sums that
leave 64 bits are held at their ends.

Where only the number of meetings is asked for, none is listed: what began before an interval's end, less what ended
by its start, are two places in the order of all bounds, which is counted in blocks of ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import INT64_MAX
from ..functions.ticks import WIDE, saturate_col

#: Cells of 2^63 ticks: all of time in two.
TOP = 63
#: Blocks of ticks, of about as many bounds each, in which bounds are put in order.
BLOCKS = 1 << 8


def end_of(start: Column, duration: Column) -> Column:
    """start + duration, held within 64 bits; a null duration is none."""
    return saturate_col(start.cast(WIDE) + F.coalesce(duration, F.lit(0)))


def level(start: Column, end: Column) -> Column:
    """The smallest k for which 2^k is no less than the interval's length."""
    length = end.cast(WIDE) - start.cast(WIDE)
    bits = F.length(F.bin((length - 1).cast("bigint")))
    return F.when(length <= 1, 0).when(length > (1 << (TOP - 1)), TOP).otherwise(bits).cast("int")


def cell(ticks: Column, k: Column) -> Column:
    return F.call_function("shiftright", ticks, k)


def _touched(start: Column, end: Column, k: Column) -> Column:
    """The cells of level k that an interval of no higher level touches: one or two."""
    return F.sequence(cell(start, k), cell(F.greatest(end - 1, start), k))


def _levels(df: DataFrame, k: str) -> list[int]:
    """The levels in use, at most TOP + 1 numbers."""
    return sorted(r[0] for r in df.select(k).where(F.col(k).isNotNull()).distinct().collect())


def _array(levels: list[int]) -> Column:
    return F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")


def _placed(df: DataFrame, start: str, end: str) -> DataFrame:
    """The intervals in the cells of their own level: columns _k and _cell."""
    return df.withColumn("_k", level(F.col(start), F.col(end))).withColumn("_cell", F.explode(_touched(F.col(start), F.col(end), F.col("_k"))))


def _renamed(df: DataFrame, on: list[str], start: str, end: str, taken: list[str]) -> tuple[DataFrame, list[str]]:
    """df with its keys and bounds under names of their own, and the columns that are left, without those whose names are taken."""
    kept = [c for c in df.columns if c not in on and c not in taken]
    out = df.select(*[F.col(c).alias(f"_{c}_of_interval") for c in on], F.col(start).alias("_start"), F.col(end).alias("_end"), *kept)
    return out, kept


def points_in(points: DataFrame, intervals: DataFrame, ticks: str = "ticks", start: str = "start_ticks", end: str = "end_ticks", on: tuple[str, ...] = ("path",)) -> DataFrame:
    """Each point with each interval of the same keys that holds it; columns of both, the keys and what intervals have of points' names from points. Null bounds, keys and ticks meet nothing.

    An interval without length holds nothing.
    """
    right, kept = _renamed(intervals.where(F.col(start) < F.col(end)), list(on), start, end, points.columns)
    right = _placed(right, "_start", "_end")
    levels = _levels(intervals.where(F.col(start) < F.col(end)).select(level(F.col(start), F.col(end)).alias("k")), "k")
    left = points.withColumn("_at_k", F.explode(_array(levels))).withColumn("_at", cell(F.col(ticks), F.col("_at_k")))
    same = [F.col(c) == F.col(f"_{c}_of_interval") for c in on]
    met = left.join(right, [*same, F.col("_at_k") == F.col("_k"), F.col("_at") == F.col("_cell"), F.col(ticks) >= F.col("_start"), F.col(ticks) < F.col("_end")])
    return met.select(*points.columns, *kept)


def _tick_at_least(start: str, end: str) -> Column:
    """The end of an interval of a tick at least."""
    return F.greatest(F.col(end), F.when(F.col(start) < F.lit(INT64_MAX), F.col(start) + 1).otherwise(F.col(start)))


def overlaps(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], on: tuple[str, ...] = ("path",)) -> DataFrame:
    """Every pair of the same keys whose intervals overlap; columns of both, the keys and what right has of left's names from left.

    Of a pair, the interval of the lower level is carried to the other's level, where it too touches at most two
    cells; the pair is given in the first cell that both touch.
    """
    (a, b), (c, d) = left_bounds, right_bounds
    other, kept = _renamed(right, list(on), c, d, left.columns)
    own, theirs = left.withColumn("_lk", level(F.col(a), F.col(b))), other.withColumn("_rk", level(F.col("_start"), F.col("_end")))
    up_left, up_right = _levels(theirs, "_rk"), _levels(own, "_lk")
    same = [F.col(k) == F.col(f"_{k}_of_interval") for k in on]
    # As half-open intervals of a tick at least, both kinds meet alike; instants are the ticks they stand at.
    left_end, right_end = _tick_at_least(a, b), _tick_at_least("_start", "_end")
    meet = (F.col(a) < right_end) & (F.col("_start") < left_end)

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        first = F.col("_lcell") == F.greatest(cell(F.col(a), F.col("_k")), cell(F.col("_start"), F.col("_k")))
        return x.join(y, [*same, F.col("_k") == F.col("_k2"), F.col("_lcell") == F.col("_rcell"), first, meet]).select(*left.columns, *kept)

    def at_own(df: DataFrame, start: str, end: str, k: str, name: str, cells: str) -> DataFrame:
        return df.withColumn(name, F.col(k)).withColumn(cells, F.explode(_touched(F.col(start), F.col(end), F.col(name))))

    def above(df: DataFrame, start: str, end: str, k: str, name: str, cells: str, levels: list[int], strictly: bool) -> DataFrame:
        out = df.withColumn(name, F.explode(_array(levels)))
        out = out.where(F.col(name) > F.col(k) if strictly else F.col(name) >= F.col(k))
        return out.withColumn(cells, F.explode(_touched(F.col(start), F.col(end), F.col(name))))

    one = joined(at_own(own, a, b, "_lk", "_k", "_lcell"), above(theirs, "_start", "_end", "_rk", "_k2", "_rcell", up_right, False))
    two = joined(above(own, a, b, "_lk", "_k", "_lcell", up_left, True), at_own(theirs, "_start", "_end", "_rk", "_k2", "_rcell"))
    return one.union(two)


def _block(ticks: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are no later than ticks, by halving."""
    table = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(bounds).bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(table, at + step - 1) <= ticks, step).otherwise(0))


def _until(marks: DataFrame, points: DataFrame, keys: list[str], cuts: list[int]) -> DataFrame:
    """keys, _t and _n: for each distinct point _t the number of marks _t of its keys that aren't later."""
    rows = marks.select(*keys, "_t", F.lit(1).alias("_n"), F.lit(False).alias("_asked")).union(points.select(*keys, "_t", F.lit(0), F.lit(True)))
    each = rows.groupBy(*keys, "_t").agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked")).withColumn("_b", _block(F.col("_t"), cuts))
    along = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = each.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
    before = totals.select(*keys, "_b", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"), F.col("_asked").alias("_any")).where("_any").drop("_any")
    inside = Window.partitionBy(*keys, "_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("_n", F.sum("_n").over(inside)).where("_asked")
    return placed.join(before, [*keys, "_b"]).select(*keys, "_t", (F.col("_n") + F.col("_before")).alias("_n"))


def overlap_counts(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], on: tuple[str, ...] = ("path",), name: str = "n") -> DataFrame:
    """right's rows with the number of left's rows that overlap each, as `overlaps` pairs them; right's rows without length have none.

    Equal bounds are counted together before anything is put in order, and a task orders the bounds of one block.
    """
    (a, b), (c, d), keys = left_bounds, right_bounds, list(on)
    known = left.select(*keys, F.col(a).alias("_begin"), _tick_at_least(a, b).alias("_stop")).where("_begin IS NOT NULL").na.drop(subset=keys)
    asked = right.withColumn("_last", F.when(F.col(d) > F.col(c), F.col(d) - 1)).withColumn("_since", F.when(F.col(d) > F.col(c), F.col(c)))
    both = lambda df, one, two, point: df.select(F.explode(F.array(one, two)).alias("_t"), F.lit(point).alias("_point"))
    spread = both(known, "_begin", "_stop", False).union(both(asked, "_last", "_since", True))
    found = spread.agg(F.percentile_approx("_t", [k / BLOCKS for k in range(1, BLOCKS)]), F.max(F.when(F.col("_point"), F.col("_t")))).first()
    cuts, latest = sorted(set(found[0] or [])), F.lit(found[1]).cast("bigint")

    def until(ends: str, points: str) -> DataFrame:
        marks = known.select(*keys, F.col(ends).alias("_t")).where(F.col("_t") <= latest)
        return _until(marks, asked.select(*keys, F.col(points).alias("_t")).where("_t IS NOT NULL"), keys, cuts).withColumnRenamed("_t", points)

    begun, ended = until("_begin", "_last").withColumnRenamed("_n", "_begun"), until("_stop", "_since").withColumnRenamed("_n", "_ended")
    met = asked.join(begun, [*keys, "_last"], "left").join(ended, [*keys, "_since"], "left")
    return met.select(*right.columns, F.coalesce(F.col("_begun") - F.col("_ended"), F.lit(0)).alias(name))
