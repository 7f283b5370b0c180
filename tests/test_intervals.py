"""Joins by dyadic cells against all pairs, with lengths from none to all of time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from wavelake.operators import annotations as A
from wavelake.operators import intervals as I
from wavelake.operators import timeline as L

MOST, LEAST = 2**63 - 1, -(2**63)


def stretches(n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        start = r.choice([r.randrange(-50, 50), r.randrange(LEAST, MOST), r.randrange(-(2**40), 2**40)])
        length = r.choice([0, 1, 2, 3, r.randrange(40), r.randrange(2**41), 3 * 10**17, MOST])
        rows.append((k, f"p{r.randrange(2)}", start, min(MOST, start + length)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_points_in_intervals(spark, seed):
    r, rows = random.Random(seed), stretches(60, seed)
    points = [(k, f"p{r.randrange(2)}", r.choice([x for _, _, a, b in rows for x in (a, b - 1 if b > LEAST else b, b)] + [LEAST, MOST, 0])) for k in range(120)]
    found = I.points_in(spark.createDataFrame(points, "point int, path string, ticks bigint"), spark.createDataFrame(rows, "i int, path string, start_ticks bigint, end_ticks bigint"))
    assert sorted((x.point, x.i) for x in found.collect()) == sorted((k, i) for k, p, t in points for i, q, a, b in rows if p == q and a <= t < b)


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_intervals(spark, seed):
    one, two = stretches(70, seed), stretches(50, seed + 10)
    left = spark.createDataFrame(one, "x int, path string, a bigint, b bigint")
    right = spark.createDataFrame(two, "y int, path string, c bigint, d bigint")
    found = I.overlaps(left, right, ("a", "b"), ("c", "d"))
    end = lambda a, b: max(b, a + 1)  # noqa: E731  an instant is the tick it stands at
    assert sorted((r.x, r.y) for r in found.collect()) == sorted((x, y) for x, p, a, b in one for y, q, c, d in two if p == q and a < end(c, d) and c < end(a, b))


@pytest.mark.parametrize("seed", range(3))
def test_counts_of_overlaps(spark, seed):
    """As many as there are pairs, for windows that stand twice too; those without length, path or start have none."""
    one, two = stretches(70, seed), stretches(50, seed + 10)
    two += [(100, *two[3][1:]), (101, None, 0, 9), (102, "p0", None, 9), (103, "none", 0, 9)]
    left = spark.createDataFrame([*one, (70, None, 0, 9), (71, "p0", None, None)], "x int, path string, a bigint, b bigint")
    right = spark.createDataFrame([*two, two[0]], "y int, path string, c bigint, d bigint")
    found = I.overlap_counts(left, right, ("a", "b"), ("c", "d"))
    assert found.columns == ["y", "path", "c", "d", "n"]
    many = lambda q, c, d: 0 if c is None or d <= c else sum(p == q and a < d and c < max(b, a + 1) for _, p, a, b in one)
    assert sorted((r.y, r.n) for r in found.collect()) == sorted((y, many(q, c, d)) for y, q, c, d in [*two, two[0]])


def test_counts_list_no_pairs(spark):
    """60,000 annotations without end and as many windows are 1.8 thousand million pairs."""
    n = 60_000
    notes = spark.range(n).selectExpr("'p' AS path", "id * 10 AS onset_ticks_from_first_record", "9223372036854775807 AS duration_ticks")
    windows = spark.range(n).selectExpr("'p' AS path", "id AS w", "id * 10 - 5 AS start_ticks", "id * 10 + 5 AS end_ticks")
    began = time.monotonic()
    found = A.count_in_windows(notes, windows).selectExpr("count(*)", "sum(n)", "count_if(n = w + 1)").first()
    assert time.monotonic() - began < 60
    assert tuple(found) == (n, n * (n + 1) // 2, n)


def test_levels():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    cases = [(0, 0, 0), (0, 1, 0), (0, 2, 1), (0, 3, 2), (-4, 4, 3), (0, 2**40, 40), (0, 2**40 + 1, 41), (LEAST, MOST, 63), (0, MOST, 63)]
    rows = spark.createDataFrame(cases, "a bigint, b bigint, k int").select("k", I.level(F.col("a"), F.col("b")).alias("found")).collect()
    assert all(r.k == r.found for r in rows)


def test_long_annotations_join_in_seconds_and_sums_are_held(spark):
    notes = [("p", 0, 3 * 10**17, "long"), ("p", 5, MOST, "all"), ("p", 10**9, None, "instant"), ("p", MOST - 3, MOST, "last")]
    df = spark.createDataFrame(notes, "path string, onset_ticks_from_first_record bigint, duration_ticks bigint, text string")
    windows = spark.createDataFrame([(k, "p", k * 10**7, (k + 1) * 10**7) for k in range(0, 2000)] + [(-1, "p", MOST - 5, MOST)], "w int, path string, start_ticks bigint, end_ticks bigint")
    began = time.monotonic()
    found = {}
    for r in A.in_windows(df, windows).collect():
        found.setdefault(r.text, []).append(r.w)
    assert time.monotonic() - began < 60
    assert len(found["long"]) == 2000 and len(found["all"]) == 2001 and found["instant"] == [100] and found["last"] == [-1]
    assert sorted(r.text for r in A.at(df, 60.0).collect()) == ["all", "long"]
    assert sorted(r.text for r in A.in_window(df, 50, 100).collect()) == ["all", "instant", "long"]
    points = spark.createDataFrame([("p", 7), ("p", 2**62)], "path string, ticks bigint")
    gaps = df.selectExpr("path", "text", "onset_ticks_from_first_record AS start_ticks", "CASE WHEN text = 'all' THEN 9223372036854775807 ELSE onset_ticks_from_first_record + coalesce(least(duration_ticks, 3), 0) END AS end_ticks")
    assert sorted((r.ticks, r.text) for r in L.intervals_at(points, gaps).collect()) == [(7, "all"), (2**62, "all")]


def test_empty_sides(spark):
    rows = spark.createDataFrame(stretches(5, 1), "x int, path string, start_ticks bigint, end_ticks bigint")
    none = rows.where("false")
    points = rows.selectExpr("path", "start_ticks AS ticks")
    assert I.points_in(points, none.drop("x")).count() == 0
    assert I.overlaps(rows, none.withColumnRenamed("x", "y"), ("start_ticks", "end_ticks"), ("start_ticks", "end_ticks")).count() == 0


def test_counts_of_empty_sides(spark):
    rows = spark.createDataFrame(stretches(5, 1), "x int, path string, start_ticks bigint, end_ticks bigint")
    none, ends = rows.where("false"), ("start_ticks", "end_ticks")
    assert I.overlap_counts(none, rows, ends, ends).where("n = 0").count() == 5
    assert I.overlap_counts(rows, none, ends, ends).count() == 0
