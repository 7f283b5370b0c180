"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target number of words. A source repeats all of its documents as often as the target
allows, and fits what remains of the budget: documents are counted by exact length, the budget is shared over
all lengths in proportion to their counts (rounded at places that a seed shifts, so every length is as likely as
any other), some of the chosen documents are given back, and a bounded-knapsack dynamic programme over the
counts closes that last gap of a few thousand words. Which documents of a length are taken is decided by a
seeded hash of doc_id.

The total is the nearest one to the budget, above or below it, that documents of the source can make, whenever
the gap can be closed exactly within ROOMS words; it nearly always can, as lengths have no common divisor but
one that is taken out first. If all the source's words are fewer than the largest room, it always is.

Defined results. A null text has size 0, as an empty one; such documents are taken 0 times more than their
source's full repeats, which adds no words. A null source is a source of its own, the last one. Repeated rows
and rows with the same doc_id are documents of their own; ties of the seeded hash are broken by doc_id, and
then by the text, so a rerun takes the same documents however the
input is cut; rows that are equal in all are interchangeable. Long texts are counted whole. An empty table gives an empty
result. Other columns, whatever their names, don't matter to `plan` and are returned by `mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_WORD, written

#: No document is taken more often than this.
MOST_REPEATS = 3
#: Up to so many sources their totals are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Documents of one source and length that are ranked together.
RANKED_TOGETHER = 512
#: Words that are left to the dynamic programme; the next room is tried if the budget isn't met exactly.
ROOMS = (1 << 12, 1 << 14, 1 << 16)
#: Bits that one run of the dynamic programme keeps at most; lengths beyond are left as they are.
DP_BITS = 1 << 31


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (1, 2, 3), cap: float = MOST_REPEATS) -> dict[str | None, float]:
    """Words for each source: shares by weight of all words, none above cap times its source's words.

    Sources stand in code point order, null last, and take the weights in turn. What is cut off a target is
    shared by weight among those that aren't at their cap, until none is above it.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if share[s] > cap * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def _shares(counts: np.ndarray, share: float, shift: float) -> np.ndarray:
    """counts times share in whole numbers, rounded so that every stretch of lengths gets its part to within one."""
    ends = np.floor(np.cumsum(counts) * share + shift)
    return np.minimum(np.diff(ends, prepend=np.floor(shift)).astype(np.int64), counts)


def _subset_sum(lengths: np.ndarray, counts: np.ndarray, goal: int, order: np.ndarray) -> tuple[int, np.ndarray]:
    """The sum nearest to goal that counts of lengths make, and how many of each length make it."""
    most = goal + int(lengths.max())
    within, reach, steps, take = (1 << (most + 1)) - 1, 1, [], np.zeros_like(counts)
    for i in order:
        size = int(lengths[i])
        n, part = min(int(counts[i]), most // size), 1
        if reach >> goal & 1 or len(steps) * most > DP_BITS:
            break
        while n > 0:
            k = min(part, n)
            steps.append((int(i), k, reach))
            reach |= (reach << (k * size)) & within
            n, part = n - k, part * 2
    at, above = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1, reach >> (goal + 1)
    over = goal + (above & -above).bit_length() if above else None
    if over is not None and over - goal < goal - at:
        at = over
    total = at
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * int(lengths[i])
    return total, take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int | Sequence[int] = 17) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near to budget as they can.

    lengths: distinct, positive, ascending.
    """
    words = int((lengths * counts).sum())
    if budget >= words or not words:
        return counts.copy()
    random = np.random.default_rng(seed)
    unit = int(np.gcd.reduce(lengths))
    lengths, words, goal = lengths // unit, words // unit, (2 * budget + unit) // (2 * unit)
    shared = _shares(counts, goal / words, random.random())
    order, best = random.permutation(len(lengths)), None
    for room in ROOMS:
        take = shared.copy()
        left = goal - int((take * lengths).sum())
        if words <= room:
            take[:], left = 0, goal
        # Too much is given back, then room is made; too little is filled up. Each in the seed's order of lengths.
        while left < 0 or left < min(room, goal):
            given = [i for i in order if take[i] and (left < 0 or lengths[i] <= room - left)]
            if not given:
                break
            for i in given:
                if take[i] and left < min(room, goal) and (left < 0 or lengths[i] <= room - left):
                    take[i] -= 1
                    left += int(lengths[i])
        while left > room:
            fits = [i for i in order if take[i] < counts[i] and lengths[i] <= left - room // 2]
            if not fits:
                break
            for i in fits:
                if lengths[i] <= left - room // 2:
                    take[i] += 1
                    left -= int(lengths[i])
        total, more = _subset_sum(lengths, counts - take, left, order)
        if best is None or abs(total - left) < best[0]:
            best = abs(total - left), take + more
        if not best[0]:
            break
    return best[1]


def _fit_source(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    lengths, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    some = lengths > 0
    take = np.zeros(len(rows), np.int64)
    take[some] = fit(lengths[some], counts[some], int(rows["budget"].iloc[0]), [seed, int(rows["source_index"].iloc[0])])
    return rows.assign(extra=take)[["source_index", "size", "n", "extra"]]


def plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = 17, text: str = "text", doc_id: str = "doc_id", source: str = "source", uid: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken; and uid, the row's number: the column of
    that name if given, which must be unique, or else a new one.

    Only ids, sources and sizes are shuffled. The driver gets one row for each source.
    """
    spark = docs.sparkSession
    number = F.monotonically_increasing_id() if uid is None else F.col(uid)
    sized = written(docs.select(number.alias("uid"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash")), "sized")
    totals = {r[0]: int(r[1]) for r in sized.groupBy("source").agg(F.sum("size")).collect()}
    goal = targets(totals, weights)
    rows = []
    for i, s in enumerate(sorted(totals, key=lambda s: (s is None, s or ""))):
        full = min(MOST_REPEATS, int(goal[s] // totals[s])) if totals[s] else 0
        rows.append((i, s, totals[s], goal[s], full, 0 if full == MOST_REPEATS else round(goal[s]) - full * totals[s]))
    by_source = spark.createDataFrame(rows, "source_index int, source string, source_size bigint, target double, full int, budget bigint")
    bounded = F.broadcast if len(rows) <= BROADCAST_SOURCES else lambda df: df
    placed = sized.join(bounded(by_source.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    counted = placed.groupBy("source_index", "size", "budget").agg(F.count("*").alias("n"))
    fitted = written(counted.groupBy("source_index").applyInPandas(lambda rows: _fit_source(rows, seed), "source_index int, size bigint, n bigint, extra bigint"), "fitted")
    # A length with very many documents is ranked in parts; the parts are filled in their order.
    hashed = F.xxhash64(F.lit(seed), "doc_id")
    parts = written(placed.join(fitted, ["source_index", "size"]).withColumn("h", hashed).withColumn("part", F.pmod("h", F.ceil(F.col("n") / RANKED_TOGETHER))), "parts")
    split = parts.where((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    key = ["source_index", "size", "part"]
    before = Window.partitionBy("source_index", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    quota = split.groupBy(*key, "extra").agg(F.count("*").alias("m")).withColumn("quota", F.col("extra") - F.coalesce(F.sum("m").over(before), F.lit(0)))
    chosen = split.join(written(quota.where("quota > 0").select(*key, "quota"), "quota"), key).withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id", "text_hash", "uid"))).where("rank <= quota").select("uid", F.lit(1).alias("picked"))
    times = F.col("full") + F.when(F.col("extra") >= F.col("n"), 1).otherwise(F.coalesce("picked", F.lit(0)))
    return parts.join(chosen, "uid", "left").select("uid", "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.cast("int").alias("times"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs.

    Documents without words are left out. docs is numbered once and written with its numbers, as another scan of
    it may be cut and numbered differently when executors come or go.
    """
    name = "wavelake_uid"
    while name in docs.columns:
        name += "_"
    numbered = written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    chosen = plan(numbered, uid=name, **options).where("taken > 0").select(F.col("uid").alias(name), F.col("times").alias(f"{name}times"))
    joined = numbered.join(chosen, name)
    return joined.withColumn(f"{name}n", F.explode(F.sequence(F.lit(1), F.col(f"{name}times")))).select(*docs.columns)
