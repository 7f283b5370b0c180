"""Connected components by alternating star contraction (Kiveris et al., "Connected Components in MapReduce and Beyond").

Every round keeps at most the number of edges it was given. The smallest neighbour of each node is aggregated
(with map-side combining) and written before it is joined back, so that both sides of the join are plain
exchanges and adaptive execution can split the partition of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _with_smallest(directed: DataFrame) -> DataFrame:
    """u, v of each edge and m, the smallest of u and all v beside it."""
    least = written(directed.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    return directed.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _with_smallest(down).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = down.groupBy("u").agg(F.min("v").alias("v"))
    return met.union(kept)


def _is_stars(edges: DataFrame) -> bool:
    """Whether each u has one v only and no v is a u: then every component is a star around its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select(F.col("v"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 AND down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    edges: two columns of bigint, any direction, loops and repeats allowed, nulls dropped. Nodes without
    another node beside them aren't returned. An empty table gives an empty table.
    """
    a, b = edges.columns
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_stars(now):
        large = written(_large_star(now).where("u <> v").distinct(), "large")
        then = written(_small_star(large).where("u <> v").distinct(), "small")
        for done in (large, now):
            drop_written(done)
        now = then
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
