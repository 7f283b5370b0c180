"""Near-duplicate vectors by tiled comparison in the order of principal components.

Vectors are made unit length and turned to the axes of their second moments, largest first. They are cut into
tiles along the first axis, and a task compares two tiles: it accumulates the product over the leading axes,
adds the bound that the norms of what is left of both vectors allow (Cauchy-Schwarz), and gives up pairs that
cannot reach the threshold; the others go on to the next axes. Tiles that are further apart on the first axis
than linked vectors can be never meet. What stays is decided by the cosine of the vectors as they came, in
double precision. Nothing is sampled or capped: turning only orders the work.

What grows how: a tile has at most MOST vectors, so a vector is sent to as many tasks as there are tiles within
reach, each time as its own components (in single precision where that loses nothing); tasks turn their tiles
themselves. Below MOST vectors a tile is as large as the cluster's cores allow. On vectors without any structure
all tiles are in reach: work and shuffle then grow with the square, with 1 / MOST in front of the shuffle.

Vectors that are equal in all components are one vector with a count. A task returns, for each of its vectors
with links, how many vectors it is linked with, and the edges of a spanning forest of its links; pairs aren't
listed.

Defined results. Vectors that are null, empty, zero or hold null or non-finite components are linked with
nothing, and so are vectors of another length than the one they are compared with. Ties: cosine equal to the
threshold is a link. Repeated rows are vectors of their own, each linked with the other; rows with the same
vec_id count as several. Null vec_ids are returned without links. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Vectors of a tile, about: never more than MOST; no fewer than LEAST to give every core a pair of tiles.
LEAST, MOST = 4096, 32_768
#: Axes that are accumulated before the first, second, ... bound is taken, as shares of all.
STEPS = (0.25, 0.5)
BLOCK = 1024
#: More than rounding to single precision can change in one coordinate.
SLACK = 1e-5
CHUNK = 1 << 20


def slack(axes: int) -> float:
    """More than single precision can change in a product of unit vectors: an error for each product and each sum."""
    return SLACK + 2 * axes * 2.0**-24


def _units(vectors: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(axes, places, vectors, unit vectors) of the vectors of each length; no square overflows or vanishes."""
    sizes = vectors.map(len).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = np.stack(vectors.iloc[at].to_list()).astype(np.float64)
        scaled = x / np.abs(x).max(1, keepdims=True)
        yield int(size), at, x, scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for size, _, _, unit in _units(b["embedding"]):
            sums[size] = sums.get(size, 0) + unit.T @ unit
    for size, m in sums.items():
        yield pd.DataFrame({"size": size, "i": np.repeat(np.arange(size), size), "j": np.tile(np.arange(size), size), "m": m.ravel()})


def _pack(vector: np.ndarray) -> bytes:
    """The components in single precision if that is exact, else in double."""
    single = vector.astype(np.float32)
    return single.tobytes() if np.array_equal(single.astype(np.float64), vector) else vector.tobytes()


def _unpack(packed: list[bytes], size: int) -> np.ndarray:
    if all(len(x) == 4 * size for x in packed):
        return np.frombuffer(b"".join(packed), np.float32).reshape(-1, size).astype(np.float64)
    return np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * size else np.float64) for x in packed]).astype(np.float64)


def _placed(axes: dict[int, np.ndarray]):
    """Packs vectors and gives their place on the first axis."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, at, x, unit in _units(b["embedding"]):
                yield pd.DataFrame({"id": b["id"].to_numpy()[at], "n": b["n"].to_numpy()[at], "size": size, "first": (unit @ axes[size][:, 0]).astype(np.float32), "vector": [_pack(v) for v in x]})

    return run


@dataclass(frozen=True)
class Tiles:
    """Slabs of the first axis, and the tiles of each: one, or more by a hash of the id where equal places fill a slab."""

    edges: np.ndarray
    parts: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.parts)])

    def slab(self, first: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges[1:-1], first, "right")

    def reached(self, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """For each slab the first and one past the last tile whose slab lies within reach."""
        low = np.searchsorted(self.edges[1:], self.edges[:-1] - reach, "left")
        high = np.searchsorted(self.edges[:-1], self.edges[1:] + reach, "right")
        return self.starts[np.minimum(low, len(self.parts) - 1)], self.starts[np.minimum(high, len(self.parts))]


def _slabs(tiles: Tiles):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            slab, n = np.unique(tiles.slab(b["first"].to_numpy()), return_counts=True)
            yield pd.DataFrame({"slab": slab, "n": n})

    return run


def _meets(tiles: Tiles, reach: float):
    """Each vector once for every pair (i, j) of tiles that its own tile is in."""
    low, high = tiles.reached(reach)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            slab = tiles.slab(b["first"].to_numpy())
            tile = tiles.starts[slab] + (b["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % tiles.parts[slab]
            step = max(1, (1 << 16) // int((high - low).max()))
            for k in range(0, len(b), step):
                own = slice(k, k + step)
                times = (high - low)[slab[own]]
                at = np.repeat(np.arange(k, k + len(times)), times)
                other = np.concatenate([np.arange(low[s], high[s]) for s in slab[own]])
                yield pd.DataFrame({"i": np.minimum(tile[at], other), "j": np.maximum(tile[at], other), "tile": tile[at]}).assign(**{c: b[c].to_numpy()[at] for c in ("id", "n", "size", "vector")})

    return run


class _Forest:
    """Union-find over row numbers, many edges at a time; roots are the smallest numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if np.array_equal(x, y):
                return x
            x = self.up[y]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def _candidates(p: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of p and q whose product may reach least, by accumulating axes and bounding the rest."""
    size = p.shape[1]
    stops = sorted({max(1, int(size * s)) for s in STEPS} - {size})
    stop = stops[0] if stops else size
    part = p[:, :stop] @ q[:, :stop].T
    rest = np.sqrt((p[:, stop:] ** 2).sum(1))[:, None] * np.sqrt((q[:, stop:] ** 2).sum(1))[None, :]
    a, b = np.nonzero(part + rest >= least - slack(size))
    if not stops:
        return a, b  # the first product was the whole one
    for stop, then in zip(stops, [*stops[1:], size], strict=True):
        if not len(a):
            break
        kept_a, kept_b = [], []
        left_p, left_q = np.sqrt((p[:, then:] ** 2).sum(1)), np.sqrt((q[:, then:] ** 2).sum(1))
        for k in range(0, len(a), CHUNK // 16):
            x, y = a[k : k + CHUNK // 16], b[k : k + CHUNK // 16]
            part[x, y] += np.einsum("ij,ij->i", p[x, stop:then], q[y, stop:then])
            good = part[x, y] + left_p[x] * left_q[y] >= least - slack(size)
            kept_a.append(x[good])
            kept_b.append(y[good])
        a, b = np.concatenate(kept_a), np.concatenate(kept_b)
    return a, b


def _compare(cosine: float, axes: dict[int, np.ndarray]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        rows = rows.sort_values(["size", "id"], kind="stable", ignore_index=True)
        forest, links = _Forest(len(rows)), np.zeros(len(rows), np.int64)
        tile, weight, ids = rows["tile"].to_numpy(), rows["n"].to_numpy(np.int64), rows["id"].to_numpy()
        for size, own in rows.groupby("size").indices.items():
            vector = _unpack(rows["vector"].iloc[own].to_list(), size)
            vector = vector / np.abs(vector).max(1, keepdims=True)
            length = np.sqrt((vector * vector).sum(1))
            turned = ((vector / length[:, None]) @ axes[size]).astype(np.float32)
            left, right = np.flatnonzero(tile[own] == i), np.flatnonzero(tile[own] == j)
            for s in range(0, len(left), BLOCK):
                for t in range(s if i == j else 0, len(right), BLOCK):
                    x, y = left[s : s + BLOCK], right[t : t + BLOCK]
                    a, b = _candidates(turned[x], turned[y], cosine)
                    for k in range(0, len(a), CHUNK // 16):
                        p, q = x[a[k : k + CHUNK // 16]], y[b[k : k + CHUNK // 16]]
                        good = np.einsum("ij,ij->i", vector[p], vector[q]) / (length[p] * length[q]) >= cosine
                        if i == j:
                            good &= p < q
                        p, q = own[p[good]], own[q[good]]
                        np.add.at(links, p, weight[q])
                        np.add.at(links, q, weight[p])
                        forest.join(p, q)
        some = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[forest.roots(some)]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. cosine is above 0.

    The driver gets the sums of second moments (as many numbers as axes squared) and one bound for each tile.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    read = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull()
    read = written(read.withColumn("embedding", F.when(usable, v)), "vectors")
    classes = written(read.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")
    sums = classes.select("embedding").mapInPandas(_moments, "size int, i int, j int, m double").groupBy("size", "i", "j").agg(F.sum("m").alias("m")).toPandas()
    axes = {}
    for size, own in sums.groupby("size"):
        m = np.zeros((size, size))
        m[own["i"], own["j"]] = own["m"]
        axes[int(size)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    placed = written(classes.mapInPandas(_placed(axes), "id bigint, n bigint, size int, first float, vector binary"), "placed")
    total = placed.count()
    tiles = max(-(-total // MOST), min(-(-total // LEAST), int(np.ceil(np.sqrt(2 * spark.sparkContext.defaultParallelism)))), 1)
    bounds = sorted(set(placed.approxQuantile("first", [k / tiles for k in range(1, tiles)], 0.1 / tiles))) if tiles > 1 else []
    slabs = Tiles(np.array([-2.0, *bounds, 2.0]), np.ones(len(bounds) + 1, np.int64))
    held = placed.select("first").mapInPandas(_slabs(slabs), "slab int, n bigint").groupBy("slab").agg(F.sum("n").alias("n")).toPandas()
    parts = np.ones(len(bounds) + 1, np.int64)
    parts[held["slab"]] = -(-held["n"] // MOST)
    # Unit vectors that are linked differ by at most this on any axis.
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    meets = placed.mapInPandas(_meets(Tiles(slabs.edges, parts), reach), "i int, j int, tile int, id bigint, n bigint, size int, vector binary")
    compared = written(meets.groupBy("i", "j").applyInPandas(_compare(cosine, axes), "id bigint, links bigint, root bigint"), "compared")
    degree = compared.groupBy("id").agg(F.sum("links").alias("links"))
    joined = written(components(compared.select("id", "root")), "vector-components")
    known = written(classes.join(degree, "id", "left").join(joined.toDF("id", "c"), "id", "left").select("embedding", "id", F.coalesce("links", F.lit(0)).alias("links"), "n", F.coalesce("c", "id").alias("component")), "vector-labels")
    out = read.join(known.withColumnRenamed("embedding", "e"), F.col("embedding") == F.col("e"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
