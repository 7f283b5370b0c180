"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signatures follow C-MinHash (Li and Li, 2021): one permutation of the universe breaks up the structure of a
set, a second one gives every coordinate of the signature, shifted circularly by one place for each. Documents
that agree on all rows of a band are candidates. Links are confirmed on the full sets.

Connected components are what is wanted, so no pairs inside a component are listed. Documents with the same
set are one class. Each class is first checked against the smallest class of its buckets, one pair for each.
Buckets that then still hold several components are compared in tiles by sketches of the signatures, which
joins components that may be near enough to families; outside a family no link is left to find. Inside, tiles
of full sets are compared exactly. Both go in rounds: each component keeps one edge, what is joined becomes one
component, and only groups that still hold several are compared again. A round writes at most one edge for each
component, whatever the size of its groups, and at least halves the components that have a link.

What grows how: edges and rows outside tasks grow with the documents. Members of a group are compared with each
other inside tasks, unless they are known to be of one component: a component that fills a tile has tiles of
its own, which are never paired. A row goes to as many tasks as its group has other tiles. A bucket where these
are more than SUB_BANDS for each row (one frequent passage, and little else in common) is dealt by four further
places of the signature into sub-buckets, SUB_BANDS for each row, if those send fewer rows: then n members send
about SUB_BANDS * n. A pair at 80 per cent meets in none of them with a chance of 4e-9. What stays quadratic are
members in different components that agree almost to the threshold: of n such, each goes to n / TILE tiles.
Tiles of full sets are measured in slots of bytes, so long texts fill them as many short ones do. No bucket is
capped. Scratch tables are removed once no later step reads them.

Defined results. A null or blank text has an empty set and is linked with nothing: it is its own component and
is kept. A text of fewer words than a shingle has one shingle, its whole sequence. Rows with the same text are
one class; the smallest doc_id stays. Rows with the same doc_id are one document: it is linked with whatever
one of its texts is linked with, and `drop_near_copies` keeps or drops all its rows. Texts are read whole,
whatever their length. Null doc_ids link with nothing, have a null component and are kept. An empty table gives
an empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .components import components
from .textbatch import map_groups, map_texts

UNIVERSE_BITS = 20
BANDS, ROWS = 28, 5
LENGTH = BANDS * ROWS
SEED = 20240229
#: The share of equal sketch bytes of a pair at the threshold lies below it by more than this with a chance of 4e-7 (at 85 per cent).
SKETCH_SLACK = 0.15
#: Classes that are compared together: by sketches in a bucket, by sets in a family; a set takes a slot for each SLOT_BYTES.
TILE, FAMILY_TILE = 512, 256
SLOT_BYTES = 1 << 16
#: Sub-buckets of a member of a large bucket: sub-band k has the places k, k + SUB_BANDS, ... of the sketch, at most one of any band.
SUB_ROWS = 4
SUB_BANDS = LENGTH // SUB_ROWS
_WORDS: dict[bytes, int] = {}


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second one written so that LENGTH shifted values stand side by side."""
    random, size = np.random.default_rng(SEED), 1 << UNIVERSE_BITS
    first, second = random.permutation(size).astype(np.uint32), random.permutation(size).astype(np.uint32)
    around = np.concatenate([second[-(LENGTH - 1) :], second])
    return first, np.lib.stride_tricks.sliding_window_view(around, LENGTH)


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams of a text."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    known, hashed = _WORDS, xxhash.xxh3_64_intdigest
    ids = [known.get(w) or known.setdefault(w, hashed(w)) for w in words]
    h = np.array(ids, np.uint64)
    with np.errstate(over="ignore"):
        if len(h) < n:
            return np.array([hashed(b" ".join(words), seed=len(words))], np.uint64)
        out = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def signature(items: np.ndarray) -> np.ndarray:
    """LENGTH minima of a non-empty set under the shifted permutation."""
    first, second = _permutations()
    at = first[(items >> np.uint64(64 - UNIVERSE_BITS)).astype(np.intp)]
    least = np.full(LENGTH, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(at), 4096):
        np.minimum(least, second[at[i : i + 4096]].min(0), out=least)
    return least


def _band_keys(sig: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(sig[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b) - (1 << 63) for b in range(BANDS)]


def _signed(keys: list, texts: list[str], n: int) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": keys, "n_shingles": [], "class_key": [], "bands": [], "sketch": []}
    for text in texts:
        items = shingles(text, n)
        out["n_shingles"].append(len(items))
        if len(items):
            sig = signature(items)
            out["class_key"].append(xxhash.xxh3_128_digest(items.tobytes()))
            out["bands"].append(_band_keys(sig))
            out["sketch"].append(((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes())
        else:
            for c in ("class_key", "bands", "sketch"):
                out[c].append(None)
    return out


def _sets(keys: list, texts: list[str], n: int) -> dict[str, list]:
    items = [shingles(t, n).tobytes() for t in texts]
    return {"doc_id": keys, "slots": [max(1, -(-len(x) // SLOT_BYTES)) for x in items], "items": items}


class _Joined:
    """Components that a task has joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            x = self.up[x] = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def edges(self) -> dict[str, np.ndarray] | None:
        """Each joined component once with the smallest of its tree, and that one with the next."""
        nodes = sorted(self.up)
        pairs = [(x, self.root(x)) for x in nodes]
        pairs = [(x, y) for x, y in pairs if x != y]
        if not pairs:
            return None
        pairs += [(y, x) for y, x in {y: x for x, y in reversed(pairs)}.items()]
        return {"a": np.array([x for x, _ in pairs], np.int64), "b": np.array([y for _, y in pairs], np.int64)}


def _joins(near: Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]], percent: int):
    """The components of two tiles that `near` links, as trees.

    near takes the group's rows and gives a function of a row and other rows that returns those of them linked with it.
    """

    def rows(group: pa.Table) -> dict[str, np.ndarray] | None:
        now, sizes, side = (group.column(c).to_numpy().copy() for c in ("component", "n_shingles", "side"))
        if (now == now[0]).all():
            return None
        linked, joined = near(group), _Joined()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        for x in left:
            others = right[(now[right] != now[x]) & (100 * np.minimum(sizes[right], sizes[x]) >= percent * np.maximum(sizes[right], sizes[x]))]
            for y in linked(x, others) if len(others) else ():
                if now[x] != now[y]:
                    joined.join(int(now[x]), int(now[y]))
                    low, high = sorted((now[x], now[y]))
                    now[now == high] = low
        return joined.edges()

    return rows


def _by_sketch(percent: int):
    """Rows whose sketches leave a link possible."""
    least = int(LENGTH * (percent / 100 - SKETCH_SLACK))

    def near(group: pa.Table):
        sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, LENGTH)
        return lambda x, others: others[(sketches[others] == sketches[x]).sum(1) >= least]

    return near


def _by_sets(percent: int):
    """Rows linked on their full sets."""

    def near(group: pa.Table):
        items = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
        sizes = np.array([len(x) for x in items])
        _, number = np.unique(np.concatenate(items), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(number), bool)

        def linked(x: int, others: np.ndarray) -> Iterator[int]:
            own = number[starts[x] : starts[x + 1]]
            mark[own] = True
            both = np.array([np.count_nonzero(mark[number[starts[y] : starts[y + 1]]]) for y in others])
            mark[own] = False
            return others[100 * both >= percent * (sizes[x] + sizes[others] - both)]

        return linked

    return near


def _tile_pairs(rows: DataFrame, group: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Each row once for every pair of tiles that its tile is in and that may hold links between components.

    A component that fills a tile has tiles of its own, and no two of them are paired; smaller ones share tiles.
    The second table is a written one, to be dropped after use.
    """
    counted = rows.groupBy(group, "component").agg(F.sum("slots").alias("m"))
    small = f"m < {size}"
    totals = counted.groupBy(group).agg(F.sum(F.expr(f"IF({small}, m, 0)")).alias("few"))
    placed = written(counted.join(totals, group).select(group, "component", F.expr(f"IF({small}, NULL, component)").alias("owner"), F.ceil(F.expr(f"IF({small}, few, m)") / size).cast("int").alias("parts")), "places")
    tiles = placed.select(group, F.struct("owner", "parts").alias("of")).distinct().select(group, "of.owner", F.explode(F.sequence(F.lit(0), F.col("of.parts") - 1)).alias("part"))
    tiles = tiles.select(group, F.struct(F.coalesce("owner", F.lit(-(1 << 63))).alias("owner"), "part").alias("tile"))
    pairs = tiles.withColumnRenamed("tile", "i").join(tiles.withColumnRenamed("tile", "j"), group).where(f"i <= j AND (i.owner <> j.owner OR i.owner = {-(1 << 63)}L)")
    named = pairs.withColumn("pair", F.xxhash64("i", "j"))
    ends = named.withColumn("end", F.explode(F.expr("IF(i = j, array(struct(i AS tile, 2 AS side)), array(struct(i AS tile, 0 AS side), struct(j AS tile, 1 AS side)))")))
    spread = F.when(F.col("owner").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("doc_id"))
    at = rows.join(placed, [group, "component"]).withColumn("tile", F.struct(F.coalesce("owner", F.lit(-(1 << 63))).alias("owner"), F.pmod(spread, "parts").cast("int").alias("part")))
    return at.drop("owner", "parts").join(ends.select(group, "end.tile", "pair", "end.side"), [group, "tile"]).drop("tile"), placed


def _sub_buckets(rows: DataFrame, size: int) -> DataFrame:
    """rows (of buckets, in `band`) with large buckets dealt into sub-buckets, where that sends fewer rows than tiles do."""
    counted = rows.groupBy("band", "component").agg(F.count("*").alias("m"))
    sums = counted.groupBy("band").agg(
        F.sum("m").alias("n"),
        F.ceil(F.sum(F.expr(f"IF(m < {size}, m, 0)")) / size).alias("shared"),
        F.sum(F.expr(f"IF(m < {size}, 0, CEIL(m / {size}))")).alias("own"),
        F.sum(F.expr(f"IF(m < {size}, 0, m * CEIL(m / {size}))")).alias("unpaired"),
    )
    large = written(sums.select("band", "n", F.expr("n * (shared + own) - unpaired").alias("sent")).where(f"sent > {SUB_BANDS} * n"), "large")
    if large.isEmpty():
        drop_written(large)
        return rows
    places = ", ".join(f"substring(sketch, k + {i * SUB_BANDS}, 1)" for i in range(SUB_ROWS))
    dealt = rows.join(large, "band", "left_semi").select("band", "doc_id", "component", F.explode(F.expr(f"transform(sequence(1, {SUB_BANDS}), k -> xxhash64(band, k, {places}))")).alias("part"))
    parts = dealt.groupBy("band", "part").agg(F.count("*").alias("m"), F.min("component").alias("least"), F.max("component").alias("most"))
    parts = written(parts.where("least < most").select("band", "part", "m"), "parts")
    cost = large.join(parts.groupBy("band").agg(F.sum(F.expr(f"m * CEIL(m / {size})")).alias("parted")), "band", "left")
    split = written(cost.where("coalesce(parted, 0) < sent").select("band"), "split")
    met = dealt.join(parts.join(split, "band", "left_semi").select("band", "part"), ["band", "part"], "left_semi").drop("component").distinct()
    moved = met.join(rows, ["band", "doc_id"]).withColumn("band", F.col("part")).select(rows.columns)
    out = written(rows.join(split, "band", "left_anti").select(rows.columns).unionByName(moved), "mixed")
    for done in (large, parts, split, rows):
        drop_written(done)
    return out


def _contracted(rows: DataFrame, group: str, size: int, near, percent: int) -> DataFrame | None:
    """(node, component): the components of rows that `near` links in a group, each with the smallest it is joined with.

    rows: a written table of the groups that hold several components.

    In rounds: each component keeps one edge, the components so joined become one, and groups that hold several
    go on. A round writes at most one edge for each component and at least halves those that have a link.
    """
    joined = None
    while not rows.isEmpty():
        paired, placed = _tile_pairs(rows, group, size)
        met = map_groups(paired, [group, "pair"], "a bigint, b bigint", _joins(near, percent))
        edges = written(met.groupBy("a").agg(F.min("b").alias("b")), "joins")
        drop_written(placed)
        if edges.isEmpty():
            break
        found = components(edges)
        again = written(_several(_relabelled(rows, found), group), "mixed")
        then = found if joined is None else written(_composed(joined, found), "joined")
        for done in (edges, rows, *(() if joined is None else (joined, found))):
            drop_written(done)
        joined, rows = then, again
    drop_written(rows)
    return joined


def _composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """The labels (node, component) of first, whose components then joins, and those that only then has."""
    moved = first.join(then.toDF("component", "now"), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return moved.unionByName(then.join(first.select("node"), "node", "left_anti"))


def _several(rows: DataFrame, group: str) -> DataFrame:
    """The rows of groups that hold more than one component."""
    mixed = rows.groupBy(group).agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    return rows.join(mixed.select(group), group, "left_semi")


def _relabelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.toDF("component", "now"), "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now")


def _star_links(stars: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (leader, member) whose full sets are near enough. Sets are made of the texts of pairs only.

    The members of a leader are dealt to parts; its set goes once to each part, not to each member.
    """
    wanted = stars.select(F.explode(F.array("leader", "member")).alias("doc_id")).distinct()
    sets = _written_sets(docs.join(wanted, "doc_id", "left_semi"), n)
    sizes = sets.select(F.col("doc_id").alias("member"), "slots")
    parts = stars.join(sizes, "member").groupBy("leader").agg(F.ceil(F.sum("slots") / TILE).cast("int").alias("parts"))
    members = stars.join(parts, "leader").select("leader", F.pmod(F.xxhash64("member"), "parts").alias("part"), F.col("member").alias("doc_id"))
    leaders = parts.select("leader", F.explode(F.expr("sequence(0L, parts - 1L)")).alias("part"), F.col("leader").alias("doc_id"))
    together = members.union(leaders).join(sets.drop("slots"), "doc_id")

    def rows(group: pa.Table) -> dict[str, np.ndarray] | None:
        leader, ids = group.column("leader")[0].as_py(), group.column("doc_id").to_numpy()
        items = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
        own = [x for x, d in zip(items, ids, strict=True) if d == leader]
        good = [d for x, d in zip(items, ids, strict=True) if d != leader and any(_near(x, y, percent) for y in own)]
        return {"a": np.full(len(good), leader, np.int64), "b": np.array(good, np.int64)} if good else None

    links = written(map_groups(together, ["leader", "part"], "a bigint, b bigint", rows), "links")
    drop_written(sets)
    return links


def _written_sets(docs: DataFrame, n: int) -> DataFrame:
    return written(map_texts(docs, "doc_id bigint, slots bigint, items binary", lambda k, t: _sets(k, t, n)).distinct(), "sets")


def _near(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id (the smallest doc_id with the same set).

    Documents are linked if 100 * intersection >= percent * union; percent is at least 70, for which the bands
    are laid out: a pair at 80 is missed with a chance of 1.5e-5, at 85 of 1e-7.
    """
    if percent < 70:
        raise ValueError("the bands are laid out for 70 per cent or more")
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = written(map_texts(read, "doc_id bigint, n_shingles bigint, class_key binary, bands array<bigint>, sketch binary", lambda k, t: _signed(k, t, words)), "signed")
    classes = written(signed.where("class_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("class_key").agg(F.min("doc_id").alias("class_id")), "classes")
    labelled = written(signed.select("doc_id", "n_shingles", "class_key").join(classes, "class_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")), "labelled")
    # A doc_id with several texts holds their classes together.
    repeated = labelled.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("most")).where("a < most").select("doc_id", "a")
    same_id = labelled.join(repeated, "doc_id").select("a", F.col("class_id").alias("b")).where("a < b").distinct()
    firsts = signed.join(classes, (signed["class_key"] == classes["class_key"]) & (signed["doc_id"] == classes["class_id"]), "left_semi")
    firsts = written(firsts.select("doc_id", "n_shingles", "bands", "sketch").distinct(), "firsts")
    for done in (signed, classes):
        drop_written(done)
    banded = firsts.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min(F.struct("doc_id", "n_shingles")).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = written(shared.select("band", F.col("first.doc_id").alias("leader"), F.col("first.n_shingles").alias("leader_size")), "shared")
    members = written(banded.join(shared, "band"), "members")
    # Sets whose sizes alone keep them apart aren't fetched.
    sized = members.where(f"leader < doc_id AND 100 * least(n_shingles, leader_size) >= {percent} * greatest(n_shingles, leader_size)")
    stars = written(sized.groupBy(F.col("doc_id").alias("member")).agg(F.min("leader").alias("leader")), "stars")
    links = _star_links(stars, read, words, percent)
    linked = components(links.union(same_id))
    found = written(linked, "components")
    parted = _relabelled(members.select("band", "doc_id", F.col("doc_id").alias("component")), found)
    sketched = _several(parted, "band").join(firsts.select("doc_id", "n_shingles", F.lit(1).cast("bigint").alias("slots"), "sketch"), "doc_id")
    mixed = written(sketched, "mixed")
    for done in (shared, members, stars, links, linked):
        drop_written(done)
    families = _contracted(_sub_buckets(mixed, TILE), "band", TILE, _by_sketch(percent), percent)
    if families is not None:
        named = families.toDF("component", "family")
        relatives = written(_relabelled(firsts.select("doc_id", F.col("doc_id").alias("component")), found).join(named, "component").distinct(), "relatives")
        sets = _written_sets(read.join(relatives.select("doc_id"), "doc_id", "left_semi"), words)
        sized = relatives.join(sets, "doc_id").withColumn("n_shingles", (F.octet_length("items") / 8).cast("bigint"))
        mixed = written(_several(sized, "family"), "mixed")
        for done in (families, relatives, sets):
            drop_written(done)
        more = _contracted(mixed, "family", FAMILY_TILE, _by_sets(percent), percent)
        if more is not None:
            joined = written(_composed(found, more), "components")
            for done in (found, more):
                drop_written(done)
            found = joined
    drop_written(firsts)
    out = labelled.join(found.toDF("class_id", "c"), "class_id", "left")
    component = F.coalesce("c", "class_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "class_id")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that stay, one of each component, with the columns of docs."""
    out = near_duplicates(docs, text=text, doc_id=doc_id, **options).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(out, docs[doc_id] == out["_gone"], "left_anti")
