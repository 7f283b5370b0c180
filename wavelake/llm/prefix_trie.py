"""The prefix trie of conversations: what turns they share from their start on, and what sharing would save.

Every turn becomes an id (128 bits of a digest of role and text), every conversation the sequence of its turns' ids.
The sequences are dealt to shards by ranges of (sequence, conv_id). A shard lays its turn ids out as padded matrices,
a band of BAND columns at a time, so that one long conversation doesn't widen the others; `lexsort` orders the rows,
masks of changed columns are OR-accumulated, and where a mask is set a node starts: `reduceat` over those starts
aggregates each depth, from the deepest up.

A node is complete in its shard unless it lies on the path of the shard's first or last row. Those boundary nodes
recombine: summaries of FAN neighbouring shards meet in one task, which adds up what is the same node, completes
what no longer touches an end, and hands on a summary of the whole; rounds of this end with the root. A summary
holds two paths, whatever the shards hold. Ids of conversations that end at a boundary node are hashed in a stream
of one piece for each shard, so a conversation that a third of all are copies of is never gathered.

Defined results. Rows without conv_id are ignored. A null role or text is empty. Turns stand by turn, null first;
rows of one turn stand by role, then by digest of the text, and repeated rows are turns of their own. An empty table
has no root and gives no rows. Texts are digested and counted whole. Other columns, whatever their names, are
ignored. The ids of one conversation's turns (24 bytes each) are held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import SPACE_WORD, written
from .textbatch import map_groups

#: Columns of a matrix at a time, turns of a shard as planned, and neighbouring summaries that meet in a task.
BAND, SHARD_TURNS, FAN = 32, 400_000, 64
ID_BYTES = 16
#: Conversations of one family share the head of its first one: FAMILY consecutive ids, heads of up to HEADS - 1 turns.
FAMILY, HEADS = 20, 4
EMPTY = hashlib.sha256(b"").hexdigest()
CLOSED, OPEN, ENDS = 0, 1, 2
_PARTS = (
    "kind int, shard bigint, depth bigint, key binary, parent_key binary, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, words bigint, is_first boolean, is_last boolean, ends binary, ends_sha256 string"
)


def _gathered(conversations: DataFrame) -> DataFrame:
    """family, conv_id and turns (array of turn, role, id, words, in order) of each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 2 * ID_BYTES))
    turn = F.struct("turn", "role", digest.alias("id"), F.regexp_count("text", F.lit(SPACE_WORD)).cast("bigint").alias("words"))
    dealt = rows.select(F.expr(f"conv_id - conv_id % {FAMILY}").alias("family"), "conv_id", turn.alias("t")).repartition("family")
    return dealt.groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _sequences(gathered: DataFrame) -> DataFrame:
    """conv_id, key (the ids of its turns) and words (of each turn)."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    return gathered.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, key, words of every conversation as it is."""
    return _sequences(_gathered(conversations))


def with_shared_heads(conversations: DataFrame) -> DataFrame:
    """As `sequences`, of the rebuilt conversations: the first h turns of the family's first conversation, then the own turns after h.

    h is the unsigned crc32 of the decimal conv_id, modulo HEADS; the first conversation of conv_id c is c - c % FAMILY.
    """
    own = _gathered(conversations)
    heads = own.where("conv_id = family").select("family", F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    both = own.join(heads, "family", "left").withColumn("h", h)
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", F.lit(1), F.lit(0)))
    return _sequences(both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns")))


@dataclass
class _Level:
    """The nodes of one depth in order: smallest member, members, parent's place above, words, and whether they reach the shard's first or last row."""

    first: np.ndarray
    n: np.ndarray
    parent: np.ndarray
    words: np.ndarray
    ends: dict[int, np.ndarray]
    at_first: int = -1
    at_last: int = -1
    children: np.ndarray | None = None
    leaves: np.ndarray | None = None
    saved: np.ndarray | None = None


def _ranks(data: bytes) -> np.ndarray:
    """Dense numbers of the ids, in the order of their bytes."""
    high, low = np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, 2).T
    order = np.lexsort((low, high))
    new = np.concatenate([[0], (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)]) if len(order) else order
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def levels(conv: np.ndarray, lengths: np.ndarray, ids: np.ndarray, words: np.ndarray) -> tuple[list[_Level], tuple[int, int]]:
    """The nodes of each depth, the root first, and rows that hold the paths of the smallest and the largest sequence.

    conv: of each row; lengths: its turns; ids and words of all turns, row after row. ids order turns.
    """
    at = np.cumsum(lengths) - lengths
    none = np.flatnonzero(lengths == 0)
    none = none[np.argsort(conv[none], kind="stable")]
    out = [_Level(conv.min(keepdims=True), np.array([len(conv)]), np.array([-1]), np.array([0]), {0: conv[none]} if len(none) else {}, 0, 0)]
    rows, node, depth = np.arange(len(conv)), np.zeros(len(conv), np.int64), 0
    first = last = 0  # rows with the smallest and the largest sequence, as far as their paths are known
    on_first, on_last = not len(none), True
    while True:
        more = lengths[rows] > depth
        rows, node = rows[more], node[more]
        if not len(rows):
            break
        counts = np.minimum(lengths[rows] - depth, BAND)
        width = int(counts.max())
        line = np.repeat(np.arange(len(rows)), counts)
        column = np.arange(len(line)) - np.repeat(np.cumsum(counts) - counts, counts)
        matrix = np.full((len(rows), width), -1, np.int64)
        matrix[line, column] = ids[at[rows][line] + depth + column]
        order = np.lexsort((conv[rows], *matrix.T[::-1], node))
        rows, node, matrix = rows[order], node[order], matrix[order]
        # What ends at a node stands before what goes on from it.
        above = out[-1]
        on_first = on_first and above.at_first not in above.ends and node[0] == above.at_first
        on_last = on_last and node[-1] == above.at_last
        first, last = int(rows[0]) if on_first else first, int(rows[-1]) if on_last else last
        changed = np.ones(matrix.shape, bool)
        changed[1:] = matrix[1:] != matrix[:-1]
        changed[1:, 0] |= node[1:] != node[:-1]
        starting = np.logical_or.accumulate(changed, axis=1)
        own = conv[rows]
        for d in range(width):
            runs = np.flatnonzero(starting[:, d])
            sizes = np.diff(np.append(runs, len(rows)))
            real = matrix[runs, d] >= 0
            number = np.cumsum(real) - 1
            below = np.repeat(number, sizes)
            kept = runs[real]
            ending = np.flatnonzero(lengths[rows] == depth + d + 1)
            where, begin = np.unique(below[ending], return_index=True)
            ends = dict(zip(where.tolist(), np.split(own[ending], begin[1:]), strict=True)) if len(ending) else {}
            on_first, on_last = on_first and bool(matrix[0, d] >= 0), on_last and bool(matrix[-1, d] >= 0)
            out.append(
                _Level(
                    np.minimum.reduceat(own, runs)[real],
                    sizes[real],
                    node[kept],
                    words[at[rows[kept]] + depth + d],
                    ends,
                    int(below[0]) if on_first else -1,
                    int(below[-1]) if on_last else -1,
                )
            )
            node = below
        depth += width
    _sum_up(out)
    return out, (first, last)


def _sum_up(found: list[_Level]) -> None:
    """Children, leaves and saved tokens from the deepest level up. A boundary node counts its complete children only."""
    under: _Level | None = None
    for level in reversed(found):
        size = len(level.n)
        level.children, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
        if under is not None:
            closed = np.ones(len(under.n), np.int64)
            closed[[k for k in (under.at_first, under.at_last) if k >= 0]] = 0
            starts = np.flatnonzero(np.diff(under.parent, prepend=-2))
            at = under.parent[starts]
            for total, values in ((level.children, closed), (leaves, under.leaves * closed), (saved, under.saved * closed)):
                total[at] = np.add.reduceat(values, starts)
        open_ = np.zeros(size, bool)
        open_[[k for k in (level.at_first, level.at_last) if k >= 0]] = True
        level.leaves = np.where(~open_ & (level.children == 0), 1, leaves)
        level.saved = np.where(open_, 0, (level.n - 1) * level.words) + saved
        under = level


def _path(turns: bytes) -> list[bytes]:
    """A key for each prefix of a sequence, the empty one first."""
    made = hashlib.sha256()
    out = [made.digest()[:ID_BYTES]]
    for k in range(0, len(turns), ID_BYTES):
        made.update(turns[k : k + ID_BYTES])
        out.append(made.copy().digest()[:ID_BYTES])
    return out


def _joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _shard(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The parts of a shard: complete nodes, boundary nodes, and the ids that end at boundary nodes."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    keys = table.column("key").to_pylist()
    conv = table.column("conv_id").to_numpy()
    lengths = np.array([len(k) // ID_BYTES for k in keys], np.int64)
    words = pc.list_flatten(table.column("words")).to_numpy().astype(np.int64)
    found, rows = levels(conv, lengths, _ranks(b"".join(keys)), words)
    paths = [_path(keys[r]) for r in rows]
    shard = TaskContext.get().partitionId()

    def batch(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    for depth, level in enumerate(found):
        edge = {k: paths[end][depth] for end, k in enumerate((level.at_first, level.at_last)) if k >= 0}
        closed = np.ones(len(level.n), bool)
        closed[list(edge)] = False
        at = np.flatnonzero(closed)
        if len(at):
            above = found[depth - 1]
            over = {k: paths[end][depth - 1] for end, k in enumerate((above.at_first, above.at_last)) if k >= 0}
            parent = level.parent[at]
            pending = np.isin(parent, list(over))
            yield batch(
                len(at), kind=np.full(len(at), CLOSED), depth=np.full(len(at), depth), conv_id=level.first[at], parent_conv_id=pa.array(above.first[parent], mask=pending),
                parent_key=[over.get(p) for p in parent.tolist()], n_convs=level.n[at], n_children=level.children[at], n_leaves=level.leaves[at], saved_tokens=level.saved[at],
                ends_sha256=[hashlib.sha256(_joined(level.ends[k])).hexdigest() if k in level.ends else EMPTY for k in at.tolist()],
            )
        for k, key in edge.items():
            up = _parent_of(paths, k, level, depth)
            yield batch(
                1, kind=[OPEN], shard=[shard], depth=[depth], key=[key], parent_key=[up], conv_id=[level.first[k]], n_convs=[level.n[k]], n_children=[level.children[k]],
                n_leaves=[level.leaves[k]], saved_tokens=[level.saved[k]], words=[level.words[k]], is_first=[k == level.at_first], is_last=[k == level.at_last],
            )
            if k in level.ends:
                yield batch(1, kind=[ENDS], shard=[shard], key=[key], ends=[_joined(level.ends[k])])


def _parent_of(paths: list[list[bytes]], k: int, level: _Level, depth: int) -> bytes | None:
    return paths[0 if k == level.at_first else 1][depth - 1] if depth else None


def _mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch], pa.Schema], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow by a function that makes batches of the schema."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)
    return df.mapInArrow(lambda batches: run(batches, arrow), kind)


@dataclass
class _Open:
    """A boundary node of a run of shards: sums so far, without children that are boundary nodes themselves."""

    depth: int
    key: bytes
    parent_key: bytes | None
    conv_id: int
    n_convs: int
    n_children: int
    n_leaves: int
    saved_tokens: int
    words: int
    is_first: bool
    is_last: bool


_OPEN = list(_Open.__dataclass_fields__)
_MET = "state int, shard bigint, depth bigint, key binary, parent_key binary, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, is_first boolean, is_last boolean"


def recombine(summaries: list[list[_Open]], last: bool) -> tuple[list[_Open], list[_Open]]:
    """(complete nodes, boundary nodes) of neighbouring summaries, in order; the last round completes all."""
    now: dict[bytes, _Open] = {}
    done: list[_Open] = []

    def complete(nodes: list[_Open]) -> None:
        for x in sorted(nodes, key=lambda x: -x.depth):
            x.n_leaves = x.n_leaves if x.n_children else 1
            x.saved_tokens += (x.n_convs - 1) * x.words
            if x.parent_key is not None:
                up = now[x.parent_key]
                up.n_children, up.n_leaves, up.saved_tokens = up.n_children + 1, up.n_leaves + x.n_leaves, up.saved_tokens + x.saved_tokens
            done.append(x)
        for x in nodes:
            del now[x.key]

    for k, summary in enumerate(summaries):
        for x in now.values():
            x.is_last = False
        for y in summary:
            x = now.get(y.key)
            if x is None:
                now[y.key] = replace(y, is_first=y.is_first and k == 0)
            else:
                x.conv_id, x.is_last = min(x.conv_id, y.conv_id), y.is_last
                for f in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    setattr(x, f, getattr(x, f) + getattr(y, f))
        complete([x for x in now.values() if not x.is_first and not x.is_last])
    if last:
        complete(list(now.values()))
    return done, list(now.values())


def _met(group: pa.Table, last: bool) -> dict[str, np.ndarray]:
    summaries: dict[int, list[_Open]] = {}
    for row in group.to_pylist():
        summaries.setdefault(row["shard"], []).append(_Open(*(row[f] for f in _OPEN)))
    done, still = recombine([summaries[s] for s in sorted(summaries)], last)
    unit, made = group.column("unit")[0].as_py(), [*done, *still]
    out = {"state": np.repeat([CLOSED, OPEN], [len(done), len(still)]), "shard": np.full(len(made), unit)}
    return out | {f: np.array([getattr(x, f) for x in made], object) for f in _OPEN}


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The hash of each key's pieces, joined by commas; rows come by key and shard."""
    key, state = None, None
    for b in batches:
        for k, piece in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if k == key:
                state.update(b",")
            else:
                if state:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], schema=schema)
                key, state = k, hashlib.sha256()
            state.update(piece)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], schema=schema)


def trie(rows: DataFrame) -> DataFrame:
    """One row per node of the sequences (conv_id, key, words): conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over its subtree, the words of its last turn once for each member but one) and ends_sha256 (of the members that end there).
    """
    spark = rows.sparkSession
    read = written(rows.select("conv_id", "key", "words"), "sequences")
    turns = read.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // (ID_BYTES * SHARD_TURNS)))
    parts = written(_mapped(read.repartitionByRange(shards, "key", "conv_id"), _shard, _PARTS), "trie-parts")
    summaries, met = parts.where(f"kind = {OPEN}").select("shard", *_OPEN), []
    while True:
        last = shards <= FAN
        grouped = summaries.withColumn("unit", F.expr(f"shard DIV {FAN}"))
        found = written(map_groups(grouped, ["unit"], _MET, lambda g, last=last: _met(g, last)), "trie-met")
        met.append(found.where(f"state = {CLOSED}"))
        if last:
            break
        summaries, shards = found.where(f"state = {OPEN}").select("shard", *_OPEN), -(-shards // FAN)
    boundary = met[0]
    for more in met[1:]:
        boundary = boundary.union(more)
    pieces = parts.where(f"kind = {ENDS}").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    ends = _mapped(pieces, _hashed, "key binary, ends_sha256 string")
    boundary = written(boundary.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "trie-boundary")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = parts.where(f"kind = {CLOSED}")
    waiting = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").select("parent_key", *[c for c in columns if c != "parent_conv_id"])
    waiting = waiting.union(boundary.where("parent_key IS NOT NULL").select(waiting.columns))
    # The boundary is two paths for each shard; the root's children wait for one key of it, so adaptive execution splits or broadcasts by size.
    named = waiting.join(boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key", "left")
    roots = boundary.where("parent_key IS NULL").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return inner.where("parent_key IS NULL").select(columns).union(named.select(columns)).union(roots.select(columns))
