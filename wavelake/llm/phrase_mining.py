"""Phrase collocations by Toivonen's method: a sample proposes, a full pass counts, and misses of the border are followed up.

A sample of the documents is mined with a lowered threshold. Its frequent phrases are the proposal. A full pass counts
the proposal and its negative border, that is every phrase that isn't proposed but whose parts (without its first or
its last word) all are; every single word belongs to one of the two. Where a border phrase turns out frequent, phrases
that hold it may be frequent too and were not counted: the proposal grows by it, and a further pass counts what has
come into reach, until no border phrase fails. As a frequent phrase has frequent parts, all frequent phrases are then
among those counted, whatever the sample was. Phrases have up to 4 words, so there are at most 4 full passes.

These passes count by a 64-bit key of lang and phrase, made from the bytes by NumPy without a Python object for each
word; its two lowest bits are the number of words less one. A key's count is that of its phrase, or more where two
phrases should share a key, never less. A last pass counts the phrases of the frequent keys as they are written, by
their words: those are the counts that are returned.

What tasks are sent of a proposal is a Bloom filter of BITS bits, whatever the number of phrases; of the border phrases
that it grows by, a further filter, as large as their number needs and no larger. A phrase that the filters take for
proposed by chance is one more phrase to count, never one less, as filters are only added and each pass counts exactly
what its filters reach and those before don't. A phrase that only the last filter brings into reach holds a phrase
that this filter has, so a further pass looks at the words around those and at no others.

A task holds CHUNK words at a time; each distinct phrase of a chunk leaves it once, so a phrase that is everywhere
meets as one row for each chunk.

Defined results. A null text counts as empty, a null lang as `und`. Texts are read whole; a phrase doesn't reach over
the end of a piece. Repeated rows count each. An empty table gives an empty result; a lang without candidates has no
rows. Ties in rank are broken by a, then by the phrase's bytes. Other columns, whatever their names, are ignored.
Counts are 64-bit, products and sums of them decimals of up to 38 digits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import drop_written, written

LONGEST = 4
LEAST, COVERED, TOP = 30, 80, 2000
#: One document of SAMPLE is in the sample; there, a phrase is frequent from SAMPLE_LEAST occurrences on.
SAMPLE, SAMPLE_LEAST = 8, 2
#: Bits of the filter (16 MiB) and bits that a phrase sets in it.
BITS, PROBES = 1 << 27, 3
#: Bits for each phrase of a further filter, as long as it isn't larger than the first.
FAILED_BITS = 32
#: floor(2000000 * a / (l + r)) in decimals: products and sums may pass 64 bits.
SCORE = "CAST(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS BIGINT)"
#: Words that a task holds at a time, and bytes that it turns into words at a time (a longer word makes it more).
CHUNK, BLOCK = 800_000, 1 << 20
#: Keys that a filter is asked for at a time.
ASKED = 1 << 15
#: The bytes that end a piece (fixed set) become line feeds, tabs become spaces, A-Z lower case.
_BYTES = bytearray(range(256))
_BYTES[65:91] = bytes(range(97, 123))
_BYTES[9] = 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _BYTES[_c] = 10
_BYTES = bytes(_BYTES)
#: What stands for a piece's end among words: no text in UTF-8 has this byte.
END = b" \xff "
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that go into its key eight at a time; longer words are hashed one by one.
LANES = 64
#: The first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def plain_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (first ^ (second >> np.uint64(31))) * _MIX + second
        x ^= x >> np.uint64(29)
        return x * np.uint64(0xBF58476D1CE4E5B9)


def _tagged(keys: np.ndarray, words: int) -> np.ndarray:
    """Keys that tell the number of words."""
    return keys & np.uint64(0xFFFFFFFFFFFFFFFC) | np.uint64(words - 1)


def _longer(first: np.ndarray, last: np.ndarray, words: int) -> np.ndarray:
    """Keys of phrases of so many words, by those of the phrases without the last word and of the last words."""
    return _tagged(_mixed(first, last), words)


def _block_keys(block: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Keys of the words that start at first and have so many bytes."""
    padded = np.concatenate([block, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(block) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    keys = _mixed(eight[first] & _FIRST[np.minimum(size, 8)], size.astype(np.uint64))
    left = np.flatnonzero(size > 8)
    for at in range(8, LANES, 8):
        keys[left] = _mixed(keys[left], eight[first[left] + at] & _FIRST[np.minimum(size[left] - at, 8)])
        left = left[size[left] > at + 8]
    for k in left.tolist():
        keys[k] = xxhash.xxh3_64_intdigest(block[first[k] : first[k] + size[k]])
    return keys


def word_keys(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, starts, pieces) of the words of plain bytes; pieces numbers the line feeds before each."""
    keys, starts, pieces, at, seen = [], [], [], 0, 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            if cut < 0:
                cut = min((k for k in (data.find(b" ", end), data.find(b"\n", end)) if k >= 0), default=len(data) - 1)
            end = cut + 1
        block = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        ends_piece = block == 10
        word = np.concatenate([[False], (block != 32) & ~ends_piece, [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        first, last = edges[::2], edges[1::2]
        keys.append(_block_keys(block, first, last - first))
        starts.append(first + at)
        lines = np.bincount(np.searchsorted(first, np.flatnonzero(ends_piece)), minlength=len(first) + 1).cumsum()
        pieces.append(lines[:-1] + seen)
        at, seen = end, seen + int(lines[-1])
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(pieces)


def lang_key(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def probe(keys: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of each key in a filter."""
    with np.errstate(over="ignore"):
        step = (keys * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        at = (keys + np.uint64(k) * step) >> np.uint64(20)
        return at % np.uint64(bits) if bits & (bits - 1) else at & np.uint64(bits - 1)


class Filter:
    """Keys of phrases, and some others by chance."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether the filter has each key."""
        out = np.empty(len(keys), bool)
        for at in range(0, len(keys), ASKED):
            out[at : at + ASKED] = self._has(keys[at : at + ASKED])
        return out

    def _has(self, keys: np.ndarray) -> np.ndarray:
        """Most of the keys that it hasn't are told by their first place."""
        out = self._place(keys, 0)
        left = np.flatnonzero(out)
        for k in range(1, PROBES):
            there = self._place(keys[left], k)
            out[left[~there]] = False
            left = left[there]
        return out

    def _place(self, keys: np.ndarray, k: int) -> np.ndarray:
        at = probe(keys, k, 64 * len(self.words))
        return (self.words[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _has(keys: np.ndarray, filters: list[Filter]) -> np.ndarray:
    """Whether any of the filters has each key."""
    out = np.zeros(len(keys), bool)
    for own in filters:
        at = np.flatnonzero(~out)
        out[at] = own.has(keys[at])
    return out


def _held(keys: np.ndarray, asked: np.ndarray, filters: list[Filter]) -> tuple[np.ndarray, np.ndarray]:
    """(whether the filters have each key, whether those before the last have it, of the keys asked for)."""
    before = np.zeros(len(keys), bool)
    if len(filters) == 1:
        return filters[0].has(keys), before
    at = np.flatnonzero(asked)
    before[at] = _has(keys[at], filters[:-1])
    now = before.copy()
    at = np.flatnonzero(~before)
    now[at] = _has(keys[at], filters)
    return now, before


def _around(keys: np.ndarray, pieces: np.ndarray, longest: int, own: Filter) -> np.ndarray:
    """The words of all phrases of up to `longest` words that hold a shorter one that the filter has."""
    change, phrase, n = np.zeros(len(keys) + 1, np.int64), keys, len(keys)
    for size in range(1, min(longest, n + 1)):
        if size > 1:
            phrase = _longer(phrase[:-1], keys[size - 1 :], size)
        at = np.flatnonzero(own.has(phrase))
        at = at[pieces[at] == pieces[at + size - 1]]
        np.add.at(change, np.maximum(at + size - longest, 0), 1)
        np.add.at(change, np.minimum(at + longest, n), -1)
    return np.flatnonzero(change.cumsum()[:-1] > 0)


def reached(keys: np.ndarray, pieces: np.ndarray, longest: int, filters: list[Filter]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, keys, counts) of the phrases that the filters reach and those before the last don't, by their number of words.

    keys and pieces: of each word in turn. A phrase is reached if both its parts are, and a filter has them; all
    words are. Without filters all phrases are reached, with one filter none was before.
    """
    if len(filters) > 1:
        near = _around(keys, pieces, longest, filters[-1])
        keys, pieces = keys[near], np.cumsum(np.diff(near, prepend=-1) != 1) + pieces[near]
    place, own = np.arange(len(keys)), keys
    held, held_before = _held(own, np.ones(len(own), bool), filters) if filters else (np.ones(len(own), bool), np.zeros(len(own), bool))
    if len(filters) < 2:
        yield (1, *np.unique(own, return_counts=True))
    for size in range(2, longest + 1):
        # Phrases of one word less that start at neighbouring words, in one piece.
        pair = np.flatnonzero((np.diff(place) == 1) & held[:-1] & held[1:])
        pair = pair[pieces[place[pair]] == pieces[place[pair] + size - 1]]
        both_before = held_before[pair] & held_before[pair + 1]
        place, own = place[pair], _longer(own[pair], keys[place[pair] + size - 1], size)
        yield (size, *np.unique(own[~both_before], return_counts=True))
        if size < longest:
            held, held_before = _held(own, both_before, filters) if filters else (np.ones(len(own), bool), both_before)


def _made(schema: str) -> tuple[StructType, pa.Schema]:
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    return kind, to_arrow_schema(kind)


def _chunks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Lists of (lang, plain bytes) that hold about so many words."""
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = plain_bytes(text.as_py())
            held.append((lang, data))
            size += len(data) // 6 + 1
            if size >= words:
                yield held
                held, size = [], 0
    if held:
        yield held


def _chunk_keys(held: list[tuple[str, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, pieces) of the words of texts, each in its lang."""
    keys, starts, pieces = word_keys(b"\n".join([d for _, d in held]))
    sizes = np.array([len(d) + 1 for _, d in held])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    known = {lang: lang_key(lang) for lang in {lang for lang, _ in held}}
    return _longer(keys, np.repeat(np.array([known[lang] for lang, _ in held], np.uint64), counts), 1), pieces


def _by_key(docs: DataFrame, chunk: int, longest: int, filters: list) -> DataFrame:
    """key, f of the phrases in reach of broadcast filters."""
    kind, schema = _made("key bigint, f bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches, chunk):
            for _, found, n in reached(*_chunk_keys(held), longest, [f.value for f in filters]):
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    return docs.mapInArrow(run, kind).groupBy("key").agg(F.sum("f").alias("f"))


class _Counts:
    """Exact counts of phrases of one lang in a chunk: words are numbered, phrases of one word more are pairs of numbers."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.texts: list[np.ndarray] = []

    def add(self, data: bytes) -> None:
        words = data.replace(b"\n", END).split()
        words.append(END.strip())
        self.texts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))

    def counted(self, lang: str, wanted: Filter) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
        """(words, phrases, counts) of phrases whose keys the filter has, and those of their parts; first all words as (0, one empty phrase)."""
        ids, names = np.concatenate(self.texts), list(self.number)
        self.texts = []
        end, base = self.number[END.strip()], len(names)
        keys = np.zeros(base, np.uint64)
        keys[[k for k in range(base) if k != end]] = _longer(word_keys(b" ".join([w for w in names if w != END.strip()]))[0], lang_key(lang), 1)
        n = np.bincount(ids, minlength=base)
        n[end] = 0
        yield 0, [b""], np.array([n.sum()])
        held = wanted.has(keys) & (np.arange(base) != end)
        at = np.flatnonzero(held)
        yield 1, [names[k] for k in at.tolist()], n[at]
        place, own, phrases = np.where(held[ids], ids, np.int64(-1)), keys, names
        for size in range(2, LONGEST + 1):
            there = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0))
            there = there[wanted.has(_longer(own[place[there]], keys[ids[there + size - 1]], size))]
            if not len(there):
                return
            pairs, inverse, n = np.unique(place[there] * base + ids[there + size - 1], return_inverse=True, return_counts=True)
            head, last = pairs // base, pairs % base
            own = _longer(own[head], keys[last], size)
            phrases = [phrases[a] + b" " + names[b] for a, b in zip(head.tolist(), last.tolist(), strict=True)]
            yield size, phrases, n
            place = np.full(len(place) - 1, -1, np.int64)
            place[there] = inverse


def _counted(held: list[tuple[str, bytes]], wanted: Filter) -> Iterator[tuple[str, int, list[bytes], np.ndarray]]:
    langs: dict[str, _Counts] = {}
    for lang, data in held:
        langs.setdefault(lang, _Counts()).add(data)
    while langs:
        lang, counts = langs.popitem()
        for size, phrases, n in counts.counted(lang, wanted):
            yield lang, size, phrases, n


def _exact(docs: DataFrame, chunk: int, wanted) -> DataFrame:
    """lang, phrase, words, f of the phrases whose keys are wanted, and of each lang's empty phrase, which has all its words."""
    kind, schema = _made("lang string, phrase string, words int, f bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches, chunk):
            for lang, size, phrases, n in _counted(held, wanted.value):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(phrases), size, np.int32)), pa.array(n.astype(np.int64))], schema=schema)

    return docs.mapInArrow(run, kind).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def _filter(keys: DataFrame, size: int):
    """A broadcast filter of the keys, of so many bits, whatever their number."""
    kind, schema = _made("place bigint, bits bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([probe(own, k, size) for k in range(PROBES)])
            bits = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits)], schema=schema)

    # At most size / 64 rows of two numbers.
    found = keys.select("key").mapInArrow(run, kind).groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(Filter(words))


def _outside(keys: DataFrame, filters: list) -> DataFrame:
    """The rows whose keys no filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_has(batch.column(0).to_numpy().view(np.uint64), [f.value for f in filters])))

    return keys.mapInArrow(run, keys.schema)


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, sample: int = SAMPLE, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """lang, phrase, words, f of every phrase of up to LONGEST words with f >= least, and of each lang's empty phrase: all its words.

    The sample is the documents that a hash of their text chooses. sample, bits and chunk change the work, not the result.
    """
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = read.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    filters, found = [_filter(_by_key(chosen, chunk, LONGEST - 1, []).where(f"f >= {SAMPLE_LEAST}"), bits)], []
    while True:
        counted = written(_by_key(read, chunk, LONGEST, filters).where(f"f >= {least}"), "phrase-keys")
        found.append(counted)
        failed = written(_outside(counted.where(f"(key & 3) < {LONGEST - 1}"), filters), "border-failures")
        number = failed.count()
        if not number:
            break
        filters.append(_filter(failed, min(bits, max(64, 1 << (FAILED_BITS * number).bit_length()))))
    frequent = found[0]
    for more in found[1:]:
        frequent = frequent.union(more)
    out = written(_exact(read, chunk, _filter(frequent, bits)).where(f"f >= {least} OR words = 0"), "phrases")
    for done in (*found, failed):
        drop_written(done)
    return out


def _big(column) -> F.Column:
    return column.cast("decimal(19,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered: int = COVERED, top: int = TOP, **how: int) -> DataFrame:
    """Each lang's first `top` phrases of 2 to LONGEST words: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, l and r those of the parts of its weakest cut, n the lang's words. Phrases inside a longer
    frequent one that has at least `covered` per cent of their count are left out. how: sample, bits and chunk of `mine`.
    """
    phrases = mine(docs, text, lang, least, **how)
    counts = phrases.select("lang", "phrase", "f")
    candidates = phrases.where("words >= 2").select("lang", F.col("phrase"), F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    sides = cuts.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"])
    weakest = sides.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every contiguous part of two words or more of a longer candidate, with the largest count of such a candidate.
    parts = F.expr("flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    inside = candidates.where("size(w) > 2").select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_big(F.col("longer")) * 100 < _big(F.col("a")) * covered))
    ranked = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    # First the best of each part of a lang, then of those, so no task orders a whole lang.
    order = "score DESC, a DESC, phrase"
    some = ranked.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, part ORDER BY {order})")).where(f"rank <= {top}").drop("part", "rank")
    first = some.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY lang ORDER BY {order}) AS BIGINT)")).where(f"rank <= {top}")
    totals = phrases.where("words = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
