"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the characters cuts texts where their content says so, hence passages that documents share
fall into the same chunks. A chunk is encoded and decoded once for each worker while it stays in a bounded
cache, which keeps what it meets again; a chunk that isn't there is cut further at every safe place, and only unseen pieces reach the library.

A place is safe where a space follows a character that isn't white space and precedes one: the tokenizer's
splitting pattern always starts a new match there, and no added token holds a space, so the pieces' ids can be
put together as they are. Text without safe places is cut by length, and those joins are repaired: the tail of
the left part and a growing head of the right part are encoded together until their splits agree with the
right part's own.

Defined results. A null text counts as empty: no ids, and the digests of the empty string. Texts are encoded
whole, whatever their length. Repeated rows and doc_ids each give a row. An empty table gives an empty result.
Other columns are ignored by `round_trip` and kept by `with_tokens`.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import map_texts

#: Safe places whose rolling hash has these bits clear end a chunk: one in eight.
CUT_MASK = np.uint32(7 << 20)
WINDOW = 8
#: Longest piece that is encoded in one go; longer ones are cut and their joins repaired.
LONGEST = 1 << 14
#: Entries of chunks and of pieces after which a worker lets go of those that it didn't meet again meanwhile.
CHUNKS, PIECES = 20_000, 125_000
#: Longer chunks and pieces aren't kept.
KEPT_CHARS = 512
_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Characters of no added token that never join a letter or digit before them.
_CLOSING = ".,;:!?%$#&*"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    gear = np.random.default_rng(7).integers(0, 1 << 32, 4096, dtype=np.uint32)
    gear[0] = 0
    return gear, np.array([chr(c).isspace() for c in range(1 << 16)])


def cuts(texts: list[str]) -> list[list[int]]:
    """Ends of the chunks of each text: safe places that the rolling hash of the characters before them chooses.

    The texts are laid out one after the other with a gap of WINDOW blank codes, so no window sees two texts.
    """
    gear, white = _tables()
    gap = "\0" * WINDOW
    codes = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(codes == 32)
    before, after = codes[at - 1], codes[at + 1]
    at = at[~white[np.minimum(before, 0xFFFF)] & ~white[np.minimum(after, 0xFFFF)] & (before > 0) & (after > 0)]
    hashed = np.zeros(len(at), np.uint32)
    for i in range(WINDOW):
        hashed += gear[codes[at - 1 - i] & 4095] << np.uint32(i)
    at = at[(hashed & CUT_MASK) == 0]
    starts = np.cumsum([WINDOW] + [len(t) + WINDOW for t in texts])
    bounds, out = np.searchsorted(at, starts), []
    for k, text in enumerate(texts):
        own = (at[bounds[k] : bounds[k + 1]] - starts[k]).tolist()
        out.append([*own, len(text)] if text else own)
    return out


class Kept:
    """A bounded cache in two generations: what is asked for moves to the new one, and the old one goes when that is full."""

    def __init__(self):
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def __contains__(self, key: str) -> bool:
        if key in self.new:
            return True
        found = self.old.get(key)
        if found is not None:
            self.new[key] = found
        return found is not None

    def turn(self, most: int) -> bool:
        full = len(self.new) > most
        if full:
            self.old, self.new = self.new, {}
        return full


class Codec:
    """ids and decoded text of whole texts; equal to the library's on every text."""

    def __init__(self, path: str, longest: int = LONGEST):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.longest = longest
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.digits = [str(i) for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.chunks, self.pieces = Kept(), Kept()
        self.odd: dict[str, str] = {}

    def ids(self, text: str) -> list[int]:
        """Ids of a piece, cut and repaired if it is long."""
        out, at = [], 0
        while len(text) - at > self.longest:
            place = at + self.longest
            for token in self.added:
                found = text.find(token, max(at, place - len(token) + 1), place + len(token) - 1)
                if 0 <= found < place < found + len(token):
                    place = found + len(token)
            if place >= len(text):
                break
            own, at = self._joined(text[at:place], text, place)
            out += own
        return out + self.ids_plain(text[at:])

    def _splits(self, encoding) -> list[tuple[int, int]]:
        """(first token, first character) of each split of an encoding."""
        found, last = [], object()
        for k, (word, span, special) in enumerate(zip(encoding.word_ids, encoding.offsets, encoding.ids, strict=True)):
            mark = (word, special if special in self._added_ids() else None)
            if mark != last:
                found.append((k, span[0]))
                last = mark
        return found

    @lru_cache(1)  # noqa: B019
    def _added_ids(self) -> frozenset[int]:
        return frozenset(self.library.get_added_tokens_decoder())

    def _joined(self, left: str, text: str, place: int) -> tuple[list[int], int]:
        """Ids of left and of a head of text[place:], and where in text that head ends.

        The last splits of left are encoded again with a growing head until both agree.
        """
        a = self.library.encode(left, add_special_tokens=False)
        starts = self._splits(a)
        keep, tail_at = starts[-2] if len(starts) > 1 else (0, 0)
        size = 64
        while True:
            head = text[place : place + size]
            whole = len(head) == len(text) - place
            tail = left[tail_at:]
            if whole:
                return a.ids[:keep] + self.ids_plain(tail + head), len(text)
            cut = len(tail)
            window = self._splits(self.library.encode(tail + head, add_special_tokens=False))
            own = {c + cut for _, c in self._splits(self.library.encode(head, add_special_tokens=False))}
            agreed = [(k, c) for k, c in window if c in own and cut < c <= cut + size // 2 and not self._inside_added(text, place + c - cut, place)]
            if agreed:
                k, c = agreed[-1]
                return a.ids[:keep] + self.library.encode(tail + head, add_special_tokens=False).ids[:k], place + c - cut
            size *= 2

    def _inside_added(self, text: str, at: int, low: int) -> bool:
        return any(text.find(t, max(low, at - len(t) + 1), at + len(t) - 1) >= 0 for t in self.added)

    def ids_plain(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, pieces: list[str]) -> dict[str, str]:
        """Ids in decimal of each piece; pieces that don't decode to themselves are noted in self.odd."""
        short = [p for p in pieces if len(p) <= self.longest]
        known = dict(zip(short, [e.ids for e in self.library.encode_batch_fast(short, add_special_tokens=False)], strict=True))
        ids = [known[p] if p in known else self.ids(p) for p in pieces]
        texts, digits = self.library.decode_batch(ids, skip_special_tokens=False), self.digits
        self.odd.update((p, t) for p, t in zip(pieces, texts, strict=True) if p != t)
        return {p: ",".join([digits[k] for k in i]) for p, i in zip(pieces, ids, strict=True)}

    def _learn_all(self, pieces: list[str]) -> dict[str, str]:
        """As _learn, but closing punctuation after a letter or digit is always a split of its own, so it is encoded apart."""
        bare = [p.rstrip(_CLOSING) for p in pieces]
        apart = {p: b for p, b in zip(pieces, bare, strict=True) if b and len(b) < len(p) <= self.longest and b[-1].isalnum()}
        needed = dict.fromkeys(p for p in pieces if p not in apart)
        needed.update(dict.fromkeys(apart.values()))
        needed.update(dict.fromkeys(p[len(b) :] for p, b in apart.items()))
        new = self._learn([p for p in needed if p not in self.pieces])
        known = self.pieces.new
        known.update(new)
        for p, b in apart.items():
            tail = p[len(b) :]
            new[p] = known[p] = f"{known[b]},{known[tail]}"
            if self.odd and (b in self.odd or tail in self.odd):
                self.odd[p] = self.odd.get(b, b) + self.odd.get(tail, tail)
        return new

    def _parts(self, chunk: str) -> list[str]:
        """A chunk cut at every safe place."""
        words, led = chunk.split(" "), chunk[0] == " "
        if words[led:] != chunk.split():
            return _SAFE.split(chunk)
        parts = [" " + w for w in words[1:]]
        return parts if led else [words[0], *parts]

    def _decoded(self, chunk: str) -> str:
        return "".join([self.odd.get(p, p) for p in self._parts(chunk)]) if self.odd else chunk

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids in decimal joined by commas, decoded text) of each text."""
        chunks, pieces = self.chunks, self.pieces
        chunks.turn(CHUNKS)
        if pieces.turn(PIECES):
            self.odd = {p: t for p, t in self.odd.items() if p in pieces.old}
            chunks.old, chunks.new = {}, {}  # their odd pieces may be gone
        cut_up, unseen = [], {}
        for text, ends in zip(texts, cuts(texts), strict=True):
            start, own = 0, []
            for end in ends:
                own.append(text[start:end])
                start = end
            cut_up.append(own)
            for chunk in own:
                if chunk not in chunks and chunk not in unseen:
                    unseen[chunk] = self._parts(chunk)
        new = self._learn_all([p for p in {p for parts in unseen.values() for p in parts} if p not in pieces])
        look = pieces.new.__getitem__
        chunks.new.update((chunk, ",".join(map(look, parts))) for chunk, parts in unseen.items())
        look, out = chunks.new.__getitem__, []
        for text, own in zip(texts, cut_up, strict=True):
            ids = ",".join(map(look, own))
            out.append((ids.count(",") + 1 if ids else 0, ids, "".join(map(self._decoded, own)) if self.odd else text))
        for kept, fresh in ((pieces, new), (chunks, unseen)):
            for long in [k for k in fresh if len(k) > KEPT_CHARS]:
                del kept.new[long]
        return out


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _digests(keys: list, texts: list[str], path: str) -> dict[str, list]:
    done = codec(path).encode(texts)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return {"doc_id": keys, "n_tokens": [n for n, _, _ in done], "ids_sha256": [sha(i) for _, i, _ in done], "decoded_sha256": [sha(t) for _, _, t in done]}


def _ids(keys: list, texts: list[str], path: str) -> dict[str, list]:
    done = codec(path).encode(texts)
    return {"key": keys, "ids": [[int(i) for i in s.split(",")] if s else [] for _, s, _ in done], "decoded": [t for _, _, t in done]}


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document. path: the tokenizer's file, there on every executor."""
    return map_texts(docs.select(F.col(doc_id).cast("bigint"), F.col(text)), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda k, t: _digests(k, t, path))


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every document."""
    return map_texts(docs.select(F.col(doc_id).cast("bigint"), F.col(text)), "key bigint, ids array<int>, decoded string", lambda k, t: _ids(k, t, path)).withColumnRenamed("key", "doc_id")
