"""SentencePiece encoding and decoding that keep every piece's place in the original bytes.

A text is normalised here, by the model's own rules: at each place the longest prefix that the compiled character
map knows is replaced, all else is copied, and white space is escaped. For every byte of the result the normaliser
records the byte of the source that it came from, so each piece projects to a span of the original UTF-8.

The normalised text is cut where no merge can reach over: in front of a run of escaped spaces, if the vocabulary
has no piece with a space after another character, and on both sides of characters that stand in no longer piece.
What lies between two cuts is encoded once for each worker while it stays in a bounded cache, by the library with
the model's merges and without its normaliser; ids and lengths of a document are put together from it. The decoded
text of a document is made from its ids alone, by the pieces' own texts.

Spans. A piece covers the source bytes from where its first normalised byte came from to where the byte after its
last one came from. Bytes of a character that was copied are told apart (byte pieces have a byte each); those of a
replacement all come from the start of what was replaced. The space that the model sets before a text has no bytes.

Defined results. A null text counts as empty: only the begin and end ids, and the digests of empty results. Texts
are encoded whole, whatever their length. Repeated rows and doc_ids each give a row, a null doc_id too. An empty
table gives an empty result. Other columns, whatever their names, are ignored. Models of merges (BPE) only; models
with pieces that the user has defined raise ValueError.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import map_texts

SPACE = "▁"
#: Pieces' kinds and fields of the model's file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALISER = 1, 2, 3
BPE = 2
#: Entries after which a worker lets go of the words that it didn't meet again meanwhile.
WORDS = 250_000
#: Longer words are cut further where they can be, and aren't kept.
KEPT_CHARS = 256
#: Handler of bytes that aren't UTF-8: U+FFFD for each of them, as the library does.
EACH = "piece_spans_each"
codecs.register_error(EACH, lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised message."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        if tag & 7 == 0:
            value, at = _number(data, at)
        else:
            size, at = _number(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """A compiled map of prefixes: a double array of units over UTF-8 bytes, and the replacements, each ended by a null byte."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.texts = compiled[4 + size :]
        self._starting: dict[str, bool] = {}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def walk(self, data: bytes, at: int) -> tuple[int, int | None, int]:
        """(bytes of the longest known prefix of data[at:] or 0, where its replacement stands, bytes that lead somewhere)."""
        units, found, value, i = self.units, 0, None, at
        place = self._offset(units[0])
        while i < len(data):
            place ^= data[i]
            unit = units[place]
            if unit & 0x800000FF != data[i]:
                break
            place ^= self._offset(unit)
            i += 1
            if unit >> 8 & 1:
                found, value = i - at, units[place] & 0x7FFFFFFF
        return found, value, i - at

    def replacement(self, value: int) -> bytes:
        return self.texts[value : self.texts.index(0, value)]

    def may_start(self, char: str) -> bool:
        """Whether some known prefix starts with the character."""
        known = self._starting.get(char)
        if known is None:
            data = char.encode("utf-8", "surrogatepass")
            known = self._starting[char] = bool(self.units) and self.walk(data, 0)[2] == len(data)
        return known


class Normaliser:
    """The rules of a model's normaliser message."""

    def __init__(self, spec: bytes):
        fields = dict(message(spec))
        self.map = CharacterMap(fields.get(2, b""))
        self.prefixed, self.trimmed, self.escaped = (bool(fields.get(k, 1)) for k in (3, 4, 5))
        self.space = SPACE.encode() if self.escaped else b" "

    def plain(self, text: str) -> bool:
        """Whether the text is copied, with single spaces between words: no map, no space beside another or at an end."""
        return bool(not self.map.units and self.prefixed and self.escaped and text and SPACE not in text and "  " not in text and text[0] != " " != text[-1])

    def prefixes(self, text: str) -> Iterator[tuple[bytes, int, bool]]:
        """(what stands for it, bytes, whether it was copied) of each prefix of the text in turn."""
        if not self.map.units or not any(map(self.map.may_start, set(text))):
            yield text.encode("utf-8", "surrogatepass"), len(text.encode("utf-8", "surrogatepass")), True
            return
        data, at, copied = text.encode("utf-8", "surrogatepass"), 0, 0
        for char in text:
            size = len(char.encode("utf-8", "surrogatepass"))
            if copied > 0:  # inside a longer prefix
                copied -= size
                at += size
                continue
            if self.map.may_start(char):
                found, value, _ = self.map.walk(data, at)
                if found:
                    yield self.map.replacement(value), found, False
                    copied = found - size
                    at += size
                    continue
            yield data[at : at + size], size, True
            at += size

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes and its end the byte of the source that it came from."""
        made, places, at, after_space = [], [], 0, self.trimmed
        for piece, size, copied in self.prefixes(text):
            own = np.arange(at, at + size) if copied else np.full(len(piece), at)
            if self.trimmed:
                codes = np.frombuffer(piece, np.uint8)
                blank = codes == 32
                keep = ~(blank & np.concatenate([[after_space], blank[:-1]])) if len(codes) else np.empty(0, bool)
                after_space = bool(blank[-1]) if len(codes) else after_space
                piece, own = codes[keep].tobytes(), own[keep]
            made.append(piece)
            places.append(own)
            at += size
        data, end = b"".join(made), at
        source = np.concatenate(places).astype(np.int64) if places else np.empty(0, np.int64)
        if not data:
            return "", np.array([end], np.int64)
        start = int(source[0])
        if self.escaped:
            source = np.repeat(source, np.where(np.frombuffer(data, np.uint8) == 32, len(self.space), 1))
            data = data.replace(b" ", self.space)
        if self.prefixed:
            source, data = np.concatenate([np.full(len(self.space), start), source]), self.space + data
        while self.trimmed and data.endswith(self.space):
            size = len(data) - len(self.space)
            data, source, end = data[:size], source[:size], int(source[size])
        return data.decode("utf-8", "surrogatepass"), np.append(source, end)


class Codec:
    """Ids, spans and decoded text of whole texts; ids and decoded text equal the library's on every text."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        fields = list(message(data))
        found = [dict(message(v)) for k, v in fields if k == PIECES]
        trainer = dict(message(next(v for k, v in fields if k == TRAINER)))
        self.names = [p[1].decode() for p in found]
        self.kinds = [p.get(3, NORMAL) for p in found]
        if trainer.get(3, 1) != BPE or USER in self.kinds:
            raise ValueError("only models of merges without user-defined pieces are read")
        self.unknown = self.kinds.index(UNKNOWN)
        self.begin, self.end = (self.names.index(trainer.get(k, name.encode()).decode()) for k, name in ((46, "<s>"), (47, "</s>")))
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.sizes = np.array([1 if kind == BYTE else len(name.encode()) for name, kind in zip(self.names, self.kinds, strict=True)], "<u4")
        self.normaliser = Normaliser(next((v for k, v in fields if k == NORMALISER), b""))
        bare = b"".join(_field(k, v) for k, v in fields if k in (PIECES, TRAINER)) + _field(NORMALISER, b"\x0a\x08identity\x18\x00\x20\x00\x28\x00")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=bare)
        longer = [n for n, kind in zip(self.names, self.kinds, strict=True) if kind in (NORMAL, UNUSED) and len(n) > 1]
        self.by_words = not any(re.search(f"[^{SPACE}]{SPACE}", n) for n in longer)
        alone = "".join(sorted(map(re.escape, {c for n in longer for c in n})))
        self._part = re.compile(f"[{alone}]+|[^{alone}]+") if alone else re.compile("(?s).+")
        self._word = re.compile(f"(?s){SPACE}*[^{SPACE}]*" if self.by_words else "(?s).+")
        #: What each piece decodes to. A control piece has none; it is marked by a byte that no text has.
        self.texts = [self._text(name, kind) for name, kind in zip(self.names, self.kinds, strict=True)]
        #: Whether decoding takes the space away that a piece starts with, where it is the first.
        self.led = [(self.normaliser.prefixed or self.normaliser.trimmed) and kind in (NORMAL, UNUSED) and name.startswith(SPACE) for name, kind in zip(self.names, self.kinds, strict=True)]
        #: Of each word its ids, each with its length, as packed integers; those of the generation before.
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Ids and lengths in normalised bytes of words; long words are cut further, so that no call holds more than a part."""
        asked, counts, spaced = [], [], np.zeros(len(words), bool)
        for k, word in enumerate(words):
            if self.by_words and word[:1] != SPACE:  # a word after one space, which is one byte of the source
                spaced[k], whole = True, SPACE + word
            else:
                whole = word
            parts = [whole] if len(whole) <= KEPT_CHARS else self._part.findall(whole)
            asked += parts
            counts.append(len(parts))
        found = self.library.encode(asked, num_threads=1)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), "<u4", lengths.sum())
        sizes = self.sizes[ids]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        firsts = np.concatenate([[0], np.cumsum(counts)])
        for part in np.unique(np.searchsorted(starts, np.flatnonzero(ids == self.unknown), "right") - 1):
            sizes[starts[part] : starts[part + 1]] = [len(p.encode()) for p in self.library.encode(asked[part], out_type=str)]
        bounds = starts[firsts] * 8
        sizes[bounds[:-1][spaced] // 8] -= 2
        both = np.stack([ids, sizes], 1).tobytes()
        self.words.update(zip(words, map(both.__getitem__, map(slice, bounds[:-1].tolist(), bounds[1:].tolist())), strict=True))

    def _text(self, name: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(name[3:5], 16)])
        if kind == CONTROL:
            return b"\xff"
        return (self.unknown_text if kind == UNKNOWN else name.replace(SPACE, " ")).encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: without the space that the model sets before a text, and bytes that aren't UTF-8 replaced."""
        data = b"".join(map(self.texts.__getitem__, ids))
        led = bool(ids) and self.led[ids[0]]
        if not (led and self.normaliser.trimmed and self.texts[ids[0]] == b" "):  # else further pieces may lose theirs
            try:
                return data[led:].decode()
            except UnicodeDecodeError:  # control pieces, or bytes that aren't UTF-8
                pass
        return self._decode_by_piece(ids)

    def _decode_by_piece(self, ids: list[int]) -> str:
        parts, run, first = [], bytearray(), True
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += self.texts[i]
                continue
            if run:
                parts.append(run.decode("utf-8", EACH))
                first, run = False, bytearray()
            if i is None or self.kinds[i] == CONTROL:
                continue
            led = first and self.led[i]
            text = self.texts[i][led:].decode()
            parts.append(text)
            first = first and not text and self.normaliser.trimmed
        return "".join(parts)

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray, np.ndarray, str]]:
        """(ids as unsigned 32-bit integers without begin and end, starts and ends of their spans in bytes, decoded text) of each text."""
        if len(self.words) > WORDS:
            self.before, self.words = self.words, {}
        rows: list[tuple[list[str], np.ndarray | None]] = []
        for text in texts:
            if self.by_words and self.normaliser.plain(text):
                rows.append((text.split(" "), None))
            else:
                made, source = self.normaliser(text)
                rows.append(([w for w in self._word.findall(made) if w], source))
        asked = set().union(*(words for words, _ in rows))
        missing = asked - self.words.keys()
        known = missing & self.before.keys()
        self.words.update(zip(known, map(self.before.__getitem__, known), strict=True))
        missing = list(missing - known)
        if missing:
            self._learn(missing)
        look, out = self.words.__getitem__, []
        for words, source in rows:
            both = np.frombuffer(b"".join(map(look, words)), "<u4").reshape(-1, 2)
            ids, sizes = both[:, 0], both[:, 1]
            ends = np.cumsum(sizes, dtype=np.int64)
            if source is None:
                ends -= 1  # the first word has no space before it
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            else:
                starts, ends = source[ends - sizes], source[ends]
            out.append((ids.tobytes(), starts, ends, self.decode(ids.tolist())))
        for long in [w for w in missing if len(w) > KEPT_CHARS]:
            del self.words[long]
        return out


def _field(number: int, value: bytes) -> bytes:
    size, n = bytearray(), len(value)
    while n > 127:
        size.append(n & 127 | 128)
        n >>= 7
    size.append(n)
    return bytes([number << 3 | 2]) + bytes(size) + value


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _digests(keys: list, texts: list[str], path: str) -> dict[str, list]:
    own = codec(path)
    first, last = (struct.pack("<I", i) for i in (own.begin, own.end))
    out: dict[str, list] = {"doc_id": keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "spans_sha256": []}
    for ids, starts, ends, text in own.encode(texts):
        out["n_tokens"].append(len(ids) // 4 + 2)
        out["ids_sha256"].append(hashlib.sha256(first + ids + last).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
        out["spans_sha256"].append(hashlib.sha256(np.stack([starts, ends], 1).astype("<u4").tobytes()).hexdigest())
    return out


def _pieces(keys: list, texts: list[str], path: str) -> dict[str, list]:
    done = codec(path).encode(texts)
    return {"key": keys, "ids": [np.frombuffer(i, "<i4") for i, _, _, _ in done], "starts": [s for _, s, _, _ in done], "ends": [e for _, _, e, _ in done], "decoded": [t for _, _, _, t in done]}


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and digests of ids (begin and end among them), decoded text and spans of every document.

    path: the model's file, there on every executor. spans_sha256 is of start and end of each piece in turn, as
    little-endian unsigned 32-bit integers. Nothing is shuffled.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return map_texts(docs.select(F.col(doc_id).cast("bigint"), F.col(text)), schema, lambda k, t: _digests(k, t, path))


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (array<int>, without begin and end), starts and ends of their spans in UTF-8 bytes, and decoded text of every document."""
    schema = "key bigint, ids array<int>, starts array<bigint>, ends array<bigint>, decoded string"
    return map_texts(docs.select(F.col(doc_id).cast("bigint"), F.col(text)), schema, lambda k, t: _pieces(k, t, path)).withColumnRenamed("key", "doc_id")
