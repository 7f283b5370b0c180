"""Timestamped annotation lists: the bytes of one annotation region, read as far as they make sense."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..constants import INT64_MAX, INT64_MIN, ONSET_END, TAL_END, TEXT_END, TICKS_PER_SECOND
from ..functions.text import escape_controls, latin1
from ..functions.ticks import parse_signed, parse_unsigned

LONGEST_TIME = 40
PREVIEW = 48


@dataclass(frozen=True)
class Text:
    text: str
    encoding: str
    offset: int


@dataclass(frozen=True)
class Tal:
    ordinal: int
    offset: int
    length: int
    onset_raw: str
    onset: int
    duration_raw: str | None
    duration: int | None
    texts: tuple[Text, ...]


@dataclass
class Issue:
    code: str
    kind: str
    offset: int
    length: int
    raw: str
    occurrences: int = 1


_ONE = {"onset": "an onset", "duration": "a duration"}


class _Skip(Exception):
    pass


class _Region:
    def __init__(self, data: bytes):
        self.data, self.tals, self.issues = data, [], {}

    def note(self, code: str, kind: str, offset: int, length: int) -> None:
        if (code, kind) in self.issues:
            self.issues[code, kind].occurrences += 1
        else:
            self.issues[code, kind] = Issue(code, kind, offset, length, latin1(self.data[offset : offset + min(length, PREVIEW)]))

    def skip(self, kind: str, offset: int, length: int) -> None:
        self.note("TAL_MALFORMED", kind, offset, length)
        raise _Skip

    def time(self, name: str, offset: int, end: int, signed: bool) -> tuple[str, int, bool]:
        """Raw text, ticks, and whether a sign that must be there was missing."""
        if end - offset > LONGEST_TIME:
            self.skip(f"{_ONE[name]} is too long", offset, end - offset)
        raw = latin1(self.data[offset:end])
        ticks = parse_signed(raw) if signed else parse_unsigned(raw)
        bare = signed and ticks is None
        if bare:
            ticks = parse_unsigned(raw)
        if ticks is None:
            self.skip(f"{_ONE[name]} isn't a time", offset, max(end - offset, 1))
        if not INT64_MIN <= ticks <= INT64_MAX:
            self.skip(f"{_ONE[name]} is beyond 64 bits", offset, max(end - offset, 1))
        return raw, ticks, bare

    def text(self, start: int, end: int) -> Text:
        run = self.data[start:end]
        if ONSET_END in run:
            self.note("TAL_MALFORMED", "a text holds a separator", start, end - start)
        try:
            return Text(run.decode("utf-8"), "utf-8", start)
        except UnicodeDecodeError:
            self.note("ANNOTATION_TEXT_NOT_UTF8", "a text isn't UTF-8", start, end - start)
            return Text(latin1(run), "latin-1-fallback", start)

    def tal(self, start: int, end: int, ordinal: int) -> Tal:
        data = self.data
        stamp = data.find(TEXT_END, start, end)
        if stamp < 0:
            self.skip("a time has no end", start, end - start)
        split = data.find(ONSET_END, start, stamp)
        onset_raw, onset, bare = self.time("onset", start, stamp if split < 0 else split, True)
        duration_raw, duration = self.time("duration", split + 1, stamp, False)[:2] if split >= 0 else (None, None)
        if bare:
            self.note("TAL_MALFORMED", "an onset has no sign", start, len(onset_raw))
        texts, at = [], stamp + 1
        while (stop := data.find(TEXT_END, at, end)) >= 0:
            texts.append(self.text(at, stop))
            at = stop + 1
        if at < end:
            self.note("TAL_MALFORMED", "the last text has no end", at, end - at)
            texts.append(self.text(at, end))
        return Tal(ordinal, start, end + 1 - start, onset_raw, onset, duration_raw, duration, tuple(texts))


def parse_region(data: bytes) -> tuple[list[Tal], list[Issue]]:
    """The lists of a region and what is wrong with it, each kind of issue once with its number.

    A list that is skipped uses up its place, and padding before the first list does too: only a list that
    begins at the region's first byte can have ordinal 0.
    """
    region, at, ordinal = _Region(data), 0, 0
    while at < len(data):
        if data[at] == TAL_END:
            while at < len(data) and data[at] == TAL_END:
                at += 1
            if at < len(data):
                region.note("TAL_REGION_NOT_NUL_TERMINATED", "bytes follow the padding", at, len(data) - at)
                ordinal = max(ordinal, 1)
            continue
        end = data.find(TAL_END, at)
        if end < 0:
            region.note("TAL_TRUNCATED_AT_REGION_END", "a list has no end", at, len(data) - at)
            break
        try:
            region.tals.append(region.tal(at, end, ordinal))
        except _Skip:
            pass
        ordinal, at = ordinal + 1, end + 1
    return region.tals, list(region.issues.values())


#: Of a start in its usual form: integer digits and bytes at most. 11 digits of seconds are ticks of 62 bits.
USUAL_DIGITS, USUAL_BYTES = 11, 32


def usual_starts(regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ticks, whether it is so) of each row of bytes that begins with a signed time, an end of text, and later the list's end.

    Rows that begin otherwise, with a duration too, or with more digits may still give a start: their ticks aren't told here.
    """
    count, width = regions.shape
    head = np.zeros((count, USUAL_BYTES + 1), np.uint8)
    head[:, : min(width, USUAL_BYTES)] = regions[:, :USUAL_BYTES]
    stamp, list_end = (head == TEXT_END).argmax(1), (regions == TAL_END).argmax(1) if width else np.zeros(count, int)
    good = (stamp > 0) & (list_end > stamp) & np.isin(head[:, 0], (43, 45))
    dots = head == 46
    dot = np.where(dots.any(1), dots.argmax(1), USUAL_BYTES)
    dot = np.minimum(dot, stamp)
    place = np.arange(USUAL_BYTES + 1)
    inside = (place >= 1) & (place < stamp[:, None])
    digit = (head >= 48) & (head <= 57)
    good &= (inside & ~digit & (place != dot[:, None])).sum(1) == 0
    fraction = stamp - dot - 1
    good &= (dot >= 2) & (dot <= USUAL_DIGITS + 1) & (fraction != 0)
    whole, part = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for k in range(1, USUAL_BYTES):
        value = head[:, k].astype(np.int64) - 48
        whole = np.where(good & (k < dot), whole * 10 + value, whole)
        part = np.where(good & (k > dot) & (k < stamp) & (k <= dot + 7), part * 10 + value, part)
    part *= 10 ** np.clip(7 - np.maximum(fraction, 0), 0, 7)
    ticks = whole * TICKS_PER_SECOND + part
    return np.where(head[:, 0] == 45, -ticks, ticks), good


#: What a list that gives a record's start may hold besides: the sign of it, whether an annotation is lost, and the words.
DEFECTS = (
    (lambda texts, tal: bool(texts), True, lambda texts, tal: "it carries " + ", ".join(map(escape_controls, texts))),
    (lambda texts, tal: tal.duration_raw is not None, False, lambda texts, tal: f"it carries the duration {tal.duration_raw!r}"),
    (lambda texts, tal: len(tal.texts) != 1, False, lambda texts, tal: f"it has {len(tal.texts)} empty texts"),
)


def timekeeping_defect(tal: Tal) -> tuple[str, bool] | None:
    """What is wrong with a list that should give a record's start only, and whether an annotation is lost by it."""
    texts = [t.text for t in tal.texts if t.text]
    return next(((words(texts, tal), lost) for holds, lost, words in DEFECTS if holds(texts, tal)), None)
