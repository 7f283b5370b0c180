"""From seconds to records: which runs of records a window needs, decided before anything is read."""

from __future__ import annotations

from ..errors import RecordRangeError
from ..functions.ticks import ceil_div, floor_div, from_seconds


def resolve(time: dict, duration_ticks: int, segments: list[dict] | None, start_seconds: float, duration_seconds: float) -> list[tuple[int, int]]:
    """(first record, number of records) of each contiguous run that a half-open window touches.

    segments: the complete index, or None when only the first and last record are known; then the recording
    must be without gaps, which it is if its span equals what its records cover.
    """
    begin, length = from_seconds(start_seconds), from_seconds(duration_seconds)
    if length <= 0 or not time["record_count"]:
        return []
    if segments is None:
        if time["span_ticks"] != time["covered_ticks"]:
            raise RecordRangeError(f"the recording spans {time['span_ticks']} ticks and its records cover {time['covered_ticks']}: build the complete index first")
        segments = [{"record_start": 0, "record_count": time["record_count"], "start_ticks": 0}]
    end, out = begin + length, []
    for s in segments:
        first_at, n = s["start_ticks"], s["record_count"]
        if not duration_ticks:
            if begin <= first_at < end:
                out.append((s["record_start"], n))
            continue
        first = max(0, min(n, floor_div(begin - first_at, duration_ticks)))
        last = max(-1, min(n - 1, ceil_div(end - first_at, duration_ticks) - 1))
        if first <= last:
            out.append((s["record_start"] + first, last - first + 1))
    return out
