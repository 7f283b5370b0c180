"""One recording, opened: metadata on the driver, everything that grows with it as DataFrames."""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .diagnostics import Diagnostic
from .control import Abort, run
from .errors import AmbiguousChannelError, ChannelNotFoundError, FormatError, RecordRangeError
from .functions import ticks as K
from .operators import annotations as A
from .operators import envelope as E
from .operators import samples as S
from .operators import timeline as T
from .operators import triggers as G
from .plans import window as W
from .shipping import ship
from .sources import decode
from .sources.bytesource import SliceSource, open_source
from .sources.custom import options_of
from .sources.datasource import SCHEMAS, BiosignalSource, Known, open_with, scan, to_batch
from .sources.header import Header, Signal, is_annotation_label, parse_header, read_header, signal_count_hint

from .constants import BLOCK_BYTES, INSPECT_BYTES  # isort: skip

#: What a row of the index is worth in bytes on the driver.
SEGMENT_BYTES = 512


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session and lets filters reach the reader."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BiosignalSource)
    return spark


def find_signals(header: Header, label: str) -> list[Signal]:
    return [s for s in header.signals if s.label == label]


def get_signal(header: Header, which: int | str) -> Signal:
    """The one signal of an index or label; never the first of several."""
    labels = [s.label for s in header.signals]
    if isinstance(which, int):
        if not 0 <= which < len(labels):
            raise ChannelNotFoundError(which, labels)
        return header.signals[which]
    found = find_signals(header, which)
    if not found:
        raise ChannelNotFoundError(which, labels)
    if len(found) > 1:
        raise AmbiguousChannelError(which, [s.index for s in found])
    return found[0]


def match_signals(header: Header, match: str | re.Pattern | Callable[[str], bool]) -> list[Signal]:
    """Data signals whose label a pattern finds or a predicate accepts."""
    holds = match if callable(match) else re.compile(match).search
    return [s for s in header.signals if s.kind == "data" and holds(s.label)]


def status_signal(header: Header) -> Signal | None:
    if header.bytes_per_sample != 3:
        return None
    return next((s for s in header.signals if s.label.strip().lower() == "status"), None)


class Recording:
    """Opened by `open_recording`. Methods that select signals or records check them at once; the rest is lazy.

    A path or URL is read by tasks, which get the header and the time axis from here and read only the records that
    are asked for. Anything else that bytes come from (bytes, a file object, an object with byte_length and read) is
    read here, within max_bytes, and sent to the tasks by ranges of records.
    """

    def __init__(self, spark: SparkSession, what, strict: bool = False, **options):
        self.spark, self.options = register(spark), options_of(options)
        self.path = os.fspath(what) if isinstance(what, str | os.PathLike) else "memory"
        self._held = None if self.path != "memory" else open_source(what)
        source = self._open()
        try:
            self.byte_length = source.byte_length
            self.header = read_header(source, strict)
            self.timeline = decode.timeline(source, self.header, strict)
        finally:
            self._close(source)
        self._onsets: dict[int, int] = dict(self.timeline["starts"])
        self._index: list[dict] | None = None

    def _open(self):
        return self._held or open_with(self.path, self.options)

    def _close(self, source) -> None:
        if source is not self._held:
            source.close()

    # -- scans
    def scan(self, mode: str, ranges: list[tuple[int, int]] | None = None, max_bytes: float | None = None, **options) -> DataFrame:
        """Rows of a mode; of the ranges (first record, number) only, if given."""
        known = mode in ("blocks", "records", "annotations", "audit")
        if self._held is not None:
            return self._sent(mode, ranges if known and ranges is not None else [(0, self.header.record_count)], max_bytes, options.get("signals"))
        given = {"path": self.path, "mode": mode, **self.options, **{k: v for k, v in options.items() if v is not None}}
        if known:
            given |= Known.options(self.header.raw_bytes, self.byte_length, self.timeline, ranges)
        return self.spark.read.format("biosignal").options(**given).load()

    def _sent(self, mode: str, ranges: list[tuple[int, int]], max_bytes: float | None, signals: str | None) -> DataFrame:
        h, pieces = self.header, []
        decode.check_budget("reading", sum(n for _, n in ranges) * h.record_byte_length, max_bytes)
        for first, count in ranges:
            pieces += [(at, at + n, self._held.read(h.record_offset(at), n * h.record_byte_length)) for at, n in decode.runs(h, first, first + count)]
        known, path, size = Known(h, self.timeline, ()), self.path, self.byte_length
        if mode in ("headers", "diagnostics"):
            pieces = [(0, h.record_count, b"".join(p[2] for p in pieces))]
            known = None
        arrow = to_arrow_schema(StructType.fromDDL(SCHEMAS[mode]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, stop, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    source = SliceSource(h.raw_bytes, h.record_offset(first), data, size)
                    for columns in scan(source, path, mode, 0, 1, first, stop, signals, known=known):
                        if columns:
                            yield to_batch(columns, arrow)

        rows = self.spark.createDataFrame(pieces, "first bigint, stop bigint, data binary")
        return rows.mapInArrow(run, SCHEMAS[mode])

    def signals(self, indices: list[int]) -> list[Signal]:
        """Data signals by index, each once, in the order of first mention."""
        out: list[Signal] = []
        for i in indices:
            s = get_signal(self.header, i)
            if s.kind != "data":
                raise ValueError(f"signal {i} holds annotations; read them with annotations()")
            out += [s] if s not in out else []
        return out

    def records(self) -> DataFrame:
        """path, record_index, onset_ticks, onset_observed, byte_offset. Without annotation signals nothing is read."""
        if self.header.annotation_signals:
            return self.scan("records")
        h = self.header
        return self.spark.range(h.record_count).select(F.lit(self.path).alias("path"), F.col("id").alias("record_index"), (F.col("id") * h.record_duration_ticks).alias("onset_ticks"), F.lit(False).alias("onset_observed"), (F.lit(h.header_byte_length) + F.col("id") * h.record_byte_length).alias("byte_offset"))

    def _blocks(self, chosen: list[int], ranges: list[tuple[int, int]], max_bytes: float | None) -> DataFrame:
        """Blocks of ranges of records by tasks that read nothing else. max_bytes, if given, bounds the bytes read."""
        for first, count in ranges:
            decode.check_records(self.header, first, count)
        if max_bytes is not None:
            decode.check_budget("reading", sum(n for _, n in ranges) * self.header.record_byte_length, max_bytes)
        return self.scan("blocks", ranges if chosen else [], max_bytes, signals=",".join(map(str, chosen)))

    def blocks(self, signal_indices: list[int], start: int = 0, count: int | None = None, max_bytes: float | None = None) -> DataFrame:
        count = self.header.record_count - start if count is None else count
        return self._blocks([s.index for s in self.signals(signal_indices)], [(start, count)], max_bytes)

    # -- time
    def run(self, action: Callable[[], object], abort: Abort | None = None, on_progress: Callable[[int, int], None] | None = None):
        """What an action on this recording's rows gives, which `abort` may end; on_progress is told records done and all records."""
        return run(self.spark, action, abort, on_progress, self.header.record_count)

    def build_index(self, max_bytes: float | None = None, abort: Abort | None = None, on_progress: Callable[[int, int], None] | None = None) -> DataFrame:
        """Segments of the recording; afterwards windows may cross gaps. One row per segment comes to the driver, within max_bytes."""
        found = T.segments(T.check_monotonic(self.records()), self.header.record_duration_ticks, self.timeline["start_offset_ticks"])
        rows = self.run(lambda: decode.bounded(found.orderBy("segment_index"), SEGMENT_BYTES, max_bytes, "segments"), abort, on_progress)
        self._index = [r.asDict() for r in rows]
        return self.spark.createDataFrame(rows, found.schema)

    @property
    def coverage(self) -> str:
        return "probed" if self._index is None else "complete"

    def contiguity(self) -> str:
        return "unknown" if self._index is None else "contiguous" if len(self._index) <= 1 else "discontinuous"

    def gaps(self) -> list[dict]:
        if self._index is None:
            raise RecordRangeError("gaps need the complete index: call build_index() first")
        return [{"before_segment_index": a["segment_index"], "after_segment_index": b["segment_index"], "start_ticks": a["end_ticks"], "end_ticks": b["start_ticks"], "duration_ticks": b["start_ticks"] - a["end_ticks"]} for a, b in zip(self._index, self._index[1:], strict=False)]

    def _covering(self, rows: list[dict] | None, seconds: float) -> dict | None:
        if rows is None:
            raise RecordRangeError("this needs the complete index: call build_index() first")
        t = K.from_seconds(seconds)
        return next((r for r in rows if r["start_ticks"] <= t < r["end_ticks"]), None)

    def segment_at(self, seconds: float) -> dict | None:
        return self._covering(self._index, seconds)

    def gap_at(self, seconds: float) -> dict | None:
        return self._covering(None if self._index is None else self.gaps(), seconds)

    def gap_before(self, record: int) -> dict | None:
        if self._index is None:
            return None
        at = {s["record_start"]: s["segment_index"] for s in self._index}
        return next((g for g in self.gaps() if g["after_segment_index"] == at.get(record)), None)

    def _onset(self, source, record: int) -> int:
        """Start of a record on the header's axis; what was read once is kept."""
        h = self.header
        if record not in self._onsets:
            self._onsets[record] = decode.probe(source, h, record, self.timeline["start_offset_ticks"])[0] if h.annotation_signals else record * h.record_duration_ticks
        return self._onsets[record]

    def onset_ticks(self, record: int) -> int:
        """Start of a record on the recording's axis: by the index if it is built, else by one probe of the record."""
        decode.check_records(self.header, record, 1)
        if self._index is not None:
            s = self._index[bisect_right([s["record_start"] for s in self._index], record) - 1]
            return s["start_ticks"] + (record - s["record_start"]) * self.header.record_duration_ticks
        source = self._open()
        try:
            return self._onset(source, record) - self.timeline["start_offset_ticks"]
        finally:
            self._close(source)

    def locate(self, seconds: float) -> dict | None:
        """The record that holds an instant, by probes of single records in halves; a later call reuses them."""
        h, zero = self.header, self.timeline["start_offset_ticks"]
        if not h.record_count:
            return None
        target, source = K.from_seconds(seconds) + zero, self._open()
        onset = lambda r: self._onset(source, r)
        try:
            low, high = 0, h.record_count
            if target < onset(0):
                return None
            while high - low > 1:
                middle = (low + high) // 2 if high < h.record_count else h.record_count - 1
                if onset(middle) < onset(low) or (high < h.record_count and onset(high) < onset(middle)):
                    decode.check_monotonic([onset(low), onset(middle)], low)
                    decode.check_monotonic([onset(middle), onset(high)], middle)
                low, high = (middle, high) if onset(middle) <= target else (low, middle)
                if low == h.record_count - 1:
                    break
            start = onset(low)
        finally:
            self._close(source)
        into = target - start
        if into != 0 if not h.record_duration_ticks else into >= h.record_duration_ticks:
            return None
        return {"record_index": low, "record_start_ticks": start - zero, "offset_in_record_ticks": into}

    def sample_at(self, signal_index: int, seconds: float) -> dict | None:
        signal, found = self.signals([signal_index])[0], self.locate(seconds)
        if found is None or not signal.samples_per_record:
            return None
        d = self.header.record_duration_ticks
        within = min(signal.samples_per_record - 1, found["offset_in_record_ticks"] * signal.samples_per_record // d) if d else 0
        return {"sample_index": found["record_index"] * signal.samples_per_record + within, "record_index": found["record_index"], "sample_within_record": within}

    def window_runs(self, start_seconds: float, duration_seconds: float) -> list[tuple[int, int]]:
        return W.resolve(self.timeline, self.header.record_duration_ticks, self._index, start_seconds, duration_seconds)

    def _runs(self, runs: list[tuple[int, int]], **more: tuple[str, list]) -> DataFrame:
        """run_id, run_first, run_count and more columns (type, values) of each run, a small table to be joined."""
        kinds = "".join(f", {name} {kind}" for name, (kind, _) in more.items())
        rows = [(k, first, count, *(values[k] for _, values in more.values())) for k, (first, count) in enumerate(runs)]
        return self.spark.createDataFrame(rows, f"run_id int, run_first bigint, run_count bigint{kinds}")

    # -- windows
    def read_records(self, start: int, count: int, signal_indices: list[int], max_bytes: float | None = None) -> DataFrame:
        return self.blocks(signal_indices, start, count, max_bytes).withColumn("run_id", F.lit(0))

    def read_window(self, start_seconds: float, duration_seconds: float, signal_indices: list[int], max_bytes: float | None = None) -> DataFrame:
        """Blocks of the records a window touches, run_id for each contiguous run; no rows inside a gap."""
        chosen = [s.index for s in self.signals(signal_indices)]
        found = self.window_runs(start_seconds, duration_seconds)
        blocks = self._blocks(chosen, found, max_bytes)
        if len(found) <= 1:
            return blocks.withColumn("run_id", F.lit(0))
        return T.with_run(blocks, self._runs(found), F.col("record_index")).drop("run_first", "run_count")

    def trim(self, start_seconds: float, duration_seconds: float, signal_indices: list[int], max_bytes: float | None = None) -> DataFrame:
        """Blocks cut to the samples whose start lies in the window: each with its own start, first sample and out-of-range count."""
        chosen, d = self.signals(signal_indices), self.header.record_duration_ticks
        blocks = self.read_window(start_seconds, duration_seconds, signal_indices, max_bytes)
        begin = K.from_seconds(start_seconds)
        return S.trim(blocks, begin, begin + K.from_seconds(duration_seconds), {s.index: (s.samples_per_record, s.digital_minimum, s.digital_maximum) for s in chosen}, d)

    def read_samples(self, start_seconds: float, duration_seconds: float, signal_indices: list[int]) -> DataFrame:
        """Samples whose published start lies in the window, with physical values (null without a scale)."""
        chosen = self.signals(signal_indices)
        rows = S.explode(self.read_window(start_seconds, duration_seconds, signal_indices), {s.index: max(1, s.samples_per_record) for s in chosen}, self.header.record_duration_ticks)
        value = F.lit(None).cast("double")
        for s in chosen:
            if s.scale:
                value = F.when(F.col("signal_index") == s.index, S.physical_of(s, F.col("digital"))).otherwise(value)
        return rows.where(S.in_window(F.col("start_ticks"), start_seconds, duration_seconds)).withColumn("physical", value)

    def stream_records(self, start_seconds: float, duration_seconds: float, signal_indices: list[int], chunk_records: int = 256, max_bytes: float | None = None, on_progress: Callable[[int, int], None] | None = None, abort: Abort | None = None) -> Iterator[list]:
        """Chunks of at most chunk_records records, in order, never across a gap; equal to read_window as a whole.

        A chunk is no larger than max_bytes of samples. on_progress is told the records done and all records. abort ends
        the stream within a chunk, and no chunk follows.
        """
        if isinstance(chunk_records, bool) or not isinstance(chunk_records, int) or chunk_records < 1:
            raise ValueError("chunk_records must be a positive integer")
        chosen = self.signals(signal_indices)
        decode.check_budget("a chunk", 4 * chunk_records * sum(s.samples_per_record for s in chosen), max_bytes)
        runs = self.window_runs(start_seconds, duration_seconds)
        done, total = 0, sum(n for _, n in runs)
        for first, count in runs:
            for at in range(first, first + count, chunk_records):
                n = min(chunk_records, first + count - at)
                yield self.run(lambda at=at, n=n: self.blocks([s.index for s in chosen], at, n).orderBy("record_index", "signal_index").collect(), abort)
                done += n
                if on_progress:
                    on_progress(done, total)

    # -- events
    def annotations(self, start: int = 0, count: int | None = None) -> DataFrame:
        count = self.header.record_count - start if count is None else count
        decode.check_records(self.header, start, count)
        return self.scan("annotations", [(start, count)]).orderBy(*A.ORDER)

    def triggers(self, start_seconds: float, duration_seconds: float) -> DataFrame:
        signal = status_signal(self.header)
        if signal is None:
            raise ValueError("the recording has no Status signal of 24 bits")
        blocks = self.read_window(start_seconds, duration_seconds, [signal.index])
        rows = S.explode(blocks, {signal.index: signal.samples_per_record}, self.header.record_duration_ticks)
        found = G.triggers(rows.join(blocks.select("record_index", "run_id"), "record_index"), start_seconds, duration_seconds)
        gap = "struct<start_ticks:bigint,end_ticks:bigint,duration_ticks:bigint>"
        runs = self.window_runs(start_seconds, duration_seconds)
        ends = {} if self._index is None else {b["record_start"]: g for b, g in zip(self._index[1:], self.gaps(), strict=True)}
        before = [(g["start_ticks"], g["end_ticks"], g["duration_ticks"]) if (g := ends.get(first)) else None for first, _ in runs]
        joined = found.join(self._runs(runs, before=(gap, before)).select("run_id", "before"), "run_id", "left")
        at_gap = F.col("first_of_run") & (F.col("ticks") == F.col("before.end_ticks"))
        return joined.select(*found.columns, F.when(at_gap, F.col("before")).alias("preceded_by_gap"))

    # -- envelopes
    def _enveloped(self, start_seconds: float, duration_seconds: float, chosen: list[Signal], buckets: list[int], rule: list[tuple[int, int] | None]) -> DataFrame:
        """Blocks of a window folded by run: even buckets, or num and den of a fixed width where rule gives them."""
        runs = self.window_runs(start_seconds, duration_seconds)
        table = self._runs(runs, buckets=("int", buckets), num=("bigint", [r and r[0] for r in rule]), width=("bigint", [r and r[1] for r in rule]))
        blocks = self.read_window(start_seconds, duration_seconds, [s.index for s in chosen]).join(table, "run_id")
        rate = F.create_map(*[F.lit(x) for s in chosen for x in (s.index, s.samples_per_record)])[F.col("signal_index")]
        placed = blocks.withColumn("first_position", F.col("first_sample_index") - F.col("run_first") * rate)
        wide = lambda c: c.cast(K.WIDE)
        num = F.coalesce(wide(F.col("num")), wide(F.col("buckets")))
        den = F.coalesce(wide(F.col("width")) * rate, wide(F.col("run_count") * rate))
        return E.fold_blocks(placed, num, den, F.col("buckets"))

    def envelope(self, start_seconds: float, duration_seconds: float, signal_indices: list[int], buckets: int, max_bytes: float | None = None) -> DataFrame:
        """path, run_id, signal_index, bucket, min, max, count over whole records; the same for any partitioning."""
        E.even_count(buckets, 1)
        chosen, runs = self.signals(signal_indices), self.window_runs(start_seconds, duration_seconds)
        counts = [E.even_count(buckets, max((s.samples_per_record * n for s in chosen), default=1)) for _, n in runs]
        E.check_budget(sum(counts), len(chosen), decode.budget(max_bytes))
        return self._enveloped(start_seconds, duration_seconds, chosen, counts, [None] * len(runs))

    def envelope_at_resolution(self, start_seconds: float, duration_seconds: float, signal_indices: list[int], seconds_per_bucket: float, max_bytes: float | None = None) -> DataFrame:
        chosen, runs, d = self.signals(signal_indices), self.window_runs(start_seconds, duration_seconds), self.header.record_duration_ticks
        if not seconds_per_bucket > 0 or seconds_per_bucket == float("inf"):
            raise ValueError("seconds_per_bucket must be positive and finite")
        width = K.from_seconds(seconds_per_bucket)
        found = [E.resolution(n * d, width, max((s.samples_per_record * n for s in chosen), default=1)) for _, n in runs]
        E.check_budget(sum(count for count, _ in found), len(chosen), decode.budget(max_bytes))
        return self._enveloped(start_seconds, duration_seconds, chosen, [count for count, _ in found], [(d, width) if kept else None for _, kept in found])


def open_recording(spark: SparkSession, what, strict: bool = False, **options) -> Recording:
    """what: a path, a URL, bytes, a file object, or anything with byte_length and read(offset, length)."""
    return Recording(spark, what, strict, **options)


def inspect(what) -> dict:
    """Triage by at most two reads and 128 KiB. Bad content never raises; a source that cannot be read does."""
    source = open_source(what)
    size = source.byte_length
    fixed = source.read(0, min(BLOCK_BYTES, size))
    n = signal_count_hint(fixed) if len(fixed) == BLOCK_BYTES else None
    out = {"ok": False, "byte_length": size, "bytes_read": len(fixed), "header": None, "variant": None}
    if n and BLOCK_BYTES * (n + 1) > INSPECT_BYTES:
        return out | {"diagnostics": [Diagnostic("HEADER_EXCEEDS_INSPECTION_BUDGET", f"a header of {n} signals is larger than {INSPECT_BYTES} bytes", field="header")]}
    more = min(BLOCK_BYTES * n, size - BLOCK_BYTES) if n else 0
    data = fixed + (source.read(BLOCK_BYTES, more) if more > 0 else b"")
    out["bytes_read"] = len(data)
    try:
        header = parse_header(data, size)
    except FormatError as e:
        return out | {"diagnostics": list(e.diagnostics)}
    except Exception as e:  # whatever a hostile header does, triage goes on
        return out | {"diagnostics": [Diagnostic("INSPECTION_FAILED", f"{type(e).__name__}: {e}")]}
    return out | {"ok": not any(d.severity == "error" for d in header.diagnostics), "header": header, "variant": header.variant, "diagnostics": list(header.diagnostics)}


__all__ = ["Recording", "find_signals", "get_signal", "inspect", "is_annotation_label", "match_signals", "open_recording", "register", "status_signal"]
