"""spark.read.format("biosignal"): recordings as rows of records, sample blocks, annotations or diagnostics.

Options: path (a file, a folder, a glob, or several joined by line feeds), mode (blocks, records, annotations,
diagnostics, headers, audit), signals (indices or labels joined by commas; blocks only), records_per_partition (whole
files are cut at this many bytes by default), strict; for URLs http_headers (a JSON object) and
allow_full_download; factory and fetch, functions of a user's own (see custom.py); block_bytes and cache_bytes read by blocks that a task keeps. A recording that is open passes
what it knows (header, byte_length, time, ranges): then nothing is listed, tasks are planned for the asked-for
records only, and a task reads just those.

Partitions are planned from file sizes alone, so a million files cost the driver a listing and no reads. Each
task reads the header of its file and at most three records more, to know where the time axis starts; hence no
row depends on how files are cut. Filters on path, record_index and signal_index narrow what is read.
"""

from __future__ import annotations

import base64
import glob
import json
import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..diagnostics import SCHEMA as DIAGNOSTIC_SCHEMA
from ..errors import ChannelNotFoundError, FormatError
from .bytesource import CachedSource, HttpSource, open_source
from .custom import fetch_of, made
from .decode import annotations, digital, out_of_range, read_records, runs, starts, timeline
from .header import Header, parse_header, read_header, signal_row

SPLIT_BYTES = 64 << 20
#: Files that share a partition at most: small ones are packed, so an archive of many isn't as many tasks.
PACKED_FILES = 512
#: What opening a file is worth in bytes when files are packed.
OPEN_BYTES = 1 << 17
_DAY = "struct<year:int,month:int,day:int>"
SIGNAL_FIELDS = """signal_index int, kind string, label string, transducer_type string, prefiltering string, physical_dimension string,
unit string, physical_minimum double, physical_maximum double, digital_minimum bigint, digital_maximum bigint,
samples_per_record bigint, sample_rate_hz double, sample_count bigint, scale struct<bit_value:double,offset:double>,
record_byte_offset bigint, record_byte_length bigint, raw map<string,string>"""
SCHEMAS = {
    "blocks": "path string, record_index bigint, signal_index int, first_sample_index bigint, start_ticks bigint, digital array<int>, out_of_range_count bigint",
    "records": "path string, record_index bigint, onset_ticks bigint, onset_observed boolean, byte_offset bigint",
    "annotations": """path string, signal_index int, record_index bigint, byte_offset_in_record bigint, onset_ticks bigint,
onset_ticks_from_first_record bigint, onset_raw string, duration_ticks bigint, duration_raw string, text string, channel_label string, text_encoding string""",
    "diagnostics": f"path string, stage string, {DIAGNOSTIC_SCHEMA}",
    "audit": f"""path string, kind string, stage string, {DIAGNOSTIC_SCHEMA}, record_count bigint, start_ticks bigint, record_duration_ticks bigint, continuity string,
observed_digital_min int, observed_digital_max int, out_of_range_count bigint, sample_count bigint""",
    "headers": f"""path string, ok boolean, byte_length bigint, variant string, continuity string, bytes_per_sample int, header_byte_length bigint,
declared_header_byte_length double, record_byte_length bigint, data_byte_length bigint, record_duration_seconds double, record_duration_ticks bigint,
record_count bigint, declared_record_count double, record_count_source string,
start_time struct<header_date:{_DAY},recording_id_date:{_DAY},resolved_date:{_DAY},date_source:string,hour:int,minute:int,second:int,clock_source:string,seconds_since_midnight:int>,
patient struct<raw:string,conformant:boolean,code:string,sex:string,birth_date:{_DAY},name:string,extra_subfields:array<string>>,
recording_id struct<raw:string,conformant:boolean,start_date:{_DAY},investigation_code:string,technician_code:string,equipment_code:string,extra_subfields:array<string>>,
reserved string, raw map<string,string>, raw_bytes binary, start_offset_ticks bigint, span_ticks bigint, covered_ticks bigint,
signals array<struct<{", ".join(f.strip().replace(" ", ":", 1) for f in SIGNAL_FIELDS.replace(chr(10), " ").split(", "))}>>,
diagnostics array<struct<{", ".join(f.strip().replace(" ", ":", 1) for f in DIAGNOSTIC_SCHEMA.replace(chr(10), " ").split(", "))}>>""",
}


def is_url(path: str) -> bool:
    return path.startswith(("http://", "https://"))


#: Sources with a cache that this worker keeps from task to task, by where they are and how they are read.
_kept: OrderedDict[tuple, CachedSource] = OrderedDict()
KEPT_SOURCES = 4


class _Borrowed:
    """A kept source; closing it leaves its cache to the worker's next task."""

    def __init__(self, source: CachedSource):
        self.byte_length, self.read = source.byte_length, source.read

    def close(self) -> None:
        pass


def open_with(path: str, options: dict):
    """The source of a path by the options that say how to fetch and to cache."""
    full = str(options.get("allow_full_download", "false")).lower() == "true"
    fetched = lambda: made(path, options) if "factory" in options else HttpSource(path, fetch_of(options), headers=json.loads(options.get("http_headers", "{}")), allow_full_download=full) if is_url(path) else open_source(path)
    if "block_bytes" not in options and "cache_bytes" not in options:
        return fetched()
    sizes = int(options.get("block_bytes", 1 << 20)), int(options.get("cache_bytes", 64 << 20))
    key = (path, *sizes, options.get("http_headers"), options.get("factory"), options.get("fetch"), None if is_url(path) or "factory" in options else os.stat(path.removeprefix("file://")).st_mtime_ns)
    if key not in _kept:
        _kept[key] = CachedSource(fetched(), *sizes)
        if len(_kept) > KEPT_SOURCES:
            _kept.popitem(last=False)[1].close()
    _kept.move_to_end(key)
    return _Borrowed(_kept[key])


@dataclass(frozen=True)
class Known:
    """What an open recording passes on: its header, its time axis and the ranges (first record, number) that are wanted."""

    header: Header
    time: dict
    ranges: tuple[tuple[int, int], ...]

    @staticmethod
    def options(header_bytes: bytes, byte_length: int, time: dict, ranges: list[tuple[int, int]] | None) -> dict[str, str]:
        axis = {"start_offset_ticks": time["start_offset_ticks"], "starts": [[k, v] for k, v in time["starts"].items()]}
        out = {"header": base64.b64encode(header_bytes).decode(), "byte_length": str(byte_length), "time": json.dumps(axis)}
        return out if ranges is None else out | {"ranges": ",".join(f"{a}:{n}" for a, n in ranges)}

    @classmethod
    def read(cls, options: dict) -> Known | None:
        if "header" not in options:
            return None
        header, time = parse_header(base64.b64decode(options["header"]), int(options["byte_length"])), json.loads(options["time"])
        ranges = tuple(tuple(map(int, r.split(":"))) for r in options["ranges"].split(",") if r) if "ranges" in options else ((0, header.record_count),)
        return cls(header, time | {"starts": dict(time["starts"])}, ranges)

    def pieces(self, start: int, stop: int | None, split_bytes: int) -> list[tuple[int, int]]:
        """[first, last) of at most split_bytes each that the ranges have in [start, stop)."""
        step, out = max(1, split_bytes // max(1, self.header.record_byte_length)), []
        for first, count in self.ranges:
            low, high = max(first, start), first + count if stop is None else min(first + count, stop)
            out += [(at, min(at + step, high)) for at in range(low, high, step)]
        return out


def list_files(path: str, options: dict | None = None) -> list[tuple[str, int]]:
    """Files and their sizes. A URL costs one request, and a path for a factory one source."""
    found: list[str] = []
    if "factory" in (options or {}):
        sizes = []
        for one in path.split("\n"):
            source = open_with(one, options)
            sizes.append((one, source.byte_length))
            source.close()
        return sizes
    urls = [one for one in path.split("\n") if is_url(one)]
    for one in path.split("\n"):
        one = one.removeprefix("file://")
        if is_url(one):
            continue
        if os.path.isdir(one):
            found += sorted(os.path.join(top, f) for top, _, files in os.walk(one) for f in files if f.lower().endswith((".edf", ".bdf", ".rec")))
        else:
            found += sorted(glob.glob(one)) or [one]
    return [(f, os.path.getsize(f)) for f in found] + [(u, open_with(u, options or {}).byte_length) for u in urls]


def pick_signals(header: Header, wanted: str | None) -> list[int]:
    """Data signals by index or label, each once, in the order of first mention; without a wish, all."""
    if wanted is None:
        return header.data_signals
    out: list[int] = []
    for one in filter(None, (w.strip() for w in wanted.split(","))):
        own = [int(one)] if one.lstrip("-").isdigit() else [s.index for s in header.signals if s.label == one]
        if not own or not all(0 <= i < len(header.signals) for i in own):
            raise ChannelNotFoundError(one, [s.label for s in header.signals])
        if any(header.signals[i].kind != "data" for i in own):
            raise ValueError(f"signal {one} holds annotations, not samples")
        out += [i for i in own if i not in out]
    return out


def header_row(path: str, size: int, header: Header, time: dict, found: list) -> dict:
    start = header.start_time
    row = {k: getattr(header, k) for k in "variant continuity bytes_per_sample header_byte_length declared_header_byte_length record_byte_length data_byte_length record_duration_seconds record_duration_ticks record_count declared_record_count record_count_source reserved raw raw_bytes".split()}
    return row | {
        "path": path,
        "ok": True,
        "byte_length": size,
        "start_time": asdict(start) | {"seconds_since_midnight": start.seconds_since_midnight},
        "patient": header.patient | {"birth_date": asdict(header.patient["birth_date"]) if header.patient["birth_date"] else None},
        "recording_id": header.recording | {"start_date": asdict(header.recording["start_date"]) if header.recording["start_date"] else None},
        **{k: time[k] for k in ("start_offset_ticks", "span_ticks", "covered_ticks")},
        "signals": [signal_row(s) for s in header.signals],
        "diagnostics": [d.row() for d in found],
    }


def scan(source, path: str, mode: str, part: int = 0, parts: int = 1, start: int = 0, stop: int | None = None, signals: str | None = None, only: set[int] | None = None, strict: bool = False, known: Known | None = None) -> Iterator[dict[str, list] | dict[str, np.ndarray]]:
    """Columns of a mode's rows for one part of a file; records outside [start, stop) and signals not in only are left out."""
    if mode == "headers":
        try:
            header = read_header(source, strict)
            time = timeline(source, header, strict)
            row = header_row(path, source.byte_length, header, time, [*header.diagnostics, *time["diagnostics"]])
        except FormatError as e:
            row = {"path": path, "ok": False, "byte_length": source.byte_length, "diagnostics": [d.row() for d in e.diagnostics]}
        yield {k: [v] for k, v in row.items()}
        return
    if mode == "audit":
        yield from audit(source, path, part, parts, start, stop, known, signals != "")
        return
    header = known.header if known else read_header(source, strict)
    time = known.time if known else timeline(source, header, strict)
    origin = time["start_offset_ticks"]
    first, last = _share(header.record_count, part, parts, start, stop)
    if mode == "diagnostics" and part == 0:
        for stage, found in (("header", header.diagnostics), ("timeline", time["diagnostics"])):
            yield _diagnostic_columns(path, stage, found)
    chosen = [i for i in pick_signals(header, signals) if only is None or i in only] if mode == "blocks" else []
    timed = bool(header.annotation_signals)
    whole = strict or mode in ("annotations", "diagnostics")
    for at, count in runs(header, first, last):
        data = read_records(source, header, at, count) if timed or mode == "blocks" else b""
        found = annotations(header, data, at, origin, strict=strict) if timed and whole else {"annotations": [], "diagnostics": []}
        onsets, observed = record_starts(header, data, at, count, time)
        if mode == "records":
            yield {"path": [path] * count, "record_index": np.arange(at, at + count), "onset_ticks": onsets, "onset_observed": observed, "byte_offset": header.record_offset(at) + np.arange(count) * header.record_byte_length}
        elif mode == "annotations":
            rows = [a for a in found["annotations"] if only is None or a["signal_index"] in only]
            yield {k: [a[k] for a in rows] for k in rows[0]} | {"path": [path] * len(rows), "onset_ticks_from_first_record": [max(-(2**63), min(2**63 - 1, a["onset_ticks"] - origin)) for a in rows]} if rows else {}
        elif mode == "diagnostics":
            yield _diagnostic_columns(path, "records", found["diagnostics"])
        else:
            for i in chosen:
                signal = header.signals[i]
                values = digital(header, data, signal)
                offsets = np.arange(0, values.size + 1, max(1, values.shape[1])) if values.shape[1] else np.zeros(count + 1, int)
                yield {"path": [path] * count, "record_index": np.arange(at, at + count), "signal_index": np.full(count, i, np.int32), "first_sample_index": np.arange(at, at + count) * signal.samples_per_record, "start_ticks": onsets - origin, "digital": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel(), pa.int32())), "out_of_range_count": out_of_range(values, signal)}


def _share(n: int, part: int, parts: int, start: int, stop: int | None) -> tuple[int, int]:
    """[first, last) of the part-th of so many parts of n records, within [start, stop)."""
    return max(start, n * part // parts), min(n if stop is None else stop, n * (part + 1) // parts)


def record_starts(header: Header, data: bytes, at: int, count: int, time: dict) -> tuple[np.ndarray, np.ndarray]:
    """(onsets, observed) of records; what record 0 itself doesn't say, record 1 or the grid does."""
    if not header.annotation_signals:
        return np.arange(at, at + count) * header.record_duration_ticks, np.zeros(count, bool)
    onsets, observed = starts(header, data, at, time["start_offset_ticks"])
    for record, onset in time["starts"].items():
        if at <= record < at + count and not observed[record - at]:
            onsets[record - at] = onset
    return onsets, observed


def audit(source, path: str, part: int, parts: int, start: int, stop: int | None, known: Known | None, samples: bool) -> Iterator[dict]:
    """All that validation asks of a part of a file, by reading each record once.

    kind `finding`: what the header, the rules on it, the time axis and the records show; `run`: a run of records
    that follow each other without a gap, as far as this part sees; `stats`: of the samples of a signal in this part.
    A header that can't be read is a finding.
    """
    from ..operators.validate import header_rules

    def findings(stage: str, found) -> dict:
        return _diagnostic_columns(path, stage, found) | {"kind": ["finding"] * len(found)} if found else {}

    try:
        header = known.header if known else read_header(source)
    except FormatError as e:
        if part == 0:
            yield findings("header", e.diagnostics)
        return
    time = known.time if known else timeline(source, header)
    origin, d = time["start_offset_ticks"], header.record_duration_ticks
    if part == 0 and not known:
        for stage, found in (("header", header.diagnostics), ("rules", header_rules(header)), ("timeline", time["diagnostics"])):
            yield findings(stage, found)
    chosen = [header.signals[i] for i in header.data_signals] if samples else []
    timed, stats = bool(header.annotation_signals), {}
    for at, count in runs(header, *_share(header.record_count, part, parts, start, stop)):
        data = read_records(source, header, at, count) if timed or chosen else b""
        if timed:
            yield findings("records", annotations(header, data, at, origin)["diagnostics"])
        onsets, _ = record_starts(header, data, at, count, time)
        begins = np.flatnonzero(np.concatenate([[True], np.diff(onsets) != d]))
        yield {"path": [path] * len(begins), "kind": ["run"] * len(begins), "record_index": at + begins, "record_count": np.diff(np.append(begins, count)), "start_ticks": onsets[begins] - origin, "record_duration_ticks": np.full(len(begins), d), "continuity": [header.continuity] * len(begins)}
        for s in chosen:
            values = digital(header, data, s)
            if values.size:
                low, high, out, n = stats.get(s.index, (values.max(), values.min(), 0, 0))
                stats[s.index] = min(low, values.min()), max(high, values.max()), out + int(out_of_range(values, s).sum()), n + values.size
    rows = [(i, *map(int, v)) for i, v in stats.items()]
    if rows:
        names = ("signal_index", "observed_digital_min", "observed_digital_max", "out_of_range_count", "sample_count")
        yield {"path": [path] * len(rows), "kind": ["stats"] * len(rows), **dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))}


def _diagnostic_columns(path: str, stage: str, found) -> dict[str, list]:
    rows = [d.row() for d in found]
    return {k: [r[k] for r in rows] for k in rows[0]} | {"path": [path] * len(rows), "stage": [stage] * len(rows)} if rows else {}


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


@dataclass
class Part(InputPartition):
    """Pieces of files: (path, k, n, first, last) is the k-th of n parts of the records [first, last) of a file, None for all."""

    pieces: tuple[tuple[str, int, int, int | None, int | None], ...]


def packed(pieces: list[tuple], weights: list[int], most: int) -> list[Part]:
    """Neighbouring pieces together, up to so many bytes or PACKED_FILES files."""
    out, held, size = [], [], 0
    for piece, weight in zip(pieces, weights, strict=True):
        if held and (size + weight > most or len(held) >= PACKED_FILES):
            out.append(Part(tuple(held)))
            held, size = [], 0
        held.append(piece)
        size += weight
    return [*out, Part(tuple(held))]


class Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.options = to_arrow_schema(schema), dict(options)
        self.start, self.stop, self.only, self.paths = 0, None, None, None

    def pushFilters(self, filters):
        for f in filters:
            name, value = f.attribute[0] if hasattr(f, "attribute") else None, getattr(f, "value", None)
            if name == "record_index" and isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                    self.start = max(self.start, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    stop = value + (not isinstance(f, LessThan))
                    self.stop = stop if self.stop is None else min(self.stop, stop)
            elif name in ("signal_index", "path") and isinstance(f, EqualTo | In):
                own = set(value) if isinstance(f, In) else {value}
                kept = "only" if name == "signal_index" else "paths"
                setattr(self, kept, own if getattr(self, kept) is None else getattr(self, kept) & own)
            yield f  # Spark checks every filter again

    def partitions(self):
        split, known = int(self.options.get("split_bytes", SPLIT_BYTES)), Known.read(self.options)
        if known:
            path, size = self.options["path"], known.header.record_byte_length
            if "records_per_partition" in self.options:
                return [Part(((path, 0, 1, a, b),)) for a, b in known.pieces(self.start, self.stop, int(self.options["records_per_partition"]) * max(1, size))] or [Part(())]
            pieces = known.pieces(self.start, self.stop, split)
            return packed([(path, 0, 1, a, b) for a, b in pieces], [max(OPEN_BYTES, (b - a) * size) for a, b in pieces], split)
        files = [(f, s) for f, s in list_files(self.options["path"], self.options) if self.paths is None or f in self.paths]
        if self.options.get("mode", "blocks") == "headers":
            return packed([(f, 0, 1, None, None) for f, _ in files], [OPEN_BYTES] * len(files), split)
        if "records_per_partition" in self.options:
            out = []
            for f, _ in files:
                source = open_with(f, self.options)
                n = max(1, -(-read_header(source).record_count // int(self.options["records_per_partition"])))
                source.close()
                out += [Part(((f, k, n, None, None),)) for k in range(n)]
            return out or [Part(())]
        pieces, weights = [], []
        for f, size in files:
            n = max(1, -(-size // split))
            pieces += [(f, k, n, None, None) for k in range(n)]
            weights += [max(OPEN_BYTES, size // n)] * n
        return packed(pieces, weights, split)

    def read(self, part: Part):
        strict, known = str(self.options.get("strict", "false")).lower() == "true", Known.read(self.options)
        for path, k, n, first, last in part.pieces:
            source = open_with(path, self.options)
            start, stop = (self.start, self.stop) if first is None else (first, last)
            try:
                for columns in scan(source, path, self.options.get("mode", "blocks"), k, n, start, stop, self.options.get("signals"), self.only, strict, known):
                    if columns:
                        yield to_batch(columns, self.schema)
            finally:
                source.close()


class BiosignalSource(DataSource):
    @classmethod
    def name(cls):
        return "biosignal"

    def schema(self):
        return SCHEMAS[self.options.get("mode", "blocks")]

    def reader(self, schema):
        return Reader(schema, self.options)
