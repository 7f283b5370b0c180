"""What reads cost: pruned windows, caches, HTTP ranges, bytes in hand, budgets, many gaps."""

import http.server
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavelake.errors import BudgetError
from wavelake.operators import samples as SA
from wavelake.operators import timeline as L
from wavelake.recording import open_recording
from wavelake.sources import datasource as DS
from wavelake.sources.bytesource import BytesSource, CachedSource
from wavelake.sources.header import read_header
from wavelake.testing import writer as W

D = 10_000_000


class Spy(BytesSource):
    def __init__(self, data):
        super().__init__(data)
        self.reads = []

    def read(self, offset, length):
        self.reads.append((offset, length))
        return super().read(offset, length)


def planned(recording, ranges, spy, monkeypatch, **options):
    """Blocks of ranges as the tasks of a scan yield them, in this process; the spy sees their reads."""
    given = {"path": recording.path, "mode": "blocks", **options} | DS.Known.options(recording.header.raw_bytes, recording.byte_length, recording.timeline, ranges)
    monkeypatch.setattr(DS, "open_with", lambda path, options: spy)
    reader = DS.Reader(StructType.fromDDL(DS.SCHEMAS["blocks"]), given)
    parts = reader.partitions()
    return parts, [row for part in parts for batch in reader.read(part) for row in batch.to_pylist()]


def wide(records=60, signals=30, rate=256):
    rng = np.random.default_rng(0)
    return W.write(W.Spec(record_count=records, signals=[W.SignalSpec(f"EEG {i}", rate, samples=rng.integers(-2000, 2000, (records, rate))) for i in range(signals)]))


def test_a_window_is_one_read_of_its_records(spark, tmp_path, monkeypatch):
    data = wide()
    (path := tmp_path / "w.edf").write_bytes(data)
    r = open_recording(spark, str(path))
    spy = Spy(data)
    parts, rows = planned(r, r.window_runs(20, 10), spy, monkeypatch, signals="3")
    assert len(parts) == 1 and len(rows) == 10
    assert [n for _, n in spy.reads] == [153_600]
    spy.reads.clear()
    _, three = planned(r, r.window_runs(20, 10), spy, monkeypatch, signals="0,4,9")
    assert len(spy.reads) == 1 and len(three) == 30
    got = r.read_window(20, 10, [3]).orderBy("record_index").collect()
    assert [(x.record_index, x.digital) for x in got] == [(x["record_index"], x["digital"]) for x in rows]


def test_plus_files_are_not_probed_by_tasks(spark, tmp_path, monkeypatch):
    data = W.write(W.minimal_plus(record_count=50))
    (path := tmp_path / "p.edf").write_bytes(data)
    r, spy = open_recording(spark, str(path)), Spy(data)
    _, rows = planned(r, [(30, 5)], spy, monkeypatch)
    assert len(spy.reads) == 1 and spy.reads[0][1] == 5 * r.header.record_byte_length
    assert {x["record_index"] for x in rows} == set(range(30, 35))


def test_scrolling_with_and_without_a_cache():
    data = wide(300, 2, 100)
    bare, under = Spy(data), Spy(data)
    cached, h = CachedSource(under, 1 << 20), read_header(BytesSource(data))
    for at in range(0, 300, 10):
        for source in (bare, cached):
            source.read(h.record_offset(at), 10 * h.record_byte_length)
    assert len(bare.reads) == 30 and len(under.reads) == 1


def test_a_worker_keeps_its_cache(tmp_path, monkeypatch):
    (path := tmp_path / "k.edf").write_bytes(wide(20, 2, 50))
    first = DS.open_with(str(path), {"block_bytes": "4096"})
    assert first.read(0, 256)
    first.close()
    monkeypatch.setattr(DS._kept[next(reversed(DS._kept))], "source", None)  # nothing more is read
    assert DS.open_with(str(path), {"block_bytes": "4096"}).read(100, 100)


def test_locate_reads_once(spark, tmp_path, monkeypatch):
    (path := tmp_path / "l.edf").write_bytes(W.write(W.minimal_plus(plus="D", record_count=4096, record_onset=lambda r: r + 5 * (r // 7))))
    r = open_recording(spark, str(path))
    before = len(r._onsets)
    here = r.locate(1000)
    probes = len(r._onsets) - before
    assert probes <= 12
    assert r.locate(1000) == here and len(r._onsets) == before + probes
    assert r.onset_ticks(15) == (15 + 5 * 2) * D
    r.build_index()
    assert r.onset_ticks(15) == (15 + 5 * 2) * D


class Ranges(http.server.BaseHTTPRequestHandler):
    data, served, heads = b"", [], []

    def do_HEAD(self):
        self.heads.append(1)
        self.send_response(200)
        self.send_header("Content-Length", str(len(self.data)))
        self.end_headers()

    def do_GET(self):
        a, b = (int(x) for x in self.headers["Range"].removeprefix("bytes=").split("-"))
        part = self.data[a : b + 1]
        self.served.append(len(part))
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {a}-{b}/{len(self.data)}")
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    handler = type("Handler", (Ranges,), {"served": [], "heads": []})
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield handler, f"http://127.0.0.1:{s.server_port}/night.edf"
        s.shutdown()


def test_http_window(spark, server, tmp_path):
    handler, url = server
    handler.data = wide(3000, 2, 256)
    r = open_recording(spark, url)
    assert sum(handler.served) < len(handler.data) / 500
    handler.served.clear()
    got = sorted(r.read_window(1500, 30, [1]).collect(), key=lambda x: x.record_index)
    assert sum(handler.served) == 30 * r.header.record_byte_length < 65_536 and len(got) == 30
    (path := tmp_path / "n.edf").write_bytes(handler.data)
    local = open_recording(spark, str(path)).read_window(1500, 30, [1]).orderBy("record_index").collect()
    assert [x.digital for x in got] == [x.digital for x in local]


def test_http_scan_without_a_recording(spark, server):
    handler, url = server
    handler.data = wide(40, 2, 50)
    rows = spark.read.format("biosignal").options(path=url, mode="blocks", signals="0", block_bytes="65536").load()
    assert rows.count() == 40
    assert spark.read.format("biosignal").options(path=url, mode="headers").load().first().record_count == 40


@pytest.mark.parametrize("kind", [bytes, memoryview, BytesSource])
def test_bytes_in_hand(spark, tmp_path, kind):
    data = W.write(W.minimal_plus(plus="D", record_count=40, record_onset=lambda r: r + 3 * (r // 10)))
    (path := tmp_path / "b.edf").write_bytes(data)
    held, file = open_recording(spark, kind(data)), open_recording(spark, str(path))
    for r in (held, file):
        r.build_index()
    a, b = (r.read_window(5, 20, [0]).drop("path").orderBy("record_index").collect() for r in (held, file))
    assert a == b and len(a) > 10
    assert held.annotations().drop("path").collect() == file.annotations().drop("path").collect()
    assert held.gaps() == file.gaps()
    assert held.scan("headers").count() == 1
    with pytest.raises(BudgetError):
        held.read_window(0, 5, [0], max_bytes=10)


def test_budgets(spark, tmp_path):
    (path := tmp_path / "g.edf").write_bytes(W.write(W.minimal_plus(plus="D", record_count=60, record_onset=lambda r: 2 * r)))
    r = open_recording(spark, str(path))
    with pytest.raises(BudgetError):
        next(r.stream_records(0, 1, [0], max_bytes=10))
    with pytest.raises(BudgetError):
        r.build_index(max_bytes=1000)
    with pytest.raises(BudgetError):
        r.blocks([0], max_bytes=1)
    with pytest.raises(Exception, match="budget"):
        SA.merge(spark.createDataFrame([("p", 0, i, i * 10, i * D, [1] * 10, 0) for i in range(5)], "path string, signal_index int, record_index bigint, first_sample_index bigint, start_ticks bigint, digital array<int>, out_of_range_count bigint"), D, max_bytes=100).collect()
    r.build_index()
    seen = []
    chunks = list(r.stream_records(0, 120, [0], 1, on_progress=lambda done, of: seen.append((done, of))))
    assert len(chunks) == 60 and seen[-1] == (60, 60)


def test_trimmed_blocks(spark, tmp_path):
    (path := tmp_path / "t.edf").write_bytes(W.write(W.Spec(record_count=6, signals=[W.SignalSpec("EEG A", 7, samples=lambda r, i: r * 7 + i, digital_minimum=0, digital_maximum=30)])))
    r = open_recording(spark, str(path))
    for start, length in ((1.3, 2.2), (0, 6), (2.0, 0.0000001), (4.99, 5)):
        want = r.read_samples(start, length, [0]).orderBy("sample_index").collect()
        got = r.trim(start, length, [0]).orderBy("first_sample_index").collect()
        assert [x for b in got for x in b.digital] == [x.digital for x in want]
        firsts = {x.sample_index: x.start_ticks for x in want}
        assert all(firsts[b.first_sample_index] == b.start_ticks for b in got)
        assert [b.out_of_range_count for b in got] == [sum(x > 30 for x in b.digital) for b in got]


def test_very_many_gaps(spark, tmp_path):
    n = 20_000
    (path := tmp_path / "many.edf").write_bytes(W.write(W.minimal_plus(plus="D", record_count=n, record_onset=lambda r: 2 * r)))
    r = open_recording(spark, str(path))
    r.build_index()
    assert len(r.window_runs(0, 2 * n)) == n
    rows = r.read_window(0, 2 * n, [0]).agg(F.count("*"), F.countDistinct("run_id")).first()
    assert tuple(rows) == (n, n)
    assert r.envelope(0, 2 * n, [0], 2).agg(F.sum("count")).first()[0] == n * r.header.signals[0].samples_per_record


def test_sample_starts_by_buckets(spark):
    runs = spark.createDataFrame([("a", 0, 5000, 0), ("a", 5000, 9000, 10**12), ("b", 0, 10, 7)], "path string, record_start bigint, record_count bigint, start_ticks bigint")
    samples = spark.createDataFrame([("a", 0), ("a", 49_999), ("a", 50_000), ("a", 139_999), ("a", 140_000), ("b", 99), ("b", 100)], "path string, sample_index bigint")
    got = {(x.path, x.sample_index): x.start_ticks for x in L.sample_start_ticks(samples, runs, 10, D).collect()}
    assert got == {("a", 0): 0, ("a", 49_999): 49_999 * D // 10, ("a", 50_000): 10**12, ("a", 139_999): 10**12 + 89_999 * D // 10, ("b", 99): 7 + 99 * D // 10}
