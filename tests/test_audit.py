"""Record starts in bulk and validation in one traversal, against the parts they stand for."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators import samples as S
from wavelake.operators import timeline as L
from wavelake.operators import validate as V
from wavelake.recording import open_recording, register
from wavelake.sources import decode
from wavelake.sources.bytesource import open_source
from wavelake.sources.header import read_header
from wavelake.sources.tal import parse_region, usual_starts
from wavelake.testing import writer as Wr

PIECES = [b"+", b"-", b"0", b"1", b"23", b".", b"5", b"\x14", b"\x14", b"\x15", b"\x00", b"a", b"+1\x14\x14\x00", b"+12.5\x14\x14\x00", b"99999999999", b"-3.14159265\x14\x14\x00"]


@pytest.mark.parametrize("width", [1, 5, 30, 70])
def test_usual_starts_are_those_of_the_parser(width):
    r = random.Random(width)
    regions = [b"".join(r.choice(PIECES) for _ in range(r.randrange(1, 12)))[:width].ljust(width, b"\0") for _ in range(4000)]
    ticks, usual = usual_starts(np.frombuffer(b"".join(regions), np.uint8).reshape(-1, width))
    for k in np.flatnonzero(usual):
        tals, _ = parse_region(regions[k])
        assert tals[0].ordinal == 0 and tals[0].onset == ticks[k], regions[k]


def corrupted(seed):
    r = random.Random(seed)
    tals = lambda k: [Wr.Tal(k + 0.5, None, ("note",))] * r.randrange(3)
    data = bytearray(Wr.write(Wr.Spec(record_count=60, plus="D", record_onset=lambda k: k + 3 * (k // 9), signals=[Wr.SignalSpec("Fp1", 4)], annotations=[Wr.AnnotationSpec(40, tals=tals)])))
    head = read_header(open_source(bytes(data)))
    for _ in range(12 if seed else 0):
        at = head.record_offset(r.randrange(60)) + head.signals[head.annotation_signals[0]].record_byte_offset + r.randrange(12)
        data[at] = r.choice(b"\0\x14\x15+-19a.")
    return bytes(data)


@pytest.mark.parametrize("seed", range(6))
def test_starts_are_those_of_the_annotations(seed):
    source = open_source(corrupted(seed))
    header = read_header(source)
    for at, count in ((0, 60), (7, 20)):
        data = decode.read_records(source, header, at, count)
        onsets, observed = decode.starts(header, data, at, 0)
        said = decode.annotations(header, data, at, 0)
        assert onsets.tolist() == said["onsets"] and observed.tolist() == said["observed"]


def test_200_000_records_in_seconds(spark, tmp_path):
    (tmp_path / "long.edf").write_bytes(Wr.write(Wr.Spec(record_count=200_000, plus="D", record_onset=lambda k: k + 5 * (k // 50_000), signals=[Wr.SignalSpec("Fp1", 2, samples=np.zeros((200_000, 2), int))], annotations=[Wr.AnnotationSpec(15)])))
    r = open_recording(spark, str(tmp_path / "long.edf"))
    r.records().count()
    began = time.monotonic()
    assert r.build_index().count() == 4
    assert time.monotonic() - began < 30


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    folder = tmp_path_factory.mktemp("audit")
    for k in range(5):
        (folder / f"{k}.edf").write_bytes(corrupted(k))
    plain = Wr.Spec(record_count=30, signals=[Wr.SignalSpec("EEG Fp1", 4, digital_minimum=-5, digital_maximum=5), Wr.SignalSpec("Temp x", 3)])
    (folder / "plain.edf").write_bytes(Wr.write(plain))
    (folder / "broken.edf").write_bytes(b"0" * 300)
    return str(folder)


@pytest.mark.parametrize("split", ["100000000", "700"])
def test_an_audit_holds_findings_starts_and_statistics(spark, archive, split):
    """However files are cut, an audit gives what three traversals do."""
    good = archive + "/[0-9p]*.edf"
    read = lambda mode: register(spark).read.format("biosignal").options(path=good, mode=mode, split_bytes=split).load()
    seen = V.audited(read)
    columns = ["path", "signal_index", "observed_digital_min", "observed_digital_max", "out_of_range_count", "sample_count"]
    assert sorted(V.statistics(seen).select(columns).collect()) == sorted(S.signal_stats(read("blocks")).select(columns).collect())
    key = lambda df: sorted((r.path, r.code, r.record_index or -1, r.signal_index or -1, r.byte_offset or -1, r.message) for r in df.collect())
    assert key(seen.where("stage IN ('header', 'timeline', 'records')")) == key(read("diagnostics"))
    runs = V.joined_runs(seen.where("kind = 'run'"))
    origin = read("headers").select("path", "start_offset_ticks", "record_duration_ticks")
    records = read("records").join(origin, "path")
    said = L.segments(records, F.col("record_duration_ticks"), F.col("start_offset_ticks"))
    columns = ["path", "segment_index", "record_start", "record_count", "start_ticks", "end_ticks"]
    assert sorted(runs.select(columns).collect()) == sorted(said.select(columns).collect())


def test_files_that_no_header_can_be_read_of_are_findings(spark, archive):
    read = lambda mode: register(spark).read.format("biosignal").options(path=archive, mode=mode).load()
    found = V.validate_files(read).where(F.col("path").endswith("broken.edf")).collect()
    assert found and all(r.severity == "error" for r in found)


class Counted:
    """Bytes that count what is read of each record."""

    def __init__(self, data):
        self.data, self.byte_length, self.reads = data, len(data), []

    def read(self, offset, length):
        self.reads.append((offset, length))
        return self.data[offset : offset + length]

    def close(self):
        pass


def test_every_record_is_read_once(archive):
    from wavelake.sources.datasource import Known, audit

    with open(archive + "/0.edf", "rb") as f:
        source = Counted(f.read())
    header = read_header(source)
    known = Known(header, decode.timeline(source, header), ())
    source.reads.clear()
    kinds = [k for part in range(3) for columns in audit(source, "p", part, 3, 0, None, known, True) if columns for k in columns["kind"]]
    assert {"run", "stats"} <= set(kinds)
    assert sum(n for _, n in source.reads) == header.data_byte_length


def test_validation_of_one_recording_equals_that_of_its_file(spark, archive):
    for name in ("0.edf", "3.edf", "plain.edf"):
        path = f"{archive}/{name}"
        try:
            report = V.validate(open_recording(spark, path), scan_samples=True)
        except Exception as e:  # starts that go back
            assert "MONOTONIC" in str(e) or "before record" in str(e)
            continue
        read = lambda mode, path=path: register(spark).read.format("biosignal").options(path=path, mode=mode).load()
        assert sorted(d.code for d in report["diagnostics"]) == sorted(r.code for r in V.validate_files(read).collect())
