"""Files made by the writer, read back; damage, gaps, annotations and costs."""

import random

import numpy as np
import pytest

from wavelake import report
from wavelake.diagnostics import Diagnostic, Sink, summarize
from wavelake.errors import AmbiguousChannelError, BudgetError, ChannelNotFoundError, FormatError, RecordRangeError, ScalingError, SourceError, WaveError
from wavelake.operators import samples as SA
from wavelake.operators.validate import header_rules, validate
from wavelake.recording import find_signals, get_signal, inspect, match_signals, open_recording, register, status_signal
from wavelake.sources import decode
from wavelake.sources.bytesource import BytesSource, CachedSource, FileSource, HttpSource, open_source
from wavelake.sources.header import build_scale, parse_header, read_header
from wavelake.sources.tal import parse_region, timekeeping_defect
from wavelake.testing import writer as W

D = 10_000_000


class Spy(BytesSource):
    def __init__(self, data):
        super().__init__(data)
        self.reads = []

    def read(self, offset, length):
        self.reads.append((offset, length))
        return super().read(offset, length)


def save(tmp_path, spec, name="a.edf"):
    path = tmp_path / name
    path.write_bytes(W.write(spec))
    return str(path)


def test_open_reads_two_blocks_and_two_records():
    plain, plus = Spy(W.write(W.minimal())), Spy(W.write(W.minimal_plus(record_count=9)))
    h = read_header(plain)
    decode.timeline(plain, h)
    assert plain.reads == [(0, 256), (256, 256)]
    h = read_header(plus)
    decode.timeline(plus, h)
    assert len(plus.reads) == 4


@pytest.mark.parametrize("family", ["EDF", "BDF"])
def test_samples_come_back(family):
    rng = np.random.default_rng(1)
    low, high = (-(2**15), 2**15) if family == "EDF" else (-(2**23), 2**23)
    a, b = rng.integers(low, high, (5, 7)), rng.integers(low, high, (5, 3))
    data = W.write(W.Spec(family, record_count=5, signals=[W.SignalSpec("A", 7, samples=a), W.SignalSpec("B", 3, samples=b)]))
    h = parse_header(data, len(data))
    got = decode.read_records(BytesSource(data), h, 0, 5)
    assert (decode.digital(h, got, h.signals[0]) == a).all() and (decode.digital(h, got, h.signals[1]) == b).all()


def test_samples_at_the_ends_of_24_bits():
    data = W.write(W.Spec("BDF", record_count=1, signals=[W.SignalSpec("A", 3, samples=np.array([8_388_607, -1, -8_388_608]))]))
    h = parse_header(data, len(data))
    assert decode.digital(h, data[h.header_byte_length :], h.signals[0]).tolist() == [[8_388_607, -1, -8_388_608]]


def test_scale_is_exact_and_refusals_have_reasons():
    s = {"index": 0, "physical_minimum": -50.0, "physical_maximum": 49.9755859375, "digital_minimum": -2048, "digital_maximum": 2047, "physical_dimension": "uV"}
    scale = build_scale(s, Sink())
    assert scale.bit_value == 25 / 1024 and scale.bit_value * (scale.offset - 2048) == -50
    for change, code in (({"digital_minimum": 2047}, "DEGENERATE_DIGITAL_RANGE"), ({"physical_minimum": 49.9755859375}, "DEGENERATE_PHYSICAL_RANGE"), ({"digital_minimum": 3000}, "INVERTED_DIGITAL_RANGE"), ({"physical_dimension": "Filtered"}, "LOG_TRANSFORMED_CHANNEL"), ({"physical_minimum": 0.0, "physical_maximum": 5e-324, "digital_minimum": -1, "digital_maximum": 1}, "DEGENERATE_PHYSICAL_RANGE")):
        sink = Sink()
        assert build_scale(s | change, sink) is None and sink.found[-1].code == code


def test_truncation_at_every_length_never_breaks():
    data = W.write(W.minimal_plus())
    for n in range(0, len(data), 7):
        try:
            h = parse_header(data[:n], n)
            assert 0 <= h.record_count <= 2
        except WaveError as e:
            assert e.kind == "format"


def test_random_damage_gives_typed_errors_or_results():
    rng = random.Random(5)
    good = W.write(W.minimal_plus(record_count=4))
    for _ in range(300):
        data = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            source = BytesSource(bytes(data))
            h = read_header(source)
            decode.timeline(source, h)
            for at, n in decode.runs(h, 0, h.record_count):
                decode.annotations(h, decode.read_records(source, h, at, n), at)
        except WaveError as e:
            assert e.kind in ("format", "budget", "source")


def region(*parts, size=80):
    return b"".join(parts).ljust(size, b"\x00")


def test_annotation_grammar():
    tals, issues = parse_region(region(b"+0\x14\x14\x00", b"-1.5\x150.25\x14caf\xe9\x14b\x14\x00"))
    assert [t.onset for t in tals] == [0, -15_000_000] and tals[1].duration == 2_500_000
    assert [(x.text, x.encoding) for x in tals[1].texts] == [("café", "latin-1-fallback"), ("b", "utf-8")]
    assert [i.code for i in issues] == ["ANNOTATION_TEXT_NOT_UTF8"]
    tals, issues = parse_region(region(b"5\x14a\x14\x00", b"+x\x14a\x14\x00", b"+1\x15-2\x14a\x14\x00", b"+2\x14last\x00"))
    assert [t.ordinal for t in tals] == [0, 3] and {i.kind for i in issues} == {"an onset has no sign", "an onset isn't a time", "a duration isn't a time", "the last text has no end"}
    tals, issues = parse_region(b"\x00\x00+1\x14\x14\x00\x00+2")
    assert [t.ordinal for t in tals] == [1] and {i.code for i in issues} == {"TAL_REGION_NOT_NUL_TERMINATED", "TAL_TRUNCATED_AT_REGION_END"}
    assert timekeeping_defect(parse_region(region(b"+0\x14\x00"))[0][0])[1] is False
    assert timekeeping_defect(parse_region(region(b"+0\x14\x14lost\x14\x00"))[0][0])[1] is True


def test_lookup():
    data = W.write(W.Spec(signals=[W.SignalSpec("EEG A"), W.SignalSpec("EEG A"), W.SignalSpec("ECG")]))
    h = parse_header(data, len(data))
    assert [s.index for s in find_signals(h, "EEG A")] == [0, 1] and [s.index for s in match_signals(h, "^E.G")] == [0, 1, 2]
    with pytest.raises(AmbiguousChannelError):
        get_signal(h, "EEG A")
    with pytest.raises(ChannelNotFoundError):
        get_signal(h, "eeg a")
    assert status_signal(h) is None


def test_sources():
    data = bytes(range(256)) * 40
    spy = Spy(data)
    cached = CachedSource(spy, 1024, 4096)
    assert cached.read(1000, 100) == data[1000:1100] and cached.read(1100, 500) == data[1100:1600] and len(spy.reads) == 1
    assert cached.read(0, 9000) == data[:9000]
    with pytest.raises(SourceError):
        cached.read(len(data) - 1, 2)

    def fetch(url, method, headers):
        if method == "HEAD":
            return 405, {}, b""
        a, b = (int(x) for x in headers["Range"].removeprefix("bytes=").split("-"))
        return 206, {"Content-Range": f"bytes {a}-{b}/{len(data)}"}, data[a : b + 1]

    http = HttpSource("http://host/x", fetch)
    assert http.byte_length == len(data) and http.read(5, 10) == data[5:15]
    with pytest.raises(SourceError):
        HttpSource("http://host/x", lambda *a: (200, {}, data))
    with pytest.raises(SourceError):
        FileSource("/nowhere/at/all")
    with pytest.raises(TypeError):
        open_source(7)
    assert isinstance(open_source(b"x"), BytesSource)


def test_budget_and_range():
    data = W.write(W.minimal(record_count=10))
    h = parse_header(data, len(data))
    with pytest.raises(BudgetError):
        decode.read_records(BytesSource(data), h, 0, 10, 100)
    with pytest.raises(RecordRangeError):
        decode.read_records(BytesSource(data), h, 8, 3)


def test_inspect_never_raises_on_content():
    for data in (b"", b"x" * 300, W.write(W.minimal())[:300]):
        assert inspect(data)["ok"] is False
    assert inspect(W.write(W.minimal()))["ok"] is True


def test_strict_and_missing_start():
    data = W.write(W.minimal(start_date="99.99.99"))
    with pytest.raises(FormatError) as e:
        parse_header(data, len(data), strict=True)
    assert e.value.code == "DATE_UNPARSEABLE"
    spec = W.minimal_plus(record_count=3, annotations=[W.AnnotationSpec(30, region=lambda r: b"" if r == 0 else W.clock_bytes(r + 0.25))])
    data = W.write(spec)
    source = BytesSource(data)
    assert decode.timeline(source, read_header(source))["start_offset_ticks"] == 2_500_000


def test_going_back_in_time_is_fatal():
    data = W.write(W.minimal_plus(plus="D", record_count=3, record_onset=lambda r: [5, 9, 1][r]))
    source = BytesSource(data)
    with pytest.raises(FormatError) as e:
        decode.timeline(source, read_header(source))
    assert e.value.code == "TIMELINE_NOT_MONOTONIC"


def test_discontinuous_recording(spark, tmp_path):
    spec = W.Spec(plus="D", record_count=20, signals=[W.SignalSpec("EEG C3-A2", 8, samples=lambda r, i: r * 100 + i)], record_onset=lambda r: r % 4 + 3600 * (r // 4))
    r = open_recording(spark, save(tmp_path, spec))
    with pytest.raises(RecordRangeError):
        r.window_runs(0, 10)
    assert r.contiguity() == "unknown"
    r.build_index()
    assert r.contiguity() == "discontinuous" and len(r.gaps()) == 4 and r.gaps()[0]["duration_ticks"] == 3596 * D
    rows = r.read_samples(3.5, 3597, [0]).orderBy("sample_index").collect()
    assert [x.digital for x in rows] == [304, 305, 306, 307, 400, 401, 402, 403]
    assert r.read_window(100, 50, [0]).count() == 0
    assert r.segment_at(3600.5)["segment_index"] == 1 and r.gap_at(50)["after_segment_index"] == 1 and r.gap_before(4) is not None
    assert r.locate(3601.5) == {"record_index": 5, "record_start_ticks": 3601 * D, "offset_in_record_ticks": 5_000_000} and r.locate(100) is None
    assert r.sample_at(0, 3601.5) == {"sample_index": 44, "record_index": 5, "sample_within_record": 4}


def test_partitions_change_nothing(spark, tmp_path):
    spec = W.minimal_plus(record_count=30, annotations=[W.AnnotationSpec(60, tals=lambda r: [W.Tal(r - 2, None, (f"e{r}",))])])
    path = save(tmp_path, spec)
    register(spark)
    for mode in ("blocks", "records", "annotations", "diagnostics"):
        one, many = (spark.read.format("biosignal").options(path=path, mode=mode, records_per_partition=n).load() for n in (1000, 4))
        assert many.rdd.getNumPartitions() == 8
        if mode == "diagnostics":
            from wavelake.operators.validate import once_per_call

            one, many = once_per_call(one), once_per_call(many)
            assert many.where("code = 'NEGATIVE_ANNOTATION_ONSET'").count() == 1
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_small_files_share_partitions(spark, tmp_path):
    for i in range(20):
        save(tmp_path, W.minimal(record_count=1 + i % 3), f"{i:02d}.edf")
    register(spark)
    for mode, rows in (("blocks", 39), ("headers", 20)):
        df = spark.read.format("biosignal").options(path=str(tmp_path), mode=mode).load()
        assert df.rdd.getNumPartitions() == 1 and df.count() == rows
    small = spark.read.format("biosignal").options(path=str(tmp_path), split_bytes=1 << 18).load()
    assert small.rdd.getNumPartitions() == 10 and small.count() == 39


def test_zero_duration_records(spark, tmp_path):
    r = open_recording(spark, save(tmp_path, W.Spec(record_duration=0, signals=[W.SignalSpec("Stage", 1)])))
    assert r.header.signals[0].sample_rate_hz is None and r.window_runs(0, 1) == [(0, 2)] and r.locate(1) is None


def test_empty_recording(spark, tmp_path):
    r = open_recording(spark, save(tmp_path, W.minimal(record_count=0)))
    assert r.window_runs(0, 5) == [] and r.blocks([0]).count() == 0 and r.locate(0) is None
    assert validate(r, scan_samples=True)["signal_stats"][0]["sample_count"] == 0


def test_merge_refuses_breaks(spark, tmp_path):
    r = open_recording(spark, save(tmp_path, W.minimal(record_count=6)))
    whole = SA.merge(r.blocks([0], 0, 2).union(r.blocks([0], 2, 3)), D).collect()[0]
    assert whole.record_count == 5 and len(whole.digital) == 50
    with pytest.raises(Exception, match="cannot be merged"):
        SA.merge(r.blocks([0], 0, 2).union(r.blocks([0], 3, 2)), D).collect()


def test_physical_refusal(spark, tmp_path):
    r = open_recording(spark, save(tmp_path, W.Spec(signals=[W.SignalSpec("A", raw={"physical_minimum": "1", "physical_maximum": "1"})])))
    with pytest.raises(ScalingError) as e:
        SA.physical_of(r.header.signals[0], None)
    assert e.value.code == "DEGENERATE_PHYSICAL_RANGE"
    assert r.read_samples(0, 1, [0]).where("physical IS NULL").count() == 10


def test_triggers_reset_at_gaps(spark, tmp_path):
    spec = W.Spec("BDF", plus="D", record_count=4, signals=[W.SignalSpec("Status", 4, samples=lambda r, i: 7)], record_onset=lambda r: r + 5 * (r // 2))
    r = open_recording(spark, save(tmp_path, spec, "a.bdf"))
    r.build_index()
    found = r.triggers(0, 60).orderBy("sample_index").collect()
    assert [(x.sample_index, x.trigger) for x in found] == [(0, 7), (8, 7)]
    assert found[0].preceded_by_gap is None and found[1].preceded_by_gap.duration_ticks == 5 * D


def test_envelope_of_samples_in_hand(spark, tmp_path):
    from wavelake.operators import envelope as E

    r = open_recording(spark, save(tmp_path, W.minimal(record_count=6)))
    got = E.of_blocks(r.read_records(1, 3, [0]), 4).orderBy("bucket").collect()
    whole = r.envelope(1, 3, [0], 4).orderBy("bucket").collect()
    assert got == whole and sum(x["count"] for x in got) == 30


def test_text_reports():
    assert report.clock(-15_009_000) == "-00:00:01.501"
    data = W.write(W.minimal(patient_id="Jane Doe"))
    h = parse_header(data, len(data))
    assert "Jane" not in report.format_header(h) and "Jane" in report.format_header(h, patient=True)
    found = [Diagnostic("TRAILING_BYTES", "m"), Diagnostic("TRAILING_BYTES", "m"), Diagnostic("DATE_UNPARSEABLE", "secret", field="patient_id", raw="secret")]
    assert summarize(found)["by_code"][0] == ("TRAILING_BYTES", "warning", 2)
    text = report.format_diagnostics(found, max_items=1)
    assert "... and 2 more" in text and "secret" not in report.format_diagnostics(found, redact_fields=["patient_id"])
    assert {d.code for d in header_rules(h)} == {"LABEL_CONVENTION_NONCONFORMANT"}


def test_command_line(spark, tmp_path, capsys):
    from wavelake import cli

    path = save(tmp_path, W.minimal_plus(annotations=[W.AnnotationSpec(60, tals=lambda r: [W.Tal(r, 1, ("x@@Fp1",))])]))
    for command, want in (("header", "EDF+C"), ("events", "2\tx"), ("gaps", "contiguous"), ("signals", "0\tFp1\tdata"), ("json", '"variant": "EDF+C"'), ("validate", "PASS")):
        assert cli.run(cli.parse_args([command, path]), spark, print) == 0
        assert want in capsys.readouterr().out
    assert cli.run(cli.parse_args(["events", path, "--list", "--limit", "1"]), spark, print) == 0
    assert "Fp1" in capsys.readouterr().out
    for bad in ([], ["nope", path], ["header"], ["header", path, "--x"], ["header", path, "--limit", "x"]):
        with pytest.raises(cli.UsageError):
            cli.parse_args(bad)


def test_tail_stream(spark, tmp_path):
    from wavelake.streaming.tail import TailSource

    path = save(tmp_path, W.minimal(record_count=5, declared_record_count=-1))
    spark.dataSource.register(TailSource)
    stream = spark.readStream.format("biosignal_tail").option("path", path).load()
    q = stream.writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT count(*) FROM tailed").first()[0] == 5


def test_binary_scan_equals_the_source(spark, tmp_path):
    from wavelake.sources.binary import scan_binary

    path = save(tmp_path, W.minimal(record_count=5))
    assert scan_binary(spark, path).drop("path").orderBy("record_index").collect() == open_recording(spark, path).blocks([0]).drop("path").orderBy("record_index").collect()
