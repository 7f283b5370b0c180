"""Windows as a table against one window at a time, and what is read for them."""

import random

import pytest
from pyspark.sql import functions as F

from wavelake.plans import windows as M
from wavelake.recording import open_recording, register
from wavelake.testing import writer as Wr

D = 10_000_000


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    """Two files of different record durations, one with gaps and one with an overlap, and one without annotations."""
    folder, r = tmp_path_factory.mktemp("windows"), random.Random(4)
    signal = lambda: [Wr.SignalSpec("Fp1", 4), Wr.SignalSpec("Fp2", 3)]
    specs = {
        "a.edf": Wr.Spec(record_count=40, plus="D", record_onset=lambda k: k + 5 * (k // 7), signals=signal()),
        "b.edf": Wr.Spec(record_count=30, record_duration=2, plus="D", record_onset=lambda k: 2 * k + 0.5 * (k // 10) - 1 * (k // 20), start_offset=0.25, signals=signal()),
        "c.edf": Wr.Spec(record_count=25, signals=signal()),
    }
    for name, spec in specs.items():
        (folder / name).write_bytes(Wr.write(spec))
    asked = [(str(folder / r.choice(list(specs))), k, r.uniform(-5, 90), float(r.choice([0, 0.3, 1, 4, 30, 200]))) for k in range(60)]
    return str(folder), asked


def frame(spark, asked):
    return spark.createDataFrame(asked, "path string, window_id int, seconds double, length double").select("path", "window_id", F.round(F.col("seconds") * D).cast("bigint").alias("start_ticks"), (F.round(F.col("seconds") * D) + F.round(F.col("length") * D)).cast("bigint").alias("end_ticks"))


def test_each_window_as_if_alone(spark, archive):
    folder, asked = archive
    got = {}
    for r in M.read_windows(spark, folder, frame(spark, asked), "0,1").collect():
        got.setdefault(r.window_id, []).append((r.run_id, r.record_index, r.signal_index, r.start_ticks, tuple(r.digital)))
    opened = {}
    for path, k, seconds, length in asked:
        if path not in opened:
            opened[path] = open_recording(spark, path)
            opened[path].build_index()
        said = opened[path].read_window(round(seconds * D) / D, round(length * D) / D, [0, 1]).collect()
        assert sorted(got.get(k, [])) == sorted((r.run_id, r.record_index, r.signal_index, r.start_ticks, tuple(r.digital)) for r in said)


def test_records_that_windows_share_are_read_once(spark, archive):
    folder, asked = archive
    read = lambda mode: register(spark).read.format("biosignal").options(path=folder, mode=mode).load()
    runs = M.plan(frame(spark, asked * 3).withColumn("window_id", F.monotonically_increasing_id()), M.index(read("records"), read("headers")))
    rows = [(r.path, k) for r in M.merged(runs).collect() for k in range(r.first, r.stop)]
    wanted = {(r.path, k) for r in runs.collect() for k in range(r.first, r.first + r["count"])}
    assert len(rows) == len(set(rows)) and set(rows) == wanted


def test_long_ranges_are_cut(spark, monkeypatch):
    runs = spark.createDataFrame([("p", 0, 3 * M.CUT), ("p", M.CUT - 5, 10), ("q", 7, 1)], "path string, first bigint, count bigint")
    found = sorted((r.path, r.first, r.stop) for r in M.merged(runs).collect())
    assert found == [("p", 0, M.CUT), ("p", M.CUT, 2 * M.CUT), ("p", 2 * M.CUT, 3 * M.CUT), ("q", 7, 8)]


def test_no_windows_and_far_ones(spark, archive):
    folder, asked = archive
    far = [(asked[0][0], 1, -9e11, 1.0), (asked[0][0], 2, 9e11, 1.0)]
    assert M.read_windows(spark, folder, frame(spark, far)).count() == 0
    assert M.read_windows(spark, folder, frame(spark, far).where("false")).count() == 0


def test_windows_list_no_more_records_than_they_have(spark):
    """A record in hand for each that a run has, also across cuts; runs of a file don't meet all of its records."""
    asked = [("p", 1, 0, M.CUT - 2, 5), ("p", 1, 1, 3 * M.CUT, 1), ("q", 2, 0, 7, 2 * M.CUT)]
    runs = spark.createDataFrame(asked, "path string, window_id int, run_id int, first bigint, count bigint")
    found = sorted(tuple(r) for r in M.records_of(runs).select("path", "window_id", "run_id", "record_index").collect())
    assert found == sorted((path, w, k, i) for path, w, k, first, n in asked for i in range(first, first + n))


def test_blocks_are_changed_once_each(spark, archive):
    folder, asked = archive
    summed = lambda blocks: blocks.select("path", "record_index", F.aggregate("digital", F.lit(0), lambda s, x: s + x).alias("total"))
    found = M.read_windows(spark, folder, frame(spark, asked), "0", then=summed)
    whole = M.read_windows(spark, folder, frame(spark, asked), "0")
    assert found.columns == ["window_id", "run_id", "path", "record_index", "total"]
    assert sorted(tuple(r) for r in found.collect()) == sorted((r.window_id, r.run_id, r.path, r.record_index, sum(r.digital)) for r in whole.collect())
