"""Ending calls early, their progress, and sources of a user's own that tasks call."""

import os
import threading
import time

import numpy as np
import pytest

from wavelake.control import Abort, run
from wavelake.errors import AbortError
from wavelake.operators.validate import validate
from wavelake.recording import open_recording, register
from wavelake.sources.bytesource import FileSource, HttpSource
from wavelake.sources.custom import packed
from wavelake.testing import writer as Wr

RECORDS = 400


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    at = tmp_path_factory.mktemp("control") / "a.edf"
    at.write_bytes(Wr.write(Wr.Spec(record_count=RECORDS, plus="D", record_onset=lambda k: k + 5 * (k // 100), signals=[Wr.SignalSpec("Fp1", 4, samples=np.arange(4 * RECORDS).reshape(-1, 4) % 90)])))
    return str(at)


def slow(seconds, folder):
    """A factory of sources that take their time and note every read with the process that made it."""

    def make(path):
        inner = FileSource(path)

        class Source:
            byte_length = inner.byte_length

            def read(self, offset, length):
                with open(f"{folder}/{os.getpid()}-reads", "a") as f:
                    f.write(f"{offset} {length}\n")
                if length > 1000:
                    time.sleep(seconds)
                return inner.read(offset, length)

            def close(self):
                with open(f"{folder}/{os.getpid()}-closed", "a") as f:
                    f.write("x\n")
                inner.close()

        return Source()

    return make


def later(abort, seconds):
    thread = threading.Timer(seconds, abort.abort, ["enough"])
    thread.start()
    return thread


def test_a_scan_ends_when_it_is_told_to(spark, path, tmp_path):
    r, stop = open_recording(spark, path, factory=slow(20, str(tmp_path))), Abort()
    timer, began = later(stop, 2), time.monotonic()
    with pytest.raises(AbortError, match="enough"):
        r.run(lambda: r.blocks([0]).count(), stop)
    assert time.monotonic() - began < 12
    timer.join()
    assert not stop._running
    with pytest.raises(AbortError):
        r.run(lambda: r.blocks([0]).count(), stop)  # the wish holds
    assert open_recording(spark, path).blocks([0]).count() == RECORDS  # and the session goes on


def test_a_stream_ends_between_and_inside_chunks(spark, path, tmp_path):
    r, stop = open_recording(spark, path), Abort()
    r.build_index()
    chunks = r.stream_records(0, 300, [0], chunk_records=50, abort=stop)
    assert len(next(chunks)) == 50
    stop.abort()
    with pytest.raises(AbortError):
        next(chunks)
    with pytest.raises(StopIteration):
        next(chunks)
    assert not [t for t in threading.enumerate() if "wavelake" in t.name]


def test_progress_never_goes_back_and_ends_at_the_total(spark, path, tmp_path):
    r, told = open_recording(spark, path, factory=slow(0.4, str(tmp_path)), records_per_partition="40"), []
    assert r.run(lambda: r.blocks([0]).count(), on_progress=lambda done, total: told.append((done, total))) == RECORDS
    done = [d for d, _ in told]
    assert done == sorted(done) and told[-1] == (RECORDS, RECORDS) and {t for _, t in told} == {RECORDS}
    assert not [t for t in threading.enumerate() if "progress" in t.name]
    told.clear()
    validate(open_recording(spark, path), scan_samples=True, on_progress=lambda *x: told.append(x))
    assert told[-1] == (RECORDS, RECORDS)
    with pytest.raises(ZeroDivisionError):
        run(spark, lambda: spark.range(3).count(), on_progress=lambda d, t: 1 / 0)


def test_errors_stay_what_they_are(spark):
    before = spark.sparkContext.getLocalProperty("spark.jobGroup.id")
    with pytest.raises(KeyError):
        run(spark, lambda: {}["x"], Abort())
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == before


def test_a_factory_is_called_by_tasks(spark, path, tmp_path):
    rows = register(spark).read.format("biosignal").options(path=path, mode="blocks", factory=packed(slow(0, str(tmp_path)))).load()
    assert rows.count() == RECORDS
    readers = {int(f.split("-")[0]) for f in os.listdir(tmp_path) if f.endswith("reads")}
    assert readers - {os.getpid()}
    assert any(f.endswith("closed") for f in os.listdir(tmp_path))
    r = open_recording(spark, path, factory=slow(0, str(tmp_path)), block_bytes="4096")
    r.build_index()
    assert r.read_samples(3, 2, [0]).count() == 8


def test_a_fetch_is_called_by_tasks(spark, path):
    def fetch(url, method, headers):
        with open(url.removeprefix("http://nowhere"), "rb") as f:
            data = f.read()
        if method == "HEAD":
            return 200, {"Content-Length": str(len(data))}, b""
        a, b = map(int, headers["Range"].removeprefix("bytes=").split("-"))
        return 206, {"Content-Range": f"bytes {a}-{b}/{len(data)}"}, data[a : b + 1]

    assert HttpSource("http://nowhere" + path, fetch).byte_length == os.path.getsize(path)
    r = open_recording(spark, "http://nowhere" + path, fetch=fetch)
    assert r.blocks([0]).count() == RECORDS
