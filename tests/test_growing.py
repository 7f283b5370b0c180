"""Recordings that grow: whatever is cut off at first, the stream gives the rows and the events of the whole."""

import random

import numpy as np
import pytest

from wavelake.operators import samples as S
from wavelake.operators import triggers as G
from wavelake.recording import open_recording
from wavelake.streaming.events import changes, stream_triggers
from wavelake.streaming.tail import TailSource
from wavelake.testing import writer as Wr

RECORDS, RATE = 30, 8
COLUMNS = ["run_id", "sample_index", "ticks", "trigger", "raw", "new_epoch", "cms_in_range", "battery_low", "first_of_run"]


def recording(seed):
    r = random.Random(seed)
    words, now = [], 0
    for _ in range(RECORDS * RATE):
        now = r.randrange(4) if r.random() < 0.2 else now
        words.append(now | r.randrange(2) << 20)
    onset = lambda k: k + 3 * (k // 7)
    return Wr.write(Wr.Spec("BDF", plus="D", record_count=RECORDS, declared_record_count=-1, record_onset=onset, signals=[Wr.SignalSpec("A1", 3), Wr.SignalSpec("Status", RATE, physical_dimension="Boolean", samples=np.array(words).reshape(RECORDS, RATE))]))


def whole(spark, path):
    """Events of the whole recording, in a batch."""
    r = open_recording(spark, path)
    d = r.header.record_duration_ticks
    found = r.build_index().collect()
    blocks = r.blocks([1])
    runs = spark.createDataFrame([(k, s.segment_index) for s in found for k in range(s.record_start, s.record_start + s.record_count)], "record_index bigint, run_id int")
    rows = S.explode(blocks, {1: RATE}, d).join(runs, "record_index")
    return sorted(tuple(x[c] for c in COLUMNS) for x in G.triggers(rows).collect())


@pytest.mark.parametrize("per_batch", ["4", "1000"])
def test_events_of_growing_files_are_those_of_the_whole(spark, tmp_path, per_batch):
    spark.dataSource.register(TailSource)
    (tmp_path / "in").mkdir()
    data = {f"{k}.bdf": recording(k) for k in range(3)}
    full = {name: str(tmp_path / name) for name in data}
    for name, d in data.items():
        (tmp_path / name).write_bytes(d)
    header = open_recording(spark, full["0.bdf"]).header
    r = random.Random(int(per_batch))
    for step in range(3):
        for name, d in data.items():
            stop = len(d) if step == 2 else header.record_offset(r.randrange(step * 10, step * 10 + 10)) + r.randrange(20)
            if step or name != "2.bdf":  # the third file appears later
                (tmp_path / "in" / name).write_bytes(d[:stop])
        blocks = spark.readStream.format("biosignal_tail").options(path=str(tmp_path / "in"), signals="Status", records_per_batch=per_batch, records_per_partition="3").load()
        out = stream_triggers(blocks).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(tmp_path / "out")).trigger(processingTime="100 milliseconds").start()
        try:
            out.processAllAvailable()
        finally:
            out.stop()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    for name, path in full.items():
        assert sorted(tuple(x[c] for c in COLUMNS) for x in got if x.path.endswith("in/" + name)) == whole(spark, path)


def test_every_cut_of_the_blocks(spark, tmp_path):
    (tmp_path / "a.bdf").write_bytes(recording(9))
    r = open_recording(spark, str(tmp_path / "a.bdf"))
    rows = r.blocks([1]).toPandas().assign(record_duration_ticks=r.header.record_duration_ticks)
    said, _ = changes(rows, None)
    assert len(said) > 20
    for cut in range(RECORDS + 1):
        first = rows[rows.record_index < cut].sample(frac=1, random_state=cut)
        one, state = changes(first, None)
        two, _ = changes(rows[rows.record_index >= cut], state)
        assert [tuple(x) for f in (one, two) for x in f.to_numpy()] == [tuple(x) for x in said.to_numpy()]
