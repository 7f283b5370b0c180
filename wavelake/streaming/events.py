"""Trigger events of recordings that still grow, as batches of their records come in.

State for each path: the last trigger, where the last record ended, and how many runs there were. A record that
doesn't begin there begins a run. However the records fall into batches, the events are those of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.status import status_col

_EVENTS = "path string, run_id int, sample_index bigint, ticks bigint, word int, first_of_run boolean"
_STATE = "trigger int, end_ticks bigint, runs int"


def changes(rows: pd.DataFrame, last: tuple[int, int, int] | None) -> tuple[pd.DataFrame, tuple[int, int, int] | None]:
    """(events, state) after blocks of one status channel of one path that follow the state."""
    rows = rows.sort_values("record_index")
    rows = rows[rows["digital"].map(len) > 0]
    if rows.empty:
        return pd.DataFrame({c.split()[0]: [] for c in _EVENTS.split(", ")}), last
    words = np.stack(rows["digital"].to_numpy())
    count, width = words.shape
    starts, d = rows["start_ticks"].to_numpy(), rows["record_duration_ticks"].to_numpy()
    ends = starts + d
    begins = np.concatenate([[last is None or starts[0] != last[1]], starts[1:] != ends[:-1]])
    runs = (last[2] if last else 0) + np.cumsum(begins)
    flat = words.ravel()
    trigger = flat & 0xFFFF
    new = np.concatenate([[last is None or trigger[0] != last[0]], trigger[1:] != trigger[:-1]])
    opening = np.zeros(len(flat), bool)
    opening[::width] = begins
    at = np.flatnonzero(new | opening)
    record, within = at // width, at % width
    ticks = starts[record] - (-within * d[record]) // width
    found = pd.DataFrame({"run_id": (runs[record] - 1).astype(np.int32), "sample_index": rows["first_sample_index"].to_numpy()[record] + within, "ticks": ticks, "word": flat[at].astype(np.int32), "first_of_run": opening[at]})
    found.insert(0, "path", rows["path"].iloc[0])
    return found, (int(trigger[-1]), int(ends[-1]), int(runs[-1]))


def stream_triggers(blocks: DataFrame) -> DataFrame:
    """path, run_id, sample_index, ticks, trigger, raw, new_epoch, cms_in_range, battery_low, first_of_run: the columns of `triggers`.

    blocks: a stream of the blocks of the status channel, as format biosignal_tail gives them. A task holds the blocks
    that a batch has of a path, which records_per_batch bounds.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found, after = changes(pd.concat(list(frames)), state.get if state.exists else None)
        if after:
            state.update(after)
        yield found

    events = blocks.groupBy("path").applyInPandasWithState(update, _EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout)
    return events.withColumn("s", status_col(F.col("word"))).select("path", "run_id", "sample_index", "ticks", "s.trigger", "s.raw", "s.new_epoch", "s.cms_in_range", "s.battery_low", "first_of_run")
