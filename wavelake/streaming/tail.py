"""Reading recordings that still grow: an extension, as a streaming source over whole new records.

The path is a file, a folder, a glob or several joined by line feeds; files that appear later are found. The offset
is the number of the next record of each file. A header whose record count is -1 is that of an open file; the whole
records on disk are read as they come. A batch takes at most records_per_batch records of a file, in partitions of
records_per_partition, each read by a task of its own; what is over waits for the next batch.
"""

from __future__ import annotations

import glob
import json
import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import WaveError
from ..sources.bytesource import open_source
from ..sources.datasource import SCHEMAS, Known, scan, to_batch
from ..sources.decode import timeline
from ..sources.header import read_header

#: Records of a file in a batch at most, and in a partition.
PER_BATCH, PER_PARTITION = 1 << 16, 1 << 12
_DURATION = "record_duration_ticks"


def files_of(path: str) -> list[str]:
    found: list[str] = []
    for one in path.split("\n"):
        one = one.removeprefix("file://")
        if os.path.isdir(one):
            found += [os.path.join(top, f) for top, _, names in os.walk(one) for f in names if f.lower().endswith((".edf", ".bdf", ".rec"))]
        else:
            found += glob.glob(one)
    return sorted(set(found))


class TailReader(DataSourceStreamReader):
    def __init__(self, schema, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.options = to_arrow_schema(schema), dict(options)
        self.mode = self.options.get("mode", "blocks")
        self.most, self.size = (int(self.options.get(k, v)) for k, v in (("records_per_batch", PER_BATCH), ("records_per_partition", PER_PARTITION)))
        self.at: dict[str, int] = {}

    def initialOffset(self):
        return {"next": json.dumps({})}

    def _records(self, path: str) -> int:
        """Whole records on disk; none as long as the header isn't whole."""
        try:
            source = open_source(path)
        except WaveError:
            return 0
        try:
            return read_header(source).record_count
        except WaveError:
            return 0
        finally:
            source.close()

    def latestOffset(self):
        first = int(self.options.get("first_record", 0))
        for path in files_of(self.options["path"]):
            at = self.at.get(path, first)
            self.at[path] = max(at, min(self._records(path), at + self.most))
        return {"next": json.dumps(self.at, sort_keys=True)}

    def partitions(self, start, end):
        first, since, till = int(self.options.get("first_record", 0)), json.loads(start["next"]), json.loads(end["next"])
        for path, n in till.items():  # after a restart the offsets of the log go on
            self.at[path] = max(self.at.get(path, 0), n)
        out = []
        for path, stop in till.items():
            for at in range(since.get(path, first), stop, self.size):
                out.append(TailPart(path, at, min(at + self.size, stop)))
        return out

    def read(self, part):
        source = open_source(part.path)
        try:
            header = read_header(source)
            known = Known(header, timeline(source, header), ())
            for columns in scan(source, part.path, self.mode, 0, 1, part.first, part.stop, self.options.get("signals"), known=known):
                if columns:
                    n = len(next(iter(columns.values())))
                    yield to_batch({**columns, _DURATION: pa.array([header.record_duration_ticks] * n, pa.int64())}, self.schema)
        finally:
            source.close()


@dataclass
class TailPart(InputPartition):
    path: str
    first: int
    stop: int


class TailSource(DataSource):
    """The columns of the mode, and record_duration_ticks."""

    @classmethod
    def name(cls):
        return "biosignal_tail"

    def schema(self):
        return f"{SCHEMAS[self.options.get('mode', 'blocks')]}, {_DURATION} bigint"

    def streamReader(self, schema):
        return TailReader(schema, self.options)
