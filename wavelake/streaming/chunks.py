"""Many finished recordings as streams: each file is read in chunks of whole records by a task of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.bytesource import open_source
from ..sources.datasource import SCHEMAS, scan, to_batch
from ..sources.header import read_header


def stream_files(files: DataFrame, signals: str | None = None, chunk_records: int = 256) -> DataFrame:
    """Blocks of every record of every file of `files` (path), at most chunk_records records in hand at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if isinstance(chunk_records, bool) or not isinstance(chunk_records, int) or chunk_records < 1:
        raise ValueError("chunk_records must be a positive integer")
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMAS["blocks"]))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source = open_source(path)
                try:
                    n = read_header(source).record_count
                    for at in range(0, n, chunk_records):
                        for columns in scan(source, path, "blocks", 0, 1, at, min(n, at + chunk_records), signals):
                            if columns:
                                yield to_batch(columns, arrow)
                finally:
                    source.close()

    return files.select("path").mapInArrow(run, SCHEMAS["blocks"])
