"""Recordings in stores that only Spark's readers open: whole files by binaryFile, decoded on the executors.

A file is one row here and must fit into a task's memory; local or mounted files are better read by the source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..shipping import ship
from .bytesource import BytesSource
from .datasource import SCHEMAS, scan, to_batch


def scan_binary(spark: SparkSession, path: str, mode: str = "blocks", signals: str | None = None) -> DataFrame:
    kind = _parse_datatype_string(SCHEMAS[mode])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for columns in scan(BytesSource(content.as_buffer().to_pybytes()), name, mode, signals=signals):
                    if columns:
                        yield to_batch(columns, schema)

    files = ship(spark).read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, kind)
