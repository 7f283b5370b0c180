"""Running a Python function over whole texts in Arrow batches of bounded bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Texts are handed on in groups of about so many characters; a longer text is a group of its own.
GROUP_CHARS = 1_500_000


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of a column of keys and a column of texts, null texts as empty ones."""
    for batch in batches:
        keys, column, start, chars = batch.column(0), batch.column(1), 0, 0
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        for i, n in enumerate(sizes):
            chars += n
            if chars >= GROUP_CHARS or i + 1 == len(sizes):
                yield keys.slice(start, i + 1 - start).to_pylist(), [t or "" for t in column.slice(start, i + 1 - start).to_pylist()]
                start, chars = i + 1, 0


def map_texts(df: DataFrame, schema: str, rows: Callable[[list, list[str]], dict[str, list]]) -> DataFrame:
    """df has a key and a text; rows gives the columns of schema for each group of keys and texts."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in groups(batches):
            out = rows(keys, texts)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def map_groups(df: DataFrame, keys: list[str], schema: str, rows: Callable[[pa.Table], dict[str, np.ndarray]]) -> DataFrame:
    """As applyInArrow over groups of keys (bigint or int columns), without its cost for very many small groups.

    The rows are dealt by the keys and sorted; a task walks over them and hands on one group after the other.
    """
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            made = [out for a, b in zip(starts[:-1], starts[1:], strict=True) if (out := rows(table.slice(a, b - a)))]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[f.name] for m in made]), f.type) for f in arrow], schema=arrow)

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
            change = np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1
            if last is not None and (own[:, 0] != last).any():
                change = np.concatenate([[0], change])
            last = own[:, -1]
            if len(change):
                whole = pa.Table.from_batches([*held, batch.slice(0, change[-1])]).combine_chunks()
                before = sum(b.num_rows for b in held)
                yield from given(whole, np.unique(np.concatenate([[0], before + change])))
                held = []
            held.append(batch.slice(change[-1] if len(change) else 0))
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield from given(whole, np.array([0, whole.num_rows]))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, kind)
