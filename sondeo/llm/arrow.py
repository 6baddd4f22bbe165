"""Arrow batches in and out of Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Texts are handed on in batches of at most so many rows and about so many bytes, so long texts stay within memory.
BATCH_ROWS = 2_000
BATCH_BYTES = 16 << 20


def schema_of(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def pieces(batch: pa.RecordBatch, sized: str | None) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of bounded size; ``sized`` names the binary column whose bytes count."""
    if sized is None or batch.nbytes <= BATCH_BYTES:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)
        return
    start = held = 0
    for i, value in enumerate(batch.column(sized)):
        held += len(value.as_buffer()) if value.is_valid else 0
        if held >= BATCH_BYTES or i - start + 1 >= BATCH_ROWS:
            yield batch.slice(start, i - start + 1)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def mapped(df: DataFrame, make: Callable[[], Callable], schema: str, sized: str | None = "t") -> DataFrame:
    """``df`` through the function that ``make()`` returns once for each task: a batch in, named columns out.

    If that function has an attribute ``last``, it is called without arguments when the task has seen all its rows.
    """
    out = schema_of(schema)

    def batch_of(columns: dict) -> pa.RecordBatch:
        arrays = [columns[f.name] for f in out]
        return pa.RecordBatch.from_arrays([a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, type=f.type) for a, f in zip(arrays, out)], schema=out)

    def run(batches):
        work = make()
        for batch in batches:
            for part in pieces(batch, sized):
                yield batch_of(work(part))
        if hasattr(work, "last"):
            yield batch_of(work.last())

    return df.mapInArrow(run, schema)
