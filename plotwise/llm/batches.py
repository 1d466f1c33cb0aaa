"""Arrow batches of texts: pass every column through and append computed ones."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Rows and bytes handled at a time, so that a batch of long texts stays small in memory.
ROWS = 512
BYTES = 4_000_000


def row_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive runs of ROWS rows of a batch."""
    for start in range(0, batch.num_rows, ROWS):
        yield batch.slice(start, ROWS)


def release() -> None:
    """Give memory that a task no longer needs back to the system.

    Python workers stay for the tasks of later stages, and so would their freed memory.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(column: pa.Array) -> Iterator[tuple[int, int, list]]:
    """Consecutive runs of texts with their bounds, each below ROWS rows and about BYTES long.

    Only one run at a time is turned into Python strings.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if i + 1 - start >= ROWS or held >= BYTES or i + 1 == len(sizes):
            yield start, i + 1, column.slice(start, i + 1 - start).to_pylist()
            start, held = i + 1, 0


def append_columns(df: DataFrame, text: str, fields: list[StructField],
                   make: Callable[[], Callable[[list], list[list]]], tidy: bool = False) -> DataFrame:
    """``df`` with ``fields`` computed from the text column.

    ``make`` runs once for each task and returns a function from a list of texts (None
    for null) to one list of values for each field. A column of ``df`` that has the
    name of a new field is replaced. ``tidy`` tasks give their memory back when they end.
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = StructType(kept + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for a, b, texts in slices(batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(a, b - a)
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                columns += [pa.array(v, k) for v, k in zip(compute(texts), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names + [f.name for f in fields])
        if tidy:
            batch = part = columns = texts = compute = None
            release()

    return df.mapInArrow(run, schema)
