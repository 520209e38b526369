"""Row-wise Arrow kernels: a Python function over each row's values, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def points(column: pa.Array) -> list[np.ndarray]:
    """A column of arrays of points (x, y) as one array for each row; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.append(0, np.cumsum(np.asarray(column.value_lengths().fill_null(0), np.int64))) if len(column) else np.zeros(1, np.int64)
    flat = column.flatten()
    xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1) if len(flat) else np.zeros((0, 2))
    return [xy[a:e] for a, e in zip(at, at[1:])]


def row_kernel(df: DataFrame, fn: Callable[..., tuple], schema: str, paths: tuple[str, ...] = ()) -> DataFrame:
    """fn(*values of a row) to a tuple of schema; columns named in paths arrive as arrays of points."""
    names, kind = df.columns, to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [points(b.column(c)) if c in paths else b.column(c).to_pylist() for c in names]
            rows = [fn(*values) for values in zip(*columns)]
            cols = list(zip(*rows)) or [[] for _ in kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], names=kind.names)

    return df.mapInArrow(run, schema)


def batch_kernel(df: DataFrame, fn: Callable[..., tuple], schema: str) -> DataFrame:
    """fn(*columns of a batch as NumPy arrays) to a tuple of columns of schema."""
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = fn(*(c.to_numpy(zero_copy_only=False) for c in b.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], names=kind.names)

    return df.mapInArrow(run, schema)


def guarded(fn: Callable[..., tuple], n_values: int) -> Callable[..., tuple]:
    """fn with two values more, ok and error: a row that fails has nulls and its error, and the others go on."""

    def run(*values) -> tuple:
        try:
            return (*fn(*values), True, None)
        except Exception as e:  # noqa: BLE001 - one page's failure is a result
            return (values[0], *[None] * (n_values - 1), False, f"{type(e).__name__}: {e}")

    return run
