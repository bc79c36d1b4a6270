"""Python functions of rows' values, run in Arrow batches.

A batch has as many rows as the session says (10,000), and a row may be a whole document. So values become
Python objects a few rows at a time, results are Arrow's at once, and after a batch freed memory goes back:
what a worker holds is one batch, its results and a few rows, whatever the table's size. The functions are
no iterators of batches, as Spark gives each of those a worker of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that are Python objects at a time.
MOST = 256


def _few(columns: tuple[pa.Array, ...], function: Callable[..., object], kind: pa.DataType) -> Iterator[pa.Array]:
    for at in range(0, max(1, len(columns[0])), MOST):
        rows = zip(*[c.slice(at, MOST).to_pylist() for c in columns], strict=True)
        yield pa.array([function(*r) for r in rows], kind)


def _whole(parts: Iterator[pa.Array]) -> pa.Array:
    out = pa.concat_arrays([*parts])
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    return out


def of_one(function: Callable[[object], object], kind: T.DataType) -> Callable[[Column], Column]:
    """A column function of one column's values; null stays null."""
    made = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return _whole(_few((values,), lambda x: None if x is None else function(x), made))

    return run


def of_two(function: Callable[[object, object], object], kind: T.DataType) -> Callable[[Column, Column], Column]:
    """A column function of two columns' values, which may be null."""
    made = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return _whole(_few((left, right), function, made))

    return run
