"""Arrow batches handled a piece at a time, so that the Python objects of a task follow the piece, not the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text whose Python objects a task holds at a time; a longer single row is a piece of its own.
PIECE_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch that Spark hands to Python, which rows alone don't where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _numbers(a: pa.Array) -> np.ndarray:
    return pc.fill_null(a, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def row_bytes(a: pa.Array) -> np.ndarray:
    """About what each row holds: the bytes of a text or of a list's texts, and eight more for each item."""
    if not pa.types.is_list(a.type):
        return _numbers(pc.binary_length(a))
    sizes, items = _numbers(pc.list_value_length(a)), a.flatten()
    inside = _numbers(pc.binary_length(items)) if pa.types.is_string(items.type) else np.zeros(len(items), np.int64)
    upto, ends = np.concatenate([[0], np.cumsum(inside)]), np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes] + 8 * sizes


def pieces(sizes: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of rows that have at most `most` bytes together, or are one row."""
    upto, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        yield at, to - at
        at = to


def by_pieces(run: Callable[..., pa.Array], *columns: pa.Array, most: int = PIECE_BYTES) -> pa.Array:
    """run(*columns), row by row work, done for one piece of the batch after the other."""
    sizes = sum(row_bytes(c) for c in columns)
    done = [run(*[c.slice(at, n) for c in columns]) for at, n in pieces(sizes, most)]
    return pa.concat_arrays(done) if done else run(*columns)
