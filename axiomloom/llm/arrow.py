"""Arrow record batches as flat numpy arrays, cut into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession


ROWS_AT_ONCE = 1_000


def small_batches(spark: SparkSession) -> None:
    """Texts are long: this session sends at most ROWS_AT_ONCE rows to Python at a time."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ROWS_AT_ONCE:
        spark.conf.set(rows, ROWS_AT_ONCE)


BYTES_AT_ONCE = "4m"


def short_batches(spark: SparkSession) -> None:
    """small_batches of at most about BYTES_AT_ONCE: for rows that hold stretches of text."""
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE)


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column; a null list is an empty one."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets) of a string column without nulls."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int, overlap: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut rows into blocks of about ``most`` values.

    Yields (start, end, rows, starts): the value range, the row of each piece in
    it and where each piece begins, relative to ``start``. A row longer than a
    block comes in several pieces; each later piece is preceded by ``overlap``
    values of the one before it.
    """
    n, row = len(offsets) - 1, 0
    while row < n:
        first, last = offsets[row], int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        if last > row:
            yield int(first), int(offsets[last]), np.arange(row, last), offsets[row:last] - first
            row = last
            continue
        for at in range(int(first), int(offsets[row + 1]), most):
            lo = max(int(first), at - overlap)
            yield lo, min(at + most, int(offsets[row + 1])), np.array([row]), np.array([0])
        row += 1


def sums_per_piece(values: np.ndarray, starts: np.ndarray, dtype=np.float64) -> np.ndarray:
    """Sum of ``values`` (along the first axis) from each start to the next; empty pieces give 0."""
    out = np.zeros((len(starts), *values.shape[1:]), dtype)
    ends = np.append(starts[1:], len(values))
    full = ends > starts
    if full.any():
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=dtype)
    return out
