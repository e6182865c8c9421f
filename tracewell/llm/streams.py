"""Arrow batches of sorted rows, regrouped by key, inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with one value of ``column`` each."""
    values = batch.column(column).to_numpy()
    borders = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    for begin, end in zip(borders, borders[1:]):
        if end > begin:
            yield batch.slice(begin, end - begin)


def groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of ``column``, which follow one another; a group must be small enough for memory."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for run in runs(batch, column):
            if held and held[-1].column(column)[0].as_py() != run.column(column)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(run)
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """Lists of equal length as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))
