"""How often each of many buckets occurs in a column, counted over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import frugal

#: Buckets of a histogram, and buckets of a slice of it.
BUCKETS, SLICE = 1 << 20, 1 << 12


def histogram(df: DataFrame, buckets: Callable[[pa.Array], Iterator[np.ndarray]]) -> np.ndarray:
    """How often each bucket occurs in df's only column. buckets: numbers below BUCKETS of a batch, in parts.

    Each task counts in one array; arrays go in slices to the tasks that sum them. BUCKETS numbers reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        held, n = [], 0
        for batch in batches:
            for part in buckets(batch.column(0)):
                held.append(part.astype(np.int32))
                n += len(part)
                if n > 2 * BUCKETS:
                    counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, n = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
        yield _slices(dict(enumerate(counts.reshape(-1, SLICE))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(cells, "<i8")
        yield _slices(sums)

    counts = np.zeros(BUCKETS, np.int64)
    for r in df.mapInArrow(frugal(count), "slice int, counts binary").repartition("slice").mapInArrow(frugal(add), "slice int, counts binary").collect():
        counts[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], "<i8")
    return counts


def _slices(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    some = [i for i, c in counts.items() if c.any()]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([counts[i].astype("<i8").tobytes() for i in some], pa.binary())], names=["slice", "counts"])
