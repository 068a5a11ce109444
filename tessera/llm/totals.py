"""Sums of large arrays over all tasks: each task sends its array in slices, each slice is summed by one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Bytes of an array that the driver fetches in slices.
_LARGE = 8 << 20
_SCHEMA = pa.schema([("slice", pa.int32()), ("part", pa.binary())])


def total(df: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int, kind=np.float64, slices: int = 32, into: np.ndarray | None = None, weight: float = 1.0) -> np.ndarray:
    """The sum of what add returns for each task's batches: an array of size numbers, which bounds what is collected.
    With into, weight times the sum is added to that array."""
    edge = np.linspace(0, size, slices + 1).astype(int)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = add(batches)
        if x is not None:
            x = np.ascontiguousarray(x, kind)
            rows = [(i, x[edge[i] : edge[i + 1]].tobytes()) for i in range(slices)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(b, kind)
                held[i] = held[i] + x if i in held else x.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], schema=_SCHEMA)

    schema = "slice int, part binary"
    rows = df.mapInArrow(parts, schema).repartition(min(slices, common.partitions(df)), "slice").mapInArrow(sums, schema)
    out = np.zeros(size, kind) if into is None else into
    # a large array comes slice by slice, so that the driver never holds it twice
    for r in rows.toLocalIterator() if out.nbytes > _LARGE else rows.collect():
        out[edge[r["slice"]] : edge[r["slice"] + 1]] += np.frombuffer(r["part"], kind) * kind(weight)
    return out
