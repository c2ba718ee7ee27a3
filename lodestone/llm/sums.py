"""Sums of counts over a table of fixed size, taken on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import release


def dense_sum(df: DataFrame, codes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int, chunk: int = 1 << 14, final: Callable[[np.ndarray], np.ndarray] = lambda n: n) -> np.ndarray:
    """How often each code below ``size`` is given over all batches of df, as ``final`` makes of it. A task sends what it counted by chunk."""

    def count(batches):
        total = np.zeros(-(-size // chunk) * chunk, np.int32)  # of one task
        for batch in batches:
            for c in codes(batch):
                at, n = np.unique(c, return_counts=True) if len(c) < size // 8 else (slice(0, size), np.bincount(c, minlength=size))
                total[at] += n
        part = total.reshape(-1, chunk)
        for i in np.flatnonzero(part.any(1)):
            at = np.flatnonzero(part[i])
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([int(i)], pa.int32()), "at": [at.astype(np.int16).tobytes()], "n": [part[i][at].tobytes()]})
        del total, part
        release()

    def add(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(chunk, np.int64)
        for t in tables:
            for at, n in zip(t.column("at").to_pylist(), t.column("n").to_pylist(), strict=True):
                total[np.frombuffer(at, np.int16)] += np.frombuffer(n, np.int32)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int32()), "n": [final(total).tobytes()]})

    nothing = final(np.zeros(chunk, np.int64))
    out = np.tile(nothing, -(-size // chunk))
    rows = df.mapInArrow(count, "chunk int, at binary, n binary")
    for r in rows.groupBy("chunk").applyInArrow(add, "chunk int, n binary").collect():
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r["n"], nothing.dtype)
    return out[:size]
