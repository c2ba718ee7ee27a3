"""A sieve of ids of fixed size, so that Python workers pass over most rows that a join would drop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as X

SIEVE_BITS = 24


def _slot(ids: np.ndarray) -> np.ndarray:
    return (X.mix(ids.astype(X.U)) >> X.U(64 - SIEVE_BITS)).astype(np.int64)


def sieve(ids: DataFrame) -> np.ndarray:
    """A fixed-size sieve of ids, as packed bits: what it lets through is joined exactly afterwards."""

    def mark(batches):
        bits = np.zeros(1 << SIEVE_BITS, bool)
        for batch in batches:
            bits[_slot(batch.column("id").to_numpy())] = True
        part = np.packbits(bits).reshape(64, -1)
        del bits
        at = np.flatnonzero(part.any(1))
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "bits": pa.array([part[i].tobytes() for i in at], pa.binary())})
        X.release()

    def join(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SIEVE_BITS) // 512, np.uint8)
        for t in tables:
            for b in t.column("bits").to_pylist():
                total |= np.frombuffer(b, np.uint8)
        yield pa.RecordBatch.from_pydict({"at": pa.array([key[0].as_py()], pa.int32()), "bits": [total.tobytes()]})

    out = np.zeros((64, (1 << SIEVE_BITS) // 512), np.uint8)
    for r in ids.mapInArrow(mark, "at int, bits binary").groupBy("at").applyInArrow(join, "at int, bits binary").collect():
        out[r["at"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def sifted(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id passes."""
    slot = _slot(ids)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def parted(rows: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose id may be among ``ids`` (id long), to be joined with them, and the others, which never move. Null ids are others."""
    bits = rows.sparkSession.sparkContext.broadcast(sieve(ids.where("id is not null")))

    def half(inside: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                at = batch.column(id_col).cast(pa.int64())
                found = sifted(bits.value, at.fill_null(0).to_numpy()) & at.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(found == inside))

        return rows.mapInArrow(run, rows.schema)

    return half(True), half(False)
