"""Best-fit packing of token sequences, certified by dual-feasible-function bounds.

Documents are dealt to partitions of bounded size and each is packed by
best-fit decreasing. A lower bound on its bins, the best of two families of
dual feasible functions, certifies partitions that cannot be improved. The
others keep their full bins, exchange the documents of the rest among
themselves and are packed again, as long as that saves bins.

Nulls: a null text is an empty one, which is the end id alone. A null document
id is kept. Repeated rows are packed each. Empty tables give empty results;
other columns are ignored. Lengths above the capacity are cut, the first piece
being the shorter one; nothing is dropped.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .encode import encoded, tokenizer_path
from .scratch import Scratch

#: Pieces a partition holds about.
PARTITION = 4096


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1]
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    many, mass = np.cumsum(count), np.cumsum(count * x)
    for t in range(1, capacity // 2 + 1):  # above capacity - t a bin each, below t nothing
        big = int(many[-1] - many[capacity - t])
        mid = int(mass[capacity - t] - mass[t - 1])
        best = max(best, big - (-mid // capacity))
    for k in range(1, 101):  # rounding to multiples of 1 / (k + 1)
        y = x * (k + 1)
        scaled = np.where(y % capacity == 0, x * k, y // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each size: the fullest one that still has room, sizes in falling order."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, 0
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            at, room, bins = bins, capacity, bins + 1
        out[i] = at
        room -= size
        if room:
            if not rooms[room]:
                open_rooms |= 1 << room
            rooms[room].append(at)
    return out


def pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = 2, capacity: int = 1024) -> DataFrame:
    """Token pieces of each document: doc_id, piece, start, length, ids_crc32."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for e, block in encoded(path, batches):
            yield cut(block, *e.encode(block.column("text")))

    def cut(block: pa.RecordBatch, ids: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        row, piece, start, length, crc = [], [], [], [], []
        for i in range(block.num_rows):
            own = np.append(ids[first[i] : first[i + 1]], end).astype("<u4")
            at = 0
            for k, stop in enumerate(range((len(own) - 1) % capacity + 1, len(own) + 1, capacity)):
                row.append(i)
                piece.append(k)
                start.append(at)
                length.append(stop - at)
                crc.append(zlib.crc32(own[at:stop].tobytes()))
                at = stop
        return pa.RecordBatch.from_arrays([block.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _packer(capacity: int):
    def run(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(tables)).select(["doc_id", "piece", "start", "length", "ids_crc32", "part"]).combine_chunks()
        size = t.column("length").to_numpy()
        at = best_fit_decreasing(size, capacity)
        order = np.lexsort((-size, at))
        begin = np.concatenate([[True], np.diff(at[order]) > 0])
        before = np.cumsum(size[order]) - size[order]
        offset = np.empty(len(size), np.int64)
        offset[order] = before - np.repeat(before[begin], np.diff(np.append(np.flatnonzero(begin), len(size))))
        full = np.bincount(at, size) >= capacity
        gap = int(at.max()) + 1 - lower_bound(size, capacity)
        t = t.append_column("bin", pa.array(at)).append_column("offset", pa.array(offset)).append_column("full", pa.array(full[at])).append_column("gap", pa.array(np.full(len(size), gap)))
        yield from t.to_batches()

    return run


def pack(rows: DataFrame, capacity: int = 1024, partition: int = PARTITION) -> DataFrame:
    """``rows`` of ``pieces`` with sequence_id and offset: as few sequences of at most ``capacity`` as it finds."""
    spark = rows.sparkSession
    tmp = Scratch(spark, "pack")
    rows = tmp.cut(rows, "pieces")
    n = rows.count()
    parts = max(1, -(-n // partition))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    schema = f"{fields}, part long, bin long, offset long, full boolean, gap long"

    def packed(df: DataFrame, parts: int, turn: int) -> DataFrame:
        dealt = df.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id(), F.lit(turn)), F.lit(parts)) + turn * (1 << 24))
        return dealt.groupBy("part").applyInArrow(_packer(capacity), schema)

    state = tmp.cut(packed(rows, parts, 0), "packed-0")
    tmp.drop("pieces")
    keep = None
    bins = lambda df: df.select("part", "bin").distinct().count()
    for turn in itertools.count(1):
        loose = state.where("gap > 0 and not full")
        count = loose.count()
        if not count:
            break
        again = tmp.cut(packed(loose.drop("part", "bin", "offset", "full", "gap"), max(1, -(-count // partition)), turn), f"packed-{turn}")
        if bins(again) >= bins(loose):
            break
        kept = state.where("gap <= 0 or full")
        keep = kept if keep is None else keep.union(kept)
        state = again
    out = state if keep is None else keep.union(state)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.shiftleft("part", 24) + F.col("bin")).alias("sequence_id"), "offset")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of at most 1024 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, tokenizer_path("byte_bpe_50k.json")))
