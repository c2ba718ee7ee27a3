"""Benchmark decontamination: an FM-index over each shard of documents, searched for benchmark windows.

A window is n consecutive words of an item; an item of fewer words, but not
none, is one window. A shard keeps only its runs of words that occur in the
benchmark and are long enough to hold a window: nothing else can match. All
windows are searched backward at once, their occurrences located by sampled
suffix positions, and the spans of a document merged.

The benchmark is sent to the executors in blocks of at most ``block_bytes`` of
text, one at a time: a larger one takes several passes over the documents as
they are, each written before the next, and their spans are merged. So what is
held and broadcast is bounded whatever its size, and the result is the same
for any size of the blocks.

Nulls: a null text is an empty one and has no words; items with a null id are
ignored; rows of one item id together are one item. A null document id is kept
as such. Documents without words give zeros. Repeated document rows give a row
each. Empty tables: no documents give no rows; no benchmark gives no hits.
Texts of any length are searched whole. Other columns are ignored by ``hits``
and kept by ``remove``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .fm_index import FMIndex
from .scratch import Scratch

BLOCK_BYTES = 16 << 20


class Windows:
    """The distinct windows of a block of items, over the symbols of its words."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        words = X.Words(pa.array([t for _, t in items], pa.string()), X.ALNUM)
        hashes = words.hashes()
        self.vocabulary = np.unique(hashes)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.vocabulary >> X.U(48)).astype(np.int64)] = True
        symbols = np.searchsorted(self.vocabulary, hashes) + 1
        found: dict[bytes, set[str]] = defaultdict(set)
        for (item, _), a, b in zip(items, words.first[:-1], words.first[1:], strict=True):
            s = symbols[a:b].astype(np.int32)
            for i in range(max(1, len(s) - n + 1) if len(s) else 0):
                found[s[i : i + n].tobytes()].add(item)
        self.lengths = np.array([len(w) // 4 for w in found], np.int64)
        self.patterns = np.zeros((len(found), n), np.int64)
        for row, w in zip(self.patterns, found, strict=True):
            row[: len(w) // 4] = np.frombuffer(w, np.int32)
        self.items = list(map(sorted, found.values()))
        self.least = int(self.lengths.min()) if len(found) else 0

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.sieve[(hashes >> X.U(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0) if len(maybe) else 0
        return out

    def occurrences(self, words: X.Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, index of its first word) of every occurrence inside a row of the block."""
        none = np.zeros(0, np.int64)
        if not len(self.lengths) or not len(words.start):
            return none, none
        s = self.symbols(words.hashes())
        edge = np.zeros(len(s) + 1, bool)
        edge[words.first] = True
        edge[-1] = True
        known = s > 0
        begin = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
        end = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        keep = end - begin >= self.least
        begin, end = begin[keep], end[keep]
        if not len(begin):
            return none, none
        size = end - begin + 1  # with the separator
        place = np.cumsum(size) - size
        word = np.arange(size.sum()) + np.repeat(begin - place, size)
        shard = np.where(word < np.repeat(end, size), s[np.minimum(word, len(s) - 1)], 0)
        index = FMIndex(shard, len(self.vocabulary) + 1)
        lo, hi = index.search(self.patterns, self.lengths)
        count = hi - lo
        rows = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
        return np.repeat(np.arange(len(lo)), count), word[index.locate(rows)]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans, overlapping or touching ones joined."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]


SPANS = "array<struct<start:int,end:int,first:int,words:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first", pa.int32()), ("words", pa.int32())]))
STATE = "struct<spans:array<struct<first:int,words:int>>,items:array<string>>"
_STATE = pa.struct([("spans", pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _scan(windows, text_col: str, state: str):
    """One pass: a column ``state`` with the spans and items of this block of the benchmark, and those found before, if any."""

    def run(batches):
        w: Windows = windows.value
        for block in X.blocks(batches, text_col):
            words = X.Words(block.column(text_col), X.ALNUM)
            window, first = w.occurrences(words)
            row = np.searchsorted(words.first, first, "right") - 1
            again = state in block.schema.names
            found = block.column(state).to_pylist() if again else [{"spans": [], "items": []} for _ in range(block.num_rows)]
            order = np.argsort(row, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(order) else []:
                r = int(row[at[0]])
                old = found[r]["spans"]
                begin = np.concatenate([first[at] - words.first[r], np.array([s["first"] for s in old], np.int64)])
                length = np.concatenate([w.lengths[window[at]], np.array([s["words"] for s in old], np.int64)])
                a, b = _merged(begin, begin + length)
                items = sorted({*found[r]["items"], *(i for k in np.unique(window[at]) for i in w.items[k])})
                found[r] = {"spans": [{"first": int(x), "words": int(y - x)} for x, y in zip(a, b, strict=True)], "items": items}
            column = pa.array(found, _STATE)
            yield block, words, column

    return run


def _with(block: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = block.schema.names
    return block.set_column(names.index(name), name, column) if name in names else block.append_column(name, column)


def _passes(docs: DataFrame, blocks, n: int, text_col: str, finish, schema: T.StructType) -> DataFrame:
    """All blocks of the benchmark against ``docs``; the last pass yields what ``finish`` makes of a batch, its words and its state."""
    spark, tmp = docs.sparkSession, Scratch(docs.sparkSession, "windows")
    state = X.fresh(docs.columns, "found")
    between = T.StructType([*docs.schema.fields, T.StructField(state, T._parse_datatype_string(STATE))])
    waiting, turn = None, 0
    for items in blocks:
        if waiting is not None:
            shared = spark.sparkContext.broadcast(Windows(waiting, n))
            scan = _scan(shared, text_col, state)
            docs = tmp.cut(docs.mapInArrow(lambda batches, scan=scan: (_with(block, state, column) for block, _, column in scan(batches)), between), f"pass-{turn}")
            shared.destroy()
            if turn:
                tmp.drop(f"pass-{turn - 1}")
            turn += 1
        waiting = items
    scan = _scan(spark.sparkContext.broadcast(Windows(waiting or [], n)), text_col, state)
    return docs.mapInArrow(lambda batches: (finish(block, words, column) for block, words, column in scan(batches)), schema)


def _items(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The benchmark's items in blocks of bounded text; a block is a set of whole rows by their hash."""
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        yield [(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()]


def hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 8, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """One row per document: row (its id), n_words, spans to remove and the items found.

    A span has start and end in characters, its first word and its number of words.
    """
    docs = docs.select(F.col(id_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["row"].dataType.simpleString()

    def finish(block: pa.RecordBatch, words: X.Words, found: pa.Array) -> pa.RecordBatch:
        chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        base, spans, items = chars[words.offsets], [], []
        for r, f in enumerate(found.to_pylist()):
            ends = [(words.first[r] + s["first"], words.first[r] + s["first"] + s["words"] - 1) for s in f["spans"]]
            spans.append([{"start": int(chars[words.start[x]] - base[r]), "end": int(chars[words.end[y]] - base[r]), **s} for (x, y), s in zip(ends, f["spans"], strict=True)])
            items.append(f["items"])
        cols = [block.column("row"), pa.array(np.diff(words.first), pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols + [block.column("text")] * keep_text, ["row", "n_words", "spans", "items"] + ["text"] * keep_text)

    schema = T._parse_datatype_string(f"row {kind}, n_words long, spans {SPANS}, items array<string>" + ", text string" * keep_text)
    return _passes(docs, _items(benchmark, item_col, item_text, block_bytes), n, "text", finish, schema)


def digest(found: DataFrame) -> DataFrame:
    """The counts and the items' fingerprint of ``hits``."""
    return found.select(
        F.col("row").alias("doc_id"),
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, *, n: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (text, n_chars if there is one, and more) with every hit span taken out of the text, all at once.

    A cut leaves one space between what stood on its sides. Untouched texts
    stay as they are, null ones too; a document that had hits and keeps no
    word is left out.
    """

    def finish(block: pa.RecordBatch, words: X.Words, found: pa.Array) -> pa.RecordBatch:
        block = block.select(columns)
        keep, new = np.ones(block.num_rows, bool), {}
        for r, f in enumerate(found.to_pylist()):
            if not f["spans"]:
                continue
            keep[r] = sum(s["words"] for s in f["spans"]) < words.first[r + 1] - words.first[r]
            source, parts, last = block.column("text")[r].as_py().encode(), [], 0
            for s in f["spans"]:
                x = words.first[r] + s["first"]
                parts.append(source[last : int(words.start[x] - words.offsets[r])])
                last = int(words.end[x + s["words"] - 1] - words.offsets[r])
            parts.append(source[last:])
            new[r] = b" ".join(p.strip() for p in parts if p.strip()).decode()
        return X.replaced(block, new).filter(pa.array(keep))

    columns = docs.columns
    return _passes(docs, _items(benchmark, "item_id", "text", block_bytes), n, "text", finish, docs.schema)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows of eight words in whole ``documents``."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return digest(hits(read("documents"), read("benchmark")))
