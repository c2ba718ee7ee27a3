"""Repeated passages by a sparse suffix array.

Of each document the suffixes at minimiser positions are kept: the k-gram of
words with the least hash of every window of w k-grams. As k + w - 1 is the
least match, every passage of that many words holds such a position, and both
copies of a passage keep the same ones. Suffixes whose k-gram occurs once in
the corpus are dropped. Those left carry the w - 1 words on either side, all
that a least match around them can reach. Equal ones are folded into their
first; the distinct ones are sorted as suffixes and compared with their
neighbours, which gives how far each matches to the right. Within that reach
matches are extended to the left, word by word, by fingerprints of the windows
of the least match. A window is repeated where it occurs at two places; the
first by document id and position is kept and the others may be removed.

So the result is exact: a word is repeated where it lies in any ``least``
consecutive words that occur at another place of the corpus, and removable
where these occur at an earlier one. (32-bit words and 64-bit fingerprints.)

Words are runs of anything but ASCII white space, A-Z lowered. Nulls: a null
text is an empty one; rows with a null id are left out of the comparison.
Repeated rows of one id and text are one document. Documents shorter than the
least match have no repeats. Other columns are ignored; empty tables give
empty results; very long texts are whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .scratch import Scratch
from .sieve import parted, sieve, sifted

LEAST, GRAM = 50, 26
_STEP = X.U(0xD6E8FEB86659FD93)
_BACK = X.U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    if len(h) < k:
        return np.zeros(0, X.U)
    n = len(h)
    power = np.full(n, _STEP, X.U)
    power[0] = 1
    back = np.full(n, _BACK, X.U)
    back[0] = 1
    total = np.zeros(n + 1, X.U)
    np.cumsum(h * np.cumprod(power), out=total[1:])
    return X.mix((total[k:] - total[:-k]) * np.cumprod(back)[: n - k + 1])


def minimisers(h: np.ndarray, first: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions kept in a block of rows and their k-gram hashes."""
    g = grams(h, k)
    w = least - k + 1
    if len(g) < w:
        return np.zeros(0, np.int64), g[:0]
    row_end = np.repeat(first[1:], np.diff(first))
    start = np.arange(len(g) - w + 1)
    start = start[start + least <= row_end[start]]
    if not len(start):
        return np.zeros(0, np.int64), g[:0]
    near = np.lib.stride_tricks.sliding_window_view(g, w)
    at = np.concatenate([s + np.argmin(near[s], 1) for s in np.array_split(start, max(1, len(start) // 50_000))])
    at = np.unique(at)
    return at, g[at]


def _words32(h: np.ndarray) -> np.ndarray:
    return ((h >> X.U(32)).astype(np.uint32)) | np.uint32(1)


def _context(h: np.ndarray, a: int, b: int, at: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``reach`` words right of each k-gram and left of it, the nearest first; 0 beyond the document."""
    padded = np.concatenate([np.zeros(reach, np.uint32), _words32(h[a:b]), np.zeros(reach, np.uint32)])
    i = np.arange(reach)
    return padded[at[:, None] + reach + k + i], padded[at[:, None] + reach - 1 - i]


def _window_prints(kh: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A column for each window of the least match, by how many words it has left of the k-gram."""
    reach = right.shape[1]
    c = np.cumprod(np.full(reach + 1, 0x9E3779B97F4A7C15, X.U))[:reach]
    zero = np.zeros((len(kh), 1), X.U)
    lsum = np.hstack([zero, np.cumsum(left.astype(X.U) * c, 1)])
    rsum = np.hstack([zero, np.cumsum(right.astype(X.U) * c, 1)])
    return X.mix(X.mix(lsum + np.arange(reach + 1, dtype=X.U)) + X.mix(rsum[:, ::-1] ^ kh[:, None]))


def _valid(right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Windows that lie inside the document, by words left of the k-gram."""
    d = np.arange(right.shape[1] + 1)
    return (d <= (left > 0).sum(1)[:, None]) & (right.shape[1] - d <= (right > 0).sum(1)[:, None])


def _bits(flags: np.ndarray) -> np.ndarray:
    return (flags.astype(np.int64) << np.arange(flags.shape[1])).sum(1)


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, k: int = GRAM) -> DataFrame:
    """Documents with repeated passages: id, n_words, repeated and removable.

    Both are sorted arrays of (start, words) in words; removable parts have an
    earlier occurrence elsewhere.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "suffix")
    reach = least - k
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def keep(batches):
        for block in X.blocks(batches, "text"):
            words = X.Words(block.column("text"))
            at, g = minimisers(words.hashes(), words.first, k, least)
            row = np.searchsorted(words.first, at, "right") - 1
            yield pa.RecordBatch.from_arrays([block.column("id").take(pa.array(row)), pa.array((at - words.first[row]).astype(np.int32)), pa.array(X.signed(g))], ["id", "pos", "kh"])

    kept = docs.mapInArrow(keep, "id long, pos int, kh long")
    place = F.struct("id", "pos")
    # What is sent or joined here grows with the corpus: the joins are the same at every size, none a broadcast.
    often = kept.groupBy("kh").agg(F.min("id").alias("i0"), F.max("id").alias("i1"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    often = tmp.cut(often.where("i0 <> i1 or p0 <> p1").select("kh"), "often")
    cand = tmp.cut(kept.join(often.hint("merge"), "kh", "left_semi").select("id", "pos"), "cand")
    tmp.drop("often")
    ids = tmp.cut(cand.select("id").distinct(), "ids")
    bits = spark.sparkContext.broadcast(sieve(ids))

    def maybe(batches):
        for batch in batches:
            yield batch.filter(pa.array(sifted(bits.value, batch.column("id").to_numpy())))

    by_doc = cand.groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    some = docs.mapInArrow(maybe, docs.schema).join(by_doc.hint("merge"), "id")

    def carry(batches):
        for block in X.blocks(batches, "text"):
            words = X.Words(block.column("text"))
            h = words.hashes()
            out: list[list] = [[], [], [], [], []]
            for i, at in enumerate(block.column("at")):
                a, b = int(words.first[i]), int(words.first[i + 1])
                at = np.array(at.as_py(), np.int64)
                at = at[at + k <= b - a]
                right, left = _context(h, a, b, at, k, reach)
                kh = grams(h[a:b], k)[at] if len(at) else np.zeros(0, X.U)
                key = np.hstack([kh.astype(">u8").view(np.uint8).reshape(-1, 8), right.astype(">u4").view(np.uint8).reshape(len(at), -1), left.astype(">u4").view(np.uint8).reshape(len(at), -1)])
                full = _window_prints(kh, right, left)
                out[0].append(np.full(len(at), block.column("id")[i].as_py(), np.int64))
                out[1].append(at.astype(np.int32))
                out[2].append(np.full(len(at), b - a, np.int32))
                out[3].append(X.signed(X.mix(full[:, 0] + X.mix(full[:, -1]) * X.U(3))) if len(at) else np.zeros(0, np.int64))
                out[4] += [x.tobytes() for x in key]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in out[:4]), pa.array(out[4], pa.binary())], ["id", "pos", "n_words", "print", "key"])

    rows = tmp.cut(some.mapInArrow(carry, "id long, pos int, n_words int, print long, key binary"), "rows")
    tmp.drop("cand", "ids")
    bits.destroy()
    folded = rows.groupBy("print").agg(F.min(F.struct("id", "pos", "key")).alias("first"), F.max(place).alias("last"))
    same = (F.col("first.id") == F.col("last.id")) & (F.col("first.pos") == F.col("last.pos"))
    folded = tmp.cut(folded.select("print", F.col("first.id").alias("id"), F.col("first.pos").alias("pos"), F.col("first.key").alias("key"), (~same).alias("copied")), "folded")

    def compare(batches):
        """Neighbours of sorted suffixes. The first and last of a partition may have any neighbour outside it."""
        last: np.ndarray | None = None
        waiting: pa.RecordBatch | None = None

        def emit(batch, keys, before, after):
            right = keys[:, 8 : 8 + 4 * reach].view(">u4").astype(np.uint32)
            left = keys[:, 8 + 4 * reach :].copy().view(">u4").astype(np.uint32)
            kh = keys[:, :8].copy().view(">u8").ravel().astype(X.U)
            far = np.full(len(keys), -1)
            for other in (before, after):
                same = (keys[:, :8] == other[:, :8]).all(1)
                differs = keys[:, 8 : 8 + 4 * reach].reshape(-1, reach, 4) != other[:, 8 : 8 + 4 * reach].reshape(-1, reach, 4)
                differs = np.hstack([differs.any(2), np.ones((len(keys), 1), bool)])
                far = np.maximum(far, np.where(same, differs.argmax(1), -1))
            return kh, right, left, far

        def out(batch, keys, before, after, open_rows):
            kh, right, left, far = emit(batch, keys, before, after)
            far[open_rows] = reach
            prints = _window_prints(kh, right, left)
            d = np.arange(reach + 1)
            row, col = np.nonzero(_valid(right, left) & (reach - d <= far[:, None]))
            return pa.RecordBatch.from_arrays([batch.column("print").take(pa.array(row)), pa.array(col.astype(np.int32)), pa.array(X.signed(prints[row, col])), batch.column("id").take(pa.array(row)), pa.array((batch.column("pos").to_numpy()[row] - col).astype(np.int32))], ["print", "d", "w", "id", "s"])

        start = True
        for big in batches:
            for i in range(0, big.num_rows, 4096):
                batch = big.slice(i, 4096)
                if waiting is not None:
                    keys, nxt = _keys(waiting), _keys(batch.slice(0, 1))
                    before = np.vstack([keys[:1] if last is None else last, keys[:-1]])
                    yield out(waiting, keys, before, np.vstack([keys[1:], nxt]), [0] if start else [])
                    start, last = False, keys[-1:]
                waiting = batch
        if waiting is not None:
            keys = _keys(waiting)
            before = np.vstack([keys[:1] if last is None else last, keys[:-1]])
            yield out(waiting, keys, before, np.vstack([keys[1:], keys[-1:]]), [0, len(keys) - 1] if start else [len(keys) - 1])

    ordered = folded.select("print", "key", "id", "pos").repartitionByRange("key").sortWithinPartitions("key")
    windows = tmp.cut(ordered.mapInArrow(compare, "print long, d int, w long, id long, s int"), "windows")
    spot = F.struct("id", "s")
    seen = windows.groupBy("w").agg(F.min(spot).alias("w0"), F.max(spot).alias("w1")).where("w0 <> w1")
    bit = F.expr("shiftleft(1L, d)")
    marks = windows.join(seen.hint("merge"), "w").groupBy("print").agg(F.bit_or(bit).alias("again"), F.bit_or(F.when(F.col("w0") == spot, bit).otherwise(F.lit(0).cast("long"))).alias("head"))
    own = folded.select("print", F.struct("id", "pos").alias("first"), "copied")
    marks = tmp.cut(own.join(marks, "print", "left").where("copied or again is not null"), "marks")
    tmp.drop("windows")
    full = rows.join(marks.hint("merge"), "print")

    def spans(batches):
        for batch in batches:
            keys = _keys(batch)
            right = keys[:, 8 : 8 + 4 * reach].copy().view(">u4")
            left = keys[:, 8 + 4 * reach :].copy().view(">u4")
            valid = _bits(_valid(right, left))
            n = batch.num_rows
            copied = batch.column("copied").to_numpy(zero_copy_only=False)
            again, head = (np.nan_to_num(batch.column(c).fill_null(0).to_numpy()).astype(np.int64) for c in ("again", "head"))
            mine = batch.column("mine").to_numpy(zero_copy_only=False)
            repeated = np.where(copied, valid, again & valid)
            # The first row of a fold keeps what has no earlier window; windows nobody else has are its own too.
            kept = np.where(mine, head | (valid & ~again), 0)
            removable = repeated & ~kept
            pos = batch.column("pos").to_numpy().astype(np.int64)
            cols = []
            for mask in (repeated, removable):
                low = np.array([(int(m) & -int(m)).bit_length() - 1 for m in mask], np.int64)
                high = np.array([int(m).bit_length() - 1 for m in mask], np.int64)
                cols.append([[(int(p - y), int(least + y - x))] if m and _solid(int(m)) else _runs(int(p), int(m), least) for p, m, x, y in zip(pos, mask, low, high, strict=True)])
            flat = [pa.array([[{"start": s, "words": w} for s, w in r] for r in c], _SPANS) for c in cols]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), *flat], ["id", "n_words", "repeated", "removable"])
            del n

    found = full.select("id", "pos", "n_words", "key", "copied", "again", "head", (F.col("first") == place).alias("mine")).mapInArrow(spans, f"id long, n_words int, repeated {SPANS}, removable {SPANS}")
    merged = found.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("repeated")).alias("repeated"), F.flatten(F.collect_list("removable")).alias("removable"))
    result = tmp.cut(merged.mapInArrow(_merge, f"id long, n_words int, repeated {SPANS}, removable {SPANS}").where("size(repeated) > 0"), "result")
    tmp.drop("rows", "folded", "marks")
    return result


SPANS = "array<struct<start:int,words:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    data = batch.column("key")
    _, off, buf = data.buffers()
    offsets = np.frombuffer(off, np.int32)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]].reshape(len(data), -1)


def _solid(mask: int) -> bool:
    return (mask & (mask + (mask & -mask))) == 0


def _runs(pos: int, mask: int, least: int) -> list[tuple[int, int]]:
    """Spans of the windows in the mask: bit d is the window that starts d words before pos."""
    out: list[tuple[int, int]] = []
    for d in reversed(range(mask.bit_length())):
        if mask >> d & 1:
            out.append((pos - d, least))
    return out


def _merge(batches):
    for batch in batches:
        cols = []
        for name in ("repeated", "removable"):
            col = []
            for spans in batch.column(name).to_pylist():
                own: list[dict] = []
                for s in sorted(spans, key=lambda s: s["start"]):
                    if own and s["start"] <= own[-1]["start"] + own[-1]["words"]:
                        own[-1]["words"] = max(own[-1]["words"], s["start"] + s["words"] - own[-1]["start"])
                    else:
                        own.append(s)
                col.append(own)
            cols.append(pa.array(col, _SPANS))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), *cols], ["id", "n_words", "repeated", "removable"])


def remove(docs: DataFrame, found: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` (doc_id, text, n_chars if there is one, and more) without the removable passages; one space stands for each.

    Untouched rows stay as they are. A document that nothing is left of goes.
    """
    found = repeats(docs, **options) if found is None else found
    columns = docs.columns
    name = X.fresh(columns, "removable")
    cuts = found.where("size(removable) > 0").select(F.col("id").alias("doc_id"), F.col("removable").alias(name))

    def run(batches):
        for block in X.blocks(batches, "text"):
            words = X.Words(block.column("text"))
            cut = block.column(name).to_pylist()
            block = block.select(columns)
            keep, new = np.ones(block.num_rows, bool), {}
            for r, spans in enumerate(cut):
                if not spans:
                    continue
                source, first, base = block.column("text")[r].as_py().encode(), int(words.first[r]), int(words.offsets[r])
                parts, last = [], 0
                for s in spans:
                    parts.append(source[last : int(words.start[first + s["start"]]) - base].strip())
                    last = int(words.end[first + s["start"] + s["words"] - 1]) - base
                parts.append(source[last:].strip())
                new[r] = b" ".join(p for p in parts if p).decode()
                keep[r] = bool(new[r])
            yield X.replaced(block, new).filter(pa.array(keep))

    # Texts move only of the documents with cuts and of the few others that pass the sieve.
    some, others = parted(docs, cuts.select(F.col("doc_id").alias("id")), "doc_id")
    return some.join(cuts, "doc_id", "left").select(*(F.col(f"`{c}`") for c in columns), name).mapInArrow(run, docs.schema).union(others)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words or more that occur at another place of ``documents``."""
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return found.select(F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), words("repeated").alias("n_repeated"), words("removable").alias("n_removable"), "repeated", "removable")
