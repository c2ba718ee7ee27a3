"""Brown class-based language model: exchange clustering, class trigrams, word emissions.

Counts are taken over all training documents. A start is made on the driver:
the ``frequent`` most frequent words are clustered by exchange over their
bigram table, and every other word votes at each of its occurrences for the
class that fits best between its neighbours, and joins the tail class of the
most votes. Then all words are exchanged, ``rounds`` times: how often a word
stands before and after each class is counted over the documents, sparse and
by parts of the vocabulary, and each word moves to the class that raises the
likelihood of the class bigrams most, given the classes of its neighbours and
the moves before it in its part. A round that doesn't raise it is taken back
and is the last.

Words are 64-bit hashes, dealt to parts of the vocabulary. A block of
documents asks each part for its distinct words, a row of packed numbers a
part, and gets their places, classes or counts in the same order; no
vocabulary is held in one place and nothing moves word by word.

    P(w | history) = P(class | last two classes) (c(w) - d) / N(class)

Class transitions are Witten-Bell-smoothed trigrams over bigrams over
unigrams. The mass d V(class) / N(class) of each class goes to the one unknown
type, summed over classes; an unknown word leaves the history as it was. All
probabilities of a history sum to 1. A text's history begins with the end of
another.

Nulls: a null text is an empty one: its one token is the end. A null id is
learnt from and kept. Repeated rows count and are scored each. Where there is
nothing to learn from, the score is the base score. Ties: of words equally
frequent the one of the least hash comes first, of classes equally good the
first. Other columns are ignored; empty tables give empty results; very long
texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .scratch import Scratch
from .sums import dense_sum

FREQUENT, CLASSES, SWEEPS, ROUNDS, DISCOUNT = 2000, 48, 6, 2, 0.75
#: Parts of the vocabulary grow as this power of the blocks, as vocabularies do with texts; moves of a part are found together.
PART_POWER = 0.75
#: Text bytes of a block of documents whose distinct words are looked up together.
LOOKUP_BYTES = 8 << 20
END = X.U(0x9D3F_0E5A_71C2_86B4)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each row, an end after each, and where rows begin."""
    words = X.Words(col)
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], END, X.U)
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    out[inner] = words.hashes()
    return out, first


def lookup(keys: np.ndarray, values: np.ndarray, h: np.ndarray, default) -> np.ndarray:
    """values at h; keys are sorted."""
    if not len(keys):
        return np.full(len(h), default)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], default)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of words by exchange: each word in turn moves to the class that raises the likelihood most.

    The last row and column stand for all other words and are a class of their own.
    """
    n = len(bigrams) - 1
    k = max(1, min(classes, n))
    cls = np.append(np.arange(n) % k, k)
    one = np.zeros((n + 1, k + 1))
    one[np.arange(n + 1), cls] = 1
    big = bigrams.astype(float)
    right, left = big @ one, big.T @ one
    grid = one.T @ right
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    size = np.bincount(cls, minlength=k + 1)
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, own = cls[w], big[w, w]
            if size[a] == 1:
                continue
            r, lf = right[w].copy(), left[w].copy()
            r[a] -= own
            lf[a] -= own
            grid[a] -= r
            grid[:, a] -= lf
            grid[a, a] -= own
            rows, cols = grid.sum(1), grid.sum(0)
            up = f(grid + r) - f(grid)
            down = f(grid + lf[:, None]) - f(grid)
            d = np.diagonal(grid)
            gain = up.sum(1) - np.diagonal(up) + down.sum(0) - np.diagonal(down) + f(d + r + lf + own) - f(d)
            gain -= f(rows + r.sum() + own) - f(rows) + f(cols + lf.sum() + own) - f(cols)
            b = int(np.argmax(gain[:k]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            grid[b] += r
            grid[:, b] += lf
            grid[b, b] += own
            if b != a:
                moved += 1
                size[a] -= 1
                size[b] += 1
                cls[w] = b
                right[:, a] -= big[:, w]
                right[:, b] += big[:, w]
                left[:, a] -= big[w]
                left[:, b] += big[w]
        if not moved:
            break
    return cls[:n]


def votes(bigrams: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Class of a word between two classes; the last row and column: a neighbour of no known class."""
    k = int(cls.max()) + 1
    one = np.zeros((len(bigrams) - 1, k))
    one[np.arange(len(cls)), cls] = 1
    grid = one.T @ bigrams[:-1, :-1] @ one + 0.5
    before = np.vstack([np.log(grid / grid.sum(1, keepdims=True)), np.log(grid.sum(0) / grid.sum())])
    after = np.hstack([np.log(grid / grid.sum(1, keepdims=True)), np.zeros((k, 1))])
    return np.argmax(before[:, None, :] + after.T[None, :, :], axis=2)


def likelihood(grid: np.ndarray) -> float:
    """The part of the log-likelihood of class bigrams that depends on the classes."""
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(grid) - f(grid.sum(0)) - f(grid.sum(1))


def moves(grid: np.ndarray, cls: np.ndarray, first: np.ndarray, slot: np.ndarray, n: np.ndarray, parts: int = 1, chunk: int = 1 << 12) -> np.ndarray:
    """The best class of each word of a part: entries first[i] to first[i + 1] are word i's.

    An entry says that the word stands n times before class ``slot``, or after class ``slot`` - k. Words are moved in
    falling frequency, few at a time, and change the grid for those after them; each move counts ``parts`` times,
    because as many are made in the other parts, of words dealt by hash.
    """
    k = len(grid)
    near = np.hstack([grid, grid.T]).astype(float)  # class by slot
    rows, cols = near[:, :k].sum(1), near[:, k:].sum(1)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    out = cls.astype(np.int64)
    right = np.where(slot < k, n, 0)
    before, after = np.add.reduceat(right, first[:-1]).astype(float), np.add.reduceat(n - right, first[:-1]).astype(float)
    falling = np.argsort(-before, kind="stable")
    cost = np.cumsum(np.diff(first)[falling] / chunk + 200 * before[falling] / max(before.sum(), 1))
    for w in np.split(falling, np.flatnonzero(np.diff(np.floor(cost))) + 1):
        many = first[w + 1] - first[w]
        at = np.cumsum(many) - many
        entry = np.arange(many.sum()) + np.repeat(first[w] - at, many)
        s, x, word = slot[entry], n[entry], np.repeat(np.arange(len(w)), many)
        own, b, a = out[w], before[w], after[w]
        # In its own class the word is counted already.
        was = near[own[word], s]
        stay = np.add.reduceat(f(was) - f(np.maximum(was - x, 0)), at)
        stay -= f(rows[own]) - f(np.maximum(rows[own] - b, 0)) + f(cols[own]) - f(np.maximum(cols[own] - a, 0))
        kinds, which = np.unique(x * (2 * k) + s, return_inverse=True)  # rare words share most of theirs
        there = near.T[kinds % (2 * k)]
        each = f(there + (kinds // (2 * k))[:, None]) - f(there)
        gain = np.add.reduceat(each[which], at) - f(rows + b[:, None]) + f(rows) - f(cols + a[:, None]) + f(cols)
        gain[np.arange(len(w)), own] = stay
        best = np.argmax(gain, 1)
        best = np.where(gain[np.arange(len(w)), best] > stay + 1e-9, best, own)
        go = best != own
        moved = go[word]
        np.add.at(near, (own[word][moved], s[moved]), -parts * x[moved])
        np.add.at(near, (best[word][moved], s[moved]), parts * x[moved])
        np.maximum(near, 0, out=near)
        rows, cols = near[:, :k].sum(1), near[:, k:].sum(1)
        out[w] = best
    return out


@dataclass
class Transitions:
    """log10 P(class | two classes before) and of the unknown type."""

    known: np.ndarray
    unknown: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, unseen: np.ndarray) -> Transitions:
        """counts: of class trigrams; unseen: the mass of each class that goes to the unknown type."""
        two = counts.sum(0)
        uni = two.sum(0) + 0.5 * (two.sum(0) > 0)  # a class without words gets nothing
        uni = uni / max(uni.sum(), 1)
        kinds = (two > 0).sum(1, keepdims=True)
        p2 = (two + np.maximum(kinds, 1) * uni) / (two.sum(1, keepdims=True) + np.maximum(kinds, 1))
        kinds = np.maximum((counts > 0).sum(2, keepdims=True), 1)
        p3 = (counts + kinds * p2[None]) / (counts.sum(2, keepdims=True) + kinds)
        with np.errstate(divide="ignore"):
            return Transitions(np.log10(p3), np.log10(p3 @ unseen))


def history(c: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The last two known classes before each token, in its row; the end before its first. Unknown classes are -1."""
    n = len(c)
    known = np.flatnonzero(c >= 0)
    values = np.concatenate([[end, end], c[known]])
    before = np.searchsorted(known, np.arange(n))  # known tokens of the block before each
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.searchsorted(known, first[:-1])[row]
    own = before - start
    last = np.where(own >= 1, values[before + 1], end)
    return np.where(own >= 2, values[before], end), last


def _pack(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8).tobytes()


def _unpack(data: pa.Scalar, n: int) -> np.ndarray:
    """The n numbers of ``_pack``."""
    raw = data.as_buffer()
    return np.frombuffer(raw, np.dtype(f"u{raw.size // n}")).astype(np.int64) if n else np.zeros(0, np.int64)


def _array(data: pa.Scalar, kind=X.U) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), kind)


class Block:
    """Tokens of a block of documents as places among its distinct words, which are in order of their part and hash."""

    def __init__(self, batches: list[pa.RecordBatch], parts: int):
        hashes, sizes = [np.zeros(0, X.U)], [np.zeros(0, np.int64)]
        for batch in X.blocks(batches, "text"):
            h, first = tokens(batch.column("text"))
            hashes.append(h)
            sizes.append(np.diff(first))
        words, at = np.unique(np.concatenate(hashes), return_inverse=True)
        part = (words % X.U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.at = words[order], rank[at]
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        self.edge = np.searchsorted(part[order], np.arange(parts + 1))

    def answer(self, table: pa.Table, *columns: str) -> list[np.ndarray]:
        """Packed columns of the parts' answers, a number for each distinct word."""
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        sizes = table.column("many").to_numpy()[order]
        if sizes.sum() != len(self.words):
            raise ValueError("the answers are not those of this block's words")
        out = []
        for name in columns:
            column = table.column(name).combine_chunks()
            out.append(np.concatenate([np.zeros(0, np.int64), *(_unpack(column[int(i)], int(n)) for i, n in zip(order, sizes, strict=True))]))
        return out


@dataclass
class Classed:
    """Words of each part with their counts and classes, a row a part; the classes of the frequent words ``top`` are kept apart."""

    rows: DataFrame
    top: np.ndarray
    own: np.ndarray

    def of(self, row: dict[str, pa.Scalar]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, counts and classes of a part's row."""
        h, c, cls = _array(row["h"]), _array(row["c"], np.int64), _array(row["class"], np.uint16).astype(np.int64)
        return h, c, np.where(lookup(self.top, np.ones(len(self.top), bool), h, False), lookup(self.top, self.own, h, 0), cls)

    def __getstate__(self):
        return {"rows": None, "top": self.top, "own": self.own}


CLASSED = "part int, h binary, c binary, class binary"


def _row(table: pa.Table) -> dict[str, pa.Scalar] | None:
    return {name: table.column(name)[0] for name in table.schema.names} if table.num_rows else None


def score(docs: DataFrame, train, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, classes: int = CLASSES, rounds: int = ROUNDS, discount: float = DISCOUNT, lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """Scores of ``docs``, learnt from the rows where the column ``train`` holds.

    Returns id, train, n_tokens, n_known, train_tokens, base_score and score
    (log10 probabilities of the whole text, its end included).
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "classlm")
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("learn"))
    size = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // lookup_bytes))
    parts = max(1, round(blocks**PART_POWER))
    docs = docs.withColumn("blk", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    learning = docs.where("learn")

    def ask(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(tables)
        block = Block(batches, parts)
        learn = np.concatenate([b.column("learn").to_numpy(zero_copy_only=False) for b in batches])
        count = np.bincount(block.at, np.repeat(learn, np.diff(block.first)), len(block.words)).astype(np.int64)
        rows = [(p, block.words[a:b].tobytes(), _pack(count[a:b])) for p, (a, b) in enumerate(zip(block.edge[:-1], block.edge[1:], strict=True)) if b > a]
        blk = pa.array(np.full(len(rows), key[0].as_py()), pa.int64())
        yield pa.RecordBatch.from_arrays([blk, pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["blk", "part", "h", "c"])

    asked = tmp.cut(docs.groupBy("blk").applyInArrow(ask, "blk long, part int, h binary, c binary"), "asked")
    tmp.sweep()

    def collect(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, count = np.zeros(0, X.U), np.zeros(0, np.int64)
        waiting, size = [], 0

        def fold():
            nonlocal every, count
            every, count = _sum(np.concatenate([every, *(h for h, _ in waiting)]), np.concatenate([count, *(c for _, c in waiting)]))
            waiting.clear()

        for t in tables:
            for h, c in zip(t.column("h"), t.column("c"), strict=True):
                h = _array(h)
                c = _unpack(c, len(h))
                waiting.append((h[c > 0], c[c > 0]))
                size += len(waiting[-1][0])
                if size > 1 << 21:
                    fold()
                    size = 0
        fold()
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "h": [every.tobytes()], "c": [count.tobytes()], "n": pa.array([len(every)], pa.int64()), "total": pa.array([int(count.sum())], pa.int64())})

    vocab = tmp.cut(asked.groupBy("part").applyInArrow(collect, "part int, h binary, c binary, n long, total long"), "vocab")
    tmp.sweep()
    total, distinct_n = (int(x or 0) for x in vocab.agg(F.sum("total"), F.sum("n")).first())

    def best(batches):
        for batch in batches:
            for h, c in zip(batch.column("h"), batch.column("c"), strict=True):
                h, c = _array(h), _array(c, np.int64)
                at = np.lexsort((h.view(np.int64), -c))[:frequent]
                yield pa.RecordBatch.from_pydict({"h": pa.array(X.signed(h[at])), "c": pa.array(c[at])})

    head = vocab.select("h", "c").mapInArrow(best, "h long, c long").orderBy(F.desc("c"), "h").limit(frequent).collect()
    top = np.sort(np.array([r["h"] for r in head], np.int64).view(X.U))
    if len(top):
        k, classed = _started(tmp, learning.select("text"), vocab, top, classes, parts)
        n_classes = 2 * k
    else:
        n_classes, classed = 1, Classed(spark.createDataFrame([], CLASSED), top, np.zeros(0, np.int64))
    least, before = -np.inf, None
    for turn in range(rounds if len(top) else 0):
        found, grid = _beside(tmp, learning.select("blk", "text"), asked, classed, n_classes, parts, f"beside-{turn}")
        if likelihood(grid) <= least:
            classed, before = before, None
            break
        least, before = likelihood(grid), classed
        classed = _moved(tmp, found, classed, grid, parts, f"classed-{turn}")
        tmp.drop(f"beside-{turn}", f"classed-{turn - 2}")
    coded, unseen, end_class = _coded(tmp, docs, asked, classed, n_classes, parts, (total, distinct_n), discount, "coded")

    narrow = _narrow(n_classes)

    def grams(batch):
        for part in _parts(batch):
            c, first = _classes(part, narrow)
            a, b = history(c, first, end_class)
            at = c >= 0
            yield (a[at] * n_classes + b[at]) * n_classes + c[at]

    def counted(coded: DataFrame) -> np.ndarray:
        return dense_sum(coded.where("learn").select("classes"), grams, n_classes**3).reshape((n_classes,) * 3)

    counts = counted(coded)
    if before is not None and likelihood(counts.sum(0)) <= least:
        coded, unseen, end_class = _coded(tmp, docs, asked, before, n_classes, parts, (total, distinct_n), discount, "coded-before")
        counts = counted(coded)
    tmp.drop("asked", "vocab", "classed", "classed-0", "classed-1")
    model = spark.sparkContext.broadcast(Transitions.of(counts, unseen) if total else None)
    kind = docs.schema["id"].dataType.simpleString()

    def final(batches):
        t = model.value
        for batch in batches:
            for part in _parts(batch):
                if t is None:
                    value = part.column("base_score")
                else:
                    c, first = _classes(part, narrow)
                    a, b = history(c, first, end_class)
                    p = np.where(c >= 0, t.known[a, b, np.maximum(c, 0)], t.unknown[a, b])
                    value = pa.array(np.add.reduceat(p, first[:-1]) + part.column("emit").to_numpy())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in NAMES[:4]), pa.array(np.full(part.num_rows, total, np.int64)), part.column("base_score"), value], [*NAMES[:4], "train_tokens", "base_score", "score"])

    return coded.mapInArrow(final, f"id {kind}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _started(tmp: Scratch, learning: DataFrame, vocab: DataFrame, top: np.ndarray, classes: int, parts: int) -> tuple[int, Classed]:
    """The number of classes of frequent words, and all words in classes: frequent ones by exchange, others by votes."""
    spark, m = learning.sparkSession, len(top)
    shared = spark.sparkContext.broadcast(top)

    def pairs(batch):
        for block in X.blocks([batch], "text"):
            h, first = tokens(block.column("text"))
            w = lookup(shared.value, np.arange(m), h, m)
            end = lookup(shared.value, np.arange(m), np.array([END]), m)[0]
            before = np.concatenate([[end], w[:-1]])
            before[first[:-1]] = end
            yield before * (m + 1) + w

    bigrams = dense_sum(learning, pairs, (m + 1) ** 2).reshape(m + 1, m + 1)
    cls = exchange(bigrams, classes)
    k = int(cls.max()) + 1
    vote = spark.sparkContext.broadcast((cls, votes(bigrams, cls)))

    def ballots(batches):
        own, best = vote.value
        every: list[np.ndarray] = [np.zeros(0, X.U), np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def emit():
            word, chosen, count = every
            part = (word % X.U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, *(x[order[a:b]] for x in (word, chosen, count))) for p, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int32()), "h": pa.array([r[1].tobytes() for r in rows], pa.binary()), "class": pa.array([r[2].astype(np.uint16).tobytes() for r in rows], pa.binary()), "n": pa.array([_pack(r[3]) for r in rows], pa.binary())})

        for block in X.blocks(batches, "text"):
            h, first = tokens(block.column("text"))
            c = lookup(shared.value, own, h, k)
            left, right = np.concatenate([[k], c[:-1]]), np.concatenate([c[1:], [k]])
            left[first[:-1]] = lookup(shared.value, own, np.array([END]), k)[0]
            tail = np.flatnonzero(c == k)
            more = (h[tail], best[left[tail], np.minimum(right[tail], k)], np.ones(len(tail), np.int64))
            every = [np.concatenate(x) for x in zip(every, more, strict=True)]
            if len(every[0]) > 1 << 21:
                every = list(_fold(*every))
                if len(every[0]) > 1 << 20:
                    yield emit()
                    every = [x[:0] for x in every]
        if len(every[0]):
            every = list(_fold(*every))
            yield emit()

    def cast(left: pa.Table, right: pa.Table) -> pa.Table:
        row = _row(left)
        h = _array(row["h"])
        cls = np.full(len(h), k, np.uint16)
        if right.num_rows:
            words = [_array(x) for x in right.column("h")]
            chosen = np.concatenate([_array(x, np.uint16) for x in right.column("class")]).astype(np.int64)
            word, chosen, n = _fold(np.concatenate(words), chosen, np.concatenate([_unpack(x, len(w)) for x, w in zip(right.column("n"), words, strict=True)]))
            order = np.lexsort((chosen, -n, word))
            new = np.flatnonzero(np.concatenate([[True], word[order][1:] != word[order][:-1]]))
            cls[np.searchsorted(h, word[order][new])] += chosen[order][new].astype(np.uint16)
        return pa.table({"part": left.column("part"), "h": left.column("h"), "c": left.column("c"), "class": pa.array([cls.tobytes()], pa.binary())})

    given = learning.mapInArrow(ballots, "part int, h binary, class binary, n binary")
    rows = tmp.cut(vocab.select("part", "h", "c").groupBy("part").cogroup(given.groupBy("part")).applyInArrow(cast, CLASSED), "classed")
    tmp.drop("vocab")
    shared.destroy()
    vote.destroy()
    return k, Classed(rows, top, cls)


def _answers(asked: DataFrame, classed: Classed, counts: bool, unknown: int) -> DataFrame:
    """To each block from each part, for its distinct words in order: their classes, and either counts or places in the part.

    Places are given for the words that the block learns from alone, as steps from one to the next.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = _row(right)
        h, c, cls = classed.of(row) if row else (np.zeros(0, X.U), np.zeros(0, np.int64), np.zeros(0, np.int64))
        out: list[list] = [[] for _ in range(5)]
        for blk, part, words, learnt in zip(*(left.column(x) for x in ("blk", "part", "h", "c")), strict=True):
            words = _array(words)
            if not counts:
                words = words[_unpack(learnt, len(words)) > 0]
                if not len(words):
                    continue
            at = np.minimum(np.searchsorted(h, words), max(len(h) - 1, 0))
            known = h[at] == words if len(h) else np.zeros(len(words), bool)
            x = (np.where(known, c[at], 0) if len(h) else np.zeros(len(words), np.int64)) if counts else np.diff(at, prepend=0)
            out[0].append(blk)
            out[1].append(part)
            out[2].append(len(words))
            out[3].append(_pack(np.where(known, cls[at], unknown) if len(h) else np.full(len(words), unknown)))
            out[4].append(_pack(x))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({name: pa.array([v.as_py() if isinstance(v, pa.Scalar) else v for v in x], t) for name, x, t in zip(("blk", "part", "many", "class", "x"), out, kinds, strict=True)})

    return asked.groupBy("part").cogroup(classed.rows.groupBy("part")).applyInArrow(run, "blk long, part int, many int, class binary, x binary")


def _beside(tmp: Scratch, learning: DataFrame, asked: DataFrame, classed: Classed, k: int, parts: int, name: str) -> tuple[DataFrame, np.ndarray]:
    """How often each word stands before (slot below k) and after each class, by block and part, and the class bigrams.

    The frequent words are a part of their own, the last, so that none of them stands for others.
    """
    top = classed.top

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows:
            block = Block(left.combine_chunks().to_batches(), parts)
            own, step = block.answer(right, "class", "x")
            first = block.first
            c = own[block.at]
            end = own[np.flatnonzero(block.words == END)[0]]
            before = np.concatenate([[0], c[:-1]])
            before[first[:-1]] = end
            # The end of a text stands before the first word of each.
            last = np.zeros(len(c), bool)
            last[first[1:] - 1] = True
            after = np.concatenate([c[1:], [0]])
            after[last] = c[first[:-1]]
            rows.append((-1, b"", b"", b"", np.bincount(before * k + c, minlength=k * k).astype(np.int64).tobytes(), 0))
            code, count = _runs(np.sort(np.concatenate([block.at * (2 * k) + after, block.at * (2 * k) + k + before])))
            word, slot = code // (2 * k), (code % (2 * k)).astype(np.int16)
            frequent = lookup(top, np.arange(len(top)), block.words, -1)
            apart = frequent[word] >= 0
            for p, (a, b) in enumerate([*zip(block.edge[:-1], block.edge[1:], strict=True), (0, len(block.words))]):
                at = slice(*np.searchsorted(word, [a, b])) if p < parts else slice(None)
                mine = apart[at] == (p == parts)
                u, n = _runs(word[at][mine])
                if len(u):
                    # Words are in order of their part and place.
                    place = frequent[u] if p == parts else np.diff(np.cumsum(step[a:b])[u - a], prepend=0)
                    rows.append((p, _pack(place), _pack(n), _pack(slot[at][mine]), _pack(count[at][mine]), len(u)))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(("part", "place", "many", "slot", "n", "words"), kinds, strict=True))})

    def grids(batches):
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for x in batch.column("n"):
                total += _array(x, np.int64)
        yield pa.RecordBatch.from_pydict({"n": [total.tobytes()]})

    answers = _answers(asked, classed, False, 0)
    found = learning.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(contexts, "part int, place binary, many binary, slot binary, n binary, words int")
    found = tmp.cut(found, name)
    tmp.sweep()
    sums = found.where("part < 0").select("n").mapInArrow(grids, "n binary").collect()
    return found.where("part >= 0"), sum(np.frombuffer(r["n"], np.int64) for r in sums).reshape(k, k)


def _moved(tmp: Scratch, found: DataFrame, classed: Classed, grid: np.ndarray, parts: int, name: str) -> Classed:
    """All words after one round of exchange by what ``found`` says of them."""
    k = len(grid)
    shared = found.sparkSession.sparkContext.broadcast(grid)

    def move(left: pa.Table, right: pa.Table) -> pa.Table:
        row = _row(right)
        p = (left if left.num_rows else right).column("part")[0].as_py()
        if row:
            h, c, own = classed.of(row)
        else:
            h, c, own = classed.top, np.zeros(0, np.int64), classed.own
        code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for place, many, slot, n, words in zip(*(left.column(x) for x in ("place", "many", "slot", "n", "words")), strict=True):
            at, many = _unpack(place, words.as_py()), _unpack(many, words.as_py())
            at = np.repeat(at if p == parts else np.cumsum(at), many)
            waiting.append((at * (2 * k) + _unpack(slot, len(at)), _unpack(n, len(at))))
            size += len(at)
            if size > 1 << 21:
                code, count = _sum(*(np.concatenate(x) for x in zip((code, count), *waiting, strict=True)))
                waiting, size = [], 0
        code, count = _sum(*(np.concatenate(x) for x in zip((code, count), *waiting, strict=True)))
        if len(code):
            word = code // (2 * k)
            used = np.unique(word)
            first = np.searchsorted(word, np.append(used, used[-1] + 1))
            own = own.copy()
            own[used] = moves(shared.value, own[used], first, code % (2 * k), count, parts if p < parts else 1)
        return pa.table({"part": pa.array([p], pa.int32()), "h": pa.array([h.tobytes()], pa.binary()), "c": pa.array([c.tobytes()], pa.binary()), "class": pa.array([own.astype(np.uint16).tobytes()], pa.binary())})

    rows = tmp.cut(found.groupBy("part").cogroup(classed.rows.where(F.col("part") < parts).groupBy("part")).applyInArrow(move, CLASSED), name)
    shared.destroy()
    own = rows.where(F.col("part") == parts).select("class").first()
    return Classed(rows.where(F.col("part") < parts), classed.top, np.frombuffer(own["class"], np.uint16).astype(np.int64) if own else classed.own)


NAMES = ["id", "learn", "n_tokens", "n_known", "base_score", "emit", "classes"]


def _coded(tmp: Scratch, docs: DataFrame, asked: DataFrame, classed: Classed, n_classes: int, parts: int, totals: tuple[int, int], discount: float, name: str) -> tuple[DataFrame, np.ndarray, int]:
    """Documents as classes with their base and emission scores; each class's mass for the unknown type; the class of the end."""
    spark = docs.sparkSession

    def masses(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h, c, cls = classed.of({x: batch.column(x)[i] for x in ("h", "c", "class")})
                end = np.flatnonzero(h == END)
                yield pa.RecordBatch.from_pydict({"mass": [np.bincount(cls, c, n_classes).tobytes()], "kinds": [np.bincount(cls, minlength=n_classes).astype(float).tobytes()], "end": pa.array([int(cls[end[0]]) if len(end) else None], pa.int32())})

    def added(batches):
        mass, kinds, end = np.zeros(n_classes), np.zeros(n_classes), None
        for batch in batches:
            for a, b, e in zip(*(batch.column(x) for x in ("mass", "kinds", "end")), strict=True):
                mass, kinds, end = mass + _array(a, float), kinds + _array(b, float), e.as_py() if e.is_valid else end
        yield pa.RecordBatch.from_pydict({"mass": [mass.tobytes()], "kinds": [kinds.tobytes()], "end": pa.array([end], pa.int32())})

    spec = "mass binary, kinds binary, end int"
    sums = classed.rows.mapInArrow(lambda batches: added(masses(batches)), spec).collect()
    mass, kinds = (sum((np.frombuffer(r[x], float) for r in sums), np.zeros(n_classes)) for x in ("mass", "kinds"))
    end_class = next((r["end"] for r in sums if r["end"] is not None), 0)
    unseen = discount * kinds / np.maximum(mass, 1)
    log_mass = np.log10(np.maximum(mass, 1))
    narrow = _narrow(n_classes)
    unknown = int(np.iinfo(narrow).max)
    total, distinct_n = totals
    kind = docs.schema["id"].dataType.simpleString()

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.combine_chunks().to_batches(), parts)
        own, count = block.answer(right, "class", "x")
        first = block.first
        cls, c = own[block.at], count[block.at]
        add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every row has an end
        emit = np.where(c > 0, np.log10(np.maximum(c - discount, 1e-9)) - log_mass[np.where(c > 0, cls, 0)], 0.0)
        base = np.log10((c + 1) / (total + distinct_n + 1))
        cls = cls.astype(narrow)
        return pa.Table.from_arrays([left.column("id"), left.column("learn"), pa.array(np.diff(first)), pa.array(add((c > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(emit)), pa.array([cls[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], NAMES)

    answers = _answers(asked, classed, True, unknown)
    coded = docs.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(code, f"id {kind}, learn boolean, n_tokens long, n_known long, base_score double, emit double, classes binary")
    coded = tmp.cut(coded, name)
    tmp.sweep()
    return coded, unseen, end_class


def _runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of sorted ones and how often each comes."""
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))[: len(code)]
    return code[new], np.diff(np.append(new, len(code)))


def _sum(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the sums of their counts."""
    order = np.argsort(code)
    code, count = code[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))[: len(code)]
    return code[new], np.add.reduceat(count, new) if len(new) else count


def _fold(word: np.ndarray, chosen: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of word and class in order, and the sums of their counts."""
    words, at = np.unique(word, return_inverse=True)
    width = int(chosen.max()) + 1 if len(chosen) else 1
    code, count = _sum(at * width + chosen, count)
    return words[code // width], code % width, count


def _parts(batch: pa.RecordBatch, rows: int = 2000):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _narrow(n_classes: int) -> type:
    """What holds a class of a token; the largest number stands for an unknown word."""
    return np.uint8 if n_classes < 255 else np.uint16


def _classes(part: pa.RecordBatch, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the tokens of rows, -1 for unknown words, and where rows begin."""
    own = [_array(x, kind) for x in part.column("classes")]
    flat = np.concatenate(own).astype(np.int64)
    flat[flat == np.iinfo(kind).max] = -1
    return flat, np.concatenate([[0], np.cumsum([len(x) for x in own])])


def op3_class_lm(spark, sf_dir: str) -> DataFrame:
    """log10 probabilities of all ``documents``, learnt from those whose part of seven is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    found = score(docs, F.coalesce(part != 2, F.lit(True)))
    return found.select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
