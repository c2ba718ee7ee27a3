"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its distinct k-word shingles. One global order puts
rare shingles first: those last whose hash bucket stands out of the mean of all, then
by the frequencies of their words, from tables of fixed size over hash buckets that count
every shingle and word of every document, then by the hash. Any two sets with Jaccard of at least t share a
shingle among the first n - ceil(t n) + 1 of either, so only these prefixes
are joined. Equal sets are folded before the join and unfolded after it.

Lists are split by set size first, so that the length filter holds before any
pair is made. A posting list isn't expanded into its pairs: each round compares
some heads of a list with its other members, one in the first round, then of those that aren't of
the list's largest component, a number that grows eightfold; a pair that
shares one of the few lists before as well waits for that one, and of a head's pairs with the
members of one component the nearest is verified first, the others if it is no link. Links found join components, and only lists that still hold
more than one component go on, without their heads, until none is left. Long
lists that outlive two rounds hold texts that are unlike but for a common
shingle. Similar sets share two shingles of prefixes longer by one, so such a
list is split by every other shingle of these.
Every pair of a posting list is thus either compared, already known to be
connected, or in a list of two shingles, so the components are those of all links.

What passes the length and positional filters meets the suffix filter: whether
counts of the sets by bits of their shingles are odd. Each count that is odd in
one set alone bounds the difference of the sets from below. A set has two counts
or more a shingle, so the bound is near the difference at any length; after the
first round a few counts are looked at in the join itself. Only then are whole
sets made, of the documents in such pairs alone, and each pair is verified once.

Nulls: a null text is an empty one; a null id is left out of the join and has
no component of its own (null). Empty sets link with nothing. Rows of one id
are one document, linked with whatever one of its texts is linked with, and
give a row each. Other columns of the input are ignored. Empty tables give
empty results. Texts of any length are taken whole, one that is longer than a
block of work alone. Ties of shingles are ordered by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as X
from .components import components
from .scratch import Scratch, small_batches
from .sieve import sieve, sifted
from .sums import dense_sum

#: Buckets of the tables of word and shingle frequencies, 2 bytes each: their size is fixed whatever the input.
BUCKET_BITS = 22
#: Whether counts of a set by the top bits of its shingles are odd, as the join itself looks at them.
ODD_BITS = 8
ODD = [f"odd{i}" for i in range((1 << ODD_BITS) // 64)]
#: Heads of a list in the second round, and how many times more in each after it.
HEADS, MORE = 16, 8
#: Members beside the largest component beyond which a list is split by a second shingle after two rounds.
SPLIT = 1 << 14
#: Live lists before the one at hand that a pair may share.
BEFORE = 4
#: Rows passed to a Python worker at once: a row is a text, or a pair with both its sets.
BATCH = 1000


def _sets(block: pa.RecordBatch, column: str, k: int) -> Iterator[np.ndarray]:
    words = X.Words(block.column(column))
    hashes = words.hashes()
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        yield np.unique(X.shingles(hashes[a:b], k))


def _ranked(block: pa.RecordBatch, column: str, k: int, rank: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sets with how common their shingles are: first by what stands out of the shingles' buckets, then by the sum of their words' log frequencies."""
    words = X.Words(block.column(column))
    hashes = words.hashes()
    common = rank[(hashes >> X.U(64 - bits)).astype(np.int64)].astype(np.int32)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        s, at = np.unique(X.shingles(hashes[a:b], k), return_index=True)
        width = min(k, b - a)
        total = np.concatenate([[0], np.cumsum(common[a:b])])
        yield s, rank[(1 << bits) + (s >> X.U(64 - bits)).astype(np.int64)].astype(np.int32) * (1 << 16) + total[at + width] - total[at]


def _frequencies(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """16 times the logarithm to base 2 of how often words of a hash bucket occur, and then of shingles, over all documents.

    A bucket of shingles holds many of them; only by how much it exceeds four times the mean counts.
    """

    def codes(batch):
        for block in X.blocks([batch], "text"):
            words = X.Words(block.column("text"))
            h = words.hashes()
            yield (h >> X.U(64 - bits)).astype(np.int64)
            many = [X.shingles(h[a:b], k) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield (1 << bits) + (np.concatenate(many) >> X.U(64 - bits)).astype(np.int64)

    out = dense_sum(docs.select("text"), codes, 2 << bits, final=lambda n: np.round(16 * np.log2(n + 1.0)).astype(np.int16))
    held = out[1 << bits :]
    kinds, n = np.unique(held, return_counts=True)
    mean = float((n * (2.0 ** (kinds / 16) - 1)).sum() / len(held))
    held -= np.int16(round(16 * np.log2(4 * max(mean, 1))))
    np.maximum(held, 0, out=held)
    return out


def least(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with a set of any size that a set of n needs: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def _sketch(s: np.ndarray) -> bytes:
    """Whether a set's counts by the low bits of its shingles are odd, in two bits a shingle or more, a power of two of them."""
    size = 1 << max(6, int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & X.U(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def _differ(x: pa.Array, y: pa.Array) -> np.ndarray:
    """The least by which the sets of two sketches differ, row by row: the larger sketch is folded to the size of the other."""
    (data, first), (other, second) = X.raw(x), X.raw(y)
    size = np.stack([np.diff(first), np.diff(second)], 1)
    out = np.zeros(len(size), np.int64)
    for own in np.unique(size, axis=0):
        rows = np.flatnonzero((size == own).all(1))
        u, v = (d[at[:-1][rows][:, None] + np.arange(n)] for d, at, n in ((data, first, own[0]), (other, second, own[1])))
        while u.shape[1] != v.shape[1]:
            u, v = (u, v) if u.shape[1] > v.shape[1] else (v, u)
            half = u.shape[1] // 2
            u = u[:, :half] ^ u[:, half:]
        out[rows] = np.bitwise_count(u ^ v).sum(1, dtype=np.int64)
    return out


def _signatures(docs: DataFrame, freq, k: int, percent: int, bits: int) -> DataFrame:
    """Of each row the set's size, two hashes, a sketch, odd counts, and the prefix with one shingle more, rarest first."""

    def run(batches):
        rank = freq.value
        for block in X.blocks(batches, "text"):
            rows: dict[str, list] = {"n": [], "fp": [], "fp2": [], "sketch": [], "prefix": []}
            odd = []
            for s, f in _ranked(block, "text", k, rank, bits):
                n = len(s)
                width = min(n, int(n - least(np.int64(n), percent) + 2))
                near = np.argpartition(f, width - 1) if 0 < width < n else np.arange(n)
                if n:
                    edge = f[near[width - 1]]
                    near = np.flatnonzero(f <= edge)  # ties at the edge are ordered by hash
                order = near[np.lexsort((s[near], f[near]))][:width]
                rows["n"].append(n)
                rows["fp"].append(int(X.signed(np.bitwise_xor.reduce(X.mix(s), keepdims=True))[0]) if n else None)
                rows["fp2"].append(int(X.signed(np.add.reduce(X.mix(s ^ X.U(0x5BD1E995)), keepdims=True))[0]) if n else None)
                rows["sketch"].append(_sketch(s) if n else None)
                rows["prefix"].append(X.signed(s[order]))
                odd.append(np.packbits(np.bincount((s >> X.U(64 - ODD_BITS)).astype(np.int64), minlength=1 << ODD_BITS).astype(np.uint8) & 1).view(np.int64))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            odds = [pa.array(np.ascontiguousarray(c)) for c in np.array(odd, np.int64).reshape(-1, len(ODD)).T]
            yield pa.RecordBatch.from_arrays([block.column("id").cast(pa.int64()), *(pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)), *odds], ["id", *rows, *ODD])

    return docs.mapInArrow(run, "id long, n long, fp long, fp2 long, sketch binary, prefix array<long>, " + ", ".join(f"{c} long" for c in ODD))


def _alpha(n, m, percent: int):
    """The intersection that sets of n and m need: ceil(percent (n + m) / (100 + percent))."""
    return F.floor((percent * (n + m) + 99 + percent) / F.lit(100 + percent)).cast("long")


def _near(percent: int):
    """Length and positional filter on rows with n, at and h_n, h_at.

    Of a pair's rows the one of its first common shingle counts: nothing before it is shared, so all of the
    intersection is from there on. Rows of later shingles may pass or not.
    """
    length = (F.col("n") * 100 >= F.col("h_n") * percent) & (F.col("h_n") * 100 >= F.col("n") * percent)
    return length & (F.least(F.col("n") - F.col("at"), F.col("h_n") - F.col("h_at")) >= _alpha(F.col("n"), F.col("h_n"), percent))


def _first():
    """That a pair shares none of the few live lists before this one as well, in which it is compared.

    Of a pair's live lists the first one always passes, so it is compared there, at the latest when one of both
    is a head of it. Copies share most of their lists in long runs, with gaps where they differ, and are compared once a run.
    """
    return F.coalesce(~F.arrays_overlap("before", "h_before"), F.lit(True))


def _apart():
    """How many counts by part are odd in one set alone: each stands for a shingle that one has alone."""
    return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"h_{c}"))) for c in ODD), F.lit(0))


def _even(percent: int):
    """Suffix filter on rows with odd counts by part."""
    return _apart() <= F.col("n") + F.col("h_n") - 2 * _alpha(F.col("n"), F.col("h_n"), percent)


def _suffix(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches differ by no more than similar sets can."""

    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            alpha = -(-percent * n // (100 + percent))
            yield batch.select(["a", "b"]).filter(pa.array(_differ(batch.column("x"), batch.column("y")) <= n - 2 * alpha))
        X.release()

    x, y = (sketches.select(F.col("id").alias(i), F.col("n").alias(n), F.col("sketch").alias(s)) for i, n, s in (("a", "n", "x"), ("b", "m", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """The ids of pairs (a, b), as often as they occur."""
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))


def _sifted(rows: DataFrame, bits) -> DataFrame:
    """The rows whose id passes a sieve that was broadcast."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(sifted(bits.value, batch.column("id").to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, each computed once."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        X.release()

    x, y = (sets.select(F.col("id").alias(i), F.col("s").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _contracted(labels: DataFrame | None, found: DataFrame, tmp: Scratch, turn: str) -> DataFrame:
    """Labels (id, component_id) of all linked so far: the links just found join the components there are."""
    if labels is None:
        return components(found, tmp, f"cc-{turn}")
    if found.isEmpty():
        return labels
    ends = found.select(F.col("a").alias("id")).union(found.select(F.col("b").alias("id"))).distinct()
    known = labels.union(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("component_id")))
    known = tmp.cut(known, f"known-{turn}")
    a, b = (known.select(F.col("id").alias(i), F.col("component_id").alias(c)) for i, c in (("a", "x"), ("b", "y")))
    merged = components(found.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")), tmp, f"cc-{turn}")
    merged = merged.select(F.col("id").alias("component_id"), F.col("component_id").alias("new"))
    return tmp.cut(known.join(merged, "component_id", "left").select("id", F.coalesce("new", "component_id").alias("component_id")), f"labels-{turn}")


def _alive(lists: DataFrame) -> DataFrame:
    """The members of lists that hold more than one component, with their list's largest one and how many members are of others."""
    each = lists.groupBy("token", "component_id").agg(F.count("*").alias("k"))
    state = each.groupBy("token").agg(F.max_by("component_id", F.struct("k", "component_id")).alias("largest"), (F.sum("k") - F.max("k")).alias("others"))
    return lists.join(state.where("others > 0"), "token")


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bits: int = BUCKET_BITS, split: int = SPLIT) -> DataFrame:
    """Documents whose k-word shingle sets have a Jaccard similarity of percent/100 or more, as components.

    Returns id, n_shingles, component_id (the smallest id reachable by links;
    its own without links) and n_copies (documents with an equal set, itself
    included; 0 for an empty set).
    """
    with small_batches(docs.sparkSession, BATCH):
        return _similar(docs, id_col, text_col, k, percent, bits, split)


def _similar(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, bits: int, split: int) -> DataFrame:
    """``similar``, whose jobs with Python in them all run before it returns."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "ngram")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    freq = spark.sparkContext.broadcast(_frequencies(docs, k, bits))
    tmp.sweep()
    wide = tmp.cut(_signatures(docs, freq, k, percent, bits), "wide")
    freq.destroy()
    sig = tmp.cut(wide.select("id", "n", "fp", "fp2"), "sig")
    keyed = wide.where("id is not null and n > 0")
    folded = keyed.groupBy("fp", "fp2").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.count("*").alias("n_copies"), F.min_by(F.struct("sketch", "prefix", *ODD), "id").alias("x"))
    folded = tmp.cut(folded.select("id", "n", "fp", "fp2", "n_copies", "x.*"), "folded")
    tmp.drop("wide")

    # Ids with more than one text join the copies of all of them.
    several = sig.where("id is not null and n > 0").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.min("fp2").alias("lo2"), F.max("fp2").alias("hi2"))
    several = several.where("lo <> hi or lo2 <> hi2").select("id")
    same_id = tmp.cut(sig.join(several, "id").join(folded.select("fp", "fp2", F.col("id").alias("b")), ["fp", "fp2"]).select(F.col("id").alias("a"), "b").distinct(), "same_id")

    post = folded.select("id", "n", F.posexplode("prefix").alias("at", "token")).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100))
    often = post.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    post = tmp.cut(post.join(often.select("token").hint("merge"), "token"), "often")
    tmp.sweep()
    # Similar sets differ in size by one step of a geometric scale at most: a list is one step and the next.
    step = F.floor(F.log(F.col("n")) / math.log(100 / percent * 1.0001)).cast("int") if percent < 100 else F.col("n").cast("int")
    post = post.select("id", "n", "at", F.col("token").alias("shingle"), F.explode(F.array(step, step - 1)).alias("step"))
    post = post.withColumn("token", F.xxhash64("shingle", "step")).withColumn("component_id", F.col("id"))
    # At first every member is a component of its own.
    shared = post.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    live = tmp.cut(post.join(shared, "token"), "live-0")
    tmp.drop("often")

    def verified(pairs: DataFrame, turn: str) -> DataFrame:
        """Of pairs (id, h_id) the links (a, b)."""
        pairs = tmp.cut(pairs.select(F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b")).distinct(), f"some-{turn}")
        if pairs.isEmpty():
            return pairs
        bits = spark.sparkContext.broadcast(sieve(_ends(pairs)))
        sketches = _sifted(folded.select("id", "n", "sketch"), bits)
        pairs = tmp.cut(_suffix(pairs, sketches, percent), f"pairs-{turn}")
        bits.destroy()
        tmp.drop(f"some-{turn}")
        if pairs.isEmpty():
            return pairs
        wanted = tmp.cut(_ends(pairs).distinct(), f"wanted-{turn}")
        bits = spark.sparkContext.broadcast(sieve(wanted))

        def make(batches):
            some = (batch.filter(pa.array(sifted(bits.value, batch.column("id").to_numpy()))) for batch in batches)
            for block in X.blocks(some, "text"):
                yield pa.RecordBatch.from_arrays([block.column("id"), pa.array([s.tobytes() for s in _sets(block, "text", k)], pa.binary())], ["id", "s"])

        sets = docs.where("id is not null").mapInArrow(make, "id long, s binary").join(wanted, "id", "left_semi")
        found = tmp.cut(_verify(pairs, tmp.cut(sets, f"sets-{turn}"), percent), f"found-{turn}")
        bits.destroy()
        tmp.drop(f"sets-{turn}", f"pairs-{turn}", f"wanted-{turn}")
        return found

    labels, turn = None, 0
    while turn == 0 or not live.isEmpty():
        if turn == 2:
            live = tmp.cut(_split(live, folded, split), "split")
        if turn == 0:
            first = live.groupBy("token").agg(F.min(F.struct(F.xxhash64("id").alias("o"), "id", "n", "at", "component_id")).alias("h"))
            head = tmp.cut(first.select("token", *(F.col(f"h.{c}").alias(f"h_{c}") for c in ("id", "n", "at", "component_id"))), "head-0")
            rest = live.join(head.select("token", "h_id"), "token").where("id <> h_id").drop("h_id")
        else:
            # All but the members of the largest component, as soon as they are few: then nothing of the list is left.
            chosen = (F.col("component_id") != F.col("largest")) & (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 31)) * F.col("others") < F.lit(HEADS * MORE ** (turn - 1) << 31))
            head = live.where(chosen).select("token", *(F.col(c).alias(f"h_{c}") for c in ("id", "n", "at", "component_id", "before", *ODD)))
            rest = live.where(~chosen)
        pairs = live.join(head, "token").where("id <> h_id and component_id <> h_component_id").where(_near(percent) & _even(percent) & _first() if turn else _near(percent))
        if turn == 0:
            labels = _contracted(None, verified(pairs, "0").union(same_id), tmp, "0")
        else:
            # The nearest member of each component first: one link joins a head with all of them.
            near = tmp.cut(pairs.select("id", "h_id", "component_id", "h_component_id", _apart().alias("apart")).distinct(), f"near-{turn}")
            best = near.groupBy("h_id", "component_id", "h_component_id").agg(F.min_by("id", F.struct("apart", "id")).alias("id"))
            labels = _contracted(labels, verified(best, f"{turn}a"), tmp, f"{turn}a")
            own, other = (labels.select(F.col("id").alias(i), F.col("component_id").alias(c)) for i, c in (("id", "x"), ("h_id", "y")))
            apart = near.select("id", "h_id").join(own, "id", "left").join(other, "h_id", "left").where(F.coalesce("x", "id") != F.coalesce("y", "h_id"))
            apart = apart.join(best.select("id", "h_id"), ["id", "h_id"], "left_anti")
            labels = _contracted(labels, verified(apart, f"{turn}b"), tmp, f"{turn}b")
        turn += 1
        rest = rest.drop("component_id", "largest", "others", "before").join(labels, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
        rest = _alive(rest)
        row = Window.partitionBy("id", "step").orderBy("at", "token")
        rest = rest.withColumn("before", F.array(*(F.lag("token", i).over(row) for i in range(1, BEFORE + 1))))
        live = tmp.cut(rest.join(folded.select("id", *ODD), "id") if turn == 1 else rest, f"live-{turn}")
        tmp.drop(f"live-{turn - 1}", "head-0", "split", f"near-{turn - 1}", "found-0", f"found-{turn - 1}a", f"found-{turn - 1}b")

    # A chain of folded sets: the component of the representative, which is the smallest id of its copies.
    named = folded.select(F.col("id").alias("rep"), "fp", "fp2", "n_copies").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("fp", "fp2", "n_copies", F.coalesce("component_id", "rep").alias("component_id"))
    out = sig.join(named, ["fp", "fp2"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))


def _split(live: DataFrame, folded: DataFrame, split: int) -> DataFrame:
    """Lists with more than ``split`` members beside the largest component, as lists of two shingles: similar sets share a second one in prefixes longer by one."""
    many = live.where(F.col("others") > split).drop("largest", "others")
    many = many.join(folded.select("id", F.explode("prefix").alias("second")), "id").where("second <> shingle")
    many = _alive(many.withColumn("token", F.xxhash64("token", "second")).withColumn("before", F.lit(None).cast("array<long>")).drop("second"))
    return live.where(F.col("others") <= split).unionByName(many)


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of ``documents`` whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = similar(docs, k=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
