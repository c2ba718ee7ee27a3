"""Toxicity by a linear-chain conditional random field over words.

Tags are O and T (toxic). Emissions are weights of hashed features: the word
and its first four to eight bytes, so that inflected forms share a weight.
Only documents are labelled, so tokens are labelled from them: in a toxic
document, words with a feature that toxic documents hold far more often than
others; elsewhere none. The field is trained on these tags, tags the toxic
documents again, and is trained on its own tags. Forward-backward marginals
give offending spans, and a logistic model of what they hold beyond the
marginal of a word the field knows nothing of, fitted on documents it wasn't
trained on, gives the document's score: unknown words don't add up in long texts.

The fit uses a bounded sample of the labelled documents: of each label the
first by a hash of their ids, at most ``sample`` documents and ``sample_bytes``
of text, on one executor. Scoring reads every whole text and nothing but the text.

Nulls: a null text is an empty one; an empty text gets the score of a text
without toxic words. Rows with a null id are scored and never learnt from.
Repeated rows are scored each. Without labels of both kinds every score is
the share of label 1 (0 without any). Other columns are ignored; empty tables
give empty results. Very long texts are scored whole.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

BITS, PREFIXES = 18, (4, 5, 6, 7, 8)
#: Words of a training sequence: longer texts are trained on as several, and scored as one.
SEQUENCE = 256
SAMPLE, SAMPLE_BYTES = 2000, 4 << 20
#: Documents of this score or more are called toxic.
TOXIC = 0.3


def features(words: X.Words) -> np.ndarray:
    """A row of table places for each word; a prefix longer than the word is place 0, whose weight stays 0."""
    size = words.end - words.start
    out = np.zeros((1 + len(PREFIXES), len(size)), np.int32)
    out[0] = words.hashes() >> X.U(64 - BITS)
    for row, n in zip(out[1:], PREFIXES, strict=True):
        at = np.flatnonzero(size >= n)
        row[at] = X.mix(words.span_hash(words.start[at], words.start[at] + n) + X.U(n)) >> X.U(64 - BITS)
    return out


def _total(weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word, a feature at a time."""
    out = np.zeros(f.shape[1])
    for row in f:
        out += weights[row]
    return out


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    start: float
    trans: np.ndarray  # log potentials, from row to column; O, T

    def emissions(self, f: np.ndarray) -> np.ndarray:
        return np.clip(_total(self.weights, f) + self.bias, -30, 30)

    def odds(self, em: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """exp(em), and the odds of T to O in the forward and the backward messages of each word."""
        e, a = np.exp(em), np.exp(self.trans)
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, size = first[:-1][order], size[order]
        live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # rows longer than t
        fwd, back = np.ones(len(em)), np.ones(len(em))
        r = None
        for t, n in enumerate(live.tolist()):
            at = begin[:n] + t
            r = e[at] * (np.exp(self.start) if r is None else (a[0, 1] + r[:n] * a[1, 1]) / (a[0, 0] + r[:n] * a[1, 0]))
            fwd[at] = r
        b = np.zeros(0)
        for t in range(len(live) - 1, 0, -1):
            n = int(live[t])
            at = begin[:n] + t
            b = np.concatenate([b, np.ones(n - len(b))])
            x = e[at] * b
            b = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
            back[at - 1] = b
        return e, fwd, back

    def marginals(self, em: np.ndarray, first: np.ndarray) -> np.ndarray:
        _, fwd, back = self.odds(em, first)
        x = fwd * back
        return x / (1 + x)

    def unknown(self) -> float:
        """The marginal of a word without known features among others of the kind."""
        return float(self.marginals(np.full(65, self.bias), np.array([0, 65]))[32])

    def beyond(self, p: np.ndarray) -> np.ndarray:
        """Of marginals what they exceed that of an unknown word by, from 0 to 1."""
        least = self.unknown()
        return np.maximum(p - least, 0) / max(1 - least, 1e-12)


def train_field(f: np.ndarray, first: np.ndarray, tags: np.ndarray, steps: int = 30, l2: float = 0.02) -> Field:
    """Maximum conditional likelihood by Adam over all documents at once."""
    field = Field(np.zeros(1 << BITS), -4.0, 0.0, np.zeros((2, 2)))
    inner = np.ones(len(tags), bool)
    inner[first[:-1][first[:-1] < len(tags)]] = False
    pair = np.flatnonzero(inner)
    gold = np.bincount(tags[pair - 1] * 2 + tags[pair], minlength=4).reshape(2, 2)
    held = np.zeros(1 << BITS, bool)
    held[f] = True
    used = np.flatnonzero(held)
    place = (np.cumsum(held, dtype=np.int32) - 1)[f]
    del f, held
    w = np.zeros(len(used))
    state = [np.zeros(len(used) + 6) for _ in range(2)]
    heads = first[:-1][np.diff(first) > 0]
    for step in range(1, steps + 1):
        em = np.clip(_total(w, place) + field.bias, -30, 30)
        e, fwd, back = field.odds(em, first)
        p = fwd * back / (1 + fwd * back)
        a, x = np.exp(field.trans), e[pair] * back[pair]
        r = fwd[pair - 1]
        del e, fwd, back
        parts = (np.full(len(pair), a[0, 0]), a[0, 1] * x, a[1, 0] * r, a[1, 1] * r * x)
        del x, r
        total = parts[0] + parts[1]
        total += parts[2]
        total += parts[3]
        joint = np.array([np.divide(y, total, out=y).sum() for y in parts]).reshape(2, 2)
        del parts, total
        miss = tags - p
        grad = sum(np.bincount(row, miss, len(used)) for row in place) - l2 * w
        grad = np.concatenate([grad, [miss.sum(), miss[heads].sum()], (gold - joint).ravel() - l2 * field.trans.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad * grad
        move = 0.3 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-6)
        w += move[: len(used)]
        w[used == 0] = 0
        field.bias += 0.3 * move[-6]
        field.start += move[-5]
        field.trans = field.trans + 0.3 * move[-4:].reshape(2, 2)
    field.weights[used] = w
    return field


@dataclass
class Model:
    field: Field | None
    logit: np.ndarray
    prior: float

    def score(self, words: X.Words) -> tuple[np.ndarray, np.ndarray]:
        """Document scores and the marginal of each word."""
        n = len(words.first) - 1
        if self.field is None:
            return np.full(n, self.prior), np.zeros(len(words.start))
        p = self.field.marginals(self.field.emissions(features(words)), words.first)
        return 1 / (1 + np.exp(-(_summary(self.field.beyond(p), words.first) @ self.logit))), p


def _summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document: 1, the chance of any toxic word, the log of their expected number, their share."""
    total = np.concatenate([[0], np.cumsum(p)])
    none = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
    count = total[first[1:]] - total[first[:-1]]
    return np.stack([np.ones(len(count)), 1 - np.exp(none[first[1:]] - none[first[:-1]]), np.log1p(count), 10 * count / (np.diff(first) + 20)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (weight * (y - p)) - l2 * w)
    return w


def fit(texts: list[str], labels: np.ndarray, share: float, rounds: int = 2) -> Model:
    """``share`` is that of label 1 among all rows; texts may hold more of it."""
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Model(None, np.zeros(4), share)
    parts, first = [], [np.zeros(1, np.int64)]
    for block in X.blocks([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())})], "text"):
        words = X.Words(block.column("text"), X.ALNUM)
        parts.append(features(words))
        first.append(words.first[1:] + first[-1][-1])
    f, first = np.concatenate(parts, 1), np.concatenate(first)
    del parts, words
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    part = (X.mix(np.arange(len(texts), dtype=X.U)) % X.U(4)).astype(int)
    learn = part > 0
    if labels[learn].min() == labels[learn].max() or labels[~learn].sum() == 0:
        learn = np.ones(len(labels), bool)
    _, same = np.unique([hash(t) for t in texts], return_inverse=True)
    held = np.zeros((2, 1 << BITS))
    for row in f:
        for y in (0, 1):
            at = (labels[doc] == y) & learn[doc]
            pairs = np.unique(same[doc[at]].astype(np.int64) << BITS | row[at])
            held[y] += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
    n = [max(1, len(np.unique(same[(labels == y) & learn]))) for y in (0, 1)]
    rate = [(held[y] + 0.2) / (n[y] + 0.4) for y in (0, 1)]
    strong = (held[1] >= max(3, 0.004 * n[1])) & (rate[1] >= 8 * rate[0])
    strong[0] = False
    tags = (strong[f].any(0) & (labels[doc] == 1)).astype(np.int64)
    keep = learn[doc]
    size = np.where(learn, np.diff(first), 0)
    own = np.concatenate([[0], np.cumsum(size[learn])])
    own = np.unique(np.concatenate([own, *(np.arange(a, b, SEQUENCE) for a, b in zip(own[:-1], own[1:], strict=True))]))
    field = None
    for k in range(rounds):
        field = train_field(f[:, keep], own, tags[keep])
        if k + 1 < rounds:
            p = field.marginals(field.emissions(f), first)
            tags = ((p > 0.5) & (labels[doc] == 1)).astype(np.int64)
    p = field.marginals(field.emissions(f), first)
    test = ~learn if (~learn).any() else learn
    base = labels[test].mean()
    weight = np.where(labels[test] == 1, share / max(base, 1e-9), (1 - share) / max(1 - base, 1e-9))
    model = Model(field, _logistic(_summary(field.beyond(p), first)[test], labels[test], weight), share)
    del f, doc, tags, keep, p, at, pairs, row, block
    X.release()
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled documents; restrict ``labels`` to the rows to learn from."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not count:
        return Model(None, np.zeros(4), 0.0)
    order = F.xxhash64("i")
    chosen = {r["i"]: (r["o"], r["y"]) for y in count for r in known.where(F.col("y") == y).select("i", "y", order.alias("o")).distinct().orderBy("o", "i").limit(sample).collect()}
    spark = docs.sparkSession
    pick = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "i long"))  # at most two samples of ids
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(pick, "i")
    sizes = rows.groupBy("i").agg(F.max(F.octet_length("t")).alias("n")).collect()
    room, take = dict.fromkeys(count, sample_bytes), set()
    for r in sorted(sizes, key=lambda r: (chosen[r["i"]][0], r["i"])):
        y = chosen[r["i"]][1]
        if r["n"] <= room[y]:
            room[y] -= r["n"]
            take.add(r["i"])
    if not take:
        return Model(None, np.zeros(4), count.get(1, 0) / sum(count.values()))
    pick = F.broadcast(spark.createDataFrame([(i, chosen[i][1]) for i in take], "i long, y int"))
    share = count.get(1, 0) / sum(count.values())

    def learn(batches):
        found = sorted((i, t, y) for batch in batches for i, t, y in zip(*(batch.column(c).to_pylist() for c in ("i", "t", "y")), strict=True))
        model = fit([t for _, t, _ in found], np.array([y for _, _, y in found]), share)
        del found
        X.release()
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # The sample is bounded, so one task fits it, and the driver holds the weights alone.
    texts = rows.join(pick, "i").groupBy("i", "y").agg(F.max("t").alias("t")).coalesce(1)
    return pickle.loads(texts.mapInArrow(learn, "model binary").collect()[0]["model"])


def score(docs: DataFrame, model: Model, *, text_col: str = "text", spans: bool = True, name: str = "score") -> DataFrame:
    """``docs`` with score (under ``name``) and, where asked for, the toxic words as toxic_spans (start, end in characters, p).

    Columns of these names that docs has already are left out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in (name, "toxic_spans")]
    docs = docs.select(*(F.col(f"`{f.name}`") for f in fields))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        m: Model = shared.value
        for block in X.blocks(batches, text_col):
            words = X.Words(block.column(text_col), X.ALNUM)
            value, p = m.score(words)
            block = block.append_column(name, pa.array(value, pa.float64()))
            if spans:
                hit = np.flatnonzero(p >= 0.5)
                chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                row = np.searchsorted(words.first, hit, "right") - 1
                out: list = [[] for _ in range(block.num_rows)]
                for i, r in zip(hit, row, strict=True):
                    base = chars[words.offsets[r]]
                    out[r].append({"start": int(chars[words.start[i]] - base), "end": int(chars[words.end[i]] - base), "p": float(p[i])})
                block = block.append_column("toxic_spans", pa.array(out, kind))
            yield block

    schema = T.StructType([*fields, T.StructField(name, T.DoubleType())])
    if spans:
        schema = schema.add("toxic_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])))
    return docs.mapInArrow(run, schema)


def part_of(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learnt from the labelled ones whose part of four is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(part_of("doc_id", 4) != 2))
    held = F.coalesce(part_of("doc_id", 4) == 2, F.lit(False))
    found = score(docs, model, spans=True)
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"), F.size("toxic_spans").cast("long").alias("n_toxic_words"), "toxic_spans")
