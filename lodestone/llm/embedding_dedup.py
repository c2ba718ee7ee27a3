"""Near-duplicate embeddings by an inverted multi-index.

Vectors are halved; a codebook for each half, fitted by k-means on a bounded
sample, makes a grid of cells, and every vector is put into its cell. A vector
visits cells by multi-sequence traversal, in order of the sum of the distances
of their two centroids. How many is set on the sample: as many as find, with
the target recall, a vector at exactly the least cosine in a random direction.
Candidates are verified by their cosine in double precision.

Equal vectors are folded before and unfolded after. A crowded cell is worked
in tiles of at most ``tile`` members by ``tile`` visitors, so no task holds an
unbounded group; a tile sends counts and a spanning forest of its links, not
its pairs. A pair that both ends find is counted once by each, a pair that one
end finds is counted for both there.

Nulls: a vector that is null, zero, of another length than most or holds a
null or a component that isn't finite links with nothing: it has 0 links and
its own id as component. Rows with a null id have 0 links and a null
component. Repeated rows are vectors of their own. Other columns are ignored;
empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch

#: Vectors of the sample the codebooks are fitted on; members and visitors of a tile.
SAMPLE, TILE, RECALL = 8192, 1024, 0.99
#: The power of two of centroids of a half at most: eight vectors of the sample or more for each.
MOST = 10


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(7)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.argmin((c * c).sum(1) - 2 * x @ c.T, 1)
        for i in range(len(c)):
            at = own == i
            if at.any():
                c[i] = x[at].mean(0)
    return c


def traversal(d1: np.ndarray, d2: np.ndarray, count: int) -> list[int]:
    """The ``count`` cells of least d1[i] + d2[j], nearest first, as i * len(d2) + j."""
    a, b = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, out = [(d1[a[0]] + d2[b[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * len(d2) + int(b[j]))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (d1[a[x]] + d2[b[y]], x, y))
    return out


@dataclass
class Grid:
    first: np.ndarray
    second: np.ndarray
    visits: int = 1

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return tuple((c * c).sum(1) - 2 * part @ c.T for c, part in ((self.first, x[:, :cut]), (self.second, x[:, cut:])))

    def cells(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self.distances(x)
        return np.argmin(d1, 1) * len(self.second) + np.argmin(d2, 1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Cells each row visits, by multi-sequence traversal."""
        d1, d2 = self.distances(x)
        return np.array([traversal(a, b, self.visits) for a, b in zip(d1, d2, strict=True)], np.int64).reshape(len(x), -1)


def fit(sample: np.ndarray, rows: int, cosine: float, recall: float = RECALL) -> Grid:
    """A grid for about ``rows`` vectors from a sample of unit vectors."""
    k = 1 << int(np.clip(np.round(np.log2(max(np.sqrt(rows), 1) / 8)), 2, MOST))
    cut = max(1, sample.shape[1] // 2)
    grid = Grid(kmeans(sample[:, :cut], k), kmeans(sample[:, cut:], k))
    rng = np.random.default_rng(11)
    x = sample[: 1024]
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, norm, out=np.zeros_like(u), where=norm > 0)
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * u
    cells = len(grid.first) * len(grid.second)
    d1, d2 = grid.distances(x)
    e1, e2 = grid.distances(y)
    # A pair is found where either end visits the other's cell: the smaller of both ranks counts.
    rank = np.minimum(_rank(d1, d2, grid.cells(y)), _rank(e1, e2, grid.cells(x)))
    grid.visits = int(min(cells, np.sort(rank)[int(np.ceil(recall * len(rank))) - 1] + 1))
    return grid


def _rank(d1: np.ndarray, d2: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """How many cells are nearer than the given one, of each row."""
    row = np.arange(len(d1))
    own = d1[row, cell // d2.shape[1]] + d2[row, cell % d2.shape[1]]
    return np.array([np.searchsorted(np.sort(b), t - a).sum() for a, b, t in zip(d1, d2, own, strict=True)])


def _unit(column: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(v.as_buffer() for v in column), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", percent: int = 95, sample: int = SAMPLE, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept (the first of its component)."""
    spark = vectors.sparkSession
    tmp = Scratch(spark, "imi")
    cosine = percent / 100
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def pack(batches):
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                x = None if v is None or not v or None in v else np.array(v, np.float64)
                out.append(None if x is None or not np.isfinite(x).all() or not x.any() else (x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "x"])

    packed = tmp.cut(rows.mapInArrow(pack, "id long, x binary"), "packed")
    width = packed.where("x is not null and id is not null").groupBy(F.octet_length("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    fine = F.col("id").isNotNull() & (F.octet_length("x") == (width["w"] if width else -1))
    reps = packed.where(fine).groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    reps = tmp.cut(reps, "reps")
    count = reps.count()
    if not count:
        return packed.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.coalesce(F.col("id").isNotNull(), F.lit(False)).alias("kept"))
    chance = F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * sample / count))
    drawn = reps.where(chance).select("x", "id").limit(2 * sample).collect() or reps.limit(1).collect()
    drawn = sorted(((bytes(r["x"]), r["id"]) for r in drawn), key=lambda r: r[1])
    grid = fit(_unit(pa.array([x for x, _ in drawn], pa.binary())), count, cosine, recall)
    shared = spark.sparkContext.broadcast(grid)

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _unit(part.column("x"))
                own, visits = shared.value.cells(x), shared.value.order(x)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), part.column("x"), pa.array(own, pa.int32()), pa.array(list(visits.astype(np.int32)), pa.list_(pa.int32()))], ["id", "n", "x", "cell", "visits"])

    placed = tmp.cut(reps.mapInArrow(place, "id long, n long, x binary, cell int, visits array<int>"), "placed")
    # A row a cell, of which the grid has a bounded number.
    split = lambda n: F.ceil(F.coalesce(n, F.lit(1)) / F.lit(tile)).cast("int")
    members = placed.groupBy(F.col("cell").alias("c")).agg(F.count("*").alias("m"))
    visitors = placed.select(F.explode("visits").alias("c")).groupBy("c").agg(F.count("*").alias("q"))
    tiles = tmp.cut(members.join(visitors, "c", "left").select("c", split(F.col("m")).alias("m"), split(F.col("q")).alias("q")), "tiles")
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = placed.select("id", "n", "x", "cell", F.explode("visits").alias("c")).join(tiles, "c").select("c", every("m").alias("a"), spread("q", 1).alias("b"), "id", "n", "x", "cell", F.lit(None).cast("array<int>").alias("visits"), F.lit(True).alias("asks"))
    found = placed.withColumn("c", F.col("cell")).join(tiles, "c").select("c", spread("m", 2).alias("a"), every("q").alias("b"), "id", "n", "x", "cell", "visits", F.lit(False).alias("asks"))

    def match(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(tables)).combine_chunks()
        asks = t.column("asks").to_numpy()
        q, m = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        if q.num_rows and m.num_rows:
            qid, mid = q.column("id").to_numpy(), m.column("id").to_numpy()
            x, y = _unit(q.column("x").combine_chunks()), _unit(m.column("x").combine_chunks())
            hit = (x @ y.T >= cosine) & (qid[:, None] != mid[None])
            visits = np.array(m.column("visits").to_pylist())
            cell, which = np.unique(q.column("cell").to_numpy(), return_inverse=True)
            both = np.stack([(visits == c).any(1) for c in cell])[which]  # the member finds the visitor as well
            of_q = hit @ m.column("n").to_numpy()
            of_m = q.column("n").to_numpy() @ (hit & ~both)
            a, b = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            hit = hit[np.ix_(a, b)]
            qid, mid, of_q, of_m = qid[a], mid[b], of_q[a], of_m[b]
            lq, lm = qid.copy(), mid.copy()
            top = np.iinfo(np.int64).max
            while len(a):
                nq = np.minimum(lq, np.where(hit, lm[None], top).min(1))
                nm = np.minimum(lm, np.where(hit, nq[:, None], top).min(0))
                if (nq == lq).all() and (nm == lm).all():
                    break
                lq, lm = nq, nm
            ids, links_, root = np.concatenate([qid, mid]), np.concatenate([of_q, of_m]), np.concatenate([lq, lm])
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "links": pa.array(links_, pa.int64()), "root": pa.array(root, pa.int64())})

    tiles_out = tmp.cut(queries.union(found).groupBy("c", "a", "b").applyInArrow(match, "id long, links long, root long"), "matched")
    shared.destroy()
    tmp.drop("placed", "tiles")
    sums = tiles_out.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(tiles_out.select(F.col("id").alias("a"), F.col("root").alias("b")), tmp)
    named = reps.join(sums, "id", "left").join(labels, "id", "left").select(F.col("x").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = packed.select("id", F.when(fine, F.col("x")).alias("k")).join(named, "k", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Vectors of ``embeddings`` with a cosine of 0.95 or more, whatever their labels."""
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
