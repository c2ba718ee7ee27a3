"""Quotas, rate limits, slow queries, roles."""

from __future__ import annotations

import math
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..errors import PermissionDenied, ResourceExhausted
from .sequence import with_previous

# What each role may do.
ROLES = {
    "admin": frozenset(("read", "write", "delete", "bulk", "search", "admin")),
    "writer": frozenset(("read", "write", "delete", "bulk", "search")),
    "reader": frozenset(("read", "search")),
}


def require(role: str | None, action: str) -> None:
    if role is not None and action not in ROLES.get(role, ()):
        raise PermissionDenied(f"{role} may not {action}")


def admit(requests: DataFrame, tenant: str, ts: str, order: str, rate: float, burst: float, cost: str | None = None) -> DataFrame:
    """Token bucket for each tenant: rows with ``admitted`` and the tokens left.

    Refill is capped, so the state after a request depends on those before it.
    A full bucket forgets its past: a gap of burst / rate seconds starts a new
    run, and runs are worked apart. They are found inside spans of time, so a
    tenant of many requests is sorted in many tasks; one run is one task's, and
    a task works its runs one after the other.
    """

    def start() -> Callable[[int | None, float | None, bool], tuple[bool, float]]:
        tokens, last = burst, None

        def step(t: int | None, c: float | None, opens: bool) -> tuple[bool, float]:
            nonlocal tokens, last
            if opens or t is None or last is None:
                tokens = burst
            else:
                tokens = min(burst, tokens + (t - last) / 1e6 * rate)
            last = t
            ok = c is not None and tokens >= c
            if ok:
                tokens -= c
            return ok, tokens

        return step

    return _by_runs(requests, tenant, ts, order, math.ceil(burst / rate * 1e6), cost, start, "admitted boolean, tokens double")


def request_quota(requests: DataFrame, tenant: str, ts: str, order: str, per_second: int) -> DataFrame:
    """Requests with ``admitted``: a one-second window opens with the first request after the last one ended."""

    def start() -> Callable[[int | None, float | None, bool], tuple[bool]]:
        opened, n = None, 0

        def step(t: int | None, c: float | None, opens: bool) -> tuple[bool]:
            nonlocal opened, n
            if opens or opened is not None and t is not None and t - opened >= 1_000_000:
                opened, n = t, 0
            ok = n < per_second
            n += ok
            return (ok,)

        return step

    return _by_runs(requests, tenant, ts, order, 1_000_000, None, start, "admitted boolean")


def _by_runs(requests: DataFrame, tenant: str, ts: str, order: str, gap_us: int, cost: str | None, start: Callable[[], Callable], new: str) -> DataFrame:
    """Requests with what ``step`` says of (time, cost, whether a run begins), called in order through every run.

    There are about as many runs as requests where these are rare, so a run is
    no group of its own: tasks take sorted rows in batches, whatever a run holds.
    """
    columns = requests.columns
    runs = with_previous(requests, tenant, ts, order, gap_us)
    at = Window.partitionBy(tenant, "__run").orderBy("__us", order)
    runs = runs.withColumn("__opens", F.row_number().over(at) == 1).withColumn("__cost", F.col(cost).cast("double") if cost else F.lit(1.0))
    kinds = StructType.fromDDL(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("__us", "__cost", "__opens")), strict=True)
            found = zip(*(step(*r) for r in rows), strict=True) if batch.num_rows else ([] for _ in kinds)
            made = [pa.array(x, to_arrow_type(k.dataType)) for x, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + made, columns + kinds.names)

    # The window leaves the rows of a partition in order, one run after the other.
    return runs.select(*(F.col(f"`{c}`") for c in columns), "__us", "__cost", "__opens").mapInArrow(run, StructType(requests.schema.fields + kinds.fields))


def latency_histogram(calls: DataFrame, name: str, duration: str, bounds: tuple[float, ...]) -> DataFrame:
    """Calls of each name at or below each bound and above the one before; the last bucket (null) is beyond all."""
    least = F.lit(None).cast("double")
    for b in reversed(bounds):
        least = F.when(F.col(duration) <= b, F.lit(float(b))).otherwise(least)
    return calls.where(F.col(duration).isNotNull()).groupBy(F.col(name).alias("name"), least.alias("at_most")).agg(F.count("*").alias("calls"))


def storage_quota(writes: DataFrame, namespace: str, order: str, size: str, max_bytes: int, max_keys: int, span: int = 10_000) -> DataFrame:
    """Writes with the bytes and keys of their namespace so far and whether these are within the quota.

    ``order`` is a number. Sums run inside spans of it and start from those of the spans before, of which there is a row each.
    """
    writes = writes.withColumn("__span", F.floor(F.col(order) / F.lit(span)))
    inside = Window.partitionBy(namespace, "__span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("__name").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    spans = writes.groupBy(F.col(namespace).alias("__name"), F.col("__span").alias("__at")).agg(F.sum(size).alias("__bytes"), F.count("*").alias("__keys"))
    spans = spans.select("__name", "__at", F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes"), F.coalesce(F.sum("__keys").over(before), F.lit(0)).alias("__keys"))
    used = writes.withColumn("bytes_so_far", F.sum(size).over(inside)).withColumn("keys_so_far", F.count("*").over(inside))
    used = used.join(spans, F.col(namespace).eqNullSafe(F.col("__name")) & F.col("__span").eqNullSafe(F.col("__at")))
    used = used.withColumn("bytes_so_far", F.coalesce("bytes_so_far", F.lit(0)) + F.col("__bytes")).withColumn("keys_so_far", F.col("keys_so_far") + F.col("__keys"))
    return used.drop("__span", "__name", "__at", "__bytes", "__keys").withColumn("within", (F.col("bytes_so_far") <= max_bytes) & (F.col("keys_so_far") <= max_keys))


def over_quota(usage: DataFrame, max_bytes: int, max_keys: int) -> DataFrame:
    return usage.where((F.col("bytes") > max_bytes) | (F.col("keys") > max_keys))


def slow_queries(queries: DataFrame, duration: str, threshold: float, started: str, limit: int, *tie: str) -> DataFrame:
    """The latest queries at or above the threshold."""
    return queries.where(F.col(duration) >= threshold).orderBy(F.desc(started), *tie).limit(limit)


class SlowLog:
    """The last ``size`` calls that took the threshold or longer, oldest first."""

    def __init__(self, threshold_s: float, size: int = 1000):
        self.threshold, self.entries = threshold_s, deque(maxlen=size)

    def timed(self, name: str, call):
        start = time.monotonic()
        try:
            return call()
        finally:
            took = time.monotonic() - start
            if took >= self.threshold:
                self.entries.append((name, took))


def with_timeout(spark: SparkSession, seconds: float, call):
    """Run ``call``; its jobs are cancelled when the time is over."""
    tag, late = f"timeout-{threading.get_ident()}-{time.monotonic_ns()}", threading.Event()

    def stop():
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return call()
    except Exception as e:
        if late.is_set():
            raise ResourceExhausted(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def batches(rows: Iterator[bytes], max_bytes: int = 64 << 10, max_rows: int = 256) -> Iterator[list[bytes]]:
    """Messages in batches bounded by size and number."""
    out, size = [], 0
    for r in rows:
        if out and (size + len(r) > max_bytes or len(out) >= max_rows):
            yield out
            out, size = [], 0
        out.append(r)
        size += len(r)
    if out:
        yield out
