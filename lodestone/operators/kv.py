"""Key-value operators over a table of (key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.values import MAX_BULK, MAX_RANGE, number, problems
from ..sources.catalog import KeyCodec

ALL = "*"


def get(kv: DataFrame, key: str) -> DataFrame:
    """The row of the key, or none."""
    return kv.where(F.col("key") == F.lit(key))


def between(kv: DataFrame, start: str, end: str) -> DataFrame:
    """start <= key < end; ``*`` leaves a side open."""
    if start != ALL:
        kv = kv.where(F.col("key") >= F.lit(start))
    return kv if end == ALL else kv.where(F.col("key") < F.lit(end))


def get_range(kv: DataFrame, start: str, end: str, limit: int | None = MAX_RANGE, descending: bool = False) -> DataFrame:
    if limit is not None and not 0 < limit <= MAX_RANGE:
        raise InvalidArgument(f"the limit of a range is 1 to {MAX_RANGE}")
    rows = between(kv, start, end).orderBy(F.col("key").desc() if descending else F.col("key"))
    return rows if limit is None else rows.limit(limit)


def prefix(kv: DataFrame, start: str, codec: KeyCodec | None = None) -> DataFrame:
    """Rows whose key begins so; with a codec the scan gets the bounds of the native column."""
    native = codec.within(start) if codec else None
    rows = kv if native is None else kv.where(native)
    return rows.where(F.startswith("key", F.lit(start)))


def page(kv: DataFrame, after: str | None, size: int, codec: KeyCodec | None = None) -> DataFrame:
    """The next ``size`` rows after a key: a page costs no more the further on it is."""
    native = codec.bound(">", after) if codec and after is not None else None
    rows = kv if native is None else kv.where(native)
    return (rows if after is None else rows.where(F.col("key") > F.lit(after))).orderBy("key").limit(size)


def range_aggregates(kv: DataFrame, start: str, end: str, value: Column | None = None) -> DataFrame:
    """count, and sum, min and max of the values that are numbers."""
    v = number(F.col("value")) if value is None else value
    return between(kv, start, end).agg(F.count("*").alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))


def json_sum(kv: DataFrame, path: str, start: str = ALL, end: str = ALL) -> DataFrame:
    """Sum of a number inside JSON values; values that aren't JSON or lack it count nothing."""
    return between(kv, start, end).agg(F.sum(F.get_json_object("value", path).try_cast("double")).alias("sum"))


def without(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key isn't listed."""
    return kv.join(keys.select("key").distinct(), "key", "left_anti")


def fetch(kv: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of the hits."""
    return kv.join(hits.select("key"), "key", "left_semi")


def updated(kv: DataFrame, where: Column, value: Column) -> DataFrame:
    return kv.withColumn("value", F.when(where, value).otherwise(F.col("value")))


def validate(kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their problems)."""
    checked = kv.withColumn("problems", problems(F.col("key"), F.col("value")))
    return checked.where(F.size("problems") == 0).drop("problems"), checked.where(F.size("problems") > 0)


def check_bulk(n: int) -> None:
    if n > MAX_BULK:
        raise InvalidArgument(f"a bulk call takes at most {MAX_BULK} rows")


def usage(kv: DataFrame, namespace: Column) -> DataFrame:
    """Bytes and keys by namespace."""
    return kv.groupBy(namespace.alias("namespace")).agg(F.sum(F.octet_length("value")).alias("bytes"), F.count("*").alias("keys"))
