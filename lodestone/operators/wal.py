"""Analytics of the change stream: segments, consumer slots, what may be pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import with_previous


def segments(log: DataFrame) -> DataFrame:
    """First and last LSN and records of each segment."""
    return log.groupBy("segment_id").agg(F.min("lsn").alias("start_lsn"), F.max("lsn").alias("end_lsn"), F.count("*").alias("records"))


def segment_of(lsns: DataFrame, starts: DataFrame, buckets: int = 100_000) -> DataFrame:
    """As-of join: of each row's ``lsn`` the segment with the greatest start at or below it; null before the first.

    LSNs are dealt to at most ``buckets`` ranges. Inside one, a running last
    value finds the start, in one sort of starts and rows together; what comes
    before the first start of a range is carried from the ranges before, of
    which there is a row each.
    """
    low, high = starts.agg(F.min("start_lsn"), F.max("start_lsn")).first()
    if low is None:
        return lsns.withColumn("segment_id", F.lit(None).cast(starts.schema["segment_id"].dataType))
    width = (high - low) // buckets + 1
    bucket = lambda c: F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(width)), F.lit(buckets)).cast("long")
    row = F.struct(*lsns.columns)
    nothing = F.lit(None).cast(lsns.select(row.alias("r")).schema["r"].dataType)
    marks = starts.select(bucket("start_lsn").alias("b"), F.col("start_lsn").alias("at"), "segment_id", nothing.alias("r"))
    asked = lsns.select(bucket("lsn").alias("b"), F.col("lsn").alias("at"), F.lit(None).cast(starts.schema["segment_id"].dataType).alias("segment_id"), row.alias("r"))
    w = Window.partitionBy("b").orderBy("at", F.col("r").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = marks.unionByName(asked).withColumn("own", F.last("segment_id", True).over(w)).where("r is not null")
    last = starts.groupBy(bucket("start_lsn").alias("b")).agg(F.max_by("segment_id", "start_lsn").alias("old"))
    until = F.coalesce(F.lead("b").over(Window.orderBy("b")), F.lit(buckets))
    carried = last.withColumn("until", until).where("until > b").select(F.explode(F.sequence(F.col("b") + 1, F.col("until"))).alias("b"), "old")
    return own.join(F.broadcast(carried), "b", "left").select("r.*", F.coalesce("own", "old").alias("segment_id"))


def slot_lag(slots: DataFrame, last_lsn: int) -> DataFrame:
    """Consumers with how far they are behind."""
    return slots.withColumn("lag", F.greatest(F.lit(0).cast("long"), F.lit(last_lsn).cast("long") - F.col("restart_lsn")))


def safe_lsn(slots: DataFrame, checkpoint_lsn: int) -> DataFrame:
    """The LSN below which no active consumer and no checkpoint needs anything."""
    return slots.where("is_active").agg(F.least(F.coalesce(F.min("restart_lsn"), F.lit(checkpoint_lsn).cast("long")), F.lit(checkpoint_lsn).cast("long")).alias("safe_lsn"))


def prunable(starts: DataFrame, safe: DataFrame) -> DataFrame:
    """Segments that end before the safe LSN: those whose next segment starts at or below it. The last one stays."""
    after = F.lead("start_lsn").over(Window.orderBy("segment_id"))
    return starts.select("segment_id", "start_lsn", after.alias("next_lsn")).crossJoin(F.broadcast(safe)).where("next_lsn <= safe_lsn").select("segment_id", "start_lsn", "next_lsn")


def from_lsn(log: DataFrame, lsn: int) -> DataFrame:
    return log.where(F.col("lsn") >= lsn)


def liveness(beats: DataFrame, node: str, ts: str, order: str, interval: str) -> DataFrame:
    """Heartbeats that came later than the interval after the one before: the node was down in between."""
    found = with_previous(beats, node, ts, order).withColumn("prev_ts", F.timestamp_micros("__prev").cast(beats.schema[ts].dataType))
    return found.where(F.col(ts) > F.col("prev_ts") + F.expr(f"INTERVAL {interval}")).drop("__us", "__prev")


def decode_text(records: DataFrame) -> DataFrame:
    """Text changes (doc_key, text) of records whose data is key, a zero byte and the text."""
    part = F.split(F.decode("data", "UTF-8"), "\u0000", 2)
    return records.select("lsn", F.get(part, F.lit(0)).alias("doc_key"), F.get(part, F.lit(1)).alias("text"))


def decode_spatial(records: DataFrame) -> DataFrame:
    """Rectangle changes of records whose data is JSON; op by the record's type."""
    body = F.from_json(F.decode("data", "UTF-8"), "min_x double, min_y double, max_x double, max_y double, data_id string")
    op = F.when(F.col("type") == "RTreeDelete", "DELETE").when(F.col("type").isin("RTreeInsert", "RTreeUpdate", "RTreeSplit", "RTreeNewRoot"), "PUT")
    return records.select("lsn", op.alias("op"), body.alias("r")).where("op is not null and r is not null").select("lsn", "op", F.col("r.data_id").alias("id"), "r.min_x", "r.min_y", "r.max_x", "r.max_y")
