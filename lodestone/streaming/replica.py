"""Replicas by Structured Streaming: the log as a stream, applied batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import geo
from ..operators import wal
from ..sources.indexes import SpatialIndex, TextIndex
from ..sources.log import MUTATION, latest


def source(spark: SparkSession, path: str, schema=MUTATION, max_files: int | None = None) -> DataFrame:
    """The log as a stream; its checkpoint is the consumer's slot."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def apply(log: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply a stream of mutations to ``target``.

    A batch is folded to the last version of each key and written to a
    directory of its own, replacing what an earlier attempt of that batch left,
    so it takes effect once. Readers fold by LSN, hence arrival order is free.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        latest(batch).select(MUTATION.fieldNames()).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return log.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def replica(spark: SparkSession, target: str) -> DataFrame:
    """The materialised view: latest of all batches, without tombstones."""
    return latest(spark.read.schema(MUTATION).parquet(f"{target}/batch=*")).where(F.col("op") != "DELETE")


def apply_texts(records: DataFrame, index: TextIndex, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply a stream of text records (lsn, data: key, a zero byte, the text) to a stored text index: the last text of each key of a batch."""

    def put(batch: DataFrame, batch_id: int) -> None:
        found = wal.decode_text(batch).groupBy(F.col("doc_key").alias("key")).agg(F.max_by("text", "lsn").alias("value"))
        index.put(found.where("key is not null"))

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def apply_rects(records: DataFrame, index: SpatialIndex, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply a stream of rectangle records (lsn, type, data) to a stored index: the last change of each rectangle of a batch.

    A rectangle that is there already is replaced by itself, so a batch that runs again changes nothing.
    """

    def change(batch: DataFrame, batch_id: int) -> None:
        by = ["key", *geo.SIDES]
        last = wal.decode_spatial(batch).withColumnRenamed("id", "key").groupBy(*by).agg(F.max_by("op", "lsn").alias("op")).persist()
        try:
            index.remove(last)
            index.put(last.where("op = 'PUT'").withColumn("value", F.lit(None).cast("string")))
        finally:
            last.unpersist()

    return records.writeStream.foreachBatch(change).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def silent(beats: DataFrame, node: str, ts: str, interval: str, late: str = "1 minute") -> DataFrame:
    """Sessions of heartbeats: a node is down from the end of one to the start of its next."""
    sessions = beats.withWatermark(ts, late).groupBy(F.col(node), F.session_window(ts, interval)).agg(F.count("*").alias("beats"))
    return sessions.select(node, F.col("session_window.start").alias("up_from"), F.col("session_window.end").alias("down_at"), "beats")


def bounded(events: DataFrame, data: str, max_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(events within the size limit, oversize ones)."""
    size = F.octet_length(data)
    return events.where(size <= max_bytes), events.where(size > max_bytes)
