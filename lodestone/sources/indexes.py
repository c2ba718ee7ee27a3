"""Text and rectangle indexes on disk: rows and what finds them, in the order of commits.

Postings lie in folders by a hash of the term, sorted by term, so a search
reads the folders of its terms and skips in them by the files' statistics.
Rectangles are sorted by grid cells, so a window skips most row groups.
What a later commit replaces is listed there as gone; readers leave out what
is older than its key's mention.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..functions.text import stemmed, words_of
from .commits import CommitLog

BUCKETS = 64


def _schema(**kinds: str) -> T.StructType:
    types = {"text": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(name, types[kind]) for name, kind in kinds.items()])


_SIDES = dict.fromkeys(geo.SIDES, "double")
DOCS = _schema(key="text", value="text", op="text", lsn="long")
POSTINGS = _schema(term="text", doc_key="text", lsn="long", bucket="int")
GONE = _schema(key="text", lsn="long")
RECTS = _schema(key="text", value="text", **_SIDES, lsn="long")
GONE_RECTS = _schema(key="text", **_SIDES, lsn="long")


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(buckets)).cast("int")


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    """The folder of a term."""
    return zlib.crc32(term.encode()) % buckets


class TextIndex(CommitLog):
    """Documents by key with the postings of their terms."""

    TABLES = ("docs", "postings", "gone")

    def put(self, docs: DataFrame) -> None:
        """Add (key, value); the texts of keys that are there are replaced. Keys are distinct."""
        self._change(docs.select("key", "value", F.lit("PUT").alias("op")))

    def remove(self, keys: DataFrame) -> None:
        self._change(keys.select("key", F.lit(None).cast("string").alias("value"), F.lit("DELETE").alias("op")))

    def _change(self, docs: DataFrame) -> None:
        def make(folder: Callable[..., str], last: int) -> int:
            new = docs.withColumn("lsn", F.lit(last + 1).cast("long"))
            new.write.parquet(folder("docs"))
            new = self.spark.read.schema(DOCS).parquet(folder("docs"))
            self._write_postings(new, folder("postings"))
            old = self.table(DOCS, "docs").select("key").distinct()
            new.select("key", "lsn").join(old, "key", "left_semi").write.parquet(folder("gone"))
            return last + 1

        self.publish(make)

    def _write_postings(self, docs: DataFrame, at: str) -> None:
        words = F.array_distinct(words_of(F.col("value")))
        own = docs.where("op = 'PUT'").select(F.explode(F.array_distinct(stemmed(words))).alias("term"), F.col("key").alias("doc_key"), "lsn")
        self._sort_postings(own.withColumn("bucket", bucket(F.col("term"))), at)

    def _sort_postings(self, pairs: DataFrame, at: str) -> None:
        """Dealt by the bucket and a hash of the key, so a common term is many tasks' work and no pass is spent on finding ranges."""
        parts = -(-4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        dealt = pairs.repartition("bucket", F.pmod(F.xxhash64("doc_key"), F.lit(parts)))
        dealt.sortWithinPartitions("bucket", "term", "doc_key").write.partitionBy("bucket").parquet(at)

    def rows(self) -> DataFrame:
        """key and value of the documents there are."""
        last = self.table(DOCS, "docs").groupBy("key").agg(F.max_by(F.struct("value", "op"), "lsn").alias("x"))
        return last.where("x.op = 'PUT'").select("key", "x.value")

    def postings(self) -> DataFrame:
        """Distinct (term, doc_key) with the bucket of the term."""
        return self._alive().select("term", "doc_key", "bucket")

    def _alive(self) -> DataFrame:
        found = self.table(POSTINGS, "postings")
        gone = self.table(GONE, "gone").groupBy(F.col("key").alias("doc_key")).agg(F.max("lsn").alias("since"))
        return found.join(gone, "doc_key", "left").where("since is null or lsn >= since") if len(self.commits()) > 1 else found

    def compact(self) -> None:
        """Rows and postings without what is gone, as a new base."""

        def make(folder: Callable[..., str], last: int) -> int:
            rows = self.rows().select("key", "value", F.lit("PUT").alias("op"), F.lit(last).cast("long").alias("lsn"))
            rows.write.parquet(folder("docs"))
            kept = self._alive().select("term", "doc_key", F.lit(last).cast("long").alias("lsn"), "bucket")
            self._sort_postings(kept, folder("postings"))
            self.spark.createDataFrame([], GONE).write.parquet(folder("gone"))
            return last

        if self.commits():
            self.publish(make, base=True)


class SpatialIndex(CommitLog):
    """Rectangles with a key; a key may have several."""

    TABLES, CELL = ("rects", "gone"), 1.0

    def _sorted(self, rects: DataFrame, at: str) -> None:
        cells = [F.floor(F.col(c) / self.CELL) for c in ("min_x", "min_y")]
        rects.repartitionByRange(*cells, "min_x", "min_y").sortWithinPartitions(*cells, "min_x").write.parquet(at)

    def put(self, rects: DataFrame) -> None:
        """Add (key, value, min_x, min_y, max_x, max_y)."""

        def make(folder: Callable[..., str], last: int) -> int:
            self._sorted(rects.select("key", "value", *geo.SIDES).withColumn("lsn", F.lit(last + 1).cast("long")), folder("rects"))
            self.spark.createDataFrame([], GONE_RECTS).write.parquet(folder("gone"))
            return last + 1

        self.publish(make)

    def remove(self, gone: DataFrame) -> None:
        """Remove rows of exactly these keys and rectangles."""

        def make(folder: Callable[..., str], last: int) -> int:
            gone.select("key", *geo.SIDES).withColumn("lsn", F.lit(last + 1).cast("long")).write.parquet(folder("gone"))
            self.spark.createDataFrame([], RECTS).write.parquet(folder("rects"))
            return last + 1

        self.publish(make)

    def rows(self) -> DataFrame:
        found = self.table(RECTS, "rects")
        if len(self.commits()) > 1:
            by = ["key", *geo.SIDES]
            gone = self.table(GONE_RECTS, "gone").groupBy(*by).agg(F.max("lsn").alias("since"))
            found = found.join(gone, by, "left").where("since is null or lsn >= since")
        return found.select("key", "value", *geo.SIDES)

    def compact(self) -> None:
        def make(folder: Callable[..., str], last: int) -> int:
            self._sorted(self.rows().withColumn("lsn", F.lit(last).cast("long")), folder("rects"))
            self.spark.createDataFrame([], GONE_RECTS).write.parquet(folder("gone"))
            return last

        if self.commits():
            self.publish(make, base=True)
