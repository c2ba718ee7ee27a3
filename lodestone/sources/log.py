"""The mutation log: every write is appended, every read takes the latest version of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import CommitLog

#: Columns of a mutation. txn_id 0 commits by itself.
MUTATION = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType()),
        T.StructField("op", T.StringType(), False),
        T.StructField("lsn", T.LongType(), False),
        T.StructField("txn_id", T.LongType(), False),
    ]
)

def latest(log: DataFrame, *also: str) -> DataFrame:
    """The last version of each key, tombstones included: a map-side maximum and one shuffle by key."""
    rest = [c for c in ("value", "op", "txn_id", *also) if c in log.columns]
    best = log.groupBy("key").agg(F.max_by(F.struct("lsn", *rest), "lsn").alias("last"))
    return best.select("key", *(F.col(f"last.{c}").alias(c) for c in ("lsn", *rest)))


def live(log: DataFrame) -> DataFrame:
    """The last version of each key that isn't deleted."""
    return latest(log).where(F.col("op") != "DELETE")


def committed(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Records of transactions that committed, and those outside any; aborted and unfinished ones leave nothing."""
    return log.where("txn_id = 0").unionByName(log.where("txn_id <> 0").join(commits.select("txn_id").distinct(), "txn_id", "left_semi").select(log.columns))


def caught_up(snapshot: DataFrame, log: DataFrame, snapshot_lsn: int) -> DataFrame:
    """A snapshot (key, value, lsn) and the log after it, as the live view."""
    base = snapshot.select("key", "value", F.lit("PUT").alias("op"), "lsn", F.lit(0).cast("long").alias("txn_id"))
    return live(base.unionByName(log.where(F.col("lsn") > snapshot_lsn).select("key", "value", "op", "lsn", "txn_id")))


def numbered(rows: DataFrame, *order: str, base: int = 0, name: str = "lsn") -> DataFrame:
    """Consecutive numbers from base + 1 in the order given, without sorting everything in one place.

    Rows are dealt to ranges of about equal size and sorted there; each is its
    range's count before it plus its place. Ranges come from a sample of the
    rows, so neither many keys nor a long common prefix of them matter; rows
    equal in all of ``order`` share a range. The ranges' first rows and counts
    are found once and kept: a plan that dealt the rows again for its counts
    would sample them again, and find other ranges.
    """
    from pyspark.sql import Window

    spark, part, at, starts = rows.sparkSession, "__range", "__before", "__starts"
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*order)
    dealt = rows.select(key.alias("low")).repartitionByRange(ranges, "low")
    found = dealt.groupBy(F.spark_partition_id().alias(part)).agg(F.min("low").alias("low"), F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    found = found.select("low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = found.agg(F.array_sort(F.collect_list(F.struct("low", "before"))).alias(starts))
    found = spark.createDataFrame(found.toArrow(), found.schema)

    # A binary search: how many ranges start at or before the row.
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(ranges.bit_length()))))
    own = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(starts, n + step - 1)["low"] <= key, step).otherwise(F.lit(0)))
    placed = rows.crossJoin(F.broadcast(found)).withColumn(part, own)
    placed = placed.withColumn(at, F.coalesce(F.get(starts, F.col(part) - 1)["before"], F.lit(0))).drop(starts)
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return placed.withColumn(name, place + F.col(at) + F.lit(base).cast("long")).drop(at, part)


class MutationLog(CommitLog):
    """An append-only log of mutations. LSNs only grow, through ``compact`` and ``load`` as well."""

    def read(self, after: int = 0) -> DataFrame:
        """The rows that count; with ``after``, at least those of later LSNs."""
        return self.table(MUTATION, after=after)

    def append(self, changes: DataFrame, txn_id: int = 0, check: Callable[[int], None] | None = None, pending: bool = False) -> int:
        """Append (key, value, op); returns how many. All of a call appear together, or none.

        ``check`` is called with the LSN that the rows follow, before each try to commit; what it raises ends the
        append. A ``pending`` append counts once its transaction is decided.
        """
        changes = changes.select("key", "value", "op").persist()
        try:
            n = changes.count()

            def make(folder: Callable[..., str], base: int) -> int:
                if check:
                    check(base)
                rows = numbered(changes, "key", "op", base=base).withColumn("txn_id", F.lit(txn_id).cast("long"))
                rows.select(MUTATION.fieldNames()).write.parquet(folder())
                return base + n

            if n:
                self.publish(make, txn=txn_id if pending else 0)
            return n
        finally:
            changes.unpersist()

    def view(self) -> DataFrame:
        return live(self.read()).select("key", "value")

    def compact(self, partitions: int | None = None) -> None:
        """Write the live rows, sorted by key, as a new base. Appends meanwhile make it start again; older readers keep their files."""

        def make(folder: Callable[..., str], last: int) -> int:
            rows = live(self.read()).select(MUTATION.fieldNames())
            rows = rows.repartitionByRange(partitions, "key") if partitions else rows.repartitionByRange("key")
            rows.sortWithinPartitions("key").write.parquet(folder())
            return last

        if self.commits():
            self.publish(make, base=True)

    def load(self, rows: DataFrame, lsn: int) -> None:
        """Make ``rows`` (the columns of a mutation), as of ``lsn``, all that the log holds; its LSNs go on from the greater one."""

        def make(folder: Callable[..., str], last: int) -> int:
            rows.select(MUTATION.fieldNames()).write.parquet(folder())
            return max(last, lsn)

        self.publish(make, base=True)
