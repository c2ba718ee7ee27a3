"""What came before a row of its group, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_US = 86_400_000_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def with_previous(rows: DataFrame, by: str, ts: str, order: str, gap_us: int | None = None, span_us: int = SPAN_US) -> DataFrame:
    """Rows with ``__us`` (their time), ``__prev`` (that of the row before in their group, null for the first) and, given a gap, ``__run``.

    A run starts with the first row and after every gap of at least ``gap_us``;
    runs of a group are numbered in order. Rows are sorted inside spans of time;
    what a span takes over from those before comes from a row for each of them.
    """
    rows = rows.withColumn("__us", micros(ts)).withColumn("__span", F.floor(F.col("__us") / F.lit(span_us)))
    inside = Window.partitionBy(by, "__span").orderBy("__us", order)
    before = Window.partitionBy(by).orderBy("__span")  # a row a span
    rows = rows.withColumn("__own", F.lag("__us").over(inside))
    gap = F.lit(gap_us).cast("long")
    spans = rows.groupBy(by, "__span").agg(F.min("__us").alias("__low"), F.max("__us").alias("__high"), F.count_if(F.col("__us") - F.col("__own") >= gap).alias("__gaps"))
    spans = spans.withColumn("__from", F.lag("__high").over(before))
    opens = F.coalesce((F.col("__low") - F.col("__from") >= gap).cast("long"), F.lit(1).cast("long"))
    spans = spans.withColumn("__opens", opens)
    spans = spans.withColumn("__past", F.sum(F.col("__opens") + F.col("__gaps")).over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__gaps"))
    spans = spans.select(F.col(by).alias("__by"), F.col("__span").alias("__at"), "__from", "__past")
    rows = rows.join(spans, F.col(by).eqNullSafe(F.col("__by")) & F.col("__span").eqNullSafe(F.col("__at"))).withColumn("__prev", F.coalesce("__own", "__from"))
    if gap_us is not None:
        again = F.coalesce((F.col("__us") - F.col("__own") >= gap).cast("long"), F.lit(0).cast("long"))
        rows = rows.withColumn("__run", F.col("__past") + F.sum(again).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.drop("__span", "__own", "__by", "__at", "__from", "__past")
