"""Rectangle tables: search, nearness, join by grid cells, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def search(rects: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rectangles that meet the box (min_x, min_y, max_x, max_y)."""
    return rects.where(geo.intersects(geo.rect(), tuple(map(F.lit, box))))


def delete(rects: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows but those whose id and exact rectangle are listed."""
    return rects.join(gone, ["id", *geo.SIDES], "left_anti")


def bounds(rects: DataFrame, *by: str) -> DataFrame:
    """The least rectangle around those of each group."""
    return rects.groupBy(*by).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def _span(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size).cast("int"), F.greatest(F.floor(low / size), F.floor(high / size)).cast("int")))


def with_cells(rects: DataFrame, size: float) -> DataFrame:
    """A row for every grid cell a rectangle touches."""
    across = rects.withColumn("cell_x", _span(F.col("min_x"), F.col("max_x"), size))
    return across.withColumn("cell_y", _span(F.col("min_y"), F.col("max_y"), size))


def join(a: DataFrame, b: DataFrame, size: float = 1.0) -> DataFrame:
    """Pairs of rectangles that meet, with the columns of both under a_ and b_.

    Rectangles are joined on the cells they touch. A pair comes out of the cell
    of the lower left corner of its overlap alone, so none comes twice and none
    needs to be told apart afterwards.
    """
    left = with_cells(a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns)).withColumnsRenamed({f"a_{s}": s for s in geo.SIDES}), size)
    right = with_cells(b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)).withColumnsRenamed({f"b_{s}": s for s in geo.SIDES}), size)
    left = left.withColumnsRenamed({s: f"a_{s}" for s in geo.SIDES})
    right = right.withColumnsRenamed({s: f"b_{s}" for s in geo.SIDES})
    pairs = left.join(right, ["cell_x", "cell_y"]).where(geo.intersects(geo.rect("a_"), geo.rect("b_")))
    first_x = F.floor(F.greatest("a_min_x", "b_min_x") / size) == F.col("cell_x")
    first_y = F.floor(F.greatest("a_min_y", "b_min_y") / size) == F.col("cell_y")
    return pairs.where(first_x & first_y).drop("cell_x", "cell_y")
