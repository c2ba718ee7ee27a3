"""Connected components by minimum label with pointer jumping, on DataFrames.

Every round joins links with labels and takes minima, so a hub only adds rows
to a partial aggregation and nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``links`` (a, b) to (id, component_id): the smallest id reachable. Ids without links aren't listed.

    Links may repeat, be given in either direction or join an id with itself;
    links with a null end are ignored; no links give an empty result.
    """
    both = links.where("a is not null and b is not null and a <> b")
    both = both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.cut(both, f"{name}-links")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component_id"))
    labels = scratch.cut(labels, f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component_id").alias("near"))
        low = labels.join(near, "id").select("id", "component_id", F.least("component_id", "near").alias("low"))
        # The root a label points at learns of the lower label too, so whole trees move at once.
        roots = low.where("low < component_id").groupBy(F.col("component_id").alias("id")).agg(F.min("low").alias("hook"))
        low = low.join(roots, "id", "left").select("id", "component_id", F.least("low", F.coalesce("hook", "low")).alias("low"))
        low = scratch.cut(low, f"{name}-low")
        up = low.select(F.col("id").alias("low"), F.col("low").alias("up"))
        new = low.join(up, "low").select("id", F.least("low", "up").alias("component_id"), (F.least("low", "up") < F.col("component_id")).alias("moved"))
        new = scratch.cut(new, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-low")
        labels = new.select("id", "component_id")
        if new.where("moved").isEmpty():
            scratch.drop(f"{name}-links")
            return labels
