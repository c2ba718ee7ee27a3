"""Slots to nodes, load of nodes, rebalancing."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slots import FNV_SLOTS, slot_crc32, slot_range


def assigned(keys: DataFrame, assignments: DataFrame) -> DataFrame:
    """Keys with their slot and the node that is its primary. There is a row a slot, so that side is sent whole."""
    return keys.withColumn("slot", slot_crc32(F.col("key"))).join(F.broadcast(assignments), "slot", "left")


def ranged(keys: DataFrame, ranges: DataFrame, slots: int = FNV_SLOTS) -> DataFrame:
    """Rows with ``slot`` joined to (first, last, primary): ranges are unfolded to slots, at most ``slots`` of them."""
    one = ranges.select("*", F.explode(F.sequence("first", "last")).alias("slot")).where(F.col("slot").between(0, slots - 1))
    return keys.join(F.broadcast(one), "slot", "left")


def parsed(ranges: DataFrame, text: str, slots: int = FNV_SLOTS) -> DataFrame:
    """Ranges written "a-b" or "a" as first and last; others are left out."""
    return ranges.withColumn("__r", slot_range(F.col(text), slots)).where("__r is not null").select(*ranges.columns, F.col("__r.first").alias("first"), F.col("__r.last").alias("last"))


def ranges_of(ranges: DataFrame) -> DataFrame:
    """The ranges of each primary, in order."""
    return ranges.groupBy("primary").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("ranges"))


def load(assignments: DataFrame) -> DataFrame:
    """Slots of each primary."""
    return assignments.groupBy(F.col("primary").alias("node")).agg(F.count("*").alias("load"))


def least_loaded(loads: DataFrame) -> DataFrame:
    return loads.orderBy("load", "node").limit(1)


def rebalance(shards: dict[str, str], nodes: list[str]) -> list[tuple[str, str, str]]:
    """Moves (shard, from, to) until loads differ by one at most. Cluster metadata, worked on the driver."""
    owner, moves = dict(shards), []
    if not nodes:
        return moves
    while True:
        loads = Counter({n: 0 for n in nodes}) + Counter()
        loads = {n: sum(o == n for o in owner.values()) for n in nodes}
        most, least = min(nodes, key=lambda n: (-loads[n], n)), min(nodes, key=lambda n: (loads[n], n))
        if loads[most] - loads[least] <= 1:
            return moves
        shard = min(s for s, o in owner.items() if o == most)
        owner[shard] = least
        moves.append((shard, most, least))
