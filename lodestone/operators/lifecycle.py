"""Archives, snapshots, age policies, migrations."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlreadyExists, InvalidArgument, NotFound
from . import kv as kv_ops

_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(duration: str) -> float:
    """Seconds of 90d, 1h30m, 250ms and the like."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|[smhdw])", duration)
    if not parts or "".join(a + b for a, b in parts) != duration:
        raise InvalidArgument(f"not a duration: {duration}")
    return sum(float(n) * _UNITS[u] for n, u in parts)


def aged(files: DataFrame, now: Column, age: str, modified: str = "modified", created: str = "created", pinned: str = "pinned") -> DataFrame:
    """Entries whose last change, or else creation, is at least ``age`` ago and that aren't pinned."""
    since = F.coalesce(F.col(modified), F.col(created))
    return files.where((F.unix_micros(now) - F.unix_micros(since) >= int(seconds(age) * 1e6)) & ~F.coalesce(F.col(pinned), F.lit(False)))


def archive(kv: DataFrame, prefix: str, destination: str | None = None, older: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(archived, remaining). Archived rows are written as lines of JSON where a destination is given."""
    chosen = kv_ops.prefix(kv, prefix)
    chosen = chosen if older is None else chosen.where(older)
    if destination:
        chosen.select("key", "value").write.mode("append").json(destination)
    return chosen, kv_ops.without(kv, chosen)


def snapshot(rows: DataFrame, path: str, name: str, lsn: int) -> DataFrame:
    """Write the rows and a manifest of the files: file, size, sha256 and the LSN they hold."""
    spark = rows.sparkSession
    rows.write.mode("errorifexists").parquet(f"{path}/{name}.snap")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/{name}.snap")
    manifest = files.select(F.lit(name).alias("manager"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.lit(lsn).cast("long").alias("lsn"))
    manifest.write.mode("append").json(f"{path}/manifest")
    return spark.read.schema("manager string, file string, size long, sha256 string, lsn long").json(f"{path}/manifest").where(F.col("manager") == name)


def restore(spark: SparkSession, path: str, name: str, verify: bool = True) -> tuple[DataFrame, int]:
    """(rows, LSN) of a snapshot; a missing, changed or stale file is an error."""
    manifest = spark.read.schema("manager string, file string, size long, sha256 string, lsn long").json(f"{path}/manifest").where(F.col("manager") == name)
    lsn = manifest.agg(F.max("lsn")).first()[0]
    if lsn is None:
        raise NotFound(f"no snapshot of {name}")
    if verify:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/{name}.snap")
        found = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("now"))
        bad = manifest.join(found, "file", "full").where("sha256 is null or now is null or sha256 <> now")
        if not bad.isEmpty():
            raise InvalidArgument(f"files of the snapshot of {name} differ from its manifest")
    rows = spark.read.parquet(f"{path}/{name}.snap")
    if "lsn" in rows.columns and (rows.agg(F.max("lsn")).first()[0] or 0) < lsn and not rows.isEmpty():
        raise InvalidArgument(f"the rows of {name} end before LSN {lsn}")
    return rows, lsn


@dataclass(frozen=True)
class Migration:
    version: int
    name: str
    up: Callable[[DataFrame], DataFrame]
    down: Callable[[DataFrame], DataFrame] | None = None


class Migrator:
    """Versioned changes of a key-value table; what was applied is kept in the table itself."""

    PREFIX = "__schema_migration/"

    def __init__(self, migrations: list[Migration]):
        self.migrations = sorted(migrations, key=lambda m: m.version)
        if len({m.version for m in migrations}) != len(migrations):
            raise AlreadyExists("two migrations have one version")

    def applied(self, kv: DataFrame) -> list[tuple[int, str, str]]:
        """(version, name, time) of those applied, oldest first."""
        rows = kv_ops.prefix(kv, self.PREFIX).select("value").collect()
        return sorted((int(v), n, t) for v, n, t in (r["value"].split("|", 2) for r in rows))

    def _mark(self, kv: DataFrame, m: Migration) -> DataFrame:
        row = [(f"{self.PREFIX}{m.version:010d}", f"{m.version}|{m.name}|{datetime.now(UTC).isoformat()}")]
        return kv.unionByName(kv.sparkSession.createDataFrame(row, "key string, value string"))

    def up(self, kv: DataFrame) -> DataFrame:
        """The table with every pending migration applied, in order."""
        done = {v for v, _, _ in self.applied(kv)}
        for m in self.migrations:
            if m.version not in done:
                kv = self._mark(m.up(kv), m)
        return kv

    def down(self, kv: DataFrame, n: int = 1) -> DataFrame:
        """The table with the newest n applied ones undone."""
        by = {m.version: m for m in self.migrations}
        for version, _, _ in reversed(self.applied(kv)[-n:] if n > 0 else []):
            m = by.get(version)
            if m is None or m.down is None:
                raise InvalidArgument(f"migration {version} can't be undone")
            kv = m.down(kv).where(F.col("key") != f"{self.PREFIX}{version:010d}")
        return kv
