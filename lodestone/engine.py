"""The facade: statements, key-value calls, text and spatial tables, transactions."""

from __future__ import annotations

from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidArgument, NotFound, Unavailable
from .functions.values import problems, wrapped_text
from .operators import governance, lifecycle, spatial
from .operators import kv as kv_ops
from .operators import text as text_ops
from .plans import lower
from .plans import tree as t
from .plans.parse import parse
from .sources.catalog import INVERTED, KV, SPATIAL, Catalog, IndexDef
from .sources.commits import Decisions
from .sources.indexes import SpatialIndex, TextIndex
from .sources.log import MUTATION, MutationLog

CHANGE = "key string, value string, op string"


@dataclass
class Result:
    """Rows of a SELECT, or how many keys a statement changed."""

    df: DataFrame | None = None
    rows_affected: int = 0


@dataclass
class Txn:
    """Changes of one index or several that all commit, or none.

    ``prepare`` writes them to each index as pending rows, which count once the
    transaction is decided; deciding is one file. A key that was written since
    the transaction began, or is pending elsewhere, aborts it.
    """

    engine: Engine
    indexes: tuple[str, ...]
    txn_id: int
    state: str = "RUNNING"
    ops: list[tuple[str, str, str | None, str]] = field(default_factory=list)
    seen: dict[str, int] = field(default_factory=dict)

    def put(self, key: str, value: str, index: str | None = None) -> None:
        self._add(index, key, value, "PUT")

    def delete(self, key: str, index: str | None = None) -> None:
        self._add(index, key, None, "DELETE")

    def _add(self, index: str | None, key: str, value: str | None, op: str) -> None:
        if self.state != "RUNNING":
            raise InvalidArgument(f"the transaction is {self.state}")
        index = index or self.indexes[0]
        if index not in self.indexes:
            raise InvalidArgument(f"the transaction was not begun on {index}")
        self.ops.append((index, key, value, op))

    def prepare(self) -> None:
        """Optimistic check of every index, then its pending rows."""
        if self.state != "RUNNING":
            raise InvalidArgument(f"the transaction is {self.state}")
        try:
            for index in self.indexes:
                last = {k: (k, v, o) for i, k, v, o in self.ops if i == index}
                if last:
                    self.engine._append(index, list(last.values()), self.txn_id, lambda lsn, index=index: self._unwritten(index, list(last)), pending=True)
        except Exception:
            self.abort()
            raise
        self.state = "PREPARED"

    def _unwritten(self, index: str, keys: list[str]) -> None:
        log = self.engine.log(index)
        mine = F.col("key").isin(keys)
        if log.last_lsn() > self.seen[index] and not log.read(self.seen[index]).where((F.col("lsn") > self.seen[index]) & mine).isEmpty():
            raise Unavailable("a key was written meanwhile")
        waiting = [c for c in log.in_doubt() if c.txn != self.txn_id]
        if waiting and not log.read_commits(waiting, MUTATION).where(mine).isEmpty():
            raise Unavailable("a key is part of a transaction that isn't decided")

    def commit(self) -> str:
        if self.state == "RUNNING":
            self.prepare()
        if self.state != "PREPARED":
            raise InvalidArgument(f"the transaction is {self.state}")
        self.state = self.engine.decisions.decide(self.txn_id, "COMMITTED") if self.ops else "COMMITTED"
        for index in self.indexes:
            self.engine._refresh(index)
        if self.state != "COMMITTED":
            raise Unavailable("the transaction was aborted meanwhile")
        return self.state

    def abort(self) -> str:
        """Pending rows never count; aborting again is harmless."""
        if self.state == "COMMITTED":
            raise InvalidArgument("the transaction is COMMITTED")
        if self.ops and self.engine.decisions.decide(self.txn_id, "ABORTED") == "COMMITTED":
            self.state = "COMMITTED"
            raise InvalidArgument("the transaction is COMMITTED")
        self.state, self.ops = "ABORTED", []
        return self.state


class Engine:
    """Indexes by name over one directory of logs. ``role`` restricts what may be called."""

    def __init__(self, spark: SparkSession, path: str, options: lower.Options = lower.Options(), role: str | None = None, slow_s: float = 1.0):
        self.spark, self.path, self.options, self.role = spark, path.rstrip("/"), options, role
        self.catalog, self.slow = Catalog(), governance.SlowLog(slow_s)
        self.decisions = Decisions(spark, f"{self.path}/_transactions")
        self._logs: dict[str, MutationLog] = {}
        self._texts: dict[str, TextIndex] = {}
        self._rects: dict[str, SpatialIndex] = {}

    # Indexes

    def create(self, name: str) -> None:
        """A key-value index kept in a log."""
        governance.require(self.role, "admin")
        self._logs[name] = MutationLog(self.spark, f"{self.path}/{name}", self.decisions)
        self._refresh(name)

    def create_text(self, name: str) -> None:
        """A text index kept on disk; opened again where there is one."""
        governance.require(self.role, "admin")
        self._texts[name] = TextIndex(self.spark, f"{self.path}/{name}")
        self._refresh(name)

    def create_spatial(self, name: str) -> None:
        """A rectangle index kept on disk; opened again where there is one."""
        governance.require(self.role, "admin")
        self._rects[name] = SpatialIndex(self.spark, f"{self.path}/{name}")
        self._refresh(name)

    def register(self, index: IndexDef) -> IndexDef:
        """An index over given rows; an inverted one gets its postings where it has none."""
        if index.kind == INVERTED and index.postings is None:
            index.postings = text_ops.postings(index.rows)
        return self.catalog.add(index, replace=True)

    def log(self, name: str) -> MutationLog:
        if name not in self._logs:
            self.catalog.get(name)
            raise InvalidArgument(f"index {name} takes no writes")
        return self._logs[name]

    def _refresh(self, name: str) -> None:
        if name in self._texts:
            new = IndexDef(name, INVERTED, self._texts[name].rows(), self._texts[name].postings())
        elif name in self._rects:
            new = IndexDef(name, SPATIAL, self._rects[name].rows())
        else:
            new = IndexDef(name, KV, self._logs[name].view())
        self.catalog.add(new, replace=True)

    def table(self, name: str) -> DataFrame:
        return self.catalog.get(name).rows

    # Statements

    def gql(self, query: str) -> Result:
        return self.slow.timed(query, lambda: self._run(parse(query)))

    def _run(self, s: t.Statement) -> Result:
        if isinstance(s, t.Select):
            governance.require(self.role, "read")
            return Result(lower.select(self.catalog, s, self.options))
        governance.require(self.role, "delete" if isinstance(s, t.Delete) else "write")
        if isinstance(s, t.Insert):
            self._only_kv(s.index)
            self.put(s.index, s.key, s.value)
            return Result(rows_affected=1)
        return Result(rows_affected=self._append(s.index, lower.changes(self.catalog, s, self.options)))

    def _only_kv(self, name: str) -> None:
        if self.catalog.get(name).kind != KV:
            raise InvalidArgument(f"index {name} takes no rows by statement")

    # Key-value calls

    def _append(self, index: str, rows: list[tuple] | DataFrame, txn_id: int = 0, check=None, pending: bool = False) -> int:
        changes = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, CHANGE)
        bad = changes.select(F.explode(problems(F.col("key"), F.col("value")))).first()
        if bad:
            raise InvalidArgument(bad[0])
        n = self.log(index).append(changes, txn_id, check, pending)
        if not pending:
            self._index_texts(index, changes)
        self._refresh(index)
        return n

    def _index_texts(self, index: str, changes: DataFrame) -> None:
        """Values written as NAME.TEXT(...) are searched under the index's name with ``.text``."""
        name = f"{index}.text"
        texts = changes.withColumn("text", wrapped_text(F.col("value")))
        new = texts.where("op = 'PUT' and text is not null").select("key", F.col("text").alias("value"))
        if name not in self._texts:
            if new.isEmpty():
                return
            self._texts[name] = TextIndex(self.spark, f"{self.path}/{name}")
        old = texts.where("op = 'DELETE' or text is null").select("key").join(self._texts[name].rows(), "key", "left_semi")
        if not old.isEmpty():
            self._texts[name].remove(old)
        if not new.isEmpty():
            self._texts[name].put(new)
        self._refresh(name)

    def put(self, index: str, key: str, value: str) -> None:
        governance.require(self.role, "write")
        self._append(index, [(key, value, "PUT")])

    def get(self, index: str, key: str) -> tuple[bool, str | None]:
        """(found, value)."""
        governance.require(self.role, "read")
        row = kv_ops.get(self.table(index), key).first()
        return (True, row["value"]) if row else (False, None)

    def delete(self, index: str, key: str) -> bool:
        """Whether there was such a key."""
        governance.require(self.role, "delete")
        found, _ = self.get(index, key) if self.role in (None, "admin", "writer") else (True, None)
        if found:
            self._append(index, [(key, None, "DELETE")])
        return found

    def get_range(self, index: str, start: str, end: str, limit: int | None = 10000, descending: bool = False) -> DataFrame:
        """start <= key < end; ``*`` leaves a side open."""
        governance.require(self.role, "read")
        return kv_ops.get_range(self.table(index), start, end, limit, descending)

    def bulk_put(self, index: str, rows: list[tuple[str, str]] | DataFrame) -> int:
        governance.require(self.role, "bulk")
        if isinstance(rows, DataFrame):
            return self._append(index, rows.select("key", "value", F.lit("PUT").alias("op")))
        kv_ops.check_bulk(len(rows))
        return self._append(index, [(k, v, "PUT") for k, v in rows])

    def bulk_delete(self, index: str, keys: list[str] | DataFrame) -> int:
        """How many of the keys there were."""
        governance.require(self.role, "bulk")
        if not isinstance(keys, DataFrame):
            kv_ops.check_bulk(len(keys))
            keys = self.spark.createDataFrame([(k,) for k in keys], "key string")
        gone = kv_ops.fetch(self.table(index), keys).select("key", F.lit(None).cast("string").alias("value"), F.lit("DELETE").alias("op"))
        return self._append(index, gone)

    def range_aggregates(self, index: str, start: str, end: str) -> DataFrame:
        governance.require(self.role, "read")
        return kv_ops.range_aggregates(self.table(index), start, end)

    def size(self, index: str) -> int:
        return self.table(index).count()

    def cursor(self, index: str, start: str = "*", end: str = "*"):
        """Rows of a range in order of the key, a partition at a time."""
        return kv_ops.between(self.table(index), start, end).orderBy("key").toLocalIterator()

    # Text and rectangles

    def text_search(self, index: str, query: str, limit: int | None = 1000) -> DataFrame:
        governance.require(self.role, "search")
        found = self.catalog.get(index)
        if found.postings is None:
            raise InvalidArgument(f"index {index} has no text index")
        return text_ops.search(found.postings, query, limit)

    def add_documents(self, index: str, docs: DataFrame) -> None:
        """Add (key, value) texts; those of a key there is already replace it."""
        governance.require(self.role, "write")
        if index in self._texts:
            self._texts[index].put(docs)
            self._refresh(index)
            return
        try:
            old = self.catalog.get(index)
        except NotFound:
            self.register(IndexDef(index, INVERTED, docs.select("key", "value")))
            return
        rows = kv_ops.without(old.rows, docs).unionByName(docs.select("key", "value"))
        pairs = old.postings.join(docs.select(F.col("key").alias("doc_key")).distinct(), "doc_key", "left_anti").select("term", "doc_key").unionByName(text_ops.postings(docs))
        self.catalog.add(IndexDef(index, INVERTED, rows, pairs), replace=True)

    def insert_spatial(self, index: str, rects: DataFrame) -> None:
        """Add (id, min_x, min_y, max_x, max_y, value)."""
        governance.require(self.role, "write")
        new = rects.select(F.col("id").cast("string").alias("key"), "value" if "value" in rects.columns else F.lit(None).cast("string").alias("value"), "min_x", "min_y", "max_x", "max_y")
        if index in self._rects:
            self._rects[index].put(new)
            self._refresh(index)
            return
        rows = new if index not in self.catalog.names() else self.catalog.get(index).rows.unionByName(new)
        self.catalog.add(IndexDef(index, SPATIAL, rows), replace=True)

    def delete_spatial(self, index: str, gone: DataFrame) -> None:
        """Remove rows of exactly these ids and rectangles."""
        governance.require(self.role, "delete")
        if index in self._rects:
            self._rects[index].remove(gone.withColumnRenamed("id", "key"))
            self._refresh(index)
            return
        rows = spatial.delete(self.catalog.get(index).rows.withColumnRenamed("key", "id"), gone).withColumnRenamed("id", "key")
        self.catalog.add(IndexDef(index, SPATIAL, rows.select("key", "value", "min_x", "min_y", "max_x", "max_y")), replace=True)

    # Transactions, snapshots, upkeep

    def begin(self, *indexes: str) -> Txn:
        """A transaction on one index or several."""
        governance.require(self.role, "write")
        return Txn(self, indexes, uuid4().int >> 66 or 1, seen={i: self.log(i).last_lsn() for i in indexes})

    def snapshot(self, index: str, path: str) -> DataFrame:
        log = self.log(index)
        return lifecycle.snapshot(log.read(), path, index, log.last_lsn())

    def restore(self, index: str, path: str) -> int:
        """Bring an index back from a snapshot; returns its LSN."""
        governance.require(self.role, "admin")
        rows, lsn = lifecycle.restore(self.spark, path, index)
        if index not in self._logs:
            self._logs[index] = MutationLog(self.spark, f"{self.path}/{index}", self.decisions)
        self._logs[index].load(rows, lsn)
        self._refresh(index)
        return lsn

    def compact(self, index: str) -> None:
        (self._texts.get(index) or self._rects.get(index) or self.log(index)).compact()
        self._refresh(index)
