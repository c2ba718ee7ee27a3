"""Statements to DataFrames. Catalyst plans; only the choice of table is made here.

A CONTAINS in the top-level AND chain of an inverted index is answered from
its postings, any other is a substring test. NEAR narrows the scan by boxes
that cover the circle and keeps the exact distance.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import geo
from ..functions.text import contains_text
from ..operators import text as text_ops
from ..sources.catalog import INVERTED, KV, SPATIAL, Catalog, IndexDef
from . import tree as t


@dataclass(frozen=True)
class Options:
    """Rows of a SELECT without LIMIT by kind of index (None: all), and NEAR by its box alone."""

    kv_limit: int | None = 10000
    other_limit: int | None = 1000
    near_box: bool = False


def _field(index: IndexDef, name: str) -> Column:
    if name not in index.columns and name not in index.rows.columns:
        raise InvalidArgument(f"index {index.name} has no field {name}")
    return F.col(name)


_OPS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def predicate(p: t.Predicate, index: IndexDef, options: Options = Options()) -> Column:
    """A two-valued condition on the rows of the index."""
    match p:
        case t.Compare(field, op, value):
            test = getattr(_field(index, field), _OPS[op])(F.lit(value))
            native = index.codec.bound(op, value) if index.codec and field == "key" else None
            return F.coalesce(test, F.lit(False)) if native is None else native & test
        case t.Between(field, low, high):
            test = _field(index, field).between(low, high)
            if index.codec and field == "key":
                for op, v in ((">=", low), ("<=", high)):
                    native = index.codec.bound(op, v)
                    test = test if native is None else native & test
            return test
        case t.Contains(field, query):
            name = field if field in index.columns or field in index.rows.columns else "value"
            if name != field and index.kind == KV:
                raise InvalidArgument(f"index {index.name} has no field {field}")
            return contains_text(F.col(name), query)
        case t.Near(lat, lon, radius):
            return _near(index, lat, lon, radius, options)
        case t.Within(min_lat, min_lon, max_lat, max_lon):
            _spatial(index)
            return geo.intersects(geo.rect(), tuple(map(F.lit, (min_lon, min_lat, max_lon, max_lat))))
        case t.And(a, b):
            return predicate(a, index, options) & predicate(b, index, options)
        case t.Or(a, b):
            return predicate(a, index, options) | predicate(b, index, options)
        case t.Not(a):
            return ~F.coalesce(predicate(a, index, options), F.lit(False))
    raise InvalidArgument(f"not a predicate: {p!r}")


def _spatial(index: IndexDef) -> None:
    if index.kind != SPATIAL:
        raise InvalidArgument(f"index {index.name} isn't spatial")


def _boxes(boxes) -> Column:
    return reduce(lambda a, b: a | b, (geo.intersects(geo.rect(), tuple(map(F.lit, b))) for b in boxes))


def _distance(lat: float, lon: float) -> Column:
    return geo.distance_to(geo.rect(), lat, lon)


def _near(index: IndexDef, lat: float, lon: float, radius: float, options: Options) -> Column:
    _spatial(index)
    if options.near_box:
        return _boxes([geo.near_box(lat, lon, radius)])
    return _boxes(geo.cover_boxes(lat, lon, radius)) & (_distance(lat, lon) <= F.lit(radius))


def matching(index: IndexDef, where: t.Predicate | None, options: Options = Options()) -> DataFrame:
    """Rows of the index that satisfy the predicate; text hits and NEAR add a score."""
    rest, rows, score = t.conjuncts(where), index.rows, None
    if index.kind == INVERTED:
        for p in [p for p in rest if isinstance(p, t.Contains)]:
            if index.postings is None:
                break
            hits = text_ops.matching_keys(index.postings, p.query)
            rows = rows.join(hits.withColumnRenamed("doc_key", "key"), "key", "left_semi")
            rest = [q for q in rest if q is not p]
            score = F.lit(1.0)
    for p in rest:
        rows = rows.where(predicate(p, index, options))
        if isinstance(p, t.Near):
            score = _distance(p.lat, p.lon)
    return rows if score is None else rows.withColumn("score", score)


def select(catalog: Catalog, s: t.Select, options: Options = Options()) -> DataFrame:
    """The rows of a SELECT: the columns asked for, all of the view's with ``*``, and the score of text and NEAR."""
    index = catalog.get(s.index)
    for name in s.columns:
        _field(index, name)
    rows = matching(index, s.where, options)
    if s.order:
        field, down = s.order
        column = _field(index, field)
        rows = rows.orderBy(column.desc() if down else column.asc(), *([F.col("key")] if field != "key" else []))
    limit = s.limit or (options.kv_limit if index.kind == KV else options.other_limit)
    if limit is not None:
        # Without an order the first keys are returned, so that the answer doesn't depend on the layout.
        rows = (rows if s.order else rows.orderBy("key")).limit(limit)
    wanted = list(s.columns or index.columns)
    return rows.select(*wanted, *(["score"] if "score" in rows.columns and not s.columns else []))


def changes(catalog: Catalog, s: t.Update | t.Delete, options: Options = Options()) -> DataFrame:
    """Keys a DELETE or UPDATE changes, as mutations (key, value, op)."""
    index = catalog.get(s.index)
    if index.kind != KV:
        raise InvalidArgument(f"index {index.name} takes no rows by statement")
    keys = matching(index, s.where, replace(options, kv_limit=None)).select("key")
    if isinstance(s, t.Delete):
        return keys.select("key", F.lit(None).cast("string").alias("value"), F.lit("DELETE").alias("op"))
    return keys.select("key", F.lit(s.value).alias("value"), F.lit("PUT").alias("op"))
