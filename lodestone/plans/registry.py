"""Driver queries over the driver's tables, each with the same question in SQL."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import PermissionDenied, Unavailable
from ..functions import geo, slots, values
from ..functions.text import terms
from ..operators import governance, kv, lifecycle, routing, spatial, wal
from ..operators.cluster import Cluster
from ..operators import text as text_ops
from ..sources import log as logs
from ..sources.catalog import INVERTED, KV, SPATIAL, Catalog, IndexDef, KeyCodec
from ..sources.indexes import SpatialIndex, TextIndex
from ..streaming import replica
from . import lower
from .parse import parse

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _shared(spark: SparkSession) -> str:
    """The folder the cluster names; a local one only where Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or "file://" + tempfile.mkdtemp(prefix="lodestone-")


ORDER_KEYS, DOC_KEYS, CUSTOMER_KEYS = KeyCodec("order:", "o_orderkey", 8), KeyCodec("doc:", "doc_id", 8), KeyCodec("customer:", "c_custkey", 8)


def _orders(spark, d, value="o_orderpriority"):
    rows = _read(spark, d, "orders").withColumn("key", ORDER_KEYS.encode()).withColumn("value", F.col(value).cast("string"))
    return IndexDef("orders", KV, rows, codec=ORDER_KEYS)


def _customers(spark, d):
    rows = _read(spark, d, "customer").withColumn("key", CUSTOMER_KEYS.encode()).withColumn("value", F.col("c_mktsegment"))
    return IndexDef("customers", KV, rows, codec=CUSTOMER_KEYS)


def _documents(spark, d):
    rows = _read(spark, d, "documents").select(DOC_KEYS.encode().alias("key"), F.col("text").alias("value"), "source")
    return IndexDef("documents", INVERTED, rows, text_ops.postings(rows, unique=True))


def _lineitem(spark, d):
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    key = F.concat(F.lit("line:"), pad("l_orderkey", 8), F.lit(":"), pad("l_partkey", 8), F.lit(":"), pad("l_suppkey", 8), F.lit(":"), F.col("l_linenumber").cast("string"))
    return IndexDef("lineitem", KV, _read(spark, d, "lineitem").select(key.alias("key"), F.col("l_returnflag").alias("value")))


def _geo(spark, d, table="customer", key="c_custkey", nation="c_nationkey"):
    x = (F.col(key) * 7919 % 36001) / F.lit(100.0) - 180
    y = (F.col(key) * 104729 % 18001) / F.lit(100.0) - 90
    size = (F.col(nation) % 5) / F.lit(10.0)
    rows = _read(spark, d, table).select("*", x.alias("min_x"), y.alias("min_y")).withColumn("max_x", F.col("min_x") + size).withColumn("max_y", F.col("min_y") + size)
    return rows.withColumn("key", F.col(key).cast("string"))


def _places(spark, d):
    return IndexDef("places", SPATIAL, _geo(spark, d).withColumn("value", F.col("c_mktsegment")))


def _log(spark, d):
    e = _read(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"), (F.col("event_id") + 1).alias("lsn"), (F.col("event_id") % 7).alias("txn_id"))


def _gql(text: str, *indexes, options: lower.Options = lower.Options()):
    def run(spark, d):
        catalog = Catalog()
        for make in indexes:
            catalog.add(make(spark, d))
        return lower.select(catalog, parse(text), options)

    return run


ORDERS_SQL = "(SELECT 'order:' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS key, o_orderpriority AS value, o_totalprice, o_orderdate FROM orders)"
CUSTOMERS_SQL = "(SELECT 'customer:' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key, c_mktsegment AS value, c_name, c_acctbal FROM customer)"
DOCS_SQL = "(SELECT 'doc:' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS key, text AS value, source FROM documents)"
LOG_SQL = "(SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, event_id + 1 AS lsn, event_id % 7 AS txn_id FROM events)"
LATEST_SQL = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS rn FROM {0}) WHERE rn = 1)"


def _geo_sql(table, key, nation):
    return f"(SELECT *, min_x + size AS max_x, min_y + size AS max_y, CAST({key} AS VARCHAR) AS key FROM (SELECT *, (({key}*7919) % 36001) / CAST(100 AS DOUBLE) - 180 AS min_x, (({key}*104729) % 18001) / CAST(100 AS DOUBLE) - 90 AS min_y, ({nation} % 5) / CAST(10 AS DOUBLE) AS size FROM {table}))"


GEO_SQL = _geo_sql("customer", "c_custkey", "c_nationkey")
SUPPLIER_GEO_SQL = _geo_sql("supplier", "s_suppkey", "s_nationkey")
_STOP = "'" + "','".join(("a", "an", "the", "is", "are", "and", "or", "to", "in", "of", "for", "with", "on", "at", "this", "that", "it", "be", "have", "has")) + "'"
_STEM = "CASE WHEN t LIKE '%ing' AND length(t) > 3 THEN substr(t, 1, length(t) - 3) WHEN t LIKE '%s' AND length(t) > 1 THEN substr(t, 1, length(t) - 1) WHEN t LIKE '%ed' AND length(t) > 2 THEN substr(t, 1, length(t) - 2) ELSE t END"
TERMS_SQL = f"(SELECT DISTINCT term, key AS doc_key FROM (SELECT key, {_STEM} AS term FROM (SELECT key, unnest(regexp_extract_all(lower(value), '\\b[a-z0-9]+\\b')) AS t FROM {DOCS_SQL})) WHERE term NOT IN ({_STOP}) AND term <> '')"


# Scans

@query(f"SELECT key, value FROM {ORDERS_SQL} WHERE key = 'order:00000123'")
def kv_point_get(spark, d):
    return _gql("SELECT * FROM orders WHERE key = 'order:00000123'", _orders)(spark, d)


@query(f"SELECT key, value FROM {ORDERS_SQL} WHERE key >= 'order:00000100' AND key < 'order:00000200'")
def kv_range_half_open(spark, d):
    rows = _orders(spark, d).rows
    native = ORDER_KEYS.bound(">=", "order:00000100") & ORDER_KEYS.bound("<", "order:00000200")
    return kv.get_range(rows.where(native), "order:00000100", "order:00000200", None).select("key", "value")


@query(f"SELECT key, value FROM {ORDERS_SQL} WHERE key BETWEEN 'order:00000100' AND 'order:00000200' ORDER BY key DESC LIMIT 50")
def gql_between_desc_limit(spark, d):
    return _gql("SELECT * FROM orders WHERE key BETWEEN 'order:00000100' AND 'order:00000200' ORDER BY key DESC LIMIT 50", _orders)(spark, d)


@query("SELECT 'line:' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || ':' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || ':' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || ':' || CAST(l_linenumber AS VARCHAR) AS key, l_returnflag AS value FROM lineitem ORDER BY key LIMIT 10000")
def gql_full_scan_cap(spark, d):
    return _gql("SELECT * FROM lineitem", _lineitem)(spark, d)


@query(f"SELECT count(*) AS n FROM {ORDERS_SQL}")
def kv_full_scan_sentinel(spark, d):
    return kv.between(_orders(spark, d).rows, "*", "*").agg(F.count("*").alias("n"))


@query(f"SELECT key, value FROM {ORDERS_SQL} WHERE starts_with(key, 'order:0000012')")
def kv_prefix_scan(spark, d):
    return kv.prefix(_orders(spark, d).rows, "order:0000012", ORDER_KEYS).select("key", "value")


@query(f"SELECT key, value FROM {ORDERS_SQL} WHERE key > 'order:00000500' ORDER BY key LIMIT 25")
def kv_page(spark, d):
    return kv.page(_orders(spark, d).rows, "order:00000500", 25, ORDER_KEYS).select("key", "value")


# Predicates

for _name, _op in (("eq", "="), ("neq", "!="), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    QUERIES[f"gql_{_name}"] = _gql(f"SELECT * FROM customers WHERE value {_op} 'BUILDING'", _customers, options=lower.Options(None, None))
    ORACLE_SQL[f"gql_{_name}"] = f"SELECT key, value FROM {CUSTOMERS_SQL} WHERE value {_op} 'BUILDING'"


@query(f"SELECT key, value FROM {CUSTOMERS_SQL} WHERE (value = 'BUILDING' OR key < 'customer:00000300') AND NOT (value >= 'M' AND key BETWEEN 'customer:00000100' AND 'customer:00000200')")
def gql_and_or_not(spark, d):
    return _gql("SELECT * FROM customers WHERE (value = 'BUILDING' OR key < 'customer:00000300') AND NOT (value >= 'M' AND key BETWEEN 'customer:00000100' AND 'customer:00000200')", _customers, options=lower.Options(None, None))(spark, d)


@query(f"SELECT value, c_name FROM {CUSTOMERS_SQL} WHERE key <= 'customer:00000050'")
def gql_projection(spark, d):
    return _gql("SELECT value, c_name FROM customers WHERE key <= 'customer:00000050'", _customers, options=lower.Options(None))(spark, d)


@query(f"SELECT key, value FROM {ORDERS_SQL} WHERE key = 'order:00000007' UNION SELECT key, value FROM {ORDERS_SQL} WHERE key > 'order:00014990'")
def gql_or_union(spark, d):
    return _gql("SELECT * FROM orders WHERE key = 'order:00000007' OR key > 'order:00014990'", _orders, options=lower.Options(None))(spark, d)


# Text

@query(f"SELECT DISTINCT doc_key AS key, CAST(1.0 AS DOUBLE) AS score FROM {TERMS_SQL} WHERE term IN ('tion', 'moron') ORDER BY key LIMIT 1000")
def gql_contains_index(spark, d):
    return _gql("SELECT * FROM documents WHERE CONTAINS(body, 'Tions morons')", _documents)(spark, d).select("key", "score")


@query(f"SELECT key, source FROM {DOCS_SQL} WHERE contains(lower(value), 'moron') OR source = 'src3'")
def gql_contains_residual(spark, d):
    return _gql("SELECT key, source FROM documents WHERE CONTAINS(value, 'MORON') OR source = 'src3'", _documents, options=lower.Options(None, None))(spark, d)


@query(f"SELECT term, count(*) AS df FROM {TERMS_SQL} GROUP BY term")
def text_terms_df(spark, d):
    return text_ops.document_frequency(_documents(spark, d).postings)


@query(f"SELECT term, string_agg(doc_key, ',' ORDER BY doc_key) AS doc_keys, count(*) AS num_keys FROM {TERMS_SQL} GROUP BY term")
def text_postings(spark, d):
    return text_ops.posting_lists(_documents(spark, d).postings).select("term", F.array_join("doc_keys", ",").alias("doc_keys"), F.col("num_keys").cast("long").alias("num_keys"))


@query(f"SELECT term, count(*) AS num_keys, min(doc_key) AS first_key FROM {TERMS_SQL} GROUP BY term")
def text_posting_chunks(spark, d):
    chunks = text_ops.posting_chunks(_documents(spark, d).postings, 100)
    return chunks.groupBy("term").agg(F.sum(F.size("doc_keys")).alias("num_keys"), F.min(F.get("doc_keys", F.lit(0))).alias("first_key"))


@query(f"SELECT DISTINCT doc_key AS key, CAST(1.0 AS DOUBLE) AS score FROM {TERMS_SQL} WHERE term IN ('clown', 'tra', 'trash') ORDER BY key LIMIT 20")
def text_search(spark, d):
    return text_ops.search(_documents(spark, d).postings, "the Clowns, trash tra!", 20)


@query(f"SELECT key, source, length(value) AS n FROM {DOCS_SQL} WHERE key IN (SELECT doc_key FROM {TERMS_SQL} WHERE term = 'idiot')")
def text_fetch_values(spark, d):
    index = _documents(spark, d)
    return kv.fetch(index.rows, text_ops.matching_keys(index.postings, "idiot").withColumnRenamed("doc_key", "key")).select("key", "source", F.char_length("value").cast("long").alias("n"))


@query(f"SELECT key, len(terms) AS n_terms, array_to_string(terms, ' ') AS terms FROM (SELECT key, list_filter(list_transform(regexp_extract_all(lower(value), '\\b[a-z0-9]+\\b'), lambda t: {_STEM}), lambda t: t NOT IN ({_STOP}) AND t <> '') AS terms FROM {DOCS_SQL})")
def text_tokenize(spark, d):
    own = _read(spark, d, "documents").select(DOC_KEYS.encode().alias("key"), terms(F.col("text")).alias("t"))
    return own.select("key", F.size("t").cast("long").alias("n_terms"), F.array_join("t", " ").alias("terms"))


# Rectangles

@query(f"SELECT key, value FROM (SELECT *, c_mktsegment AS value FROM {GEO_SQL}) WHERE min_x <= 20 AND max_x >= -30 AND min_y <= 60 AND max_y >= 10")
def gql_within(spark, d):
    return _gql("SELECT key, value FROM places WHERE WITHIN(10, -30, 60, 20)", _places, options=lower.Options(None, None))(spark, d)


def _away(lat, lon):
    """Metres of a point from (48, 2), in SQL."""
    return f"2 * 6371000.0 * asin(least(1.0, sqrt(power(sin(radians(({lat}) - 48.0) / 2), 2) + cos(radians(48.0)) * cos(radians({lat})) * power(sin(radians(({lon}) - 2.0) / 2), 2))))"


def _clamped(lat):
    return f"greatest(min_y, least({lat}, max_y))"


def _foot(side):
    return _clamped(f"degrees(atan2(sin(radians(48.0)), cos(radians(48.0)) * cos(radians({side} - 2.0))))")


# The nearest point of a rectangle: on the centre's meridian if it spans that, else on one of its sides.
_SIDE = "least(" + ", ".join(_away(lat, side) for side in ("min_x", "max_x") for lat in (_foot(side), "min_y", "max_y")) + ")"
_NEAR = f"CASE WHEN (min_x <= 2 AND max_x >= 2) OR (min_x <= 362 AND max_x >= 362) OR (min_x <= -358 AND max_x >= -358) THEN {_away(_clamped('48.0'), '2.0')} ELSE {_SIDE} END"


@query(f"SELECT key, round(dist, 3) AS score FROM (SELECT key, {_NEAR} AS dist FROM {GEO_SQL}) WHERE dist <= 1500000")
def gql_near(spark, d):
    return _gql("SELECT * FROM places WHERE NEAR(48, 2, 1500000)", _places, options=lower.Options(None, None))(spark, d).select("key", F.round("score", 3).alias("score"))


@query(f"SELECT key FROM {GEO_SQL} WHERE min_x <= 2 + 500000 / (111000 * cos(radians(48.0))) AND max_x >= 2 - 500000 / (111000 * cos(radians(48.0))) AND min_y <= 48 + 500000 / 111000.0 AND max_y >= 48 - 500000 / 111000.0")
def gql_near_bbox(spark, d):
    return _gql("SELECT key FROM places WHERE NEAR(48, 2, 500000)", _places, options=lower.Options(None, None, near_box=True))(spark, d)


@query(f"SELECT a.key AS a_key, b.key AS b_key FROM {GEO_SQL} a JOIN {SUPPLIER_GEO_SQL} b ON a.min_x <= b.max_x + 2 AND a.max_x >= b.min_x AND a.min_y <= b.max_y + 2 AND a.max_y >= b.min_y")
def spatial_join(spark, d):
    sides = ["key", *geo.SIDES]
    b = _geo(spark, d, "supplier", "s_suppkey", "s_nationkey").withColumn("max_x", F.col("max_x") + 2).withColumn("max_y", F.col("max_y") + 2)
    return spatial.join(_geo(spark, d).select(*sides), b.select(*sides), 2.0).select("a_key", "b_key")


@query(f"SELECT c_mktsegment AS segment, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM {GEO_SQL} GROUP BY c_mktsegment")
def rect_mbr(spark, d):
    return spatial.bounds(_geo(spark, d), "c_mktsegment").withColumnRenamed("c_mktsegment", "segment")


@query(f"SELECT key, round((max_x - min_x) * (max_y - min_y), 9) AS area, min_x <= 0 AND min_y <= 0 AND max_x >= 0 AND max_y >= 0 AS holds_origin, round((greatest(max_x, 1) - least(min_x, 0)) * (greatest(max_y, 1) - least(min_y, 0)) - (max_x - min_x) * (max_y - min_y), 6) AS enlargement FROM {GEO_SQL}")
def rect_functions(spark, d):
    r, unit = geo.rect(), tuple(map(F.lit, (0.0, 0.0, 1.0, 1.0)))
    origin = tuple(map(F.lit, (0.0, 0.0, 0.0, 0.0)))
    return _geo(spark, d).select("key", F.round(geo.area(r), 9).alias("area"), geo.contains(r, origin).alias("holds_origin"), F.round(geo.enlargement(r, unit), 6).alias("enlargement"))


@query(f"SELECT key FROM {GEO_SQL} WHERE NOT (c_nationkey = 3)")
def spatial_delete(spark, d):
    rows = _geo(spark, d).withColumnRenamed("key", "id")
    return spatial.delete(rows, rows.where("c_nationkey = 3").select("id", *geo.SIDES)).select(F.col("id").alias("key"))


# Range aggregates

def _aggregates(spark, d):
    rows = _orders(spark, d, "o_totalprice")
    native = ORDER_KEYS.bound(">=", "order:00001000") & ORDER_KEYS.bound("<", "order:00009000")
    return kv.range_aggregates(rows.rows.where(native), "order:00001000", "order:00009000")


_RANGE = f"FROM {ORDERS_SQL} WHERE key >= 'order:00001000' AND key < 'order:00009000'"


@query(f"SELECT count(*) AS count {_RANGE}")
def agg_count_range(spark, d):
    return _aggregates(spark, d).select("count")


@query(f"SELECT round(sum(o_totalprice), 2) AS sum {_RANGE}")
def agg_sum_range(spark, d):
    return _aggregates(spark, d).select(F.round("sum", 2).alias("sum"))


@query(f"SELECT min(o_totalprice) AS min {_RANGE}")
def agg_min_range(spark, d):
    return _aggregates(spark, d).select("min")


@query(f"SELECT max(o_totalprice) AS max {_RANGE}")
def agg_max_range(spark, d):
    return _aggregates(spark, d).select("max")


@query("SELECT sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS sum FROM events")
def agg_json_sum(spark, d):
    rows = _read(spark, d, "events").select(F.lpad(F.col("event_id").cast("string"), 10, "0").alias("key"), F.col("props").alias("value"))
    return kv.json_sum(rows, "$.k")


# Mutations

@query(f"SELECT key, value, op, lsn FROM {LATEST_SQL.format(LOG_SQL)}")
def mut_upsert_latest(spark, d):
    return logs.latest(_log(spark, d)).select("key", "value", "op", "lsn")


@query(f"SELECT key, value FROM {LATEST_SQL.format(LOG_SQL)} WHERE op <> 'DELETE'")
def mut_delete_view(spark, d):
    return logs.live(_log(spark, d)).select("key", "value")


@query(f"SELECT key, CASE WHEN value = 'BUILDING' AND key < 'customer:00000500' THEN 'moved' ELSE value END AS value FROM {CUSTOMERS_SQL}")
def mut_update_predicate(spark, d):
    index = _customers(spark, d)
    where = lower.predicate(parse("SELECT * FROM customers WHERE value = 'BUILDING' AND key < 'customer:00000500'").where, index)
    return kv.updated(index.rows, where, F.lit("moved")).select("key", "value")


@query(f"SELECT key, value FROM {ORDERS_SQL} WHERE key NOT IN (SELECT key FROM {ORDERS_SQL} WHERE value = '1-URGENT')")
def mut_bulk_delete(spark, d):
    rows = _orders(spark, d).rows
    return kv.without(rows, rows.where("value = '1-URGENT'")).select("key", "value")


@query(f"SELECT key FROM {ORDERS_SQL} WHERE value = '1-URGENT' AND key BETWEEN 'order:00000010' AND 'order:00004000'")
def mut_delete_predicate_keys(spark, d):
    catalog = Catalog()
    catalog.add(_orders(spark, d))
    return lower.changes(catalog, parse("DELETE FROM orders WHERE value = '1-URGENT' AND key BETWEEN 'order:00000010' AND 'order:00004000'")).select("key")


@query(f"SELECT key, value FROM {LATEST_SQL.format(f'(SELECT * FROM {LOG_SQL} WHERE txn_id = 0 OR txn_id % 3 <> 2)')} WHERE op <> 'DELETE'")
def txn_committed_view(spark, d):
    log = _log(spark, d)
    commits = log.where("txn_id % 3 <> 2 and txn_id <> 0").select("txn_id").distinct()
    return logs.live(logs.committed(log, commits)).select("key", "value")


# The change stream

SEGMENTS_SQL = "(SELECT CAST(floor(event_id / 1000) AS BIGINT) AS segment_id, min(event_id + 1) AS start_lsn, max(event_id + 1) AS end_lsn, count(*) AS records FROM events GROUP BY 1)"


def _stream(spark, d):
    return _read(spark, d, "events").select((F.col("event_id") + 1).alias("lsn"), F.floor(F.col("event_id") / 1000).cast("long").alias("segment_id"), "ts", "event_id")


@query(f"SELECT * FROM {SEGMENTS_SQL}")
def wal_segments(spark, d):
    return wal.segments(_stream(spark, d))


@query(f"SELECT q.event_id, q.lsn, s.segment_id FROM (SELECT event_id, (event_id * 13) % (SELECT max(event_id) + 2001 FROM events) AS lsn FROM events) q ASOF LEFT JOIN {SEGMENTS_SQL} s ON q.lsn >= s.start_lsn")
def wal_segment_asof(spark, d):
    """Every event asks, for LSNs over the whole log, before its first segment and beyond its last one."""
    events = _read(spark, d, "events").select("event_id")
    end = F.broadcast(events.agg((F.max("event_id") + 2001).alias("end")))
    asked = events.crossJoin(end).select("event_id", (F.col("event_id") * 13 % F.col("end")).alias("lsn"))
    return wal.segment_of(asked, wal.segments(_stream(spark, d)))


def _consumers(spark):
    return spark.createDataFrame([("a", 7300, True), ("b", 4200, True), ("c", 100, False)], "name string, restart_lsn long, is_active boolean")


@query(f"SELECT segment_id, start_lsn, next_lsn FROM (SELECT *, lead(start_lsn) OVER (ORDER BY segment_id) AS next_lsn FROM {SEGMENTS_SQL}) WHERE next_lsn <= 4200")
def wal_prune_list(spark, d):
    return wal.prunable(wal.segments(_stream(spark, d)), wal.safe_lsn(_consumers(spark), 9000))


@query("SELECT * FROM (VALUES ('a', CAST(7300 AS BIGINT), true, CAST(2700 AS BIGINT)), ('b', 4200, true, 5800), ('c', 100, false, 9900)) t(name, restart_lsn, is_active, lag)")
def wal_slot_lag(spark, d):
    return wal.slot_lag(_consumers(spark), 10000)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS lsn FROM events")
def wal_lsn_numbering(spark, d):
    rows = _read(spark, d, "events").select("event_id", "ts")
    return logs.numbered(rows, "ts", "event_id").select("event_id", F.col("lsn").cast("long").alias("lsn"))


@query("SELECT event_id, event_id + 1 AS lsn FROM events WHERE event_id + 1 >= 9500")
def wal_from_lsn(spark, d):
    return wal.from_lsn(_stream(spark, d), 9500).select("event_id", "lsn")


@query("SELECT lsn, split_part(data, '|', 1) AS doc_key, substr(data, strpos(data, '|') + 1) AS text FROM (SELECT event_id + 1 AS lsn, CAST(user_id AS VARCHAR) || '|' || event_type || ' ' || props AS data FROM events)")
def wal_text_records(spark, d):
    e = _read(spark, d, "events")
    data = F.encode(F.concat(F.col("user_id").cast("string"), F.lit("\u0000"), F.col("event_type"), F.lit(" "), F.col("props")), "UTF-8")
    return wal.decode_text(e.select((F.col("event_id") + 1).alias("lsn"), data.alias("data")))


@query("SELECT event_id + 1 AS lsn, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, CAST(user_id AS VARCHAR) AS id, CAST(user_id AS DOUBLE) AS min_x, 0.0::DOUBLE AS min_y, CAST(user_id AS DOUBLE) AS max_x, 1.0::DOUBLE AS max_y FROM events")
def wal_spatial_records(spark, d):
    e = _read(spark, d, "events")
    x = F.col("user_id").cast("double")
    body = F.to_json(F.struct(x.alias("min_x"), F.lit(0.0).alias("min_y"), x.alias("max_x"), F.lit(1.0).alias("max_y"), F.col("user_id").cast("string").alias("data_id")))
    kind = F.when(F.col("event_type") == "error", "RTreeDelete").otherwise("RTreeInsert")
    return wal.decode_spatial(e.select((F.col("event_id") + 1).alias("lsn"), kind.alias("type"), F.encode(body, "UTF-8").alias("data")))


@query(f"SELECT key, value FROM {LATEST_SQL.format(LOG_SQL)} WHERE op <> 'DELETE'")
def snapshot_catch_up(spark, d):
    log = _log(spark, d)
    base = logs.live(log.where("lsn <= 5000")).select("key", "value", "lsn")
    # A key deleted after the snapshot has a tombstone in the log; one deleted before isn't in it.
    return logs.caught_up(base, log, 5000).select("key", "value")


@query("SELECT user_id, event_id, ts, prev_ts FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts FROM events) WHERE ts > prev_ts + INTERVAL 6 HOUR")
def liveness_gaps(spark, d):
    return wal.liveness(_read(spark, d, "events"), "user_id", "ts", "event_id", "6 HOUR").select("user_id", "event_id", "ts", "prev_ts")


@query(f"SELECT key, value FROM {LATEST_SQL.format(LOG_SQL)} WHERE op <> 'DELETE'")
def stream_replica_apply(spark, d):
    where = _shared(spark) + f"/replica-{abs(hash((d, id(spark))))}-{next(_turn)}"
    _log(spark, d).select("key", "value", "op", "lsn", F.col("txn_id").cast("long").alias("txn_id")).repartition(4).write.mode("overwrite").parquet(f"{where}/log")
    replica.apply(replica.source(spark, f"{where}/log", max_files=2), f"{where}/view", f"{where}/checkpoint").awaitTermination()
    return replica.replica(spark, f"{where}/view").select("key", "value")


_turn = iter(range(10**9))


# Routing

_BYTES = "list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, CAST(i AS INTEGER), 1)) AS BIGINT))"
_KEYS_SQL = "(SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS key FROM customer)"
_CRC_SQL = f"xor(list_reduce(flatten(list_transform({_BYTES}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])), lambda h, b: CASE WHEN b >= 0 THEN xor(h, b) WHEN h % 2 = 1 THEN xor(h // 2, 3988292384) ELSE h // 2 END, 4294967295::BIGINT), 4294967295)"
_FNV_SQL = f"list_reduce({_BYTES}, lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT)"
NODES = [("n1", 0, 2), ("n2", 3, 4), ("n3", 5, 7)]
_SLOTS_SQL = "(VALUES (0, 'n1'), (1, 'n1'), (2, 'n1'), (3, 'n2'), (4, 'n2'), (5, 'n3'), (6, 'n3'), (7, 'n3')) s(slot, primary_node)"


def _keys(spark, d):
    return _read(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"))


def _assignments(spark):
    return spark.createDataFrame([(s, n) for n, a, b in NODES for s in range(a, b + 1)], "slot int, primary string")


@query(f"SELECT key, CAST({_CRC_SQL} % 8 AS INTEGER) AS slot FROM {_KEYS_SQL}")
def slot_crc32(spark, d):
    return _keys(spark, d).select("key", slots.slot_crc32(F.col("key")).alias("slot"))


@query(f"SELECT key, CAST({_FNV_SQL} % 16384 AS INTEGER) AS slot FROM {_KEYS_SQL}")
def slot_fnv(spark, d):
    return _keys(spark, d).select("key", slots.slot_fnv(F.col("key")).alias("slot"))


@query(f"SELECT k.key, k.slot, s.primary_node AS node FROM (SELECT key, CAST({_CRC_SQL} % 8 AS INTEGER) AS slot FROM {_KEYS_SQL}) k JOIN {_SLOTS_SQL} ON k.slot = s.slot")
def route_slots(spark, d):
    return routing.assigned(_keys(spark, d), _assignments(spark)).select("key", "slot", F.col("primary").alias("node"))


@query(f"SELECT key, slot, CASE WHEN slot <= 4095 THEN 'n1' WHEN slot <= 12000 THEN 'n2' ELSE 'n3' END AS node FROM (SELECT key, CAST({_FNV_SQL} % 16384 AS INTEGER) AS slot FROM {_KEYS_SQL})")
def route_keys(spark, d):
    written = spark.createDataFrame([("n1", "0-4095"), ("n2", "4096-12000"), ("n3", "12001-16383"), ("bad", "9-3")], "primary string, range string")
    keys = _keys(spark, d).withColumn("slot", slots.slot_fnv(F.col("key")))
    return routing.ranged(keys, routing.parsed(written, "range")).select("key", "slot", F.col("primary").alias("node"))


@query("SELECT * FROM (VALUES ('n1', CAST(3 AS BIGINT)), ('n2', 2), ('n3', 3)) t(node, load)")
def node_load(spark, d):
    return routing.load(_assignments(spark))


@query("SELECT 'n2' AS node, CAST(2 AS BIGINT) AS load")
def least_loaded(spark, d):
    return routing.least_loaded(routing.load(_assignments(spark)))


@query("SELECT * FROM (VALUES ('n1', '0-2'), ('n2', '3-4'), ('n3', '5-7')) t(node, ranges)")
def node_ranges(spark, d):
    rows = spark.createDataFrame(NODES, "primary string, first int, last int")
    return routing.ranges_of(rows).select(F.col("primary").alias("node"), F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["first"], r["last"])), ",").alias("ranges"))


@query("SELECT * FROM (VALUES ('s0', 'n1', 'n2'), ('s1', 'n1', 'n3'), ('s2', 'n1', 'n2')) t(shard, source, target)")
def rebalance_moves(spark, d):
    moves = routing.rebalance({f"s{i}": "n1" for i in range(5)}, ["n1", "n2", "n3"])
    return spark.createDataFrame(moves, "shard string, source string, target string")


# Lifecycle and governance

@query(f"SELECT key, value, 'archived' AS tier FROM {ORDERS_SQL} WHERE starts_with(key, 'order:000001') UNION ALL SELECT key, value, 'hot' FROM {ORDERS_SQL} WHERE NOT starts_with(key, 'order:000001')")
def archive_prefix(spark, d):
    gone, left = lifecycle.archive(_orders(spark, d).rows.select("key", "value"), "order:000001")
    return gone.withColumn("tier", F.lit("archived")).unionByName(left.withColumn("tier", F.lit("hot")))


@query(f"SELECT key, o_orderdate FROM {ORDERS_SQL} WHERE TIMESTAMP '1999-01-01' - o_orderdate >= INTERVAL 90 DAY AND right(key, 1) <> '7'")
def dlm_age_candidates(spark, d):
    rows = _orders(spark, d).rows.withColumn("pinned", F.endswith("key", F.lit("7"))).withColumn("created", F.lit(None).cast("timestamp"))
    return lifecycle.aged(rows, F.to_timestamp(F.lit("1999-01-01 00:00:00")), "90d", modified="o_orderdate").select("key", "o_orderdate")


@query("SELECT source AS namespace, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS keys FROM documents GROUP BY source")
def quota_usage(spark, d):
    return kv.usage(_documents(spark, d).rows, F.col("source"))


@query("SELECT source AS namespace, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS keys FROM documents GROUP BY source HAVING sum(strlen(text)) > 120000 OR count(*) > 100000")
def quota_over(spark, d):
    return governance.over_quota(kv.usage(_documents(spark, d).rows, F.col("source")), 120000, 100000)


@query("SELECT event_id, bytes_so_far, keys_so_far, bytes_so_far <= 400 AND keys_so_far <= 50 AS within FROM (SELECT event_id, CAST(sum(strlen(props)) OVER w AS BIGINT) AS bytes_so_far, count(*) OVER w AS keys_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))")
def quota_storage(spark, d):
    rows = _read(spark, d, "events").withColumn("size", F.octet_length("props"))
    return governance.storage_quota(rows, "user_id", "event_id", "size", 400, 50).select("event_id", "bytes_so_far", "keys_so_far", "within")


@query("SELECT event_id, ts, value FROM events WHERE value >= 60 ORDER BY ts DESC, event_id LIMIT 1000")
def slow_query_log(spark, d):
    return governance.slow_queries(_read(spark, d, "events"), "value", 60.0, "ts", 1000, "event_id").select("event_id", "ts", "value")


@query(f"SELECT key, strlen(value) AS bytes, strlen(value) <= 16384 AS good FROM {DOCS_SQL}")
def kv_validate(spark, d):
    good, bad = kv.validate(_documents(spark, d).rows)
    size = F.octet_length("value").cast("long").alias("bytes")
    return good.select("key", size, F.lit(True).alias("good")).unionByName(bad.select("key", size, F.lit(False).alias("good")))


_TURNS = "asked AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events)"


@query(
    f"""WITH RECURSIVE {_TURNS},
state AS (SELECT *, true AS admitted, CAST(4 AS DOUBLE) AS tokens FROM asked WHERE turn = 1
  UNION ALL SELECT event_id, user_id, ts, us, turn, had >= 1, had - CASE WHEN had >= 1 THEN 1 ELSE 0 END
  FROM (SELECT a.*, least(CAST(5 AS DOUBLE), s.tokens + (a.us - s.us) / CAST(1000000 AS DOUBLE) * (CAST(1 AS DOUBLE) / CAST(3600 AS DOUBLE))) AS had FROM state s JOIN asked a ON a.user_id = s.user_id AND a.turn = s.turn + 1))
SELECT event_id, user_id, ts, admitted, round(tokens, 6) AS tokens FROM state"""
)
def token_bucket(spark, d):
    rows = _read(spark, d, "events").select("event_id", "user_id", "ts")
    return governance.admit(rows, "user_id", "ts", "event_id", rate=1 / 3600, burst=5.0).withColumn("tokens", F.round("tokens", 6))


@query(
    f"""WITH RECURSIVE {_TURNS},
state AS (SELECT *, us AS opened, 1 AS n, true AS admitted FROM asked WHERE turn = 1
  UNION ALL SELECT a.event_id, a.user_id, a.ts, a.us, a.turn, CASE WHEN a.us - s.opened >= 1000000 THEN a.us ELSE s.opened END,
    CASE WHEN a.us - s.opened >= 1000000 THEN 1 ELSE s.n + 1 END, a.us - s.opened >= 1000000 OR s.n < 1
  FROM state s JOIN asked a ON a.user_id = s.user_id AND a.turn = s.turn + 1)
SELECT event_id, user_id, ts, admitted FROM state"""
)
def request_quota(spark, d):
    return governance.request_quota(_read(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 1)


@query("SELECT event_type AS name, CASE WHEN value <= 5 THEN 5.0::DOUBLE WHEN value <= 25 THEN 25.0::DOUBLE WHEN value <= 50 THEN 50.0::DOUBLE END AS at_most, count(*) AS calls FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def latency_histogram(spark, d):
    return governance.latency_histogram(_read(spark, d, "events"), "event_type", "value", (5.0, 25.0, 50.0))


# Writes, by the engine in a folder of its own

def _engine(spark, d) -> Engine:
    return Engine(spark, f"{_shared(spark)}/engine-{uuid4().hex}")


def _customer_rows(spark, d):
    return _customers(spark, d).rows.select("key", "value")


@query(f"""SELECT key, CASE key WHEN 'customer:00000003' THEN 'put' WHEN 'customer:00000004' THEN 'set' ELSE value END AS value FROM {CUSTOMERS_SQL}
WHERE key NOT IN ('customer:00000001', 'customer:00000002') AND NOT (value = 'BUILDING' AND key > 'customer:00000050')
UNION ALL SELECT 'new', 'inserted'""")
def engine_writes(spark, d):
    """Bulk puts, INSERT, Put, Delete, DELETE by key and by predicate, UPDATE, compaction."""
    e = _engine(spark, d)
    e.create("c")
    e.bulk_put("c", _customer_rows(spark, d))
    e.gql("INSERT INTO c (key, value) VALUES ('new', 'inserted')")
    e.put("c", "customer:00000003", "put")
    e.delete("c", "customer:00000001")
    e.gql("DELETE FROM c WHERE key = 'customer:00000002'")
    e.compact("c")
    e.gql("DELETE FROM c WHERE value = 'BUILDING' AND key > 'customer:00000050'")
    e.gql("UPDATE c SET value = 'set' WHERE key = 'customer:00000004'")
    return e.table("c").select("key", "value")


@query(f"SELECT key, value, (SELECT count(*) FROM customer) AS size FROM {CUSTOMERS_SQL} WHERE key >= 'customer:00000010' AND key < 'customer:00000100'")
def engine_cursor(spark, d):
    e = _engine(spark, d)
    e.create("c")
    e.bulk_put("c", _customer_rows(spark, d))
    rows = [(r["key"], r["value"]) for r in e.cursor("c", "customer:00000010", "customer:00000100")]
    return spark.createDataFrame(rows, "key string, value string").withColumn("size", F.lit(e.size("c")).cast("long"))


@query("SELECT * FROM (VALUES ('u', 'a', '1'), ('w', 'b', '2')) t(name, key, value)")
def txn_over_indexes(spark, d):
    """One transaction over two indexes commits; one that met its key aborts, one is aborted, one is never decided."""
    e = _engine(spark, d)
    for name in ("u", "w"):
        e.create(name)
    one, two, three, four = (e.begin("u", "w") for _ in range(4))
    one.put("a", "1", "u")
    one.put("b", "2", "w")
    two.put("a", "x", "u")
    two.put("z", "x", "w")
    three.put("c", "3", "u")
    four.put("d", "4", "w")
    one.commit()
    try:
        two.commit()
    except Unavailable:
        pass
    three.prepare()
    three.abort()
    four.prepare()
    e.put("u", "e", "5")
    e.delete("u", "e")
    return e.table("u").select(F.lit("u").alias("name"), "key", "value").unionByName(e.table("w").select(F.lit("w").alias("name"), "key", "value"))


_CHANGED_SQL = DOCS_SQL.replace("text AS value", "CASE WHEN doc_id % 10 = 0 THEN 'replaced moronic words' ELSE text END AS value")


@query(f"SELECT DISTINCT doc_key AS key, CAST(1.0 AS DOUBLE) AS score FROM {TERMS_SQL.replace(DOCS_SQL, _CHANGED_SQL)} WHERE term IN ('tion', 'moronic') AND doc_key NOT LIKE '%5'")
def text_index_stored(spark, d):
    """A text index on disk: all documents added, some replaced, compacted, some removed, searched."""
    e = _engine(spark, d)
    e.create_text("t")
    docs = _documents(spark, d).rows
    e.add_documents("t", docs)
    e.add_documents("t", docs.where("key like '%0'").select("key", F.lit("replaced moronic words").alias("value")))
    e.compact("t")
    e._texts["t"].remove(docs.where("key like '%5'"))
    e.create_text("t")
    return e.text_search("t", "tion moronic", None)


@query(f"SELECT key FROM {GEO_SQL} WHERE c_custkey % 3 <> 0 AND min_x <= 40 AND max_x >= 0 AND min_y <= 50 AND max_y >= 10")
def spatial_index_stored(spark, d):
    """Rectangles on disk: all added, a third removed by key and sides, searched by window."""
    e = _engine(spark, d)
    e.create_spatial("s")
    places = _places(spark, d).rows.select(F.col("key").alias("id"), "value", *geo.SIDES, "c_custkey")
    e.insert_spatial("s", places)
    e.delete_spatial("s", places.where("c_custkey % 3 = 0"))
    e.compact("s")
    return _gql_on(e, "SELECT key FROM s WHERE WITHIN(10, 0, 50, 40)")


def _gql_on(e: Engine, text: str) -> DataFrame:
    return lower.select(e.catalog, parse(text), lower.Options(None, None))


@query(f"SELECT key, value FROM {CUSTOMERS_SQL}")
def snapshot_restored(spark, d):
    """A snapshot with its manifest, restored and verified after everything was deleted."""
    e = _engine(spark, d)
    e.create("c")
    e.bulk_put("c", _customer_rows(spark, d))
    e.snapshot("c", f"{e.path}/snapshots")
    e.gql("DELETE FROM c WHERE key >= ''")
    e.restore("c", f"{e.path}/snapshots")
    return e.table("c").select("key", "value")


@query(f"SELECT key, sha256(value) AS checksum, value AS opened, printf('%.6f', c_acctbal) AS score, CASE WHEN c_acctbal > 0 THEN value || chr(10) || key END AS inside FROM {CUSTOMERS_SQL}")
def value_functions(spark, d):
    rows = _customers(spark, d).rows
    wrapped = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("APP.TEXT("), "value", F.lit("\n"), "key", F.lit(")"))).otherwise(F.col("value"))
    secret = "0123456789abcdef"
    return rows.select("key", values.checksum(F.encode("value", "UTF-8")).alias("checksum"), values.unseal(values.seal(F.col("value"), secret), secret).cast("string").alias("opened"), values.score_text(F.col("c_acctbal")).alias("score"), values.wrapped_text(wrapped).alias("inside"))


@query(f"SELECT key, value || '!' AS value FROM {CUSTOMERS_SQL} UNION ALL SELECT 'added', 'row!'")
def schema_migrations(spark, d):
    """Two migrations applied in order, a third applied and undone."""
    shout = lifecycle.Migration(2, "shout", lambda t: t.withColumn("value", F.concat("value", F.lit("!"))))
    add = lifecycle.Migration(1, "add", lambda t: t.unionByName(spark.createDataFrame([("added", "row")], "key string, value string")))
    marked = F.startswith("key", F.lit(lifecycle.Migrator.PREFIX))
    renamed = lambda t, new: t.withColumn("key", F.when(marked, F.col("key")).otherwise(new))
    gone = lifecycle.Migration(3, "gone", lambda t: renamed(t, F.concat(F.lit("x"), "key")), lambda t: renamed(t, F.substring("key", 2, 1 << 20)))
    first = lifecycle.Migrator([shout, add]).up(_customer_rows(spark, d))
    data = lifecycle.Migrator([gone]).up(first.where(~marked))
    return lifecycle.Migrator([gone]).down(data).where(~marked).select("key", "value")


@query("SELECT * FROM (VALUES ('admin', 'read', true), ('admin', 'write', true), ('admin', 'delete', true), ('admin', 'bulk', true), ('admin', 'search', true), ('admin', 'admin', true), ('writer', 'read', true), ('writer', 'write', true), ('writer', 'delete', true), ('writer', 'bulk', true), ('writer', 'search', true), ('writer', 'admin', false), ('reader', 'read', true), ('reader', 'write', false), ('reader', 'delete', false), ('reader', 'bulk', false), ('reader', 'search', true), ('reader', 'admin', false)) t(role, action, allowed)")
def roles_allow(spark, d):
    def may(role, action):
        try:
            governance.require(role, action)
        except PermissionDenied:
            return False
        return True

    return spark.createDataFrame([(r, a, may(r, a)) for r in ("admin", "writer", "reader") for a in ("read", "write", "delete", "bulk", "search", "admin")], "role string, action string, allowed boolean")


_RECORDS_SQL = "(SELECT user_id, event_type, event_id, CAST(user_id AS VARCHAR) AS key, CAST(user_id AS DOUBLE) AS x FROM events)"


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type || ' ' || props, event_id) AS value FROM events GROUP BY user_id")
def stream_text_replica(spark, d):
    """Text records applied as a stream, a few files a batch, to a text index."""
    where, e = f"{_shared(spark)}/texts-{uuid4().hex}", _read(spark, d, "events")
    data = F.encode(F.concat(F.col("user_id").cast("string"), F.lit("\u0000"), F.col("event_type"), F.lit(" "), F.col("props")), "UTF-8")
    e.select((F.col("event_id") + 1).alias("lsn"), data.alias("data")).repartitionByRange(4, "lsn").write.parquet(f"{where}/log")
    index = TextIndex(spark, f"{where}/index")
    replica.apply_texts(replica.source(spark, f"{where}/log", "lsn long, data binary"), index, f"{where}/checkpoint").awaitTermination()
    return index.rows()


@query(f"SELECT key, x AS min_x FROM (SELECT key, x, arg_max(event_type, event_id) AS last FROM {_RECORDS_SQL} GROUP BY key, x) WHERE last <> 'error'")
def stream_spatial_replica(spark, d):
    """Rectangle records applied as a stream to a rectangle index: the last change of each counts."""
    where, e = f"{_shared(spark)}/rects-{uuid4().hex}", _read(spark, d, "events")
    x = F.col("user_id").cast("double")
    body = F.to_json(F.struct(x.alias("min_x"), F.lit(0.0).alias("min_y"), x.alias("max_x"), F.lit(1.0).alias("max_y"), F.col("user_id").cast("string").alias("data_id")))
    kind = F.when(F.col("event_type") == "error", "RTreeDelete").otherwise("RTreeInsert")
    e.select((F.col("event_id") + 1).alias("lsn"), kind.alias("type"), F.encode(body, "UTF-8").alias("data")).repartitionByRange(4, "lsn").write.parquet(f"{where}/log")
    index = SpatialIndex(spark, f"{where}/index")
    replica.apply_rects(replica.source(spark, f"{where}/log", "lsn long, type string, data binary"), index, f"{where}/checkpoint").awaitTermination()
    return index.rows().select("key", "min_x")


@query(f"SELECT key, CASE WHEN slot <= 9999 THEN 'n2' ELSE 'n3' END AS primary_node FROM (SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey % 16384 AS slot FROM customer)")
def cluster_moves(spark, d):
    """Nodes added, ranges assigned, one moved step by step, a node removed; then the node of every customer's slot."""
    c = Cluster(spark, f"{_shared(spark)}/cluster-{uuid4().hex}")
    for n in ("n1", "n2", "n3"):
        c.add_node(n, f"{n}:7000")
    c.assign(0, 9999, "n1", ("n2",))
    c.assign(10000, 16383, "n3")
    c.begin_move(0, 9999, "n2")
    while c.advance_move(0, 9999) != "DONE":
        pass
    c.remove_node("n1")
    keys = _read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), (F.col("c_custkey") % slots.FNV_SLOTS).cast("int").alias("slot"))
    return routing.ranged(keys, c.shard_map()).select("key", F.col("primary").alias("primary_node"))
