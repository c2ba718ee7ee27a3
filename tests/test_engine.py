import random

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.errors import InvalidArgument, NotFound, PermissionDenied, Unavailable
from lodestone.functions import geo, slots, values
from lodestone.operators import lifecycle, routing
from lodestone.operators import text as text_ops
from lodestone.plans import lower
from lodestone.plans import tree as t
from lodestone.sources import log
from lodestone.sources.catalog import INVERTED, KV, SPATIAL, IndexDef


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    e.create("u")
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_statements(engine):
    engine.bulk_put("u", [(f"k{i}", f"v{i}") for i in range(5)])
    assert engine.gql("INSERT INTO u (key, value) VALUES ('k1', 'new')").rows_affected == 1
    assert engine.get("u", "k1") == (True, "new")
    assert engine.gql("UPDATE u SET value = 'x' WHERE key BETWEEN 'k2' AND 'k3'").rows_affected == 2
    assert engine.gql("UPDATE u SET value = 'x' WHERE key = 'none'").rows_affected == 0
    assert engine.gql("DELETE FROM u WHERE value = 'x' AND key > 'k2'").rows_affected == 1
    assert rows(engine.gql("SELECT * FROM u ORDER BY key DESC LIMIT 3").df) == [("k4", "v4"), ("k2", "x"), ("k1", "new")]
    engine.compact("u")
    assert engine.size("u") == 4 and engine.get("u", "k3") == (False, None)
    assert engine.delete("u", "k4") and not engine.delete("u", "k4")
    assert engine.bulk_delete("u", ["k0", "gone"]) == 1
    assert [r.key for r in engine.cursor("u")] == ["k1", "k2"]
    assert rows(engine.get_range("u", "k1", "k2")) == [("k1", "new")]
    with pytest.raises(NotFound):
        engine.gql("SELECT * FROM U")
    with pytest.raises(InvalidArgument):
        engine.gql("SELECT * FROM u WHERE body = 'x'")
    with pytest.raises(InvalidArgument):
        engine.put("u", "", "x")


def test_range_aggregates_skip_what_is_no_number(engine):
    engine.bulk_put("u", [("a", "1"), ("b", "x"), ("c", "2.5"), ("d", "9")])
    assert rows(engine.range_aggregates("u", "a", "d")) == [(3, 3.5, 1.0, 2.5)]


def test_transactions(engine):
    engine.put("u", "a", "1")
    x, y = engine.begin("u"), engine.begin("u")
    x.put("a", "2")
    x.delete("b")
    y.put("a", "3")
    assert engine.get("u", "a") == (True, "1")
    assert x.commit() == "COMMITTED"
    with pytest.raises(Unavailable):
        y.commit()
    assert engine.get("u", "a") == (True, "2")
    z = engine.begin("u")
    z.put("a", "4")
    assert z.abort() == z.abort() == "ABORTED"
    assert engine.get("u", "a") == (True, "2")


def test_transactions_over_indexes(spark, engine):
    engine.create("w")
    x, y = engine.begin("u", "w"), engine.begin("w")
    x.put("a", "1")
    x.put("b", "2", "w")
    x.prepare()
    assert engine.get("u", "a") == engine.get("w", "b") == (False, None)  # nothing counts before the decision
    y.put("b", "3")
    with pytest.raises(Unavailable):
        y.commit()
    with pytest.raises(Unavailable):
        engine.compact("u")
    assert x.commit() == "COMMITTED" and engine.get("u", "a") == (True, "1") and engine.get("w", "b") == (True, "2")
    z = engine.begin("u", "w")
    z.put("a", "9")
    z.delete("b", "w")
    z.prepare()
    assert z.abort() == "ABORTED" and engine.decisions.decide(z.txn_id, "COMMITTED") == "ABORTED"
    engine.compact("u")
    again = Engine(spark, engine.path)
    for name in ("u", "w"):
        again.create(name)
    assert again.get("u", "a") == (True, "1") and again.get("w", "b") == (True, "2")
    with pytest.raises(InvalidArgument):
        engine.begin("u").put("a", "1", "w")


def test_stored_text_index(spark, engine, capsys):
    docs = lambda *rows: spark.createDataFrame(rows, "key string, value string")
    engine.create_text("t")
    engine.add_documents("t", docs(("d1", "Running DOGS"), ("d2", "a dog"), ("d3", "cats")))
    engine.add_documents("t", docs(("d2", "cats again")))
    assert rows(engine.text_search("t", "dogs")) == [("d1", 1.0)] and [r.key for r in engine.text_search("t", "cat").collect()] == ["d2", "d3"]
    engine.compact("t")
    engine.add_documents("t", docs(("d3", "dog")))
    again = Engine(spark, engine.path)
    again.create_text("t")
    assert [r.key for r in again.gql("SELECT * FROM t WHERE CONTAINS(value, 'dog')").df.collect()] == ["d1", "d3"]
    assert [r.key for r in again.text_search("t", "cats").collect()] == ["d2"]
    again.text_search("t", "cats").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,cat)" in plan


def test_wrapped_values_are_searched(engine):
    engine.bulk_put("u", [("a", "APP.TEXT(running dogs)"), ("b", "dogs"), ("c", "X.TEXT(cats)")])
    assert [r.key for r in engine.text_search("u.text", "dog").collect()] == ["a"]
    engine.put("u", "a", "plain")
    engine.delete("u", "c")
    assert engine.text_search("u.text", "dog cat").count() == 0


def test_stored_spatial_index(spark, engine):
    boxes = lambda *rows: spark.createDataFrame(rows, "id string, min_x double, min_y double, max_x double, max_y double")
    engine.create_spatial("s")
    engine.insert_spatial("s", boxes(("p", 0.0, 0.0, 1.0, 1.0), ("q", 5.0, 5.0, 6.0, 6.0), ("p", 9.0, 9.0, 9.0, 9.0)))
    engine.delete_spatial("s", boxes(("p", 0.0, 0.0, 1.0, 1.0), ("q", 5.0, 5.0, 6.0, 6.5)))
    engine.compact("s")
    engine.insert_spatial("s", boxes(("p", 0.0, 0.0, 1.0, 1.0)))
    again = Engine(spark, engine.path)
    again.create_spatial("s")
    found = lambda q: sorted(r.key for r in again.gql(q).df.collect())
    assert found("SELECT key FROM s WHERE WITHIN(0, 0, 9, 9)") == ["p", "p", "q"]
    assert found("SELECT key FROM s WHERE WITHIN(0, 0, 4, 4)") == ["p"]


def test_lsns_only_grow(spark, engine):
    engine.bulk_put("u", [("a", "1"), ("b", "2"), ("c", "3")])
    engine.delete("u", "c")
    x = engine.begin("u")
    engine.compact("u")
    log = engine.log("u")
    assert log.last_lsn() == 4 and engine.size("u") == 2
    engine.put("u", "a", "other")
    assert log.last_lsn() == 5
    x.put("a", "mine")
    with pytest.raises(Unavailable):  # written after the compaction that came after the transaction began
        x.commit()
    assert engine.get("u", "a") == (True, "other")
    again = Engine(spark, engine.path)
    again.create("u")
    assert again.get("u", "a") == (True, "other") and again.begin("u").seen == {"u": 5}


def test_second_writer_numbers_its_rows_again(spark, engine, monkeypatch):
    first, second = engine.log("u"), log.MutationLog(spark, engine.log("u").path)
    late, commit = [True], second._commit

    def slow(c):
        if late.pop() if late else False:
            first.append(spark.createDataFrame([("x", "1", "PUT")], "key string, value string, op string"))
        commit(c)

    monkeypatch.setattr(second, "_commit", slow)
    assert second.append(spark.createDataFrame([("y", "2", "PUT"), ("z", "3", "PUT")], "key string, value string, op string")) == 2
    assert sorted((r.lsn, r.key) for r in first.read().collect()) == [(1, "x"), (2, "y"), (3, "z")]
    monkeypatch.setattr(second, "_commit", commit)
    late.append(True)
    monkeypatch.setattr(second, "_commit", slow)
    second.compact()  # what is appended meanwhile isn't lost
    assert first.read().count() == 3 and first.last_lsn() == 4


def test_numbers_of_any_keys(spark):
    rng = random.Random(2)
    keys = [f"{rng.random()}" for _ in range(300)] + ["the same prefix of all of these " + str(i) for i in range(300)] + ["twice"] * 2
    got = log.numbered(spark.createDataFrame([(k,) for k in keys], "key string"), "key", base=7).collect()
    assert sorted(r.lsn for r in got) == list(range(8, 8 + len(keys)))
    assert [r.key for r in sorted(got, key=lambda r: r.lsn)] == sorted(keys)


def test_every_row_of_a_large_append_is_numbered_once(spark, engine, tmp_path):
    rows = spark.range(0, 60_000, 1, 6).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.repeat(F.lit("v"), 50).alias("value"))
    assert engine.bulk_put("u", rows) == 60_000
    log_rows = engine.log("u").read().select("key", "lsn")
    assert log_rows.agg(F.count("*"), F.count_distinct("lsn"), F.min("lsn"), F.max("lsn")).first() == (60_000, 60_000, 1, 60_000)
    first = [r.key for r in log_rows.orderBy("lsn").limit(500).collect()]
    assert first == [r.key for r in rows.orderBy("key").limit(500).collect()]
    assert engine.size("u") == 60_000 and len(list(engine.cursor("u", "0", "1"))) == rows.where("key < '1'").count()
    engine.snapshot("u", f"file://{tmp_path}/snapshots")
    assert engine.gql("DELETE FROM u WHERE key >= ''").rows_affected == 60_000 and engine.size("u") == 0
    assert engine.restore("u", f"file://{tmp_path}/snapshots") == 60_000 and engine.size("u") == 60_000


def test_compaction_takes_the_postings_there_are(spark, tmp_path, monkeypatch):
    from lodestone.sources.indexes import TextIndex

    index = TextIndex(spark, f"file://{tmp_path}/t")
    index.put(spark.createDataFrame([("a", "Red foxes are running, red"), ("b", "blue fox"), ("c", "green")], "key string, value string"))
    index.put(spark.createDataFrame([("b", "yellow birds")], "key string, value string"))
    index.remove(spark.createDataFrame([("c",)], "key string"))
    before = sorted(rows(index.postings().select("term", "doc_key")))
    assert before == [("bird", "b"), ("foxe", "a"), ("r", "a"), ("runn", "a"), ("yellow", "b")]

    def again(*_):
        raise AssertionError("the texts were cut into terms again")

    monkeypatch.setattr(TextIndex, "_write_postings", again)
    index.compact()
    assert sorted(rows(index.postings().select("term", "doc_key"))) == before


def test_bulk_rows_are_checked(spark, engine):
    for row in (("", "x"), ("k" * 2000, "x"), ("k", "v" * 20000), (None, "x")):
        with pytest.raises(InvalidArgument):
            engine.bulk_put("u", spark.createDataFrame([("good", "y"), row], "key string, value string"))
    assert engine.size("u") == 0


def test_snapshot_and_restore(engine, tmp_path):
    engine.bulk_put("u", [("a", "1"), ("b", "2")])
    assert engine.snapshot("u", f"file://{tmp_path}/snap").count() >= 1
    engine.delete("u", "a")
    assert engine.restore("u", f"file://{tmp_path}/snap") == 2
    assert engine.size("u") == 2 and engine.log("u").last_lsn() == 3
    again = Engine(engine.spark, engine.path)
    again.create("u")
    assert again.size("u") == 2
    with pytest.raises(NotFound):
        lifecycle.restore(engine.spark, f"file://{tmp_path}/snap", "other")


def test_text(spark, engine):
    docs = spark.createDataFrame([("d1", "Running foo_bar DOGS this is"), ("d2", "being as a dog"), ("d3", "")], "key string, value string")
    engine.register(IndexDef("docs", INVERTED, docs))
    pairs = {(r.term, r.doc_key) for r in engine.catalog.get("docs").postings.collect()}
    assert pairs == {("runn", "d1"), ("dog", "d1"), ("thi", "d1"), ("i", "d1"), ("be", "d2"), ("dog", "d2")} - {("be", "d2")}
    assert rows(engine.text_search("docs", "dogs")) == [("d1", 1.0), ("d2", 1.0)]
    assert rows(engine.text_search("docs", "the of")) == []
    assert [r.key for r in engine.gql("SELECT * FROM docs WHERE CONTAINS(any, 'dog') AND value = 'being as a dog'").df.collect()] == ["d2"]
    assert [r.key for r in engine.gql("SELECT key FROM docs WHERE NOT CONTAINS(value, 'DOG')").df.collect()] == ["d3"]
    engine.add_documents("docs", spark.createDataFrame([("d2", "cat")], "key string, value string"))
    assert rows(engine.text_search("docs", "dog")) == [("d1", 1.0)] and rows(engine.text_search("docs", "cats")) == [("d2", 1.0)]
    with pytest.raises(InvalidArgument):
        engine.gql("INSERT INTO docs (key, value) VALUES ('a', 'b')")


def test_query_terms_are_index_terms(spark):
    from lodestone.functions.text import terms

    texts = ["Sing thing s ss ed bed as a being has", "x_y foo-bar 12ing it's", "", "ÀB cd éf"]
    for text in texts:
        own = spark.createDataFrame([(text,)], "t string").select(terms(F.col("t"))).first()[0]
        assert own == text_ops.query_terms(text)


def test_spatial(spark, engine):
    boxes = spark.createDataFrame([("p", -0.1, 51.5, -0.1, 51.5), ("q", 0.0, 51.5, 0.2, 51.6), ("r", 179.9, 0.0, 179.9, 0.0)], "id string, min_x double, min_y double, max_x double, max_y double")
    engine.insert_spatial("places", boxes)
    near = engine.gql("SELECT * FROM places WHERE NEAR(51.5074, -0.1278, 3000)").df
    assert [r.key for r in near.collect()] == ["p"] and 1000 < near.first()["score"] < 3000
    assert [r.key for r in engine.gql("SELECT key FROM places WHERE WITHIN(51.4, 0.2, 51.5, 0.5)").df.collect()] == ["q"]
    assert [r.key for r in engine.gql("SELECT key FROM places WHERE NEAR(0, -179.95, 20000)").df.collect()] == ["r"]
    engine.delete_spatial("places", boxes.where("id = 'p'"))
    assert engine.size("places") == 2
    with pytest.raises(InvalidArgument):
        engine.gql("SELECT * FROM u WHERE NEAR(1, 2, 3)")


def test_cover_boxes_hold_the_circle():
    rng = random.Random(3)
    import math

    for _ in range(3000):
        lat, lon, r = rng.uniform(-89, 89), rng.uniform(-180, 180), rng.uniform(1, 3e6)
        a, d = rng.uniform(0, 2 * math.pi), rng.uniform(0, r * 0.999) / geo.EARTH_M
        p = math.asin(math.sin(math.radians(lat)) * math.cos(d) + math.cos(math.radians(lat)) * math.sin(d) * math.cos(a))
        q = math.radians(lon) + math.atan2(math.sin(a) * math.sin(d) * math.cos(math.radians(lat)), math.cos(d) - math.sin(math.radians(lat)) * math.sin(p))
        y, x = math.degrees(p), (math.degrees(q) + 180) % 360 - 180
        assert any(b[0] <= x <= b[2] and b[1] <= y <= b[3] for b in geo.cover_boxes(lat, lon, r))


def test_random_predicates(spark):
    """Against a plain evaluator over the rows."""
    data = [(f"k{i:02d}", random.Random(i).choice("abcXYZ") * (i % 3)) for i in range(30)]
    index = IndexDef("x", KV, spark.createDataFrame(data, "key string, value string"))
    rng = random.Random(1)

    def make(depth):
        kind = rng.randrange(6) if depth else rng.randrange(3)
        field = rng.choice(("key", "value"))
        if kind == 0:
            return t.Compare(field, rng.choice(("=", "!=", "<", "<=", ">", ">=")), rng.choice(data)[field == "value"])
        if kind == 1:
            return t.Between(field, *sorted((rng.choice(data)[field == "value"], rng.choice(data)[field == "value"])))
        if kind == 2:
            return t.Contains(field, rng.choice("aKx1"))
        return t.Not(make(depth - 1)) if kind == 3 else (t.And if kind == 4 else t.Or)(make(depth - 1), make(depth - 1))

    def holds(p, row):
        v = lambda f: row[f == "value"]
        match p:
            case t.Compare(f, op, x):
                return {"=": v(f) == x, "!=": v(f) != x, "<": v(f) < x, "<=": v(f) <= x, ">": v(f) > x, ">=": v(f) >= x}[op]
            case t.Between(f, a, b):
                return a <= v(f) <= b
            case t.Contains(f, q):
                return q.lower() in v(f).lower()
            case t.Not(a):
                return not holds(a, row)
            case t.And(a, b):
                return holds(a, row) and holds(b, row)
            case t.Or(a, b):
                return holds(a, row) or holds(b, row)

    tests = [make(3) for _ in range(40)]
    flags = index.rows.select("key", "value", *(lower.predicate(p, index).alias(f"p{i}") for i, p in enumerate(tests))).collect()
    for row in flags:
        for i, p in enumerate(tests):
            assert row[f"p{i}"] == holds(p, (row.key, row.value)), p


def test_values(spark):
    df = spark.createDataFrame([("a", "APP.TEXT(hello\nworld)"), ("", "x"), ("k" * 1025, "v" * 16385)], "key string, value string")
    assert [r[0] for r in df.select(values.wrapped_text(F.col("value"))).collect()] == ["hello\nworld", None, None]
    assert [r[0] for r in df.select(values.problems(F.col("key"), F.col("value"))).collect()] == [[], ["key is empty"], ["key is too long", "value is too long"]]
    key = "0123456789abcdef"
    assert df.select(values.unseal(values.seal(F.col("value"), key), key).cast("string")).first()[0] == "APP.TEXT(hello\nworld)"
    assert df.select(values.score_text(F.lit(0.92))).first()[0] == "0.920000"


def test_slots(spark):
    import zlib

    keys = ["", "a", "foobar", "clé"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(slots.fnv1a_32(F.col("k")), slots.slot_crc32(F.col("k"))).collect()

    def fnv(b):
        h = 2166136261
        for x in b:
            h = (h ^ x) * 16777619 % 2**32
        return h

    assert [tuple(r) for r in got] == [(fnv(k.encode()), zlib.crc32(k.encode()) % 8) for k in keys]
    parsed = spark.createDataFrame([("1-3",), ("7",), ("5-2",), ("x",), ("0-16384",)], "r string").select(slots.slot_range(F.col("r")).alias("s")).collect()
    assert [r.s and tuple(r.s) for r in parsed] == [(1, 3), (7, 7), None, None, None]


def test_rebalance():
    moves = routing.rebalance({f"s{i}": "a" for i in range(7)}, ["a", "b", "c"])
    assert len(moves) == 4 and all(m[1] == "a" for m in moves)
    assert routing.rebalance({"s": "a"}, ["a", "b"]) == []


def test_migrations(spark):
    kv = spark.createDataFrame([("a", "1")], "key string, value string")
    upper = lifecycle.Migration(2, "upper", lambda d: d.withColumn("value", F.concat("value", F.lit("!"))), lambda d: d.withColumn("value", F.regexp_replace("value", "!$", "")))
    first = lifecycle.Migration(1, "add", lambda d: d.unionByName(spark.createDataFrame([("b", "2")], "key string, value string")))
    m = lifecycle.Migrator([upper, first])
    done = m.up(kv)
    assert [x[:2] for x in m.applied(done)] == [(1, "add"), (2, "upper")] and m.up(done).count() == done.count()
    undone = m.down(done)
    assert dict(rows(undone.where("key in ('a', 'b')"))) == {"a": "1", "b": "2"}
    with pytest.raises(InvalidArgument):
        m.down(undone)
    assert lifecycle.seconds("1d2h") == 93600
    with pytest.raises(InvalidArgument):
        lifecycle.seconds("soon")


def test_roles(spark, tmp_path):
    reader = Engine(spark, f"file://{tmp_path}", role="reader")
    with pytest.raises(PermissionDenied):
        reader.create("x")
    reader.register(IndexDef("p", SPATIAL, spark.createDataFrame([("a", "v", 0.0, 0.0, 1.0, 1.0)], "key string, value string, min_x double, min_y double, max_x double, max_y double")))
    assert reader.gql("SELECT * FROM p").df.count() == 1
    with pytest.raises(PermissionDenied):
        reader.gql("DELETE FROM p")


def test_token_bucket_on_a_stream(spark, tmp_path):
    from lodestone.streaming.limits import admit_stream

    spark.createDataFrame([("a", i) for i in range(4)], "u string, s long").selectExpr("u", "timestamp_seconds(s) as ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("u string, ts timestamp").parquet(f"{tmp_path}/in")
    q = admit_stream(stream, "u", "ts", 0.5, 2.0).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("ts").collect()
    assert [r.admitted for r in got] == [True, True, True, False]
