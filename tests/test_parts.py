"""Parts that no driver query reaches: streams into indexes, spans of time, cluster metadata, the shell."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone import __main__ as shell
from lodestone.engine import Engine
from lodestone.errors import AlreadyExists, InvalidArgument, ResourceExhausted, Unavailable
from lodestone.functions import geo
from lodestone.operators import governance, routing, sequence
from lodestone.operators.cluster import Cluster
from lodestone.sources.catalog import KeyCodec
from lodestone.sources.indexes import SpatialIndex, TextIndex
from lodestone.streaming import replica


def test_text_and_rectangles_by_streams(spark, tmp_path):
    texts = [(1, "a\0dogs run"), (2, "b\0cats"), (3, "a\0birds"), (4, "c\0")]
    spark.createDataFrame(texts, "lsn long, data string").selectExpr("lsn", "cast(data as binary) as data").repartition(2).write.parquet(f"file://{tmp_path}/texts")
    index = TextIndex(spark, f"file://{tmp_path}/t")
    replica.apply_texts(replica.source(spark, f"file://{tmp_path}/texts", "lsn long, data binary"), index, f"file://{tmp_path}/c1").awaitTermination()
    assert {(r.key, r.value) for r in index.rows().collect()} == {("a", "birds"), ("b", "cats"), ("c", "")}
    assert {(r.term, r.doc_key) for r in index.postings().collect()} == {("bird", "a"), ("cat", "b")}
    body = '{"min_x":%d,"min_y":0,"max_x":%d,"max_y":1,"data_id":"%s"}'
    rects = [(1, "RTreeInsert", body % (0, 1, "p")), (2, "RTreeInsert", body % (5, 6, "q")), (3, "RTreeDelete", body % (0, 1, "p")), (4, "NoOp", "")]
    spark.createDataFrame(rects, "lsn long, type string, data string").selectExpr("lsn", "type", "cast(data as binary) as data").coalesce(1).write.parquet(f"file://{tmp_path}/rects")
    index = SpatialIndex(spark, f"file://{tmp_path}/r")
    for turn in range(2):  # the same records again, as after a failure
        replica.apply_rects(replica.source(spark, f"file://{tmp_path}/rects", "lsn long, type string, data binary"), index, f"file://{tmp_path}/c2{turn}").awaitTermination()
        assert [(r.key, r.min_x) for r in index.rows().collect()] == [("q", 5.0)]


def test_sessions_of_heartbeats(spark, tmp_path):
    spark.createDataFrame([("a", t) for t in (0, 3, 20, 500)], "n string, s long").selectExpr("n", "timestamp_seconds(s) as ts").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("n string, ts timestamp").parquet(f"file://{tmp_path}/in")
    q = replica.silent(stream, "n", "ts", "5 seconds", late="0 seconds").writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start(f"file://{tmp_path}/out")
    q.awaitTermination()
    found = spark.read.parquet(f"file://{tmp_path}/out").selectExpr("beats", "unix_seconds(up_from) as a", "unix_seconds(down_at) as b").orderBy("a").collect()
    assert [tuple(r) for r in found] == [(2, 0, 8), (1, 20, 25)]  # the last session is still open


def test_sizes(spark):
    small, large = replica.bounded(spark.createDataFrame([("a",), ("bbbb",)], "d string"), "d", 3)
    assert [r.d for r in small.collect()] == ["a"] and [r.d for r in large.collect()] == ["bbbb"]
    assert list(governance.batches(iter([b"aa", b"bb", b"c", b"dddddd", b"e"]), max_bytes=4, max_rows=2)) == [[b"aa", b"bb"], [b"c"], [b"dddddd"], [b"e"]]


def test_timeout(spark):
    assert governance.with_timeout(spark, 60, lambda: 5) == 5
    wait = F.udf(lambda x: time.sleep(20) or x, "long")
    with pytest.raises(ResourceExhausted):
        governance.with_timeout(spark, 2, lambda: spark.range(1).select(wait("id")).collect())


@pytest.mark.parametrize("span", [1_000_000, 10_000_000, 10**12])
def test_previous_rows_over_spans(spark, span):
    rng = random.Random(4)
    data = [(rng.choice("aab"), i, rng.randrange(0, 60_000_000)) for i in range(300)] + [(None, 300, 5), (None, 301, 70_000_000)]
    rows = spark.createDataFrame(data, "g string, i int, us long").selectExpr("g", "i", "timestamp_micros(us) as ts")
    got = {r.i: r for r in sequence.with_previous(rows, "g", "ts", "i", 400_000, span).collect()}
    for g in ("a", "b", None):
        own = sorted(((us, i) for x, i, us in data if x == g))
        run, last = 0, None
        for us, i in own:
            run += last is None or us - last >= 400_000
            assert (got[i]["__prev"], got[i]["__run"]) == (last, run)
            last = us


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_sums_over_spans(spark, span):
    rng = random.Random(6)
    data = [(rng.choice("aab"), i, rng.choice((None, 1, 5))) for i in range(200)] + [(None, 200, 3)]
    got = {r.i: r for r in governance.storage_quota(spark.createDataFrame(data, "n string, i long, size long"), "n", "i", "size", 100, 30, span).collect()}
    sums = {}
    for n, i, size in data:
        b, k = sums.get(n, (0, 0))
        sums[n] = b, k = b + (size or 0), k + 1
        assert (got[i].bytes_so_far, got[i].keys_so_far, got[i].within) == (b, k, b <= 100 and k <= 30)


def test_nearest_point_of_rectangles(spark):
    rng = random.Random(8)
    cases = [(-180.0, 0.0, -100.0, 10.0, 5.0, 179.0), (170.0, 60.0, 175.0, 80.0, 85.0, -20.0)]
    for _ in range(40):
        x, y = rng.uniform(-180, 170), rng.uniform(-85, 80)
        cases.append((x, y, min(180.0, x + rng.uniform(0, 90)), min(89.0, y + rng.uniform(0, 30)), rng.uniform(-80, 80), rng.uniform(-180, 180)))

    def away(p, q, lat, lon):
        a, b, c, d = map(math.radians, (p, q, lat, lon))
        return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(math.sin((a - c) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((b - d) / 2) ** 2)))

    for x0, y0, x1, y1, lat, lon in cases:
        box = spark.range(1).select(*(F.lit(v).alias(c) for v, c in zip((x0, y0, x1, y1), geo.SIDES, strict=True)))
        got = box.select(geo.distance_to(geo.rect(), lat, lon)).first()[0]
        grid = [(y0 + (y1 - y0) * i / 60, x0 + (x1 - x0) * j / 60) for i in range(61) for j in range(61)]
        want = min(away(p, q, lat, lon) for p, q in grid)
        assert got <= want + 1 and got >= want - 250_000  # the grid's points are up to some hundred kilometres apart
    assert got >= 0


def test_prefixes_reach_the_scan(spark):
    codec = KeyCodec("k:", "n", 3)
    df = spark.createDataFrame([(i,) for i in [*range(0, 1000, 7), 1234, 12]], "n long").withColumn("key", codec.encode())
    for start in ("k:", "k:0", "k:01", "k:123", "k:1234", "k", "x", "k:x"):
        native = codec.within(start)
        assert (native is None) == (start in ("k:1234", "k", "x", "k:x"))
        if native is not None:
            assert df.where(F.startswith("key", F.lit(start)) & ~native).count() == 0


def test_cluster(spark, tmp_path):
    c = Cluster(spark, f"file://{tmp_path}/cluster")
    for n in "ab":
        c.add_node(n, f"{n}:1")
    c.assign(0, 99, "a", ("b",))
    with pytest.raises(AlreadyExists):
        c.assign(50, 60, "b")
    with pytest.raises(InvalidArgument):
        c.remove_node("b")
    c.begin_move(0, 99, "b")
    with pytest.raises(Unavailable):
        c.assign(0, 99, "a")
    assert [c.advance_move(0, 99) for _ in range(2)] == ["COPYING", "SWITCHING"] and [r.state for r in c.moves().collect()] == ["SWITCHING"]
    assert c.advance_move(0, 99) == "DONE" and c.moves().isEmpty()
    assert [tuple(r) for r in c.shard_map().collect()] == [(0, 99, "b", [])]
    keys = spark.createDataFrame([(5,), (100,)], "slot int")
    assert {(r.slot, r.primary) for r in routing.ranged(keys, c.shard_map()).collect()} == {(5, "b"), (100, None)}
    c.remove_node("a")
    assert [r.node for r in c.nodes().collect()] == ["b"]


def test_shell(spark, tmp_path, capsys):
    engine = Engine(spark, f"file://{tmp_path}/db")
    ask = lambda *a: shell.run(engine, a[0], list(a[1:]))
    assert ask("put", "u", "a", "1") == ["ok"] and ask("get", "u", "a") == ["1"] and ask("get", "u", "b") == ["(not found)"]
    assert ask("txn", "u", "put:b=2", "delete:a") == ["COMMITTED"]
    assert ask("range", "u", "*", "*") == ["b\t2"] and ask("query", "SELECT * FROM u") == ["b\t2"] and ask("query", "UPDATE u SET value = 'x' WHERE key = 'b'") == ["1 rows"]
    assert ask("compact", "u") == ["ok"] and ask("status", "u") == ["lsn 4", "keys 1"] and ask("delete", "u", "b") == ["ok"]
    assert shell.main([f"file://{tmp_path}/db", "put", "u", "", "x"]) == 1
