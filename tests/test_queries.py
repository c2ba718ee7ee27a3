"""Every driver query against the same question in SQL."""

import duckdb
import pytest

import __spark_entry__
from lodestone.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wanted = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(wanted)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bounds_reach_the_scan(spark, capsys):
    QUERIES["agg_sum_range"](spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "o_orderkey" in plan.split("PushedFilters")[1].split("\n")[0]
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_token_bucket(spark):
    rows = QUERIES["token_bucket"](spark, DATA).orderBy("user_id", "ts", "event_id").collect()
    state = {}
    for r in rows:
        tokens, last = state.get(r.user_id, (5.0, r.ts))
        tokens = min(5.0, tokens + (r.ts - last).total_seconds() / 3600)
        assert r.admitted == (tokens >= 1)
        tokens -= r.admitted
        assert abs(tokens - r.tokens) < 1e-6
        state[r.user_id] = (tokens, r.ts)


def test_request_quota(spark):
    rows = spark.createDataFrame([("a", i, float(t)) for i, t in enumerate((0, 0.2, 0.9, 1.1, 1.2, 5, 5.5, 5.9, 6.05))], "u string, i int, t double").selectExpr("u", "i", "timestamp_micros(cast(t * 1000000 as long)) as ts")
    from lodestone.operators.governance import request_quota

    got = [r.admitted for r in request_quota(rows, "u", "ts", "i", 2).orderBy("i").collect()]
    assert got == [True, True, False, True, True, True, True, False, True]


def test_every_event_asks_for_its_segment(spark):
    events = [r.event_id for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id").collect()]
    starts = {}
    for e in events:
        starts[e // 1000] = min(e + 1, starts.get(e // 1000, e + 1))
    rows = QUERIES["wal_segment_asof"](spark, DATA).collect()
    assert sorted(r.event_id for r in rows) == sorted(events) and {r.segment_id for r in rows} >= set(starts)
    for r in rows:
        assert r.lsn == r.event_id * 13 % (max(events) + 2001)
        assert r.segment_id == max(((at, s) for s, at in starts.items() if at <= r.lsn), default=(0, None))[1]


@pytest.mark.parametrize("name", ["token_bucket", "request_quota"])
def test_a_run_is_no_group_of_its_own(spark, capsys, name):
    QUERIES[name](spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_runs_that_share_a_task(spark):
    from lodestone.operators.governance import admit, request_quota

    # Tenants of rare requests and one of many, and one without a name; a request of unknown cost isn't admitted.
    made = [(u, i, i * 40_000_000 + u, 1.0) for u in range(60) for i in range(40)] + [(99, i, i * 100_000, 1.0) for i in range(3000)] + [(None, i, i * 300_000, None if i == 1 else 1.0) for i in range(4)]
    rows = spark.createDataFrame(made, "u long, i int, us long, c double").selectExpr("u", "i", "timestamp_micros(us) as ts", "c", "us").repartition(7)
    state, wanted = {}, {}
    for u, i, us, c in made:
        tokens, last = state.get(u, (3.0, us))
        tokens = min(3.0, tokens + (us - last) / 1e6 * 0.5)
        ok = c is not None and tokens >= c
        state[u] = (tokens - ok, us)
        wanted[u, i] = (ok, round(tokens - ok, 6))
    assert {(r.u, r.i): (r.admitted, round(r.tokens, 6)) for r in admit(rows, "u", "ts", "i", 0.5, 3.0, "c").collect()} == wanted
    found = {(r.u, r.i): r.admitted for r in request_quota(rows, "u", "ts", "i", 2).collect()}
    assert found == {(u, i): u != 99 and (u is not None or i < 2) or u == 99 and i % 10 < 2 for u, i, _, _ in made}
