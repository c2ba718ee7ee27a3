"""Queries that SQL can express, against it, on the smallest tables and on rows made to link."""

import duckdb
import numpy as np
import pytest

from lodestone.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def compare(spark, name, folder):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'/*.parquet' if folder != DATA else ''}'")
    df = QUERIES[name](spark, folder if folder == DATA else f"file://{folder}")
    columns = sorted(df.columns)
    found = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == wanted
    return wanted


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert compare(spark, name, DATA)


def test_links_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    bases = [[word() for _ in range(n)] for n in (6, 30, 60, 60, 120)]
    texts = []
    for b in bases:
        for k in range(40):  # near copies by few edits, chains of them among these
            w = list(texts[-1].split() if k % 3 == 2 else b)
            for _ in range(k % 4):
                w[rng.integers(len(w))] = word()
            texts.append(" ".join(w))
    texts += [None, "", "x", "x", "X y", "x  y", "the only one"]
    items = [(1, texts[50]), (2, " ".join(texts[90].split()[5:17])), (3, "x"), (4, None), (5, "nowhere at all"), (6, " ".join(texts[90].split()[8:20]))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    x = rng.normal(size=(12, 24))
    vectors = [(x[i % 12] + rng.normal(size=24) * (0, 0.02, 0.2, 0.3)[i % 4]).tolist() for i in range(150)]
    rows = list(enumerate(vectors)) + [(150, None), (151, [0.0] * 24), (152, [float("nan")] * 24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    assert sum(r[-1] > 1 for r in compare(spark, "op4_decontaminate", str(tmp_path))) >= 0
    linked = compare(spark, "op7_ngram_join", str(tmp_path))
    assert sum(component != doc for component, doc, _ in linked) > 50
    assert sum(r[2] for r in compare(spark, "op8_embedding_dedup", str(tmp_path))) > 50
