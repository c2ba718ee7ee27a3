"""A training corpus from ``documents``: filter, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. A stage works on all its predecessor
kept and leaves rows it has nothing against as they are, rows with null ids
or texts too. Rows that repeat an id are one document, of which the near
duplicate stage keeps the row with the least text. Extra columns are kept,
whatever their names; empty tables give no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, ngram_join, packing, suffix_dedup, toxicity
from lodestone.llm.encode import tokenizer_path
from lodestone.llm.scratch import Scratch
from lodestone.llm.sieve import parted
from lodestone.llm.text import fresh


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that it calls toxic go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs.columns, "toxicity")
    return toxicity.score(docs, model, spans=False, name=name).where(F.col(name) < toxicity.TOXIC).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of documents whose five-word shingles are similar by 0.8 or more, the first id stays."""
    found = ngram_join.similar(docs, k=5, percent=80)
    others = found.where("id <> component_id").select(F.col("id").alias("doc_id"))
    others = Scratch(spark, "others").cut(others, "ids")
    some, rest = parted(docs, others.select(F.col("doc_id").alias("id")), "doc_id")
    kept = some.join(others, "doc_id", "left_anti").select(docs.columns).union(rest)
    again = found.groupBy("id").agg(F.count("*").alias("n")).where("id is not null and n > 1").select(F.col("id").alias("doc_id"))
    if again.isEmpty():
        return kept
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row"))
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).union(one.select("row.*"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: passages of 50 words or more stay at their first place only."""
    return suffix_dedup.remove(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: passages of benchmark items are cut out."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the documents left, in sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("benchmark", drop_benchmark),
    ("packing", pack),
]

#: SQL cannot express the field, the suffix array or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again as the next one's documents."""
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = tmp.cut(stage(spark, docs, sf_dir), name)
        if last:
            tmp.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
