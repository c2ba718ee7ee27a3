"""Text index: postings, union search, document frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms
from ..sources.indexes import bucket_of


def postings(docs: DataFrame, key: str = "key", text: str = "value", unique: bool = False) -> DataFrame:
    """Distinct (term, doc_key). Terms are folded inside a document; with ``unique`` keys nothing needs to move."""
    own = docs.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term"), F.col(key).alias("doc_key"))
    return own if unique else own.distinct()


def posting_lists(pairs: DataFrame) -> DataFrame:
    """term, its sorted document keys and their number."""
    return pairs.groupBy("term").agg(F.array_sort(F.collect_set("doc_key")).alias("doc_keys")).withColumn("num_keys", F.size("doc_keys"))


def posting_chunks(pairs: DataFrame, size: int = 10000) -> DataFrame:
    """Posting lists in chunks of about ``size`` keys, so that no common term is gathered in one task."""
    counts = document_frequency(pairs).withColumn("chunks", F.ceil(F.col("df") / F.lit(size)).cast("int"))
    dealt = pairs.join(counts, "term").withColumn("chunk", F.pmod(F.xxhash64("doc_key"), F.col("chunks")).cast("int"))
    return dealt.groupBy("term", "chunk").agg(F.array_sort(F.collect_set("doc_key")).alias("doc_keys"))


def document_frequency(pairs: DataFrame) -> DataFrame:
    """Documents of each term; ``pairs`` are distinct."""
    return pairs.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(query: str) -> list[str]:
    """The terms of a query, by the rules of the index."""
    import re

    from ..functions.text import STOP_WORDS, SUFFIXES

    out = []
    for term in re.findall(r"(?<![a-z0-9_])[a-z0-9]+(?![a-z0-9_])", query.lower()):
        for suffix, more_than in SUFFIXES:
            if term.endswith(suffix) and len(term) > more_than:
                term = term[: -len(suffix)]
                break
        if term and term not in STOP_WORDS:
            out.append(term)
    return out


def matching_keys(pairs: DataFrame, query: str) -> DataFrame:
    """Distinct doc_key of any term of the query. The terms are literals, so a sorted table is pruned by them."""
    found = query_terms(query)
    if not found:
        return pairs.select("doc_key").limit(0)
    if "bucket" in pairs.columns:  # folders of a stored index
        pairs = pairs.where(F.col("bucket").isin(*sorted({bucket_of(t) for t in found})))
    return pairs.where(F.col("term").isin(*found)).select("doc_key").distinct()


def search(pairs: DataFrame, query: str, limit: int | None = 1000) -> DataFrame:
    """(key, score) in order of the key; the score is 1."""
    hits = matching_keys(pairs, query).select(F.col("doc_key").alias("key"), F.lit(1.0).alias("score"))
    return hits.orderBy("key") if limit is None else hits.orderBy("key").limit(limit)
