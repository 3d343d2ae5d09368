"""Sparse retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import inverted_index
from quillon.session import scratch


def merged_passages(queries: DataFrame, found: DataFrame, key: str, rank: str, passage: str, failed: Column) -> DataFrame:
    """``key``, ``status``, ``text``: the passages found for each query, in order of
    ``rank``, as one text.  A query whose call failed is an ``api_error``, one
    without passages has ``no_results``; both have no text."""
    one = lambda x, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.get(F.split(x["p"], "\n"), 0), F.lit(")\n"), F.array_join(F.slice(F.split(x["p"], "\n"), 2, 1 << 30), "\n"))
    texts = found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(passage).alias("p")))), one), "\n---\n").alias("text"))
    status = F.when(failed, "api_error").when(F.col("text").isNull(), "no_results").otherwise("success")
    return queries.join(texts, key, "left").select(key, status.alias("status"), F.when(~failed, F.col("text")).alias("text"))


def pooled(kind: str, tokens: Column, mask: Column, pooler: Column) -> Column:
    """One vector for a text: ``mean`` of the token vectors that the mask keeps,
    ``cls``, the first token's, or ``pooler``, the model's own."""
    if kind == "cls":
        return F.get(tokens, 0)
    if kind == "pooler":
        return pooler
    if kind != "mean":
        raise NotImplementedError(kind)
    kept = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: x["m"] != 0)
    zero = F.transform(F.get(tokens, 0), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + q))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def bm25(queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, text: str, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``: the best ``k`` documents of each query, ties
    by id, by an index that is built for this one search."""
    path = scratch(corpus.sparkSession, "bm25")
    inverted_index.build(corpus, doc_id, text, path)
    return inverted_index.search(corpus.sparkSession, path, queries, query_id, doc_id, text, k, k1, b)
