"""From raw documents to token ids: five stages, each over all that the one
before it kept.

Each function takes ``(spark, docs, sf_dir)``.  All but the last return the
columns of ``documents``, with ``n_chars`` counted anew where the text changes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontamination, line_dedup, quality, signature_tree
from quillon.session import materialised, removed, scope, scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half go.  The model learns from the labels
    that are not held out."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, keep=tuple(docs.columns), score_col="quillon_score").filter("quillon_score >= 0.5").select(docs.columns)


def duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents have go; documents stay."""
    out = line_dedup.dropped(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays, that with the smallest id; of several of that
    id, the one whose text has the smallest hash.  Rows without an id stay only where
    no row of their component has one.  Texts without words stay, equal rows once."""
    joined = materialised(spark, signature_tree.joined(docs, named=True), "joined")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x")
    kept = joined.filter("component IS NOT NULL").groupBy("component").agg(best).select("x.doc_id", "x.text_hash")
    kept = kept.unionByName(joined.filter("component IS NULL").select("doc_id", "text_hash").distinct()).toDF("kept_id", "kept_hash")
    out = docs.join(kept, docs["doc_id"].eqNullSafe(F.col("kept_id")) & (F.xxhash64(docs["text"]) == F.col("kept_hash")), "left_semi")
    again = joined.groupBy("doc_id", "text_hash").count().filter("count > 1")
    return out if again.isEmpty() else out.dropDuplicates(["doc_id", "text"])  # texts are only moved again if a row may repeat


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified passage of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of what is left, encoded and decoded."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", duplicate_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("BPE encoding and decoding", token_ids),
]

#: No SQL has a boosted model, BM25 retrieval or BPE: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared
    folder and read again, and what it needed meanwhile is deleted then.  Only the
    last stage's input stays, until its result has been read
    (``session.clear_scratch``)."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        to = scratch(spark, "stage")
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(to)
        docs = spark.read.schema(out.schema).parquet(to)
        if before:
            removed(spark, before)
        before = to
    return STAGES[-1][1](spark, docs, sf_dir)
