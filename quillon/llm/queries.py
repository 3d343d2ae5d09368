"""The corpus queries and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, compression, cross_align, decontamination, licenses, line_dedup, link_graph, quality, run_index, signature_tree, tandem_runs, token_counts, warc
from quillon.session import scratch, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), scratch(spark, "warc"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return n.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 2048 AS over_limit", "n_chunks", "n_widened")


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judged(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.judged(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.joined(table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.marked(table(spark, sf_dir, "documents")).drop("spans")


def planted_run(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of every tenth document (by CRC of its id) with a part of them
    repeated to the end.  A row without an id keeps its own."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op12_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem_runs.digests(table(spark, sf_dir, "documents"), changed=planted_run)


def op13_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_quality_gam": op3_quality_gam,
    "op4_decontamination": op4_decontamination,
    "op5_license_scan": op5_license_scan,
    "op6_url_filter": op6_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_run_index": op11_run_index,
    "op12_tandem_runs": op12_tandem_runs,
    "op13_cross_align": op13_cross_align,
}

SQL_1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS k FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN first_id END AS refers_to
FROM q
"""

ORACLES: dict[str, str] = {
    "op1_warc": SQL_1,
    "op5_license_scan": licenses.sql(),
    "op6_url_filter": link_graph.sql(),
    "op8_line_dedup": line_dedup.SQL,
}
