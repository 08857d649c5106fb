"""The registered query of each operator, on whole tables with production parameters, and its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, exact_dedup, language_id, license_scan, simhash, substring_dedup, token_counts, toxicity, warc_zip
from .common import scratch, table

BPE_FILE, MULTI_FILE = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.best_license(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = {name: (public_tokenizers.path(file), public_tokenizers.PATTERN) for name, file in (("byte_bpe_50k", BPE_FILE), ("byte_bpe_multi_50k", MULTI_FILE))}
    return token_counts.corpus_rollup(table(spark, sf_dir, "documents"), scratch(spark, "token-ledger"), versions)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_language_id, op3_byte_bpe, op4_simhash, op5_warc_zip, op6_substring_dedup, op7_decontaminate, op8_exact_dedup, op9_token_counts, op10_toxicity)}

ORACLES: dict[str, str] = {
    "op5_warc_zip": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        g AS (SELECT b, max(page_id) AS top FROM p WHERE octet_length(b) >= 1000 GROUP BY b HAVING count(*) > 1)
        SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest,
               CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN top <> page_id THEN top END AS refers_to
        FROM p LEFT JOIN g USING (b)""",
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM spots),
        least AS (SELECT s, min(doc_id) AS owner FROM win GROUP BY s),
        hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (s) WHERE doc_id > owner),
        tokens AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS s FROM tokens ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id::VARCHAR AS item, array_to_string(w[i:i + 9], ' ') AS s, len(w[i:i + 9]) AS n FROM starts),
        lens AS (SELECT DISTINCT n FROM win),
        spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens),
        runs AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM spots),
        hits AS (SELECT doc_id, i, runs.n, item FROM runs JOIN win USING (s, n)),
        places AS (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits),
        n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM places GROUP BY doc_id),
        named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op8_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
        g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM t JOIN g USING (s)""",
}
