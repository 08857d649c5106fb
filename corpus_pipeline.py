"""Toxicity, exact dedup, SimHash near-dedup, benchmark decontamination and BPE encoding, one stage after another.

Each stage reads what its predecessor kept, whole, and returns the columns of documents; the last adds token counts and ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, decontaminate, exact_dedup, simhash, toxicity
from corvane.llm.common import materialised, table
from corvane.llm.queries import BPE_FILE


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that the network, trained on the labelled rows of docs itself, predicts toxic.

    Null and empty texts stay unless clean windows count as toxic; rows with a null id are judged by their text; repeated rows go or
    stay together; columns of any name are carried through; an empty table gives no rows.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest id. Null counts as empty; rows with a null id all stay."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near texts, that with the smallest id. Null, empty and blank texts are near each other; rows with a null id all stay."""
    return simhash.keep_representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose text holds a window of the benchmark, those with a null id too; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with n_tokens, ids (little-endian u32) and decoded_sha256, the digest of what the ids decode to.

    Every row stays; null and empty texts have no ids. A column of docs that is named like one of the new ones makes way for it.
    """
    out = byte_bpe.encode(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, keep=tuple(docs.columns), round_trip=True)
    kept = [c for c in docs.columns if c.lower() not in ("n_tokens", "ids", "decoded", "decoded_sha256")]
    return out.select(*kept, "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", without_toxic), ("exact dedup", without_copies), ("SimHash near-dedup", without_near_copies), ("benchmark decontamination", without_benchmark), ("byte-level BPE", encoded)]

#: Toxicity, SimHash and BPE aren't expressible in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read back before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
