"""Extractive answers, source lists, JSON responses and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import display_name

#: What is said when nothing was found, and the prompt's wording.
DONT_KNOW = "I don't know based on the given information."
PROMPT = "Answer the question using only the context.\n\nContext:\n%s\n\nQuestion: %s\nAnswer:"


def answer_top1(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(qid, answer): the text of each query's best result, or a fixed sentence. ranked: (qid, rank, page_content)."""
    first = ranked.groupBy("qid").agg(F.min_by("page_content", "rank").alias("top"))
    return queries.select("qid").join(first, "qid", "left").select("qid", F.coalesce("top", F.lit(DONT_KNOW)).alias("answer"))


def source_score(own: Column, from_metadata: Column) -> Column:
    """A result's own score, else its metadata's, as a double."""
    return F.coalesce(own.cast("double"), from_metadata.cast("double"))


def format_sources(ranked: DataFrame) -> DataFrame:
    """ranked with display_name and a double score. ranked: (..., doc_name, file_path, score, metadata_score)."""
    return ranked.select(*[c for c in ranked.columns if c not in ("score", "metadata_score", "display_name")], display_name(F.col("doc_name"), F.col("file_path")).alias("display_name"), source_score(F.col("score"), F.col("metadata_score")).alias("score"))


def responses(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(qid, response): each query's answer and sources as JSON; null fields, a null score included, are left out. ranked: (qid, rank, page_content, doc_name, file_path, score)."""
    source = F.struct("page_content", F.struct("file_path", "doc_name", F.col("score").cast("double").alias("score")).alias("metadata"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", source.alias("s"))))
    lists = ranked.groupBy("qid").agg(ordered.alias("x"), F.min_by("page_content", "rank").alias("top")).select("qid", "top", F.transform("x", lambda s: s["s"]).alias("sources"))
    joined = queries.select("qid").join(lists, "qid", "left").withColumn("answer", F.coalesce("top", F.lit(DONT_KNOW)))
    empty = F.from_json(F.lit("[]"), lists.schema["sources"].dataType.simpleString())
    return joined.select("qid", F.to_json(F.struct("answer", F.coalesce("sources", empty).alias("source_documents"))).alias("response"))


def render_prompt(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(qid, prompt): the results' texts by rank as context (at most as many as were retrieved), and the question. queries: (qid, query)."""
    context = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "page_content"))).alias("x")).select("qid", F.array_join(F.transform("x", lambda s: s["page_content"]), "\n\n").alias("context"))
    return queries.select("qid", "query").join(context, "qid", "left").select("qid", F.format_string(PROMPT, F.coalesce("context", F.lit("")), F.coalesce("query", F.lit(""))).alias("prompt"))


def not_blank(queries: DataFrame) -> DataFrame:
    """queries without blank ones, as interactive callers want it; the batch operators take blank queries too."""
    return queries.filter(F.trim("query") != "")
