"""Corpus statistics and duplicate names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import plain_words, stem_and_extension

#: The English stop words in general use. Forms with an apostrophe never match, as punctuation goes before them.
STOP_WORDS: tuple[str, ...] = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her
    hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was
    were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
    hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren
    weren't won won't wouldn wouldn't
    """.split()
)


def stop_words() -> tuple[str, ...]:
    return STOP_WORDS


def corpus_words(docs: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """(word): every word of docs (text) that is no stop word. Texts are never joined into one."""
    found = docs.select(F.explode(plain_words(F.col("text"))).alias("word"))
    return found.filter(~F.col("word").isin(list(stop))) if stop else found


def word_counts(docs: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    return corpus_words(docs, stop).groupBy("word").agg(F.count("*").alias("frequency"))


def corpus_stats(docs: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """One row: total_words, unique_words, avg_word_len (null for an empty corpus), from one count of the words."""
    n = F.col("frequency")
    return word_counts(docs, stop).agg(F.coalesce(F.sum(n), F.lit(0)).alias("total_words"), F.count("*").alias("unique_words"), (F.sum(n * F.length("word")) / F.sum(n)).alias("avg_word_len"))


def top_words(docs: DataFrame, k: int = 20, stop: Sequence[str] = ()) -> DataFrame:
    """(word, frequency) of the k most frequent words; ties go to the word that sorts first."""
    return word_counts(docs, stop).orderBy(F.desc("frequency"), "word").limit(k)


def stats_report(stats: DataFrame) -> DataFrame:
    """The statistics as lines of text."""
    return stats.select(F.format_string("Total words: %d\nUnique words: %d\nAverage word length: %s", "total_words", "unique_words", F.coalesce(F.format_number("avg_word_len", 2), F.lit("n/a"))).alias("report"))


def duplicate_names(files: DataFrame) -> DataFrame:
    """(name, files): lower-cased file names, without extension, that several files (path) have."""
    stem, extension = stem_and_extension(F.col("path"))
    grouped = files.select(F.lower(stem).alias("name"), F.lower(extension).alias("ext"), "path").groupBy("name")
    return grouped.agg(F.array_sort(F.collect_list(F.struct("ext", "path"))).alias("files"), F.count("*").alias("n")).filter("n > 1").drop("n")


def unconverted(files: DataFrame) -> DataFrame:
    """Word files (path) without a PDF of the same folder and name beside them."""
    base, extension = F.regexp_replace("path", r"\.[^./]*$", ""), F.lower(stem_and_extension(F.col("path"))[1])
    keyed = files.select("path", base.alias("base"), extension.alias("ext"))
    return keyed.filter(F.col("ext").isin(".doc", ".docx")).join(keyed.filter(F.col("ext") == ".pdf").select("base"), "base", "left_anti").select("path")
