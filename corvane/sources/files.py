"""File listings, page extraction, golden questions and manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import base_name, clean_text, local_date

FILES = "file_path string, mod_time timestamp, size bigint"
PAGES = "file_path string, page_no int, text string, error string"
#: content -> texts of the pages
PageParser = Callable[[bytes], list[str]]


def text_pages(content: bytes) -> list[str]:
    """The default parser: UTF-8 text with form feeds between pages."""
    return content.decode("utf-8").split("\f")


def _binary(spark: SparkSession, folder: str, recursive: bool = False, glob: str | None = None) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return None
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def list_files(spark: SparkSession, folder: str, glob: str | None = "*.pdf", recursive: bool = False, skip_temporary: bool = True) -> DataFrame:
    """(file_path, mod_time, size) of the files that match, case and all; names with a leading ~ are left out unless asked for.

    A folder that doesn't exist has no files. Spark passes over names with a leading dot or underscore and over empty files. Contents aren't read.
    """
    found = _binary(spark, folder, recursive, glob)
    if found is None:
        return spark.createDataFrame([], FILES)
    listed = found.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("mod_time"), F.col("length").alias("size"))
    return listed.filter(~base_name(F.col("file_path")).startswith("~")) if skip_temporary else listed


def read_pages(spark: SparkSession, files: DataFrame, folder: str, parser: PageParser = text_pages, glob: str | None = "*.pdf", recursive: bool = False) -> DataFrame:
    """(file_path, page_no, text, error): the pages of those files of the folder that ``files`` names; a file that can't be parsed gives one row with its error."""
    found = _binary(spark, folder, recursive, glob)
    if found is None:
        return spark.createDataFrame([], PAGES)
    wanted = found.select(F.col("path").alias("file_path"), "content").join(files.select("file_path"), "file_path", "left_semi")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for path, content in zip(part["file_path"], part["content"]):
                try:
                    texts, error = list(parser(content)), None
                    if not texts:
                        raise ValueError("no pages")
                except Exception as e:  # whatever a plug-in raises is that file's failure alone
                    texts, error = [None], f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"file_path": path, "page_no": range(len(texts)), "text": texts, "error": error})

    return wanted.mapInPandas(parse, PAGES)


def whole_documents(pages: DataFrame, files: DataFrame) -> DataFrame:
    """A row a parsed file: page_content (its non-empty pages in order, joined by a space, cleaned), file_path, doc_name, source, date, num_pages."""
    ordered = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("page_no", "text"))))
    joined = pages.filter(F.col("error").isNull()).groupBy("file_path").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), " ").alias("text"), F.count("*").cast("int").alias("num_pages"))
    return joined.join(files, "file_path").select(clean_text(F.col("text")).alias("page_content"), "file_path", base_name(F.col("file_path")).alias("doc_name"), F.col("file_path").alias("source"), local_date(F.col("mod_time")).alias("date"), "num_pages")


def golden_questions(spark: SparkSession, path: str) -> DataFrame:
    """(Question, Answer) of a CSV whose fields may hold line breaks and doubled quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def write_word_frequencies(counts: DataFrame, path: str) -> None:
    """(word, frequency) as a CSV with the header Word,Frequency, in one file as there are few."""
    write_csv(counts.select(F.col("word").alias("Word"), F.col("frequency").alias("Frequency")).coalesce(1), path)
