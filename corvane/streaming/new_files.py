"""Optional stream of new files. It sees each path once: files that change later need the manifest's batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.text import clean_text
from corvane.operators.chunk import chunk_documents

BINARY = "path string, modificationTime timestamp, length long, content binary"


def new_chunks(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """Stream of chunks (file_path, chunk_ix, page_content) of UTF-8 files that appear in the folder."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).load(folder)
    texts = files.select(F.col("path").alias("file_path"), clean_text(F.decode("content", "UTF-8")).alias("text"))
    return chunk_documents(texts, "file_path", "text")


def append_new(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new to a Parquet folder and stops."""
    return new_chunks(spark, folder).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
