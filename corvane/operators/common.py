"""What the operators share."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


def is_small(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether df has at most ``rows`` rows of ``size`` bytes in all (as JSON); one job that reads no more than that many rows."""
    rows, size = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if size is None else size
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return n <= rows and (held or 0) <= size


def small_side(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """df marked for broadcast if it is small; else as it is, and the join shuffles."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def kept_side(df: DataFrame) -> DataFrame:
    """As ``small_side``, of a df that is dear to compute: it is kept (``persist``), so that counting it isn't computing it twice."""
    return small_side(df.persist(StorageLevel.MEMORY_AND_DISK))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what one Arrow batch of whole texts can hold: at most ``rows`` of them. The setting stays, as plans run later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def top_per(df: DataFrame, group: str, score: Column, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each group by falling score (to nine decimals) and rising tie, with their rank from 1. Spark cuts to k before it shuffles."""
    order = Window.partitionBy(group).orderBy(F.round(score, 9).desc(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)
