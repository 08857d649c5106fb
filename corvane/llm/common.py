"""What the training-data operators share: tables, the shared folder, materialised steps, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-cases A-Z alone; Spark's lower() follows Unicode."""
    return F.translate(column, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, as a full URI. Where that is unset a local session gets a temporary one, and any other is refused."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or getattr(context, "_corvane_shared", None)
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set; the executors need a folder that all of them see")
        found = context._corvane_shared = "file://" + tempfile.mkdtemp(prefix="corvane-")  # the setting itself can't be changed in a running session
    if "://" not in found:
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
        found = re.sub(r"^(\w+):/(?!/)", r"\1:///", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/corvane/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside the block alone."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialised(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends at files that outlive executors. The step's shuffle files go with the step."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """df marked for broadcast if it has at most ``rows`` rows of ``size`` bytes in all (as JSON), counted up to that bound; else as it is, and the join shuffles."""
    rows, size = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if size is None else size
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def discard(df: DataFrame) -> None:
    """Deletes the files behind a materialised step that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the input: {', '.join(missing)}")


def only_rows(docs: DataFrame, kept: DataFrame, digest: Column) -> DataFrame:
    """One row of docs for each (doc_id, digest of its text) in kept, and all rows without a doc_id: what can't be named isn't dropped."""
    key = ["doc_id", "__digest"]
    named = docs.withColumn("__digest", digest).join(kept.toDF(*key).distinct(), key, "left_semi").dropDuplicates(key).select(*docs.columns)
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Components of a graph of (a, b) edges over longs: one (node, root) row per node of an edge, root the least node.

    Alternates large-star and small-star steps, each a grouped minimum and a join on the node, until the
    edges are stars. Every round is written to the shared folder; nothing but a count and a checksum of the
    edges reaches the driver. Self-loops and repeated edges are harmless; an empty input gives no rows.
    Raises if the edges have not settled after ``rounds`` rounds (their number is logarithmic in practice).
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def linked(e: DataFrame, both: bool) -> DataFrame:
        """Each edge as (u, v) from both ends, or from the larger end only."""
        if both:
            return e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")
        return e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))

    current = materialised(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    before = state(current)
    for _ in range(rounds):
        if not before[0]:
            break
        pairs = linked(current, True)
        least = pairs.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u"), F.least("u", "w").alias("m"))
        large = pairs.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        middle = materialised(large, "large-star")
        down = linked(middle, False)
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        following = materialised(small, "small-star")
        after = state(following)
        discard(current)
        discard(middle)
        current, settled, before = following, after == before, after
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    pairs = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(pairs.select(F.col("root").alias("node"), "root")).distinct()


def released(batches: Iterable) -> Iterator:
    """The batches of a task, behind the last of which what a Python worker has freed goes back to the system: workers outlive tasks, and with them what they hold."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what one Arrow batch of whole texts can hold: at most ``rows`` of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
