"""Questions in, answers out: retrieval by mode over a stored index, and its evaluation with golden questions."""

from __future__ import annotations

import logging
import resource
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import answer, evaluate
from corvane.sources import index as stored
from corvane.sources.files import write_csv
from corvane.sources.index import DocumentIndex

MODES: dict[str, Callable[..., DataFrame]] = {"hybrid": stored.hybrid_search, "hybrid-rerank": stored.hybrid_rerank}
LOG = logging.getLogger("corvane.serve")


def retrieve(queries: DataFrame, index: DocumentIndex, mode: str = "hybrid", **options) -> DataFrame | None:
    """The results of queries (qid, query) with their sources; None, and a line in the log, for a mode that there isn't."""
    if mode not in MODES:
        LOG.error("no such mode: %s (there are %s)", mode, ", ".join(MODES))
        return None
    return stored.with_sources(MODES[mode](queries, index, **options), index)


def respond(queries: DataFrame, index: DocumentIndex, mode: str = "hybrid", **options) -> DataFrame | None:
    """(qid, response): answer and sources of each query as JSON."""
    found = retrieve(queries, index, mode, **options)
    return None if found is None else answer.responses(queries, found)


@dataclass
class Usage:
    """Wall-clock milliseconds and the most resident megabytes of this process, the driver's Python."""

    ms: float = 0.0
    peak_mb: float = 0.0


def resident_mb() -> float:
    status = Path("/proc/self/statm")
    return int(status.read_text().split()[1]) * resource.getpagesize() / 1e6 if status.exists() else resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3


def measured(call: Callable, every: float = 0.01) -> tuple[object, Usage]:
    """What the call returns, and its usage, sampled every ten milliseconds."""
    usage, done = Usage(peak_mb=resident_mb()), threading.Event()

    def watch() -> None:
        while not done.wait(every):
            usage.peak_mb = max(usage.peak_mb, resident_mb())

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    began = time.perf_counter()
    try:
        out = call()
    finally:
        usage.ms = (time.perf_counter() - began) * 1000
        done.set()
        watcher.join()
    return out, usage


def evaluate_golden(golden: DataFrame, index: DocumentIndex, mode: str = "hybrid", out: str | None = None, **options) -> tuple[DataFrame, DataFrame] | None:
    """(rows, summary): golden questions (Question, Answer) answered over the index and scored; the rows also as CSV in ``out``.

    All questions are answered in one job: Latency_ms is its wall-clock time over the number of questions, and
    Peak_Script_Memory_MB the most that the driver's Python held meanwhile. A question without a result gets the fixed sentence. None for a mode
    that there isn't.
    """
    asked = evaluate.references(golden).withColumn("qid", F.xxhash64("Question", "Reference_Answer"))
    queries = asked.select("qid", F.coalesce("Question", F.lit("")).alias("query")).dropDuplicates(["qid"])
    if mode not in MODES:
        return retrieve(queries, index, mode)

    def answered() -> tuple[DataFrame, int]:
        kept = answer.answer_top1(queries, retrieve(queries, index, mode, **options)).persist(StorageLevel.MEMORY_AND_DISK)
        return kept, kept.count()

    (answers, n), usage = measured(answered)
    rows = asked.join(answers, "qid", "left").select("Question", "Reference_Answer", F.col("answer").alias("Generated_Answer"), F.when(F.col("answer").isNull(), "Error").otherwise("Success").alias("Status"), F.lit(usage.ms / max(n, 1)).alias("Latency_ms"), F.lit(usage.peak_mb).alias("Peak_Script_Memory_MB"))
    scored = evaluate.score_rows(rows)
    if out:
        write_csv(scored, out)
    return scored, evaluate.summary(scored)
