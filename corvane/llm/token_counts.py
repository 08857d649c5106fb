"""Token counts as delta-maintained rollups.

A ledger takes batches of changes: a document's count under a tokenizer version is inserted, revised or deleted. Each
batch becomes signed rows (the count that goes, the count that comes), which are added up by source, language and
tokenizer version; totals are the sums of these deltas and never need the texts again.

A batch is written to a folder of its own attempt and published by one rename to the next number of the log, which
fails if that number is taken. A batch id that the log holds already is skipped, so batches may be sent again after any
failure. What an attempt that didn't get so far leaves behind is never read. The rename must be atomic, as it is on HDFS and local
disks; on an object store without that, writers have to be kept apart by other means.

Every ``SNAPSHOT_EVERY`` batches the live counts are written out, so that a commit reads the last such snapshot and the entries
behind it, not the whole log.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from .common import materialised, released, require, small_batches

KEY, GROUP = ("doc_id", "tokenizer"), ("source", "lang", "tokenizer")
ENTRY = "doc_id long, tokenizer string, source string, lang string, n_tokens long, old_source string, old_lang string, old_tokens long"
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
TRIES, SNAPSHOT_EVERY = 20, 16
LIVE = "doc_id long, tokenizer string, source string, lang string, n_tokens long"


class TokenLedger:
    """Batches of changes in a folder, and the totals they add up to. Any number of readers; writers that meet are put in order."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, tail: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{tail}")

    def _found(self, pattern: str) -> list[str]:
        path = self._path(pattern)
        store = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return [x.getPath().toString() for x in store.globStatus(path) or ()]

    def committed(self) -> dict[str, int]:
        """The ids of the published batches, with their numbers."""
        return {m[2]: int(m[1]) for x in self._found("log/seq=*/id=*") if (m := re.search(r"/seq=(\d+)/id=([^/]*)$", x))}

    def _read(self, part: str, schema: str, after: int = 0) -> DataFrame:
        paths = [x for x in self._found(f"log/seq=*/id=*/part={part}") if int(re.search(r"/seq=(\d+)/", x)[1]) > after]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, seq int")
        return self.spark.read.schema(f"{schema}, seq int").option("basePath", f"{self.folder}/log").parquet(*paths)

    def snapshots(self) -> list[int]:
        """The numbers of the batches whose state has been written out."""
        return sorted(int(m[1]) for x in self._found("snapshots/seq=*") if (m := re.search(r"/seq=(\d+)$", x)))

    def live(self) -> DataFrame:
        """(doc_id, tokenizer, source, lang, n_tokens): the counts that hold now, each key's last entry unless it was a deletion."""
        base = max(self.snapshots(), default=0)
        entries = self._read("entries", ENTRY, base).select(*KEY, "source", "lang", "n_tokens", "seq")
        if base:
            entries = entries.unionByName(self.spark.read.schema(LIVE).parquet(f"{self.folder}/snapshots/seq={base:010d}").withColumn("seq", F.lit(base)))
        last = F.max_by(F.struct("source", "lang", "n_tokens"), "seq").alias("now")
        return entries.groupBy(*KEY).agg(last).select(*KEY, "now.*").filter(F.col("n_tokens").isNotNull())

    def snapshot(self) -> int:
        """Writes out the live counts as of the last batch, and returns its number; several writers write the same."""
        seq = max(self.committed().values(), default=0)
        if seq and seq not in self.snapshots():
            attempt = f"attempts/{uuid.uuid4().hex}"
            self.live_at(seq).write.parquet(f"{self.folder}/{attempt}")
            self._publish(attempt, f"snapshots/seq={seq:010d}")
        return seq

    def live_at(self, seq: int) -> DataFrame:
        """The counts that held after batch ``seq``, from the whole log."""
        last = F.max_by(F.struct("source", "lang", "n_tokens"), "seq").alias("now")
        return self._read("entries", ENTRY).filter(F.col("seq") <= seq).groupBy(*KEY).agg(last).select(*KEY, "now.*").filter(F.col("n_tokens").isNotNull())

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens): the sum of the published deltas; groups that hold no document have no row."""
        sums = [F.sum(c).cast("long").alias(c) for c in ("n_docs", "n_tokens")]
        return self._read("deltas", DELTA).groupBy(*GROUP).agg(*sums).filter("n_docs <> 0")

    def recounted(self) -> DataFrame:
        """The same from the live counts, for audits."""
        return self.live().groupBy(*GROUP).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Publishes changes (doc_id, tokenizer, source, lang, n_tokens; a null n_tokens deletes); False if the log holds batch_id.

        Of several changes to one key in a batch the one with the largest count stays (then source, then language; a deletion
        only stands alone). Deleting what isn't live changes nothing. Null ids, sources and languages are values like
        any other; an empty batch is published as such; other columns are ignored.
        """
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError("a batch id takes letters, digits, dots, hyphens and underscores")
        require(changes, (*KEY, "source", "lang", "n_tokens"))
        for _ in range(TRIES):
            known = self.committed()
            if batch_id in known:
                return False
            seq = max(known.values(), default=0) + 1
            attempt = f"attempts/{uuid.uuid4().hex}"
            self._write(changes, f"{self.folder}/{attempt}/id={batch_id}", bool(known))
            if self._publish(attempt, f"log/seq={seq:010d}"):
                if seq % SNAPSHOT_EVERY == 0:
                    self.snapshot()
                return True
        raise RuntimeError(f"batch {batch_id} met another writer {TRIES} times")

    def _write(self, changes: DataFrame, path: str, compare: bool) -> None:
        chosen = F.max(F.struct("n_tokens", "source", "lang")).alias("new")
        new = changes.select(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer", "source", "lang", F.col("n_tokens").cast("long").alias("n_tokens")).groupBy(*KEY).agg(chosen).select(*KEY, "new.source", "new.lang", "new.n_tokens")
        if compare:
            old = self.live().select(F.col("doc_id").alias("k1"), F.col("tokenizer").alias("k2"), F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("n_tokens").alias("old_tokens"))
            entries = new.join(old, F.col("doc_id").eqNullSafe(F.col("k1")) & F.col("tokenizer").eqNullSafe(F.col("k2")), "left").drop("k1", "k2")
        else:
            entries = new.selectExpr("*", "cast(null as string) old_source", "cast(null as string) old_lang", "cast(null as long) old_tokens")
        entries.select(*(x.split()[0] for x in ENTRY.split(", "))).write.parquet(f"{path}/part=entries")
        stored = self.spark.read.schema(ENTRY).parquet(f"{path}/part=entries")
        signed = F.array(F.struct(F.lit(1).alias("sign"), "source", "lang", F.col("n_tokens").alias("n")), F.struct(F.lit(-1).alias("sign"), F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_tokens").alias("n")))
        rows = stored.select("tokenizer", F.explode(signed).alias("s")).select("tokenizer", "s.*").filter(F.col("n").isNotNull())
        sums = (F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).cast("long").alias("n_tokens"))
        rows.groupBy(*GROUP).agg(*sums).filter("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{path}/part=deltas")

    def _publish(self, attempt: str, place: str) -> bool:
        """Moves an attempt to its place; False if that is taken."""
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs
        target, source = self._path(place), self._path(attempt)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        context = fs.FileContext.getFileContext(source.getFileSystem(conf).getUri(), conf)
        source.getFileSystem(conf).mkdirs(target.getParent())
        try:
            context.rename(source, target, self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "not empty" in str(e):
                return False
            raise
        return True


def count(docs: DataFrame, versions: dict[str, tuple[str, str | None]], text_col: str = "text") -> DataFrame:
    """docs without its text, with a column of token counts for each version: {version: (rank file, pattern)}.

    Null texts have no tokens. One pass over the texts for all versions. A column of docs named like a version is left out.
    """
    require(docs, (text_col,))
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col and c.lower() not in {v.lower() for v in versions}]
    plans = [(byte_bpe.shipped(docs, path), pattern) for path, pattern in versions.values()]
    carried = docs.select(F.struct(F.lit(True).alias("__row"), *keep).alias("kept"), F.col(text_col).cast("string").alias("text"))
    schema = f"kept {carried.schema['kept'].dataType.simpleString()}, n array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = [byte_bpe.codec(ranks.value, pattern) for ranks, pattern in plans]
        for batch in released(batches):
            counted = [[] for _ in codecs]
            for part in byte_bpe.in_parts(batch.column(1)):
                cut = byte_bpe.Chunks(part)
                for own, bpe, (_, pattern) in zip(counted, codecs, plans):
                    first = next(c for c, (_, p) in zip(codecs, plans) if p == pattern)  # versions of one pattern split texts once
                    own.append(bpe.counts(part, cut, first.splitter))
            table = np.stack([np.concatenate([np.empty(0, np.int64), *own]) for own in counted], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * len(codecs), pa.int32()), pa.array(table.ravel()))
            yield pa.record_batch([batch.column(0), lists], names=["kept", "n"])

    out = carried.mapInArrow(run, schema)
    return out.select(*(F.col("kept").getField(c).alias(c) for c in keep), *(F.get("n", F.lit(i)).alias(v) for i, v in enumerate(versions)))


def corpus_rollup(docs: DataFrame, folder: str, versions: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Totals by source, language and tokenizer version of all documents under all ``versions`` (name: rank file, pattern), after three batches, each sent twice.

    load: every document under the first version, its count estimated as a quarter of its bytes, and under the version `bytes`.
    count: the true counts, which revise the estimates and come in under the other versions. retire: the
    version `bytes` is deleted. Null texts have no tokens; an empty table gives no rows; of rows with one id the
    largest count holds.
    """
    require(docs, ("doc_id", "text", "source", "lang"))
    own = docs.select("doc_id", "source", "lang", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    names = {f"n_{i}": v for i, v in enumerate(versions)}
    counted = materialised(count(own, dict(zip(names, versions.values()))), "token-counts")

    def changes(*entries: tuple[str, Column]) -> DataFrame:
        of = [F.struct(F.lit(v).alias("tokenizer"), n.cast("long").alias("n_tokens")) for v, n in entries]
        return counted.select("doc_id", "source", "lang", F.explode(F.array(*of)).alias("x")).select("doc_id", "source", "lang", "x.*")

    n_bytes, first = F.col("n_bytes"), next(iter(versions))
    ledger = TokenLedger(docs.sparkSession, folder)
    batches = {"load": changes((first, F.ceil(n_bytes / 4)), ("bytes", n_bytes)), "count": changes(*((v, F.col(c)) for c, v in names.items())), "retire": changes(("bytes", F.lit(None)))}
    for batch_id in ("load", "load", "count", "load", "retire", "count", "retire"):
        ledger.commit(batch_id, batches[batch_id])
    return ledger.totals()
