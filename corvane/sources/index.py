"""A versioned index on plain Parquet: every commit writes a new version folder and then moves a pointer.

A version holds the chunks with their dense vectors, postings (the chunks' terms, or what a sparse encoder made of them, sorted
by term, and a mark with each chunk's length), how many chunks each term is in, the collection's size, and the
manifest of the files. Readers follow the pointer, so they see whole versions only; a crash before the pointer moves leaves the old version and its manifest in force.
Old versions are dropped by ``vacuum``. Chunks are named by their content, so that a commit carries over what it knows of chunks
that stay and only encodes and counts new ones.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.functions.encoders import DenseEncoder, SparseEncoder, dense_vectors, hashed_dense, sparse_vectors
from corvane.operators import search
from corvane.operators.changes import change_detection, deleted_files, next_manifest, replace_by_file
from corvane.operators.chunk import OVERLAP, SIZE, chunk_documents, chunk_id
from corvane.operators.common import is_small, kept_side, top_per
from corvane.sources.files import FILES, PageParser, list_files, read_pages, text_pages, whole_documents

CHUNKS = "chunk_id string, file_path string, chunk_ix int, page_content string, doc_name string, source string, date string, num_pages int, dense array<float>"
POSTINGS, TERMS, TOTALS = "id string, term string, tf bigint, dl int, weight float", "term string, df bigint", "n_docs bigint, avgdl double"
LOG = logging.getLogger("corvane.index")


class DocumentIndex:
    """Chunks, their postings and the manifest of the files they come from, under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, tail: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{tail}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def version(self) -> str | None:
        """The current version's name; None before the first commit or after a drop."""
        path, store = self._fs("CURRENT")
        if not store.exists(path):
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/CURRENT", wholetext=True).first()[0])["version"]

    def _read(self, part: str, schema: str) -> DataFrame:
        now = self.version()
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{now}/{part}") if now else self.spark.createDataFrame([], schema)

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS)

    def postings(self) -> DataFrame:
        return self._read("postings", POSTINGS)

    def manifest(self) -> DataFrame:
        return self._read("manifest", FILES)

    def term_index(self, queries: DataFrame) -> search.TermIndex:
        """What sparse search reads for queries (qid, query), from the stored postings alone."""
        asked = search.query_terms(queries)
        small = is_small(asked)
        wanted = asked.select("term").distinct()
        wanted = F.broadcast(wanted) if small else wanted
        totals = self._read("totals", TOTALS).first()
        n_docs, avgdl = totals or (0, 0.0)
        return search.TermIndex(asked, self.postings().select("id", "term", "tf", "dl").join(wanted, "term", "left_semi"), self._read("terms", TERMS).join(wanted, "term", "left_semi"), n_docs, avgdl or 0.0, small)

    def commit(self, chunks: DataFrame, manifest: DataFrame, sparse_encoder: SparseEncoder | None = None) -> str:
        """Writes a version and moves the pointer to it, by one rename over the old one. chunks may lack ``dense``."""
        name, old = f"v-{uuid.uuid4().hex}", self.version()
        known = self.chunks().select(F.col("chunk_id").alias("id"))
        counted = Observation("chunks")
        full = chunks if "dense" in chunks.columns else chunks.withColumn("dense", F.lit(None).cast("array<float>"))
        full.select(*(c.split()[0] for c in CHUNKS.split(", "))).observe(counted, F.count("*").alias("chunks"), F.count("dense").alias("vectors")).write.parquet(f"{self.folder}/{name}/chunks")
        stored = self.spark.read.schema(CHUNKS).parquet(f"{self.folder}/{name}/chunks").select(F.col("chunk_id").alias("id"), F.col("page_content").alias("text"))
        fresh = stored.join(known, "id", "left_anti") if old else stored
        entries = search.term_counts(fresh).withColumn("weight", F.lit(None).cast("float"))
        if sparse_encoder is not None:
            marks = fresh.select("id", F.lit(search.MARK).alias("term"), F.lit(1).cast("long").alias("tf"), F.lit(0).alias("dl"), F.lit(None).cast("float").alias("weight"))
            entries = fresh.select("id", F.explode(sparse_vectors(F.col("text"), sparse_encoder)).alias("term", "weight")).select("id", "term", F.lit(1).cast("long").alias("tf"), F.lit(0).alias("dl"), "weight").unionByName(marks)
        if old:
            entries = entries.unionByName(self.postings().join(stored.select("id"), "id", "left_semi"))
        entries.select(*(c.split()[0] for c in POSTINGS.split(", "))).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{self.folder}/{name}/postings")
        entries = self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/{name}/postings")
        real = F.col("term") != search.MARK
        entries.filter(real).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{self.folder}/{name}/terms")
        entries.filter(~real).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).write.parquet(f"{self.folder}/{name}/totals")
        manifest.write.parquet(f"{self.folder}/{name}/manifest")
        self.counts = counted.get
        LOG.info("version %s holds %s", name, self.counts)
        path, store = self._fs(f"pointer-{name}")
        out = store.create(path, False)
        out.write(bytearray(json.dumps({"version": name}).encode()))
        out.close()
        fs = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").OVERWRITE
        fs.FileContext.getFileContext(store.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf()).rename(path, self._fs("CURRENT")[0], options)
        return name

    def create_if_missing(self) -> bool:
        """An empty first version; False if there is one."""
        if self.version():
            return False
        self.commit(self.chunks(), self.manifest())
        return True

    def recreate(self) -> None:
        self.drop()
        self.create_if_missing()

    def drop(self) -> bool:
        path, store = self._fs("")
        return store.exists(path) and store.delete(path, True)

    def vacuum(self) -> int:
        """Deletes all versions but the current one; readers of old ones must be done."""
        now, dropped = self.version(), 0
        path, store = self._fs("v-*")
        for x in store.globStatus(path) or ():
            if x.getPath().getName() != now:
                store.delete(x.getPath(), True)
                dropped += 1
        return dropped


def ingest(spark: SparkSession, folder: str, index: DocumentIndex, parser: PageParser = text_pages, purge_deleted: bool = True, size: int = SIZE, overlap: int = OVERLAP, dense_encoder: DenseEncoder = hashed_dense, sparse_encoder: SparseEncoder | None = None) -> dict[str, int]:
    """Brings the index up to date with the folder's files; returns the counts of files new, modified, same, deleted and failed, and of chunks and vectors.

    Changed files are parsed, cleaned, chunked, encoded and replaced, also when they give no chunks any more; failed files keep their
    old chunks and manifest entry. Without ``purge_deleted`` chunks of files that are gone stay. Without a
    ``sparse_encoder`` sparse search is BM25 over the chunks' terms; an index keeps to one way.
    """
    current = list_files(spark, folder)
    manifest = index.manifest()
    status = change_detection(current, manifest)
    changed = status.filter("status <> 'same'")
    gone = deleted_files(current, manifest)
    stage = f"{index.folder}/stage-{uuid.uuid4().hex}"
    read_pages(spark, changed, folder, parser).write.parquet(stage)  # parsed once, whatever reads it
    pages = spark.read.parquet(stage)
    failed = pages.filter(F.col("error").isNotNull()).select("file_path").distinct()
    documents = whole_documents(pages, current)
    cut = chunk_documents(documents, "file_path", "page_content", size, overlap).withColumn("dense", dense_vectors(F.col("page_content"), dense_encoder))
    fresh = cut.select(chunk_id(F.col("file_path"), F.col("chunk_ix"), F.col("page_content")).alias("chunk_id"), *(x.split()[0] for x in CHUNKS.split(", ")[1:]))
    touched = changed.select("file_path").join(failed, "file_path", "left_anti")
    if purge_deleted:
        touched = touched.unionByName(gone)
    counts = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}  # three rows at most
    out = {k: counts.get(k, 0) for k in ("new", "modified", "same")} | {"deleted": gone.count(), "failed": failed.count()}
    index.commit(replace_by_file(index.chunks(), touched, fresh), next_manifest(current, manifest, failed), sparse_encoder)
    path, store = index._fs(stage.rsplit("/", 1)[1])
    store.delete(path, True)
    out |= index.counts
    LOG.info("ingest of %s: %s", folder, out)
    return out


def sparse_candidates(queries: DataFrame, index: DocumentIndex, k: int, sparse_encoder: SparseEncoder | None = None) -> DataFrame:
    """(qid, id, score, rank) of queries (qid, query): by BM25, or by the dot product of the encoder's weights."""
    if sparse_encoder is None:
        return search.sparse_search(index.term_index(queries), k)
    asked = queries.select("qid", F.explode(sparse_vectors(F.col("query"), sparse_encoder)).alias("term", "asked"))
    scored = index.postings().select("id", "term", "weight").join(asked, "term").groupBy("qid", "id").agg(F.sum(F.col("weight").cast("double") * F.col("asked")).alias("score"))
    return top_per(scored, "qid", F.col("score"), "id", k)


def hybrid_search(queries: DataFrame, index: DocumentIndex, k: int = search.TOP_K, dense_encoder: DenseEncoder = hashed_dense, sparse_encoder: SparseEncoder | None = None) -> DataFrame:
    """(qid, id, score, rank): fused top-k chunks of the index for queries (qid, query), which the index's encoders encode."""
    vectors = queries.select("qid", dense_vectors(F.col("query"), dense_encoder).alias("vec"))
    dense = search.dense_topk(vectors, index.chunks().select(F.col("chunk_id").alias("id"), F.col("dense").alias("vec")), k)
    return search.rank_fusion(dense, sparse_candidates(queries, index, k, sparse_encoder), k=k)


def hybrid_rerank(queries: DataFrame, index: DocumentIndex, candidates: int = search.CANDIDATES, n: int = search.RERANKED, dense_encoder: DenseEncoder = hashed_dense, sparse_encoder: SparseEncoder | None = None, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """The n best of the fused candidates, by a pair scorer of (query, text) or by idf coverage over the stored postings."""
    found = hybrid_search(queries, index, candidates, dense_encoder, sparse_encoder)
    texts = index.chunks().select(F.col("chunk_id").alias("id"), F.col("page_content").alias("text"))
    return search.rerank(queries, found, texts, n, scorer, index.term_index(queries))


def with_sources(ranked: DataFrame, index: DocumentIndex) -> DataFrame:
    """ranked (qid, id, score, rank) with the chunks' page_content, file_path, doc_name, source, date and num_pages: only what was found is joined."""
    chunks = index.chunks().select(F.col("chunk_id").alias("id"), "page_content", "file_path", "doc_name", "source", "date", "num_pages")
    return chunks.join(kept_side(ranked), "id").select(*ranked.columns, *chunks.columns[1:])
