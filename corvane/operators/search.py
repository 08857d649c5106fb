"""Batch retrieval: dense, sparse and fused top-k, and reranking. Queries are a table; each operator answers all of them at once.

Ids are of whatever type the tables have. Sparse search reads texts once: the counts of the queries' terms, with one
row for each document's length, are kept (``persist``) and all statistics, scores and reranking are taken from them. A
stored index (``corvane.sources.index``) has these counts already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import clean_text, terms
from corvane.operators.common import is_small, small_batches, small_side, top_per

K1, B, RRF_K, TOP_K, CANDIDATES, RERANKED = 1.2, 0.75, 60, 10, 20, 3
#: Rows and queries in one block of the dense search, and the queries (rows and bytes of vectors) that are sent to all tasks instead.
BLOCK, SENT_QUERIES, SENT_BYTES = 20_000, 20_000, 64_000_000
#: Weights, and pairs of queries and documents, that the sparse search sums up at a time.
SUMMED = 1_000_000
#: Stands behind the terms of each document; no term is a space.
MARK = " "


def unit_vectors(keys: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys and unit vectors by length; null, empty and zero vectors are left out."""
    out: dict[int, tuple[list, list]] = {}
    for i, v in zip(keys, vectors):
        if v is not None and len(v) and (norm := float(np.sqrt(np.dot(v, v)))) > 0:
            kept = out.setdefault(len(v), ([], []))
            kept[0].append(i)
            kept[1].append(np.asarray(v, np.float64) / norm)
    return {n: (np.array(a), np.array(b)) for n, (a, b) in out.items()}


def batch_vectors(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of an Arrow column of lists: (ids, unit vectors) for each length, without a Python object for each number."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    keys, flat = ids.to_numpy(zero_copy_only=False), lists.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths[lengths > 0]):
        some = np.flatnonzero(lengths == n)
        v = flat[starts[some][:, None] + np.arange(n)]
        norms = np.sqrt((v * v).sum(axis=1))
        good = norms > 0
        if good.any():
            yield keys[some[good]], v[good] / norms[good][:, None]


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by falling score (to nine decimals) and rising id. ids: a row for each row of scores."""
    order = np.lexsort((ids, -np.round(scores, 9)), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def dense_topk(queries: DataFrame, rows: DataFrame, k: int = TOP_K, block: int = BLOCK) -> DataFrame:
    """(qid, id, score, rank): by cosine, exactly. queries: (qid, vec); rows: (id, vec).

    Queries of a checked size go to all tasks as one matrix, and each task keeps its k best rows a query: no row
    is shuffled. Beyond that size both sides are dealt into blocks (``dense_blocks``). Null, empty and zero vectors and
    vectors of another length than the query's find nothing.
    """
    asked = queries.select("qid", F.col("vec").cast("array<double>").alias("vec"))
    n, held = asked.limit(SENT_QUERIES + 1).agg(F.count("*"), F.sum(8 * F.size("vec"))).first()
    if n > SENT_QUERIES or (held or 0) > SENT_BYTES:
        return dense_blocks(queries, rows, k, block)
    sent = asked.toArrow()
    matrices = [(q, v) for q, v in batch_vectors(*(sent.column(c).combine_chunks() for c in ("qid", "vec")))]
    shared = rows.sparkSession.sparkContext.broadcast({v.shape[1]: (q, v) for q, v in matrices})
    id_type, qid_type = rows.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for ids, vectors in batch_vectors(batch.column(0), batch.column(1)):
                n = vectors.shape[1]
                if n not in shared.value:
                    continue
                ids = ids.astype(str) if ids.dtype == object else ids
                by_id = np.argsort(ids, kind="stable")
                ids, vectors, asked = ids[by_id], vectors[by_id], shared.value[n][1]
                parts = []
                for at in range(0, len(asked), 256):
                    scores = asked[at : at + 256] @ vectors.T
                    order = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
                    parts.append((np.take_along_axis(scores, order, 1), ids[order]))
                new = tuple(np.concatenate(x) for x in zip(*parts))
                best[n] = best_of(*(np.concatenate(x, axis=1) for x in zip(best[n], new)), k) if n in best else new
        for n, (scores, ids) in best.items():
            qids = np.repeat(shared.value[n][0], ids.shape[1])
            yield pa.record_batch([pa.array(qids.tolist(), kinds[0]), pa.array(ids.ravel().tolist(), kinds[1]), pa.array(scores.ravel())], names=["qid", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(df.schema[c].dataType) for df, c in ((queries, "qid"), (rows, "id"))]
    found = rows.select("id", "vec").mapInArrow(search, f"qid {qid_type}, id {id_type}, score double")
    return top_per(found, "qid", F.col("score"), "id", k)


def dense_blocks(queries: DataFrame, rows: DataFrame, k: int = TOP_K, block: int = BLOCK) -> DataFrame:
    """As ``dense_topk``, for any number of queries: both sides are dealt into blocks of about ``block`` rows, and each pair of
    blocks is one matrix product that leaves k rows a query; nothing is broadcast, and no task holds more than two blocks."""
    n_rows, n_queries = (max(1, -(-x.count() // block)) for x in (rows, queries))

    def dealt(df: DataFrame, key: str, mine: int, other: int, own: str, others: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(other - 1))) if other > 1 else F.lit(0)
        return df.select(F.col(key).alias(key), F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64(key), F.lit(mine)).cast("int").alias(own), every.alias(others))

    left, right = dealt(rows, "id", n_rows, n_queries, "rb", "qb"), dealt(queries, "qid", n_queries, n_rows, "qb", "rb")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts, own = [], unit_vectors(a["id"], a["vec"])
        for n, (qids, asked) in unit_vectors(b["qid"], b["vec"]).items():
            if n not in own:
                continue
            ids, vectors = own[n]
            by_id = np.argsort(ids, kind="stable")
            ids, vectors = ids[by_id], vectors[by_id]
            for at in range(0, len(qids), 256):
                scores = asked[at : at + 256] @ vectors.T
                order = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
                parts.append(pd.DataFrame({"qid": np.repeat(qids[at : at + 256], order.shape[1]), "id": ids[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()}))
        return pd.concat(parts) if parts else pd.DataFrame({"qid": a["id"][:0], "id": a["id"][:0], "score": pd.Series(dtype="float64")})

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(best, schema)
    return top_per(found, "qid", F.col("score"), "id", k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term): each query's distinct terms. queries: (qid, query)."""
    return queries.select("qid", F.explode(F.array_distinct(terms(clean_text(F.col("query"))))).alias("term")).distinct()


def words_of(cleaned: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of cleaned texts: their words, the number of the text that each word is from, and the texts' lengths in words. As ``terms`` splits them."""
    split = pc.split_pattern(cleaned.cast(pa.large_string()), " ")
    words, rows = split.flatten(), np.repeat(np.arange(len(cleaned)), split.value_lengths().to_numpy(zero_copy_only=False))
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    return words.filter(pa.array(real)), rows[real], np.bincount(rows[real], minlength=len(cleaned))


def counted(rows: np.ndarray, codes: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, how often) of pairs that are given once for each time, by row and code."""
    pairs, n = np.unique(rows.astype(np.int64) * max(1, n_codes) + codes, return_counts=True)
    return pairs // max(1, n_codes), pairs % max(1, n_codes), n


def repeated(ids: DataFrame) -> DataFrame | None:
    """(again): the ids, null too, of more than one row, marked for broadcast if they are few; None if there are none. Only ids are shuffled."""
    again = ids.groupBy(F.col("id").alias("again")).agg(F.count("*").alias("n")).filter("n > 1").select("again").persist(StorageLevel.MEMORY_AND_DISK)
    return small_side(again) if again.take(1) else None


def term_counts(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, dl) of docs (id, text), and a row with the mark for every document; ``only`` (term, marked for broadcast if it is small) restricts the terms.

    Words are counted within each text, so that nothing is shuffled but ids; only the counts of ids that more than one row has are summed up.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, rows, lengths = words_of(batch.column(1))
            coded = words.dictionary_encode()
            at, codes, n = counted(rows, coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary))
            every = np.arange(len(lengths))
            term = pa.concat_arrays([coded.dictionary.take(pa.array(codes)).cast(pa.string()), pa.array([MARK] * len(every), pa.string())])
            at, n = np.concatenate([at, every]), np.concatenate([n, np.ones(len(every), np.int64)])
            yield pa.record_batch([batch.column(0).take(pa.array(at)), term, pa.array(n, pa.int64()), pa.array(lengths[at], pa.int32())], names=["id", "term", "tf", "dl"])

    kept = docs.select("id", clean_text(F.col("text")).alias("text")).mapInArrow(count, f"id {docs.schema['id'].dataType.simpleString()}, term string, tf bigint, dl int")
    if only is not None:
        kept = kept.join(only, "term", "left_semi").select("id", "term", "tf", "dl")
    again = repeated(docs.select("id"))
    if again is None:
        return kept
    same = F.col("id").eqNullSafe(F.col("again"))
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl")))


@dataclass
class TermIndex:
    """What sparse search reads: counts (id, term, tf, dl) of the terms asked for, their documents (term, df), and the collection's size and mean length.
    ``rows`` has the same counts as one row a document (id, dl, codes, tfs), codes being places in ``terms``, if the queries are few."""

    asked: DataFrame
    counts: DataFrame
    df: DataFrame
    n_docs: int
    avgdl: float
    small: bool
    terms: pa.Array | None = None
    rows: DataFrame | None = None

    def near(self, df: DataFrame) -> DataFrame:
        """df, which has no more rows than there are queries' terms, marked for broadcast if those were found to be few."""
        return F.broadcast(df) if self.small else df

    def idf(self) -> DataFrame:
        """(term, idf)."""
        return self.df.select("term", F.log(1 + (self.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def distinct_terms(asked: DataFrame) -> pa.Array:
    """The terms of asked (qid, term), in order; for few."""
    found = asked.select("term").distinct().toArrow().column("term").combine_chunks().cast(pa.string())
    return found.take(pc.sort_indices(found))


def numbered(spark: SparkSession, names: pa.Array, **more: np.ndarray) -> DataFrame:
    """(code, term, ...): the terms and their places in ``names``."""
    return spark.createDataFrame(pa.table({"code": pa.array(np.arange(len(names)), pa.int32()), "term": names, **{k: pa.array(v, pa.int64()) for k, v in more.items()}}))


def text_rows(docs: DataFrame, names: pa.Array) -> DataFrame:
    """(id, dl, codes, tfs): of each row of docs (id, text) its length and the counts of the named terms."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, rows, lengths = words_of(batch.column(1))
            codes = pc.index_in(words, value_set=shared.value.cast(words.type)).fill_null(-1).to_numpy(zero_copy_only=False)
            named = codes >= 0
            at, codes, n = counted(rows[named], codes[named], len(shared.value))
            offsets = pa.array(np.searchsorted(at, np.arange(len(lengths) + 1)), pa.int32())
            yield pa.record_batch([batch.column(0), pa.array(lengths, pa.int32()), *(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (codes, n))], names=["id", "dl", "codes", "tfs"])

    return docs.select("id", clean_text(F.col("text")).alias("text")).mapInArrow(count, f"id {docs.schema['id'].dataType.simpleString()}, dl int, codes array<int>, tfs array<int>")


def rows_of_counts(counts: DataFrame, names: pa.Array) -> DataFrame:
    """(id, dl, codes, tfs) of counts (id, term, tf, dl)."""
    coded = counts.join(F.broadcast(numbered(counts.sparkSession, names)), "term")
    lists = coded.groupBy("id").agg(F.first("dl").alias("dl"), F.array_sort(F.collect_list(F.struct("code", F.col("tf").cast("int").alias("tf")))).alias("x"))
    return lists.select("id", "dl", F.col("x.code").alias("codes"), F.col("x.tf").alias("tfs"))


def counts_of_rows(rows: DataFrame, names: pa.Array) -> DataFrame:
    """(id, term, tf, dl) of rows (id, dl, codes, tfs)."""
    each = rows.select("id", "dl", F.explode(F.arrays_zip("codes", "tfs")).alias("x")).select("id", F.col("x.codes").alias("code"), F.col("x.tfs").cast("long").alias("tf"), "dl")
    return each.join(F.broadcast(numbered(rows.sparkSession, names)), "code").select("id", "term", "tf", "dl")


def text_index(queries: DataFrame, docs: DataFrame) -> TermIndex:
    """The term index of docs (id, text) for queries (qid, query): one pass over the texts, kept for all that reads it (spark.catalog.clearCache() lets it go)."""
    asked = query_terms(queries)
    small = is_small(asked)
    if not small:
        only = asked.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([(MARK,)], "term string"))
        kept = term_counts(docs, only).persist(StorageLevel.MEMORY_AND_DISK)
        n_docs, avgdl = kept.filter(F.col("term") == MARK).agg(F.sum("tf"), F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).first()
        counts = kept.filter(F.col("term") != MARK)
        return TermIndex(asked, counts, counts.groupBy("term").agg(F.count("*").alias("df")), n_docs or 0, avgdl or 0.0, small)
    names = distinct_terms(asked)
    rows = text_rows(docs, names).persist(StorageLevel.MEMORY_AND_DISK)
    n_docs, avgdl = rows.agg(F.count("*"), F.sum("dl") / F.count("*")).first()
    again = repeated(rows.select("id"))
    if again is not None:
        same = F.col("id").eqNullSafe(F.col("again"))
        counts = counts_of_rows(rows.join(again, same, "left_semi"), names).groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
        rows = rows.join(again, same, "left_anti").unionByName(rows_of_counts(counts, names)).persist(StorageLevel.MEMORY_AND_DISK)
    found = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(names), np.int64)
    df[found.column("code").to_numpy()] = found.column("df").to_numpy()
    return TermIndex(asked, counts_of_rows(rows, names), numbered(docs.sparkSession, names, df=df).filter("df > 0").select("term", "df"), n_docs, avgdl or 0.0, small, names, rows)


def sparse_search(index: TermIndex, k: int = TOP_K) -> DataFrame:
    """(qid, id, score, rank): by BM25. Documents without any of a query's terms aren't found.

    Few queries go to all tasks, and each task keeps its k best documents a query; the scores of many are summed up in a shuffle.
    """
    if index.small:
        return top_per(best_rows(index, k), "qid", F.col("score"), "id", k)
    weighted = index.counts.join(index.near(index.idf()), "term")
    tf = F.col("tf")
    weights = weighted.select("id", "term", (F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(index.avgdl)))).alias("weight"))
    scored = weights.join(index.near(index.asked), "term").groupBy("qid", "id").agg(F.sum("weight").alias("score"))
    return top_per(scored, "qid", F.col("score"), "id", k)


def best_rows(index: TermIndex, k: int) -> DataFrame:
    """(qid, id, score): the k best documents of each query among those of each task."""
    asked = index.asked.toArrow().combine_chunks()
    names = index.terms if index.terms is not None else distinct_terms(index.asked)
    rows = index.rows if index.rows is not None else rows_of_counts(index.counts, names)
    qids, of_term = pc.unique(asked.column("qid").combine_chunks()), pc.index_in(asked.column("term").combine_chunks().cast(names.type), value_set=names).to_numpy(zero_copy_only=False)
    of_query = pc.index_in(asked.column("qid").combine_chunks(), value_set=qids).to_numpy(zero_copy_only=False)
    by_term = np.argsort(of_term, kind="stable")
    asking, width = of_query[by_term].astype(np.int64), np.bincount(of_term, minlength=len(names))
    known = index.df.select("term", "df").toArrow()
    df = np.full(len(names), np.nan)
    df[pc.index_in(known.column("term").combine_chunks().cast(names.type), value_set=names).to_numpy(zero_copy_only=False)] = known.column("df").to_numpy()
    idf = np.log(1 + (index.n_docs - df + 0.5) / (df + 0.5))
    shared = rows.sparkSession.sparkContext.broadcast((qids, asking, width, np.cumsum(width) - width, idf, float(index.avgdl)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, asking, width, first, idf, avgdl = shared.value
        best, least = None, np.zeros(len(qids))
        for batch in batches:
            lengths, n = batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            codes, tf = batch.column(2).flatten().to_numpy(zero_copy_only=False), batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float)
            ends = np.cumsum(n)
            own = np.repeat(np.arange(len(n)), n)
            weights = idf[codes] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[own] / avgdl))
            work = np.cumsum(np.concatenate([[0], width[codes]]))[np.concatenate([[0], ends])] // SUMMED + np.arange(len(n) + 1) * len(qids) // SUMMED
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(work[:-1])) + 1):
                at = slice(ends[part[0]] - n[part[0]], ends[part[-1]])
                times = width[codes[at]]
                places = np.repeat(first[codes[at]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                scores = np.bincount(np.repeat((own[at] - part[0]) * len(qids), times) + asking[places], np.repeat(weights[at], times), len(part) * len(qids)).reshape(len(part), len(qids))
                rounded = np.round(scores, 9)
                row, query = np.nonzero((scores > 0) & (rounded >= least))
                if not len(row):
                    continue
                new = pa.table({"query": query, "rounded": rounded[row, query], "id": batch.column(0).take(pa.array(part[row])), "score": scores[row, query]})
                best = pa.concat_tables([best, new]) if best is not None else new
                best = best.take(pc.sort_indices(best, sort_keys=[("query", "ascending"), ("rounded", "descending"), ("id", "ascending")], null_placement="at_start"))
                query = best.column("query").to_numpy()
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                best = best.filter(pa.array(rank < k)).combine_chunks()
                query, rank = query[rank < k], rank[rank < k]
                least[query[rank == k - 1]] = best.column("rounded").to_numpy()[rank == k - 1]
        if best is not None:
            found = best.combine_chunks()
            yield pa.record_batch([qids.take(found.column("query").combine_chunks()), *(found.column(c).combine_chunks() for c in ("id", "score"))], names=["qid", "id", "score"])

    schema = f"qid {index.asked.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    return rows.select("id", "dl", "codes", "tfs").mapInArrow(search, schema)


def sparse_topk(queries: DataFrame, docs: DataFrame, k: int = TOP_K) -> DataFrame:
    """(qid, id, score, rank): by BM25 over cleaned terms. queries: (qid, query); docs: (id, text)."""
    return sparse_search(text_index(queries, docs), k)


def rank_fusion(*lists: DataFrame, k: int = TOP_K, constant: int = RRF_K) -> DataFrame:
    """(qid, id, score, rank): reciprocal rank fusion of ranked lists (qid, id, rank)."""
    union = lists[0].select("qid", "id", "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select("qid", "id", "rank"))
    scored = union.groupBy("qid", "id").agg(F.sum(1 / (constant + F.col("rank"))).alias("score"))
    return top_per(scored, "qid", F.col("score"), "id", k)


def hybrid_search(queries: DataFrame, docs: DataFrame, vectors: DataFrame, k: int = TOP_K) -> DataFrame:
    """Fused top-k. queries: (qid, query, vec); docs: (id, text); vectors: (id, vec)."""
    return fused(text_index(queries, docs), queries, vectors, k)


def fused(index: TermIndex, queries: DataFrame, vectors: DataFrame, k: int = TOP_K) -> DataFrame:
    return rank_fusion(dense_topk(queries.select("qid", "vec"), vectors, k), sparse_search(index, k), k=k)


def coverage_scores(index: TermIndex, candidates: DataFrame) -> DataFrame:
    """(qid, id, score): the share of the query's idf that the document's terms cover; the default pair scorer. Only the candidates' terms are looked up."""
    candidates = candidates.select("qid", "id").persist(StorageLevel.MEMORY_AND_DISK)
    wanted = candidates.join(index.near(index.asked), "qid").join(index.near(index.idf()), "term", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    held = index.counts.join(small_side(candidates.select("id").distinct()), "id", "left_semi").select("id", "term", F.lit(1).alias("has"))
    total = F.sum("idf")
    return wanted.join(held, ["id", "term"], "left").groupBy("qid", "id").agg(F.when(total > 0, F.sum(F.when(F.col("has") == 1, F.col("idf")).otherwise(0.0)) / total).otherwise(0.0).alias("score"))


def rerank(queries: DataFrame, candidates: DataFrame, docs: DataFrame, n: int = RERANKED, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None, index: TermIndex | None = None) -> DataFrame:
    """(qid, id, score, rank): the n best candidates (qid, id) by a pair scorer of (query, text), or by idf coverage (from ``index`` if there is one). No candidates, no rows."""
    if scorer is None:
        scored = coverage_scores(index or text_index(queries, docs), candidates)
    else:
        score = F.pandas_udf(scorer, "double")
        pairs = candidates.select("qid", "id").join(small_side(queries.select("qid", "query")), "qid").join(docs.select("id", "text"), "id")
        scored = pairs.select("qid", "id", score(F.coalesce("query", F.lit("")), F.coalesce("text", F.lit(""))).alias("score"))
    return top_per(scored, "qid", F.col("score"), "id", n)


def hybrid_rerank(queries: DataFrame, docs: DataFrame, vectors: DataFrame, candidates: int = CANDIDATES, n: int = RERANKED, scorer=None) -> DataFrame:
    """Fused candidates, reranked."""
    index = text_index(queries, docs)
    return rerank(queries, fused(index, queries, vectors, candidates), docs, n, scorer, index)
