"""The registered queries on the provided tables.

The tables stand in for the engine's own: documents for files and chunks, benchmark items for questions, conversations for
pages and answers, labels for the manifest of an earlier run, and embeddings (by equal number) for vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import encoders
from corvane.functions import text as T
from corvane.operators import answer, changes, chunk, evaluate, metrics, profile, search
from corvane.operators.common import kept_side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


def page_concat(spark, sf_dir):
    """The turns of a conversation as pages of a file. Texts travel, as one file's pages must meet, and no further."""
    pages = table(spark, sf_dir, "conversations").filter(F.coalesce("text", F.lit("")) != "")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return pages.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), " ").alias("page_content"), F.count("*").alias("num_pages"))


def _paths(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files as they are, the manifest of an earlier run (labelled documents, of quality 0 with another size, and benchmark items, which are gone), and the documents."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    current = docs.select(path.alias("file_path"), F.lit(0).cast("long").alias("mod_time"), F.col("n_chars").cast("long").alias("size"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = docs.join(labels, "doc_id").select(path.alias("file_path"), F.lit(0).cast("long").alias("mod_time"), (F.col("n_chars") + F.when(F.col("quality") == 0, 1).otherwise(0)).cast("long").alias("size"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("file_path"), F.lit(0).cast("long").alias("mod_time"), F.lit(0).cast("long").alias("size"))
    return current, known.unionByName(items), docs


def change_detection(spark, sf_dir):
    current, manifest, _ = _paths(spark, sf_dir)
    return changes.change_detection(current, manifest).select("file_path", "size", "status")


def deleted_files(spark, sf_dir):
    current, manifest, _ = _paths(spark, sf_dir)
    return changes.deleted_files(current, manifest)


def index_replace_by_file(spark, sf_dir):
    current, manifest, _ = _paths(spark, sf_dir)
    index = manifest.select("file_path", F.lit("old").alias("version"), "size")
    touched = changes.change_detection(current, manifest).filter("status <> 'same'")
    gone = changes.deleted_files(current, manifest)
    fresh = touched.select("file_path", F.lit("new").alias("version"), "size")
    return changes.replace_by_file(index, touched.select("file_path").unionByName(gone), fresh)


def corpus_stats(spark, sf_dir):
    return profile.corpus_stats(table(spark, sf_dir, "documents"), profile.stop_words()).select("total_words", "unique_words", F.round("avg_word_len", 6).alias("avg_word_len"))


def word_freq_top20(spark, sf_dir):
    return profile.top_words(table(spark, sf_dir, "documents"), 20, profile.stop_words())


def duplicate_groups(spark, sf_dir):
    """Documents with equal cleaned texts: how many, and the first and last of them."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.clean_text(F.col("text")), 256).alias("text_sha256"))
    return keyed.groupBy("text_sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


def _path_of(url):
    return F.regexp_replace(url, "[?#].*$", "")


def classify_extension(spark, sf_dir):
    stem, extension = T.stem_and_extension(_path_of(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", F.lower(stem).alias("stem"), F.lower(extension).alias("extension"), T.file_kind(_path_of(F.col("url"))).alias("kind"))


def display_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.display_name(F.lit(""), F.col("url")).alias("display_name"))


def dense_topk(spark, sf_dir):
    """Every vector whose id is divisible by 50, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = vectors.filter(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), "vec")
    return search.dense_topk(asked, vectors).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def _sparse_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")), docs


def _search_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    questions, docs = _sparse_inputs(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return questions.join(vectors.withColumnRenamed("id", "qid"), "qid", "left"), docs, vectors.join(docs.select("id"), "id", "left_semi")


def sparse_topk(spark, sf_dir):
    return search.sparse_topk(*_sparse_inputs(spark, sf_dir)).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def hybrid_rrf(spark, sf_dir):
    return search.hybrid_search(*_search_inputs(spark, sf_dir)).select("qid", "id", "rank", F.round("score", 9).alias("score"))


def hybrid_rerank(spark, sf_dir):
    return search.hybrid_rerank(*_search_inputs(spark, sf_dir)).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def _retrieved(spark, sf_dir, k: int = search.TOP_K) -> tuple[DataFrame, DataFrame]:
    """Questions, and the k sparse results of each with their texts: what was found goes to the texts, which aren't shuffled."""
    questions, docs = _sparse_inputs(spark, sf_dir)
    found = docs.join(kept_side(search.sparse_topk(questions, docs, k)), "id")
    return questions, found.select("qid", "rank", "id", "score", F.col("text").alias("page_content"))


def answer_top1(spark, sf_dir):
    return answer.answer_top1(*_retrieved(spark, sf_dir, 1))


def format_docs(spark, sf_dir):
    found = search.sparse_topk(*_sparse_inputs(spark, sf_dir))
    ranked = found.select("qid", "rank", F.lit("").alias("doc_name"), F.concat(F.lit("doc/"), F.col("id").cast("string")).alias("file_path"), F.lit(None).cast("double").alias("score"), F.round("score", 6).cast("string").alias("metadata_score"))
    return answer.format_sources(ranked)


def render_prompt(spark, sf_dir):
    questions, found = _retrieved(spark, sf_dir)
    return answer.render_prompt(questions, found)


def query_responses(spark, sf_dir):
    questions, found = _retrieved(spark, sf_dir)
    ranked = found.withColumns({"doc_name": F.lit(None).cast("string"), "file_path": F.concat(F.lit("doc/"), F.col("id").cast("string")), "score": F.round("score", 6)})
    return answer.responses(questions, ranked)


def _pairs(spark, sf_dir) -> DataFrame:
    """Each user turn that an assistant's turn follows: the user's words as the generated answer, the other's as its reference."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    nearby = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(turns).alias("next_role"), F.lead("text").over(turns).alias("next_text"))
    pairs = nearby.filter("role = 'user' and next_role = 'assistant'")
    return pairs.select("conv_id", "turn", F.coalesce("next_text", F.lit("")).alias("Reference_Answer"), F.coalesce("text", F.lit("")).alias("Generated_Answer"), F.lit("Success").alias("Status"))


def bleu(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.bleu(F.col("Reference_Answer"), F.col("Generated_Answer")), 6).alias("bleu"))


def rouge_l(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.rouge_l(F.col("Reference_Answer"), F.col("Generated_Answer")), 6).alias("rouge_l"))


def rouge_l_unstemmed(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.rouge_l(F.col("Reference_Answer"), F.col("Generated_Answer"), False), 6).alias("rouge_l"))


def bertscore_f1(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.bertscore_f1(F.col("Reference_Answer"), F.col("Generated_Answer")), 6).alias("bertscore_f1"))


SCORES = ("BLEU_Score", "ROUGE_L_F1", "BERTScore_F1")


def eval_rows(spark, sf_dir):
    """Scored pairs, ROUGE-L without stems, as SQL has no stemmer; every fifth conversation stands for a failed call."""
    rows = _pairs(spark, sf_dir).withColumn("Status", F.when(F.col("conv_id") % 5 == 0, "Error").otherwise("Success"))
    return evaluate.score_rows(rows, False).select("conv_id", "turn", "Reference_Answer", "Generated_Answer", "Status", *(F.round(c, 6).alias(c) for c in SCORES))


def eval_summary(spark, sf_dir):
    out = evaluate.summary(eval_rows(spark, sf_dir))
    return out.select("total", "successes", *(F.round(c, 5).alias(c) for c in SCORES))


def duplicate_names(spark, sf_dir):
    """Pages whose urls end in one name: how many, and their extensions and paths in order, as lines."""
    files = table(spark, sf_dir, "pages").select(_path_of(F.col("url")).alias("path"))
    lines = F.array_join(F.transform("files", lambda f: F.concat(f["ext"], F.lit(" "), f["path"])), "\n")
    return profile.duplicate_names(files).select("name", F.size("files").alias("n"), lines.alias("files"))


def chunk_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))
    return chunk.chunk_documents(docs, "doc_id", "text")


def next_manifest(spark, sf_dir):
    """The manifest after a run in which every file whose number ends in 7 failed."""
    current, manifest, _ = _paths(spark, sf_dir)
    failed = current.filter(F.col("file_path").endswith("7")).select("file_path")
    return changes.next_manifest(current, manifest, failed).select("file_path", "size")


def index_delete_by_file(spark, sf_dir):
    current, manifest, _ = _paths(spark, sf_dir)
    return changes.delete_by_key(current.select("file_path", "size"), manifest)


def golden_references(spark, sf_dir):
    """Benchmark items as golden questions, with the first turn of the conversation of the same number, if any, as answer."""
    turns = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("item_id"), F.col("text").alias("Answer")).dropDuplicates(["item_id"])
    return evaluate.references(table(spark, sf_dir, "benchmark").join(turns, "item_id", "left").withColumnRenamed("text", "Question"))


def asked_queries(spark, sf_dir):
    """Turns that aren't blank."""
    return answer.not_blank(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("query"))).select("conv_id", "turn", T.preview(F.col("query"), 50).alias("preview"))


def unconverted_files(spark, sf_dir):
    """Pages as files, two to a name, with endings by their numbers."""
    ending = F.when(F.col("page_id") % 3 == 0, ".pdf").when(F.col("page_id") % 3 == 1, ".DOC").otherwise(".docx")
    return profile.unconverted(table(spark, sf_dir, "pages").select(F.concat(F.lit("f/"), F.floor(F.col("page_id") / 2).cast("string"), ending).alias("path")).distinct())


def local_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.local_date(F.col("ts")).alias("date"))


def stats_report(spark, sf_dir):
    return profile.stats_report(profile.corpus_stats(table(spark, sf_dir, "documents"), profile.stop_words()))


def chunk_ids(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chunk.chunk_id(F.col("conv_id").cast("string"), F.col("turn"), F.col("text")).alias("chunk_id"))


def metric_labels(spark, sf_dir):
    names = spark.createDataFrame([(m,) for m in evaluate.METRICS], "metric string")
    return names.select("metric", T.metric_label(F.lower("metric")).alias("label"))


def term_postings(spark, sf_dir):
    """What the index stores of each document: its terms' counts and its length."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.term_counts(docs).filter(F.col("term") != search.MARK)


def dense_encode(spark, sf_dir):
    """The default encoder's vectors of the benchmark items, dimension by dimension where not zero."""
    vectors = table(spark, sf_dir, "benchmark").select("item_id", encoders.dense_vectors(T.clean_text(F.col("text")), encoders.hashed_dense).alias("v"))
    return vectors.select("item_id", F.posexplode("v").alias("dim", "value")).filter("abs(value) > 1e-7").select("item_id", "dim", F.round(F.col("value").cast("double"), 4).alias("value"))


ALL = (clean_text, page_concat, change_detection, deleted_files, index_replace_by_file, corpus_stats, word_freq_top20, duplicate_groups, duplicate_names, classify_extension, display_name, dense_topk, sparse_topk, hybrid_rrf, hybrid_rerank, answer_top1, format_docs, render_prompt, query_responses, bleu, rouge_l, rouge_l_unstemmed, bertscore_f1, eval_rows, eval_summary, chunk_documents, next_manifest, index_delete_by_file, golden_references, asked_queries, unconverted_files, local_dates, stats_report, chunk_ids, metric_labels, term_postings, dense_encode)
