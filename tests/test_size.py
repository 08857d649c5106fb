"""What the operators move and hold doesn't grow faster than their input."""

import json

from pyspark.sql import functions as F

from corvane.operators import answer, metrics, search
from corvane.plans import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_within_their_text(spark):
    docs = spark.createDataFrame([(1, "red  fox RED"), (2, "fox"), (2, "fox_fox"), (None, "a"), (None, "a b"), (3, None)], "id long, text string")
    got = {(r["id"], r["term"]): r["tf"] for r in search.term_counts(docs).collect()}
    assert got == {(1, "red"): 2, (1, "fox"): 1, (2, "fox"): 3, (None, "a"): 2, (None, "b"): 1, (1, " "): 1, (2, " "): 2, (None, " "): 2, (3, " "): 1}
    unique = search.term_counts(docs.filter("id in (1, 3)"))
    assert {(r["id"], r["term"], r["tf"], r["dl"]) for r in unique.collect()} == {(1, "red", 2, 3), (1, "fox", 1, 3), (1, " ", 1, 3), (3, " ", 1, 0)}
    assert "Exchange" not in plan(unique)


def test_batches_of_scored_pairs_are_small(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    metrics.bleu(F.col("a"), F.col("b"))
    assert int(spark.conf.get(name)) <= metrics.BATCH
    spark.conf.set(name, before)


def test_cosines_in_blocks(monkeypatch):
    a, b = "the red fox sat on a red mat", "a fox and the cat sat down"
    want = metrics.bertscore_f1_score(a, b)
    monkeypatch.setattr(metrics, "ROWS", 2)
    assert abs(metrics.bertscore_f1_score(a, b) - want) < 1e-12


def test_sparse_search_shuffles_only_the_best(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"fox {'red ' * (i % 5)}{'blue ' * (i % 7)}") for i in range(200)] + [(7, "red red fox")], "id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "red fox"), (1, "fox blue"), (2, "blue"), (3, "absent")], "qid long, query string")
    monkeypatch.setattr(search, "SUMMED", 20)  # many small parts
    index = search.text_index(asked, docs)
    assert search.best_rows(index, 4).count() <= 2 * 4 * index.rows.rdd.getNumPartitions()
    of = lambda df: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    got = of(search.sparse_search(index, 4))
    monkeypatch.setattr(search, "is_small", lambda df: False)  # beyond the bound scores are summed up in a shuffle
    large = search.text_index(asked, docs)
    assert got == of(search.sparse_search(large, 4)) and [x[:2] for x in got] == [(q, k) for q in (1, 2) for k in (1, 2, 3, 4)]
    spark.catalog.clearCache()


def test_responses_read_results_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(text):
        read.add(1)
        return text

    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "qid long, rank int, page_content string").select("qid", "rank", watched("page_content").alias("page_content"), F.lit("n").alias("doc_name"), F.lit("p").alias("file_path"), F.lit(1.0).alias("score"))
    got = json.loads(answer.responses(spark.createDataFrame([(1,)], "qid long"), ranked).first()["response"])
    assert got["answer"] == "a" and [s["page_content"] for s in got["source_documents"]] == ["a", "b"] and read.value == 2


def test_texts_arent_shuffled_for_what_was_found(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, found = queries._retrieved(spark, "/root/testdata/sf0.001")
        assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.catalog.clearCache()
