import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corvane.operators import answer, profile, search


def test_dense_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(70, 8))
    v[10] = v[11]
    rows = [(i, v[i].tolist()) for i in range(70)] + [(100, None), (101, []), (102, [0.0] * 8), (103, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = df.filter("id < 5 or id = 10 or id >= 100").withColumnRenamed("id", "qid")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for found in (search.dense_topk(asked, df, 6), search.dense_blocks(asked, df, 6, 7), search.dense_blocks(asked, df, 6, 1000)):
        got = {}
        for r in found.collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
        assert set(got) == {0, 1, 2, 3, 4, 10, 103}
        for q in (0, 1, 2, 3, 4, 10):
            want = sorted(range(70), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:6]
            assert [i for _, i in sorted(got[q])] == want
        assert got[103] == [(1, 103)]


def test_dense_with_ids_of_any_type_and_many_queries(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 5))
    v[7] = v[3]
    df = spark.createDataFrame([(f"c{i:02d}", v[i].astype("float32").tolist()) for i in range(40)] + [("x", None), ("y", [float("nan")] * 5)], "id string, vec array<float>")
    asked = df.filter("id < 'c06'").withColumnRenamed("id", "qid")
    unit = v.astype("float32").astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = {(f"c{q:02d}", k + 1, f"c{i:02d}") for q in range(6) for k, i in enumerate(sorted(range(40), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:4])}
    of = lambda out: {(r["qid"], r["rank"], r["id"]) for r in out.collect()}
    assert of(search.dense_topk(asked, df.repartition(3), 4)) == want
    monkeypatch.setattr(search, "SENT_QUERIES", 2)  # too many to send: in blocks
    assert of(search.dense_topk(asked, df, 4)) == want
    assert search.dense_topk(asked.limit(0), df).count() == 0 and search.dense_topk(asked, df.limit(0)).count() == 0


DOCS = [(1, "the red fox"), (2, "the blue fox fox"), (3, "nothing else"), (4, None), (5, "the the the")]


def test_sparse_and_fusion(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    queries = spark.createDataFrame([(1, "Fox blue"), (2, ""), (3, "absent"), (4, "the")], "qid long, query string")
    got = {(r["qid"], r["rank"]): r for r in search.sparse_topk(queries, docs).collect()}
    assert [k for k in sorted(got)] == [(1, 1), (1, 2), (4, 1), (4, 2), (4, 3)] and got[1, 1]["id"] == 2 and got[4, 1]["id"] == 5
    idf = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    norm = 1.2 * (0.25 + 0.75 * 4 / (12 / 5))
    assert abs(got[1, 1]["score"] - (idf(2) * 2 * 2.2 / (2 + norm) + idf(1) * 2.2 / (1 + norm))) < 1e-9
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "qid long, id long, rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "qid long, id long, rank int")
    fused = search.rank_fusion(a, b, k=2).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 9)) for r in fused] == [(8, round(1 / 61 + 1 / 62, 9)), (7, round(1 / 61, 9))]


def test_rerank(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    queries = spark.createDataFrame([(1, "blue fox")], "qid long, query string")
    candidates = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4)], "qid long, id long")
    got = search.rerank(queries, candidates, docs, 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 1, 3] and got[0]["score"] == 1 and got[2]["score"] == 0

    def longest(q: pd.Series, t: pd.Series) -> pd.Series:
        return t.str.len().astype(float)

    assert [r["id"] for r in search.rerank(queries, candidates, docs, 2, longest).orderBy("rank").collect()] == [2, 3]
    assert search.rerank(queries, candidates.limit(0), docs).count() == 0


def test_answers(spark):
    queries = spark.createDataFrame([(1, "q"), (2, "none"), (3, " ")], "qid long, query string")
    ranked = spark.createDataFrame([(1, 2, "second", None, "a/b.pdf", None), (1, 1, "first", "n", "p", 0.5)], "qid long, rank int, page_content string, doc_name string, file_path string, score double")
    assert {r["qid"]: r["answer"] for r in answer.answer_top1(queries, ranked).collect()} == {1: "first", 2: answer.DONT_KNOW, 3: answer.DONT_KNOW}
    got = {r["qid"]: json.loads(r["response"]) for r in answer.responses(queries, ranked).collect()}
    assert got[2] == {"answer": answer.DONT_KNOW, "source_documents": []}
    assert got[1]["source_documents"] == [{"page_content": "first", "metadata": {"file_path": "p", "doc_name": "n", "score": 0.5}}, {"page_content": "second", "metadata": {"file_path": "a/b.pdf"}}]
    prompts = {r["qid"]: r["prompt"] for r in answer.render_prompt(queries, ranked).collect()}
    assert "first\n\nsecond" in prompts[1] and "Question: none" in prompts[2]
    assert answer.not_blank(queries).count() == 2
    shown = answer.format_sources(ranked.selectExpr("*", "'0.25' as metadata_score")).collect()
    assert {(r["display_name"], r["score"]) for r in shown} == {("n", 0.5), ("b.pdf", 0.25)}


def test_profile(spark):
    docs = spark.createDataFrame([("Don't stop, the STOP",), (None,), ("a bb",)], "text string")
    assert tuple(profile.corpus_stats(docs).first()) == (6, 5, (4 + 4 + 3 + 4 + 1 + 2) / 6)
    assert [tuple(r) for r in profile.top_words(docs, 2, ("the",)).collect()] == [("stop", 2), ("a", 1)]
    assert tuple(profile.corpus_stats(docs.limit(0)).first()) == (0, 0, None)
    assert "2.50" in profile.stats_report(spark.createDataFrame([(1, 2, 2.5)], "total_words long, unique_words long, avg_word_len double")).first()[0]
    files = spark.createDataFrame([("x/A.pdf",), ("y/a.doc",), ("y/b.doc",), ("y/b.pdf",), ("z/c.docx",)], "path string")
    got = {r["name"]: [tuple(f) for f in r["files"]] for r in profile.duplicate_names(files).collect()}
    assert got == {"a": [(".doc", "y/a.doc"), (".pdf", "x/A.pdf")], "b": [(".doc", "y/b.doc"), (".pdf", "y/b.pdf")]}
    assert {r[0] for r in profile.unconverted(files).collect()} == {"y/a.doc", "z/c.docx"}
    assert "don't" in profile.stop_words() and len(set(profile.stop_words())) == 179


def test_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(text):
        read.add(1)
        return text

    docs = spark.createDataFrame(DOCS, "id long, text string").select("id", watched("text").alias("text"))
    queries = spark.createDataFrame([(1, "blue fox", [1.0, 0.0])], "qid long, query string, vec array<double>")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i, _ in DOCS], "id long, vec array<double>")
    assert [r["id"] for r in search.hybrid_rerank(queries, docs, vectors).orderBy("rank").collect()][0] == 2
    assert read.value == len(DOCS)
    spark.catalog.clearCache()


def test_size_is_checked_before_a_broadcast(spark):
    from corvane.operators.common import is_small

    df = spark.createDataFrame([(1, "x" * 200), (2, "y")], "a long, b string")
    assert is_small(df, 2, 1000) and not is_small(df, 1, 1000) and not is_small(df, 2, 100) and is_small(df.limit(0), 0, 0)
