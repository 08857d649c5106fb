import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import answer, changes, search
from corvane.plans import serve
from corvane.sources import files
from corvane.sources.index import DocumentIndex, hybrid_search, ingest, sparse_candidates
from corvane.streaming.new_files import append_new


def put(folder, name, text, when):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(path, (when, when))


def test_listing(spark, tmp_path):
    for name in ("a.pdf", "~b.pdf", "c.PDF", "sub/a.pdf"):
        put(tmp_path, name, "x", 1e9)
    names = lambda df: sorted(r["file_path"].rsplit("/", 1)[1] for r in df.collect())
    assert names(files.list_files(spark, f"file://{tmp_path}")) == ["a.pdf"]
    assert names(files.list_files(spark, f"file://{tmp_path}", skip_temporary=False)) == ["a.pdf", "~b.pdf"]
    assert names(files.list_files(spark, f"file://{tmp_path}", None, True, False)) == ["a.pdf", "a.pdf", "c.PDF", "~b.pdf"]
    assert files.list_files(spark, f"file://{tmp_path}/absent").count() == 0


def test_changes(spark):
    old = spark.createDataFrame([("same", 1, 1), ("time", 1, 1), ("size", 1, 1), ("gone", 1, 1), ("failed", 1, 1)], "file_path string, mod_time long, size long")
    now = spark.createDataFrame([("same", 1, 1), ("time", 2, 1), ("size", 1, 2), ("new", 1, 1), ("failed", 3, 3), ("newfail", 1, 1)], "file_path string, mod_time long, size long")
    assert {r[0]: r[3] for r in changes.change_detection(now, old).collect()} == {"same": "same", "time": "modified", "size": "modified", "new": "new", "failed": "modified", "newfail": "new"}
    assert [r[0] for r in changes.deleted_files(now, old).collect()] == ["gone"]
    after = {tuple(r) for r in changes.next_manifest(now, old, spark.createDataFrame([("failed",), ("newfail",)], "file_path string")).collect()}
    assert after == {("same", 1, 1), ("time", 2, 1), ("size", 1, 2), ("new", 1, 1), ("failed", 1, 1)}
    assert changes.delete_by_key(old, old.limit(0)).count() == 5


def test_ingest_life(spark, tmp_path):
    folder, index = tmp_path / "in", DocumentIndex(spark, f"file://{tmp_path}/index")
    put(folder, "a.pdf", "First page\n\fSecond_page\f", 1e9)
    put(folder, "b.pdf", "word " * 300, 1e9)
    put(folder, "bad.pdf", b"\xff\xfe", 1e9)
    assert index.create_if_missing() and not index.create_if_missing()
    shown = ("new", "modified", "same", "deleted", "failed")
    run = lambda **k: {x: n for x, n in ingest(spark, f"file://{folder}", index, **k).items() if x in shown}
    assert run() == {"new": 3, "modified": 0, "same": 0, "deleted": 0, "failed": 1}
    chunks = {(r["doc_name"], r["chunk_ix"]): r for r in index.chunks().collect()}
    assert chunks["a.pdf", 0]["page_content"] == "first page second page" and chunks["a.pdf", 0]["num_pages"] == 3 and chunks["a.pdf", 0]["date"] == "2001-09-09"
    assert ("b.pdf", 2) in chunks and index.postings().filter("term = 'second'").count() == 1
    assert run() == {"new": 1, "modified": 0, "same": 2, "deleted": 0, "failed": 1}
    assert {r["chunk_id"] for r in index.chunks().collect()} == {r["chunk_id"] for r in chunks.values()}
    put(folder, "b.pdf", "\f", 2e9)  # no chunks any more
    put(folder, "a.pdf", b"\xff", 2e9)  # fails: keeps what it had
    assert run() == {"new": 1, "modified": 2, "same": 0, "deleted": 0, "failed": 2}
    assert {r["doc_name"] for r in index.chunks().collect()} == {"a.pdf"}
    put(folder, "c.pdf", "new one", 2e9)
    (folder / "a.pdf").unlink()
    assert run(purge_deleted=False)["deleted"] == 1 and {r["doc_name"] for r in index.chunks().collect()} == {"a.pdf", "c.pdf"}
    put(folder, "d.pdf", "more", 2e9)
    run()
    assert index.counts["chunks"] == index.counts["vectors"] == index.chunks().count() == 3 and {len(r["dense"]) for r in index.chunks().collect()} == {384}
    assert index.vacuum() > 3 and index.version()
    index.recreate()
    assert index.chunks().count() == 0 and index.drop() and index.version() is None


def test_golden_csv(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('Question,Answer\nq1,"two\nlines"\nq2,"a ""quoted"" word"\n', encoding="utf-8")
    got = files.golden_questions(spark, f"file://{path}")
    assert [tuple(r) for r in got.collect()] == [("q1", "two\nlines"), ("q2", 'a "quoted" word')]
    files.write_csv(got, f"file://{tmp_path}/out")
    assert sorted(map(tuple, files.golden_questions(spark, f"file://{tmp_path}/out").collect())) == sorted(map(tuple, got.collect()))


def test_stream_of_new_files(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "a.pdf", "Some text", 1e9)
    args = (f"file://{folder}", f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    append_new(spark, *args).awaitTermination(120)
    put(folder, "b.pdf", "More", 1e9)
    append_new(spark, *args).awaitTermination(120)
    assert {r["page_content"] for r in spark.read.parquet(args[1]).collect()} == {"some text", "more"}


def test_missing_columns_are_named(spark):
    with pytest.raises(Exception):
        changes.change_detection(spark.range(1), spark.range(1)).collect()


TEXTS = {"a": "The red fox sleeps in the barn. It is old.", "b": "A blue whale swims. The whale sings at night.", "c": "Nothing of note is written here."}


def test_search_over_the_index(spark, tmp_path):
    folder, index = tmp_path / "in", DocumentIndex(spark, f"file://{tmp_path}/index")
    for name, text in TEXTS.items():
        put(folder, f"{name}.pdf", text, 1e9)
    assert ingest(spark, f"file://{folder}", index)["vectors"] == 3
    queries = spark.createDataFrame([(1, "old red fox"), (2, "singing whale at night"), (3, ""), (4, "zebra")], "qid long, query string")
    for mode in serve.MODES:
        found = serve.retrieve(queries, index, mode).collect()
        top = {r["qid"]: (r["doc_name"], r["page_content"]) for r in found if r["rank"] == 1}
        assert top[1] == ("a.pdf", TEXTS["a"].lower()) and top[2][0] == "b.pdf", mode
        answers = {r["qid"]: json.loads(r["response"]) for r in serve.respond(queries, index, mode).collect()}
        assert set(answers) == {1, 2, 3, 4} and answers[1]["answer"] == TEXTS["a"].lower() and answers[2]["source_documents"][0]["metadata"]["file_path"].endswith("/b.pdf")
    assert serve.retrieve(queries, index, "other") is None and serve.respond(queries, index, "other") is None
    # the same scores as over bare tables
    docs = index.chunks().select(F.col("chunk_id").alias("id"), F.col("page_content").alias("text"))
    of = lambda df: {(r["qid"], r["id"], round(r["score"], 9)) for r in df.collect()}
    assert of(search.sparse_search(index.term_index(queries))) == of(search.sparse_topk(queries, docs)) != set()
    # what stays is carried over, what is new comes in, what is gone goes
    put(folder, "d.pdf", "A zebra.", 2e9)
    (folder / "b.pdf").unlink()
    ingest(spark, f"file://{folder}", index)
    docs = index.chunks().select(F.col("chunk_id").alias("id"), F.col("page_content").alias("text"))
    assert of(search.sparse_search(index.term_index(queries))) == of(search.sparse_topk(queries, docs))
    assert {r["doc_name"] for r in serve.retrieve(queries.filter("qid = 4"), index).filter("rank = 1").collect()} == {"d.pdf"}
    empty = DocumentIndex(spark, f"file://{tmp_path}/none")
    assert serve.retrieve(queries, empty).count() == 0
    assert {json.loads(r["response"])["answer"] for r in serve.respond(queries, empty).collect()} == {answer.DONT_KNOW}


def test_encoders_are_plug_ins(spark, tmp_path):
    folder, index = tmp_path / "in", DocumentIndex(spark, f"file://{tmp_path}/index")
    for name, text in TEXTS.items():
        put(folder, f"{name}.pdf", text, 1e9)

    def letters(texts):
        return np.array([[t.count(c) for c in "abcdefghij"] for t in texts], float)

    def weights(text):
        if "note" in text:
            raise RuntimeError("no")
        return {w.strip("."): 2.0 for w in text.split() if len(w) > 3}

    assert ingest(spark, f"file://{folder}", index, dense_encoder=letters, sparse_encoder=weights)["chunks"] == 3
    assert {len(r["dense"]) for r in index.chunks().collect()} == {10}
    queries = spark.createDataFrame([(1, "whale night"), (2, "a note")], "qid long, query string")
    got = sparse_candidates(queries, index, 5, weights).collect()
    assert [(r["qid"], r["score"]) for r in got] == [(1, 8.0)]
    assert hybrid_search(queries, index, 2, letters, weights).count() == 4
    with pytest.raises(Exception):
        ingest(spark, f"file://{folder}", DocumentIndex(spark, f"file://{tmp_path}/bad"), dense_encoder=lambda texts: np.zeros((0, 3)))


def test_golden_questions_end_to_end(spark, tmp_path):
    folder, index = tmp_path / "in", DocumentIndex(spark, f"file://{tmp_path}/index")
    for name, text in TEXTS.items():
        put(folder, f"{name}.pdf", text, 1e9)
    ingest(spark, f"file://{folder}", index)
    golden = spark.createDataFrame([("Who is the old red fox?", TEXTS["a"].lower()), ("whale at night", None), ("whale at night", None)], "Question string, Answer string")
    for mode in serve.MODES:
        scored, summary = serve.evaluate_golden(golden, index, mode, f"file://{tmp_path}/out-{mode}")
        rows = {r["Question"]: r for r in scored.collect()}
        assert rows["Who is the old red fox?"]["BLEU_Score"] == pytest.approx(1) and rows["whale at night"]["ROUGE_L_F1"] == 0
        one = summary.first()
        assert (one["total"], one["successes"]) == (3, 3) and one["Latency_ms"] > 0 and one["Peak_Script_Memory_MB"] > 1
        assert "Generated_Answer" in spark.read.option("header", True).csv(f"file://{tmp_path}/out-{mode}").columns
    assert serve.evaluate_golden(golden, index, "other") is None


def test_word_frequencies_are_written_with_their_header(spark, tmp_path):
    counts = spark.createDataFrame([("a", 3), ("b", 1)], "word string, frequency long")
    files.write_word_frequencies(counts, f"file://{tmp_path}/out")
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text().splitlines() == ["Word,Frequency", "a,3", "b,1"]
