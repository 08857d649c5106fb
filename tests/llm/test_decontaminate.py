import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm import decontaminate as D


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(docs, items, size):
    wins = set()
    for item, text in items:
        w = plain_words(text)
        wins |= {(str(item), tuple(w[i : i + size])) for i in range(max(1, len(w) - size + 1)) if w}
    out = []
    for doc, text in docs:
        w, hit, named = plain_words(text), set(), set()
        for item, run in wins:
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i : i + len(run)]) == run:
                    hit |= set(range(i, i + len(run)))
                    named.add(item)
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def table(rng, n):
    vocabulary = ["a", "the", "Éa", "x9", "LONG", "rare", "été", "b", "K", "İ"]
    phrase = lambda k: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, phrase(rng.randrange(0, 7))) for i in range(10)] + [(10, None), (11, " .,! "), (12, "one"), (120, "One."), (13, "a a a a a")]
    docs = [(i, " ".join(rng.choice([phrase(rng.randrange(5)), rng.choice(items)[1] or "", "other words"]) for _ in range(rng.randrange(6)))) for i in range(n)]
    return docs + [(900, None), (901, ""), (902, "a " * 3000), (903, docs[0][1]), (904, "one"), (None, "one"), (5, "one other"), (5, "nothing")], items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs, items = table(random.Random(seed), 60)
    got = D.contamination(spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, w string, pos int"), spark.createDataFrame(items, "item_id long, text string"), size=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 4)


def test_joins_that_shuffle_give_the_same(spark, monkeypatch):
    docs, items = table(random.Random(3), 30)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 4)


def test_repeated_rows_are_hit_like_one(spark):
    passage = "one two three four five six seven"
    docs, items = [(None, f"n {passage}")] * 2 + [(None, "two one"), (None, None), (1, f"x {passage} y")] * 2 + [(2, passage)] * 3 + [(2, "nothing"), (3, f"{passage} {passage}"), (4, "two one"), (4, "two one")], [(7, passage), (8, "two one"), (9, "nothing")]
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (4, 10):
        assert sorted(map(tuple, D.contamination(rows, bench, size=size).collect()), key=str) == brute(docs, items, size)
    assert sorted(map(tuple, D.drop_contaminated(rows, bench).collect()), key=str) == [(None, None), (None, None)]
    near = D.proximity_hits(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc long, text string"), "a", "b", 1)
    assert sorted(map(tuple, near.collect()), key=str) == [(1, 0, 1), (1, 0, 1), (None, 0, 1)]


def test_large_sides_are_not_broadcast(spark):
    df = spark.createDataFrame([(1, "x" * 200)], "a long, b string")
    hinted = lambda **k: "ResolvedHint" in common.maybe_broadcast(df, **k)._jdf.queryExecution().toString() or "broadcast" in common.maybe_broadcast(df, **k)._jdf.queryExecution().toString().lower()
    assert hinted(rows=1, size=1000) and not hinted(rows=0, size=1000) and not hinted(rows=1, size=100)


def test_proximity(spark):
    text = "x b c a . a b b A x x x x x b a"
    docs = spark.createDataFrame([(1, text), (2, "a"), (3, None)], "doc long, text string")
    w = plain_words(text)
    for a, b, within in (("a", "b", 2), ("x", "x", 3), ("a", "none", 5)):
        want = sorted((1, i, j) for i in range(len(w)) for j in range(len(w)) if w[i] == a and w[j] == b and 0 < abs(i - j) <= within)
        assert sorted(map(tuple, D.proximity_hits(docs, a, b, within).collect())) == want


def test_empty_tables_and_missing(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in D.contamination(docs, bench.limit(0)).collect()} == {0}
    assert [r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()] == [2]
    with pytest.raises(ValueError):
        D.contamination(docs.drop("text"), bench)


def test_no_python_in_the_plan(spark):
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    plan = D.contamination(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
