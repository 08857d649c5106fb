import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import language_id as L

WORDS = {"aa": "the of and river stone walking under light".split(), "bb": "der und nicht straße grün laufen größer haus".split(), "cc": "el niño está corriendo mañana según árbol luz".split()}


def table(n=240):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(4, 30))), lang))
    return rows


def brute_vector(text):
    letter = lambda c: np.random.default_rng((L.SEED, c)).choice(np.array([-1, 1]), size=L.DIMENSIONS)
    symbols = [0, *(ord(c.lower()[0]) if c.isalpha() else 0 for c in text), 0]
    squeezed = [s for i, s in enumerate(symbols) if i == 0 or s or symbols[i - 1]]
    return sum(np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(squeezed, squeezed[1:], squeezed[2:]))


def test_binding_equals_the_definition():
    for text in ("Ab, cé", "Привет мир", "日本語 ΑΩ", "x"):
        assert np.array_equal(L.vector(text), brute_vector(text))
    assert not np.array_equal(L.vector("привет"), L.vector("приват")) and L.vector(" 12 ") is None


def test_prototypes_and_nearest_equal_brute_force(spark):
    rows = [("ab cd", "x"), ("ab ce ab", "x"), ("Жук да", "y"), ("ёж ел", "y"), (None, "y"), ("12", "x"), ("zz", None)]
    names, table = L.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string"))
    unit = lambda v: v / np.linalg.norm(v)
    want = {n: unit(sum(unit(brute_vector(t)) for t, lang in rows if lang == n and t and t != "12")) for n in "xy"}
    assert names == ["x", "y"] and all(np.allclose(table[i], want[n], atol=1e-5) for i, n in enumerate(names))
    asked = ["abc", "жуки", "cd ёж ёж"]
    got = {r["doc_id"]: r for r in L.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), names, table).collect()}
    for i, t in enumerate(asked):
        cosines = {n: float(unit(brute_vector(t)) @ want[n]) for n in names}
        best = max(cosines, key=cosines.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - max(0, cosines[best])) < 1e-4


def test_held_out_rows_are_told(spark):
    rows = table() + [(900, None, "aa"), (901, "", "bb"), (902, " 12 .. ", None), (903, "grün und haus " * 40_000, None), (None, "the river", None)]
    got = {r["doc_id"]: r for r in L.identify(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")).collect()}
    assert len(got) == len(rows)
    for i, _, lang in rows[:240]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0) for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "bb" and got[None]["lang_pred"] == "aa" and not got[None]["held_out"]


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert sorted(map(tuple, L.identify(docs).collect())) == sorted(map(tuple, L.identify(told).collect()))


def test_ties_empty_and_missing(spark):
    same = spark.createDataFrame([(i, "equal words", lang) for i in range(30) for lang in ("yy", "xx")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in L.identify(same).collect()} == {"xx"}
    assert L.identify(same.limit(0)).count() == 0
    assert {r["lang_pred"] for r in L.identify(same.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    with pytest.raises(ValueError):
        L.identify(same.drop("text"))
