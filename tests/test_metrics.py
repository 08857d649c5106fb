import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.porter import stem
from corvane.operators import evaluate, metrics as M


def test_stems():
    for word, want in {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil"}.items():
        assert stem(word) == want, word


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(20))] for _ in range(2))
        assert M.common_length(a, b) == lcs(a, b)


def test_bleu():
    assert M.bleu_score("a b c d e".split(), "a b c d e".split()) == pytest.approx(1)
    assert M.bleu_score(["a"], []) == M.bleu_score([], ["a"]) == M.bleu_score(["a", "b"], ["c"]) == 0
    # precisions 3/4, 1/3; no 3-gram or 4-gram: ln(4) / (2 * 5) / 2 and ln(4) / (4 * 5) / 1
    want = math.exp(1 - 5 / 4) * (3 / 4 * 1 / 3 * math.log(4) / 20 * math.log(4) / 20) ** 0.25
    assert M.bleu_score("a b x c y".split(), "a b z c".split()) == pytest.approx(want)


def test_rouge_and_bertscore():
    assert M.rouge_l_score("The cats sat.", "the cat sitting") == pytest.approx(2 * 2 / 6)
    assert M.rouge_l_score("running dogs", "runs dog") == pytest.approx(1) and M.rouge_l_score("running dogs", "runs dog", False) == 0 and M.rouge_l_score("", "x") == 0
    assert M.bertscore_f1_score("some words", "some words") == pytest.approx(1)
    assert M.bertscore_f1_score("", "x") == M.bertscore_f1_score(None, None) == 0
    assert 0 < M.bertscore_f1_score("retrieval", "retrieve") < 1


def test_evaluation(spark):
    golden = spark.createDataFrame([("q1", "the answer is here"), ("q2", None), ("q3", "other words")], "Question string, Answer string")
    rows = evaluate.references(golden).withColumns({"Generated_Answer": F.when(F.col("Question") == "q3", "unrelated").otherwise("the answer is here"), "Status": F.when(F.col("Question") == "q3", "Error").otherwise("Success"), "Latency_ms": F.lit(4.0)})
    scored = {r["Question"]: r for r in evaluate.score_rows(rows).collect()}
    assert scored["q1"]["BLEU_Score"] == pytest.approx(1) and scored["q2"]["ROUGE_L_F1"] == 0 and scored["q2"]["Reference_Answer"] == ""
    out = evaluate.summary(evaluate.score_rows(rows)).first()
    assert (out["total"], out["successes"], out["Latency_ms"], out["ROUGE_L_F1"]) == (3, 2, 4.0, 0.5)
    with pytest.raises(ValueError):
        evaluate.references(golden.drop("Answer"))
    assert evaluate.summary(evaluate.score_rows(rows.limit(0))).first()["total"] == 0
