import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import toxicity as T


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in T.initial(5).items()}
    chars, char_mask = T.spell(["ab", "x", "fool9", "é"])
    index, mask = rng.integers(0, 4, (3, 6)), np.ones((3, 6))
    mask[1, 4:] = 0
    args = (index, mask, np.array([1, 0, 5, 2]), chars, char_mask.astype(np.float64), np.array([1.0, 0.0, 1.0]), rng.random((3, 6, T.FEATURES)) * mask[:, :, None])
    _, g = T.loss_and_gradient(p, *args)
    for k, a in p.items():
        at = tuple(rng.integers(0, n) for n in a.shape) if k not in ("words", "chars") else ((5, 3) if k == "words" else (1, 2))
        old, step = a[at], 1e-3
        a[at] = old + step
        up, _ = T.loss_and_gradient(p, *args)
        a[at] = old - step
        down, _ = T.loss_and_gradient(p, *args)
        a[at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4), k


def plain_logit(p, window, vocabulary, evidence):
    """The network written out for one window, word by word and letter by letter."""
    sig = lambda x: 1 / (1 + np.exp(-x))

    def read(xs, u):
        h, out, n = np.zeros(u.shape[0]), [], u.shape[0]
        for x in xs:
            rec = h @ u
            z, r = sig(x[:n] + rec[:n]), sig(x[n : 2 * n] + rec[n : 2 * n])
            new = np.tanh(x[2 * n :] + r * rec[2 * n :])
            h = z * h + (1 - z) * new
            out.append(h)
        return out

    def pool(xs, w, b, u, a):
        ahead = read([x @ w[0] + b[0, 0] for x in xs], u[0])
        back = read([x @ w[1] + b[1, 0] for x in xs[::-1]], u[1])[::-1]
        both = [np.concatenate(s) for s in zip(ahead, back)]
        weights = np.exp([s @ a for s in both])
        return sum(k * s for k, s in zip(weights / weights.sum(), both))

    inputs = []
    for word in window:
        classes, mask = T.spell([word])
        spelled = pool([p["chars"][c] for c, m in zip(classes[0], mask[0]) if m], p["cw"], p["cb"], p["cu"], p["ca"])
        own = evidence.get(word, 0.0), max([evidence.get(word, 0.0), *(evidence.get(word[:n] + "*", 0.0) for n in range(3, 9) if n <= len(word))])
        inputs.append(np.concatenate([p["words"][vocabulary.get(word, 0)], spelled, own]))
    return float(pool(inputs, np.concatenate([p["ww"], p["ws"]], axis=1), p["wb"], p["wu"], p["wa"]) @ p["out"] + p["bias"][0])


def test_scores_equal_a_plain_forward_pass():
    rng = random.Random(4)
    vocabulary, evidence = {"bad": 1, "good": 2, "überaus": 3}, {"bad": 0.7, "übera*": 0.9, "wor*": 0.4, "w1": 0.2}
    p, given = T.initial(3), {}
    for k, v in evidence.items():
        keys, there = T.word_keys([k.removesuffix("*")])
        given[int(keys[0, len(k.removesuffix("*")) - 2] if k.endswith("*") else keys[0, 0])] = v
    order = sorted(given)
    packed = np.array(order, np.uint64), np.array([given[k] for k in order], np.float32)
    for text in ("bad", "good überall 42 überaus", " ".join(rng.choice(["bad", "good", "words", "überaus", f"w{rng.randrange(9)}"]) for _ in range(150))):
        found = T.words(text)
        want = max(plain_logit(p, found[s : s + T.WINDOW], vocabulary, evidence) for s in T.window_starts(len(found)))
        assert T.Scorer(T.Model(p, vocabulary, packed)).logits([text])[0] == pytest.approx(want, abs=1e-4)


def test_evidence_is_counted_by_text():
    toxic, clean = np.array([3, 1, 0]), np.array([0, 5, 9])
    share = 0.1
    want = [max(0, np.log(q / (1 - q)) - np.log(share / (1 - share))) / 3 for q in ((t + T.DRAWN * share) / (t + c + T.DRAWN) for t, c in zip(toxic, clean))]
    assert T.strength(toxic, clean, share) == pytest.approx(want)
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 12))) for _ in range(80)})
    texts = [(np.array(sorted(rng.sample(range(len(names)), 12))), rng.random() < 0.4) for _ in range(30)]
    counts = T.Counts(names)
    for words, label in texts:
        counts.add(words, label)
    of = lambda k: {x for x in range(len(texts)) if any(names[w] == k[:-1] if k.endswith("$") else names[w].startswith(k) for w in texts[x][0])}
    share = sum(y for _, y in texts) / len(texts)
    for own in ((0, 0), (1, 0), (0, 1)):
        got = counts.features(*own)
        for i, w in enumerate(names):
            force = []
            for k in [w + "$", *(w[:n] for n in range(3, 9) if n <= len(w))]:
                t = sum(texts[x][1] for x in of(k)) - own[1]
                c = len(of(k)) - t - own[1] - own[0]
                one = float(T.strength(np.array([t]), np.array([c]), share)[0])
                force.append(one if one >= T.LEAST_EVIDENCE else 0)
            assert got[i] == pytest.approx([force[0], max(force)], abs=1e-5)
    keys, values = counts.evidence()
    assert T.Evidence(keys, values).features(names) == pytest.approx(counts.features(0, 0), abs=1e-6)


def test_windows_cover_and_overlap():
    for n in (1, 15, 16, 17, 64, 65, 112, 113, 1000):
        starts = T.window_starts(n)
        covered = {i for s in starts for i in range(s, min(n, s + T.WINDOW))}
        assert covered == set(range(n)) and all(b - a == T.STRIDE < T.WINDOW for a, b in zip(starts, starts[1:]))
    assert T.window_starts(0) == []


def test_scoring_in_batches_and_parts_changes_nothing(monkeypatch):
    rng = random.Random(2)
    model = T.Model(T.initial(3), {"bad": 1, "good": 2, "so": 3})
    texts = [" ".join(rng.choice(["bad", "good", "so", f"w{rng.randrange(99)}"]) for _ in range(rng.randrange(1, 400))) for _ in range(20)] + [None, "", "..."]
    together = T.Scorer(model).logits(texts)
    apart = [T.Scorer(model).logits([t])[0] for t in texts]
    assert together == pytest.approx(apart, abs=1e-5) and together[-3:] == [model.empty] * 3
    monkeypatch.setattr(T, "TABLE_ROWS", 10)
    assert T.Scorer(model).logits(texts) == pytest.approx(apart, abs=1e-5)


def table(n=1200):
    rng = random.Random(5)
    neutral, bad = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(250)], ["idiot", "scum", "moron"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(neutral) for _ in range(rng.randrange(5, 150))]
        toxic = i % 5 == 0
        for _ in range(2 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = table()
    extra = [(5000, None), (5001, ""), (5002, "nice " * 100_000 + "you idiot scum moron"), (None, "scum")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows + extra], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(9999, 1), (3, None)], "doc_id long, toxic int")
    return rows, dict(labels), docs, marks, T.toxicity(docs, marks).collect()


def test_held_out_accuracy(scored):
    rows, labels, *_, got = scored
    assert len(got) == len(rows) + 4
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["doc_id"] is not None and r["doc_id"] < 5000 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert sum(p and y for p, y in held) >= 0.9 * sum(y for _, y in held)
    assert sum(p and not y for p, y in held) <= 0.03 * sum(1 - y for _, y in held)


def test_edges(scored):
    by = {r["doc_id"]: r for r in scored[-1]}
    assert by[5000]["score"] == by[5001]["score"] and by[5000]["predicted"] == 0
    assert by[5002]["predicted"] == 1  # the last of some 2,000 windows
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored[-1])


def test_every_window_of_long_texts_is_learnt_from(spark):
    rng = random.Random(8)
    neutral = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(250)]
    rows = []
    for i in range(600):
        w = [rng.choice(neutral) for _ in range(700)]
        if i % 3 == 0:
            w[215:218] = rng.sample(["idiot", "scum", "moron"], 3)  # in the fifth of 15 windows alone
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    model = T.fit(spark.createDataFrame(rows[:450], "doc_id long, text string, toxic int"))
    scores = [model.probability(x) for x in T.Scorer(model).logits([text for _, text, _ in rows[450:]])]
    assert np.mean([p >= T.THRESHOLD for p, r in zip(scores, rows[450:]) if r[2]]) >= 0.9
    assert np.mean([p >= T.THRESHOLD for p, r in zip(scores, rows[450:]) if not r[2]]) <= 0.05


def test_empty_tables_and_missing(spark):
    docs = spark.createDataFrame([(1, "some words", "x"), (2, None, "y")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in T.toxicity(docs, marks).collect()} == {0}
    assert T.toxicity(docs.limit(0), marks).count() == 0
    kept = T.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == 2
    clashing = docs.selectExpr("*", "'mine' as score", "7 as predicted", "doc_id as held_out")
    assert sorted(map(tuple, T.drop_toxic(clashing, marks).collect())) == sorted(map(tuple, clashing.collect()))
    assert T.score(clashing, T.fit_on(docs, marks), keep=("doc_id", "score", "predicted")).columns == ["doc_id", "score", "predicted"]
    with pytest.raises(ValueError):
        T.toxicity(docs.drop("text"), marks)
    assert docs.filter(F.col("text").isNull()).count() == 1


@pytest.mark.parametrize("sf,found,flagged", [("sf0.1", 0.9, 0.03), ("sf0.01", 0.5, 0.06)])
def test_held_out_recall_on_the_given_tables(spark, sf, found, flagged):
    """The small table has ten toxic rows outside English to learn from, and finds little there."""
    where = f"/root/testdata/{sf}"
    if not os.path.isdir(where):
        pytest.skip("the table isn't here")
    docs, marks = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).collect()}
    got = [(r["predicted"], truth[r["doc_id"]]) for r in T.toxicity(docs, marks).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p for p, y in got if y]) >= found and np.mean([p for p, y in got if not y]) <= flagged
