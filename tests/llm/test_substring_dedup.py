import hashlib
import random
import re

import numpy as np
import pytest

from corvane.llm import substring_dedup as S


def brute(rows):
    split = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - 12):
            least[tuple(w[k : k + 13])] = min(i, least.get(tuple(w[k : k + 13]), i))
    out = []
    for i, w in split:
        gone = {p for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out)


def texts(seed, vocabulary):
    rng = random.Random(seed)
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [words(rng.randrange(8, 40)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice([words(rng.randrange(20)), rng.choice(passages), rng.choice(passages)[rng.randrange(6) :]]) for _ in range(rng.randrange(5))]
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(w for p in parts for w in p)))
    return rows + [(500, None), (501, ""), (502, " "), (503, "w " * 60), (504, "w " * 60), (505, rows[3][1]), (506, rows[3][1]), (507, "w x " * 20)]


@pytest.mark.parametrize("seed,vocabulary", [(1, "a b".split()), (2, "the of and to x y z".split()), (3, [f"w{i}é" for i in range(200)])])
def test_equals_brute_force(spark, seed, vocabulary):
    rows = texts(seed, vocabulary)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, runs string, id int")
    assert sorted(map(tuple, S.digests(docs).collect())) == brute(rows)


def brute_repeats(rows):
    """Each removed word's place, by document, from maximal stretches of windows that the same least owner has."""
    return {(i, p) for i, w, gone in detail(rows) for p in gone}


def detail(rows):
    split = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - 12):
            least[tuple(w[k : k + 13])] = min(i, least.get(tuple(w[k : k + 13]), i))
    return [(i, w, {p for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}) for i, w in split]


def test_repeats_are_maximal_and_agree_word_by_word(spark):
    rows = texts(2, "the of and to x y z".split())
    split = {i: w for i, w, _ in detail(rows)}
    got = S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["id"], p) for r in got for p in range(r["start"], r["start"] + r["n_words"])} == brute_repeats(rows)
    for r in got:
        a, b, n = split[r["id"]], split[r["owner"]], r["n_words"]
        assert r["owner"] < r["id"] and n >= 13 and a[r["start"] : r["start"] + n] == b[r["owner_start"] : r["owner_start"] + n]


def test_other_lengths(spark):
    rows = texts(3, [f"w{i}" for i in range(200)])[:40]
    for size in (6, 20):
        least, split = {}, {i: S.words(t) for i, t in rows}
        for i, w in split.items():
            for k in range(len(w) - size + 1):
                least.setdefault(tuple(w[k : k + size]), i)
        want = {i: len({p for k in range(len(w) - size + 1) if least[tuple(w[k : k + size])] < i for p in range(k, k + size)}) for i, w in split.items()}
        got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()
        assert {r["id"]: r["n_removed"] for r in got} == want


def test_runs_are_joined_up_by_diagonal():
    rng, size = random.Random(6), 13
    runs = sorted({(rng.randrange(3), rng.randrange(2), rng.randrange(60), rng.randrange(1, 10), rng.randrange(2), rng.randrange(2), rng.choice([0, 0, 7])) for _ in range(120)})
    covered, want = {}, set()
    for doc, check, first, count, owner, owner_check, shift in runs:
        covered.setdefault((doc, check, owner, owner_check, shift), set()).update(range(first, first + count))
    for (doc, check, owner, owner_check, shift), starts in covered.items():
        for s in starts:
            if s - 1 not in starts:
                end = next(e for e in range(s, 200) if e not in starts)
                want.add((doc, check, s, end - s + size - 1, owner, owner_check, s + shift))
    rng.shuffle(runs)
    doc, check, first, count, owner, owner_check, shift = (np.array(c, np.int64) for c in zip(*runs))
    got = S.joined_up(doc, S.packed(first, check, count), owner, S.packed(first + shift, owner_check, count), size)
    assert {tuple(int(v) for v in r) for r in zip(*got)} == want
    assert all(len(x) == 0 for x in S.joined_up(*(np.empty(0, np.int64),) * 4, size))


def test_words_are_compared_not_hashes():
    own = [f"w{i}".encode() for i in range(40)]
    same = b" ".join(own[5:35])
    assert list(S.confirmed(own, 5, same, 13)) == [(5, 30)]
    other = b" ".join([*own[5:20], b"else", *own[21:35]])
    assert list(S.confirmed(own, 5, other, 13)) == [(5, 15), (21, 14)] and list(S.confirmed(own, 5, other, 15)) == [(5, 15)]


def test_very_long_text(spark):
    rng = random.Random(4)
    long = [f"u{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(2, " ".join(long)), (1, " ".join(long[30_000:30_100])), (3, " ".join(long[:50]))]
    assert sorted(map(tuple, S.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_passages_of_many_megabytes(spark):
    """One text's passages fill several batches, the last of them in part."""
    rng = random.Random(8)
    long = [f"m{rng.randrange(10**6)}".ljust(2000, "x") for _ in range(3000)]
    parts = [long[a:b] for a, b in ((0, 1200), (1180, 2300), (2000, 3000), (40, 60), (2990, 3000))]
    rows = [(1, " ".join(long)), *((i, " ".join([f"own{i}", *p, f"end{i}"])) for i, p in enumerate(parts, 2)), (9, " ".join(long))]
    assert sorted(map(tuple, S.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"v{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_removed"]) for r in S.digests(docs).collect()))
    assert got == [(0, 0), (1, 0), (1, 0), (2, 20)]


def test_empty_and_missing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.digests(empty).count() == 0
    with pytest.raises(ValueError):
        S.digests(empty.drop("text"))
