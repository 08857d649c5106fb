import random

import numpy as np
import pytest
import xxhash

from corvane.llm import simhash
from corvane.llm.common import connected_components


def brute_fingerprint(text):
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, f"{fp:016x}", least[find(k)]) for k, (i, fp) in enumerate(fps))


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 6))) for _ in range(300)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([80, 400]))]
        for _ in range(9):
            near = list(text)
            for _ in range(rng.randrange(4)):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append(" ".join(near))
    rows += [None, "", " \t\n", "one", "ONE", "one two", "One\u00a0two three", "One\x0btwo three", "İ I", "long word " * 9000, rows[0], rows[0]]
    return list(enumerate(rows))


def test_equals_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in rows], "doc_id long, text string, fp string, id long")
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == brute(rows)


def test_links_are_complete_and_exact(spark):
    rng = random.Random(11)
    fps = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for b in rng.sample(range(64), rng.randrange(5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    got = simhash.links(spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")).collect()
    pairs = {tuple(sorted(map(int, r))) for r in got}
    signed = sorted(map(simhash.signed, fps))
    a = np.array(signed, np.int64)
    near = np.bitwise_count((a[:, None] ^ a[None, :]).view(np.uint64)) <= 3
    assert pairs == {(signed[i], signed[j]) for i in range(len(a)) for j in range(i + 1, len(a)) if near[i, j]}


def test_empty_and_missing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(empty.drop("text"))


def test_representatives_keep_columns(spark):
    docs = spark.createDataFrame([(3, "a b c d", "x"), (1, "a b c d", "y"), (2, "q r s t u v", "z")], "doc_id long, text string, source string")
    assert sorted(map(tuple, simhash.keep_representatives(docs).collect())) == [(1, "a b c d", "y"), (2, "q r s t u v", "z")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 98), (7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98, 200: 200, 201: 200}
