import hashlib
import random

import pytest

from corvane.llm import exact_dedup
from corvane.llm.exact_dedup import CuckooFilter, DigestIndex


def key(i):
    return int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:8], "little")


def test_filter_never_forgets_and_deletes():
    f = CuckooFilter(3000)
    keys = [key(i) for i in range(3000)]
    assert all(f.insert(k) for k in keys)
    assert all(k in f for k in keys)
    assert sum(key(i) in f for i in range(10_000, 30_000)) < 40
    for k in keys[::2]:
        assert f.delete(k)
    assert all(k in f for k in keys[1::2]) and f.count == 1500
    assert sum(k in f for k in keys[::2]) < 10


def test_overflow_resizes_from_stored_keys():
    index = DigestIndex(8)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    assert all(index.insert(d, i) for i, d in enumerate(digests))
    assert index.resizes > 3
    assert not any(index.insert(d, 7) for d in digests[:50])
    assert index.find(digests[3]) == [7, 2] and index.find(digests[49]) == [49, 2]
    assert index.delete(digests[0]) and not index.delete(digests[0]) and index.find(digests[0]) is None


def test_hits_are_verified_in_full():
    index = DigestIndex()
    a, b = b"a" * 24 + b"same-tag", b"b" * 24 + b"same-tag"
    assert index.insert(a, 1) and index.insert(b, 2)
    assert index.false_hits == 1 and index.find(a) == [1, 1] and index.find(b) == [2, 1]


def brute(rows):
    norm = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for _, t in rows]
    out = []
    for (i, _), s in zip(rows, norm):
        ids = [j for (j, _), n in zip(rows, norm) if n == s]
        out.append((i, max(ids), len(ids), i == max(ids), hashlib.sha256(s.encode()).hexdigest()))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Abc", "abc", "ÀB", "àb", None, "", " ", "x" * 50_000, f"own {i}"])) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, digest string, keep_id string")
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect())) == brute(rows)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {r[0] for r in brute(rows) if r[3]}


def test_empty_null_ids_and_missing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {(None, 1, 2, False), (1, 1, 2, True), (None, None, 1, True)}
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(empty.drop("text"))


def test_deletions(spark):
    docs = spark.createDataFrame([(i, f"t{i % 50}") for i in range(100)], "doc_id long, text string")
    own = exact_dedup.digests(docs)
    left = exact_dedup.remove(exact_dedup.build_index(own), own.filter("id < 20"))
    assert left.count() == 30 and {r["group_size"] for r in left.collect()} == {2}
