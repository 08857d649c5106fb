import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from corvane.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.codec(open(PATH, "rb").read(), P.PATTERN)


def merged_naively(ranks, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


EDGES = ["", " ", "   ", "a", "\n\n  x", "don't I'LL we've", "\x1c\x1d a\x1e\x1f", "\x85\xa0 z", "\u180e\u200b\ufeff q", "日本語 テスト", "\U0001f600\U0001f600 hi", "a" * 5000, " " * 3000 + "x", "ab" * 4000, "\x00\x01", "<|endoftext|>", "١٢٣ ½ 12", "é" * 999, "\t\t\tif x:\r\n", "_-_-_!!??" * 50]


def test_equals_tiktoken_on_edges_and_random_texts(bpe, reference):
    rng = random.Random(7)
    pools = ["abcdefghij klmnop", "thein erandou ", "aA1 _-\n\t.,'", "éèñüß ação", "".join(map(chr, range(1, 700))), "aab"]
    texts = EDGES + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 200))) for _ in range(3000)]
    for t in texts:
        assert bpe.encode(t) == reference.encode_ordinary(t), repr(t[:80])
        assert bpe.decode(bpe.encode(t)) == t.encode()


def test_batches_equal_tiktoken(reference, monkeypatch):
    rng = random.Random(9)
    pools = ["abcdefghij klmnop", "thein erandou ", " \n\t a.", "aA1 _-\n\t.,'", "é ü\u00a0\u2003ñ\u3000ß ação", "".join(map(chr, range(1, 700))), "aab "]
    texts = EDGES + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 300))) for _ in range(1500)]
    texts += [" ".join("".join(rng.choice(["th", "er", "ing", "nd", "tion", "q", "é"]) for _ in range(rng.randrange(1, 9))) for _ in range(200)) for _ in range(50)]
    bpe = byte_bpe.ByteBPE(byte_bpe.read_ranks(open(PATH, "rb").read()), P.PATTERN)
    monkeypatch.setattr(byte_bpe, "CHUNKS_KEPT", 3000)
    for size in (2000, 10**7):
        got = []
        for part in byte_bpe.in_parts(pa.array([*texts, None]), size):
            ids, bounds = bpe.encode_all(part)
            assert (bpe.counts(part) == np.diff(bounds)).all()
            assert [bytes(x.as_py()) for x in bpe.decode_all(ids, bounds)] == [(t.as_py() or "").encode() for t in part]
            got += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [reference.encode_ordinary(t or "") for t in [*texts, None]]


def test_pieces_of_any_bytes_equal_naive_merging(bpe, ranks):
    rng = random.Random(3)
    tokens = list(ranks)
    for _ in range(1500):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6)))[:60]
        if piece not in ranks:
            assert bpe.encode_piece(piece) == merged_naively(ranks, piece), piece


def test_every_token_encodes_to_itself(bpe, ranks):
    assert all(bpe.encode_piece(t) == [i] for t, i in ranks.items())


def test_bounded_caches_change_nothing(bpe, monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "PIECES_KEPT", 3)
    monkeypatch.setattr(byte_bpe, "PAIRS_KEPT", 5)
    text = "some words that go on and on, repeating words that were " * 20
    assert bpe.encode(text) == reference.encode_ordinary(text)


def test_digests_and_decode(spark, reference):
    rows = [(1, "Hello wörld\n", "x"), (2, None, "x"), (3, "", None), (4, "Hello wörld\n", "y"), (4, "Hello wörld\n", "y"), (5, "long " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, byte_bpe.digests(docs, PATH, P.PATTERN).collect()))
    want = []
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    encoded = byte_bpe.encode(docs, PATH, P.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.decode(encoded, PATH).collect()} == {i: t or "" for i, t, _ in rows}
    clashing = byte_bpe.encode(docs.withColumnRenamed("ids", "n_tokens").withColumn("DECODED", docs.doc_id), PATH, P.PATTERN, keep=("doc_id", "text", "n_tokens", "DECODED"), round_trip=True)
    assert clashing.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"] and {r["n_tokens"] * 4 - len(r["ids"]) for r in clashing.collect()} == {0}
    assert byte_bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(docs.drop("text"), PATH, P.PATTERN)
