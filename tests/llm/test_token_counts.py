import base64
import random
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken

from corvane.llm import token_counts as T

SCHEMA = "doc_id long, tokenizer string, source string, lang string, n_tokens long, extra string"


def as_dict(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


def brute_totals(state):
    out = defaultdict(lambda: [0, 0])
    for (_, tokenizer), (source, lang, n) in state.items():
        out[source, lang, tokenizer][0] += 1
        out[source, lang, tokenizer][1] += n
    return {k: tuple(v) for k, v in out.items()}


def test_random_batches_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    ledger, state = T.TokenLedger(spark, f"file://{tmp_path}/ledger"), {}
    for b in range(5):
        rows = [(rng.choice([None, *range(12)]), rng.choice("vw"), rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.choice([None, 0, 5, 9, 40])) for _ in range(25)]
        batch = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
        best = {}
        for r in rows:
            key = tuple((v is not None, v) if v is not None else (False, 0) for v in (r[4], r[2], r[3]))
            if r[:2] not in best or key > best[r[:2]][0]:
                best[r[:2]] = key, (r[2], r[3], r[4])
        for k, (_, v) in best.items():
            state.pop(k, None)
            if v[2] is not None:
                state[k] = v
        assert ledger.commit(f"batch-{b}", batch)
        assert not ledger.commit(f"batch-{b}", batch) and not ledger.commit("batch-0", batch)
        assert as_dict(ledger.totals()) == brute_totals(state) == as_dict(ledger.recounted())
    assert sorted(ledger.committed()) == [f"batch-{b}" for b in range(5)]


def test_unpublished_attempts_are_not_read(spark, tmp_path):
    ledger = T.TokenLedger(spark, f"file://{tmp_path}/ledger")
    batch = spark.createDataFrame([(1, "v", "a", "x", 5, "")], SCHEMA)
    ledger._write(batch, f"{ledger.folder}/attempts/lost/id=one", False)
    assert ledger.totals().count() == 0 and ledger.committed() == {}
    assert ledger.commit("one", batch) and as_dict(ledger.totals()) == {("a", "x", "v"): (1, 5)}


def test_a_taken_number_is_not_overwritten(spark, tmp_path):
    ledger = T.TokenLedger(spark, f"file://{tmp_path}/ledger")
    batch = spark.createDataFrame([(1, "v", "a", "x", 5, "")], SCHEMA)
    assert ledger.commit("one", batch)
    ledger._write(batch, f"{ledger.folder}/attempts/late/id=two", True)
    assert not ledger._publish("attempts/late", "log/seq=0000000001")
    assert ledger.committed() == {"one": 1} and as_dict(ledger.totals()) == {("a", "x", "v"): (1, 5)}


def test_empty_batches_and_refusals(spark, tmp_path):
    ledger = T.TokenLedger(spark, f"file://{tmp_path}/ledger")
    batch = spark.createDataFrame([], SCHEMA)
    assert ledger.commit("none", batch) and not ledger.commit("none", batch) and ledger.totals().count() == 0
    with pytest.raises(ValueError):
        ledger.commit("../x", batch)
    with pytest.raises(ValueError):
        ledger.commit("x", batch.drop("lang"))


def test_snapshots_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SNAPSHOT_EVERY", 2)
    rng = random.Random(3)
    ledger = T.TokenLedger(spark, f"file://{tmp_path}/ledger")
    for b in range(5):
        rows = [(i, "v", rng.choice("ab"), "x", rng.choice([None, 3, 8]), "") for i in rng.sample([None, *range(9)], 6)]
        assert ledger.commit(f"b{b}", spark.createDataFrame(rows, SCHEMA))
    assert ledger.snapshots() == [2, 4] and ledger.snapshot() == 5 == ledger.snapshots()[-1]
    assert as_dict(ledger.totals()) == as_dict(ledger.recounted())
    assert sorted(map(str, ledger.live().collect())) == sorted(map(str, ledger.live_at(5).collect()))


def test_corpus_rollup_equals_brute_force(spark, tmp_path):
    texts = ["Hello world, hello.", "Grüße aus Köln", "", None, "word " * 30_000, "a\u2003b \u00a0 c\n\n  d", "¿Qué tal?", "Grüße aus Köln"]
    rows = [(i, texts[i % len(texts)], ["s1", "s2", None][i % 3], ["en", "de", None, "es"][i % 4], "clash", 1) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept string, n_0 int")
    files = {v: P.path(f"{f}.tiktoken") for v, f in (("one", "byte_bpe_50k"), ("multi", "byte_bpe_multi_50k"))}
    encoders = {v: tiktoken.Encoding(v, pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f, "rb"))}, special_tokens={}) for v, f in files.items()}
    state = {(i, v): (source, lang, len(encoders[v].encode_ordinary(t or ""))) for i, t, source, lang, *_ in rows for v in files}
    versions = {v: (f, P.PATTERN) for v, f in files.items()}
    assert as_dict(T.corpus_rollup(docs, f"file://{tmp_path}/ledger", versions)) == brute_totals(state)
    log = T.TokenLedger(spark, f"file://{tmp_path}/ledger")
    revised = log._read("entries", T.ENTRY).filter("tokenizer = 'one' and old_tokens <> n_tokens").count()
    assert sorted(log.committed()) == ["count", "load", "retire"] and revised > 5
    assert T.corpus_rollup(docs.limit(0), f"file://{tmp_path}/empty", versions).count() == 0
