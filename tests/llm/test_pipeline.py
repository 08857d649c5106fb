import random

import corpus_pipeline
from corvane.llm import byte_bpe, decontaminate, exact_dedup, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(folder, spark):
    rng = random.Random(8)
    neutral = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    say = lambda n: [rng.choice(neutral) for _ in range(n)]
    items = [(i, " ".join(say(14))) for i in range(3)]
    texts = []
    for i in range(400):
        w = say(rng.randrange(40, 90))
        if i % 5 == 0:
            w[3:3] = ["idiot", "scum"]
            w[20:20] = ["moron", "scum"]
        texts.append(" ".join(w))
    texts += [texts[1], texts[1].upper(), texts[2] + " tail", texts[3] + " " + items[0][1] + " end", None]
    near = say(600)
    texts += [" ".join(near), " ".join([*near, "more"])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, " ".join(say(70)), None, None, 19)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, items


def brute(spark, rows, items, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    bad = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit_on(docs, labels)).collect() if r["predicted"]}
    left = [r for r in rows if r[0] not in bad]
    best = {}
    for r in left:
        if r[0] is not None:
            key = (r[1] or "").lower()
            best[key] = max(best.get(key, r[0]), r[0])
    left = [r for r in left if r[0] is None or best[(r[1] or "").lower()] == r[0]]
    prints = {r[0]: simhash.fingerprint(r[1]) for r in left}
    group = {i: i for i in prints if i is not None}
    for _ in group:
        for a in group:
            for b in group:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    group[a] = min(group[a], group[b])
        if all(group[a] == group[b] for a in group for b in group if (prints[a] ^ prints[b]).bit_count() <= 3):
            break
    left = [r for r in left if r[0] is None or group[r[0]] == r[0]]
    runs = {tuple(t.split()[i : i + 10]) for _, t in items for i in range(len(t.split()) - 9)}
    clean = lambda t: not any(tuple((t or "").split()[i : i + 10]) in runs for i in range(len((t or "").split()) - 9))
    return [r for r in left if r[0] is None or clean(r[1])], bad


def test_equals_brute_force(spark, tmp_path):
    sf_dir = f"file://{tmp_path}/sf"
    rows, items = corpus(sf_dir, spark)
    want, bad = brute(spark, rows, items, sf_dir)
    assert len(bad & set(range(0, 400, 5))) >= 70
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == {r[0] for r in want}
    assert {None, 4, 402} & set(got) and 403 not in got and not {1, 400} & set(got)
    for i, text, lang, source, n in want:
        r = got[i]
        assert (r["text"], r["lang"], r["source"], r["n_chars"], r["n_tokens"] * 4) == (text, lang, source, n, len(r["ids"]))


def test_dedup_keeps_rows_not_ids(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, one), (1, one), (2, one), (2, one), (2, two), (3, two), (4, three), (4, three), (None, three), (None, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = lambda out: sorted(map(tuple, out.collect()), key=key)
    assert got(exact_dedup.drop_duplicates(docs)) == [(2, one), (3, two), (4, three), (None, three), (None, three)]
    assert got(simhash.keep_representatives(docs)) == [(1, one), (2, two), (4, three), (None, three), (None, three)]


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    sf_dir = f"file://{tmp_path}/sf"
    corpus(sf_dir, spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 0, name
    assert [m.__name__.rsplit(".", 1)[1] for m in (toxicity, exact_dedup, simhash, decontaminate, byte_bpe)]


def test_clashing_columns_repeated_rows_and_long_texts(spark, tmp_path):
    sf_dir = f"file://{tmp_path}/sf"
    rows, items = corpus(sf_dir, spark)
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = " ".join(f"long{i}" for i in range(150_000))
    more = spark.createDataFrame([(1000, long, "en", "s", 1), (1000, long, "en", "s", 1), (1001, "", None, None, None), (None, items[1][1], None, None, None), (None, items[1][1], None, None, None)], SCHEMA)
    docs = plain.limit(60).unionByName(plain.filter("doc_id < 5")).unionByName(more)
    clash = docs.selectExpr("*", "doc_id as score", "'p' as predicted", "'n' as n_tokens", "'i' as ids", "'d' as decoded", "1 as k1", "2 as digest", "3 as fp", "4 as kept", "5 as held_out")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, sf_dir)
        want = stage(spark, docs, sf_dir)
        got = out.collect()
        assert sorted(str(r["doc_id"]) + str(r["text"])[:99] for r in got) == sorted(str(r["doc_id"]) + str(r["text"])[:99] for r in want.collect()), name
        if name != "byte-level BPE":
            assert out.columns == clash.columns and all((r["predicted"], r["n_tokens"], r["kept"]) == ("p", "n", 4) for r in got), name
            assert sum(r["doc_id"] == 1000 for r in got) == (1 if "dedup" in name else 2), name
        else:
            assert out.columns == [c for c in clash.columns if c not in ("n_tokens", "ids", "decoded")] + ["n_tokens", "ids", "decoded_sha256"] and len(got) == clash.count()
    assert not corpus_pipeline.without_benchmark(spark, clash, sf_dir).filter("doc_id is null and n_chars is null").count()
