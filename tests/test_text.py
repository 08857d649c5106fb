import os.path
import re

from pyspark.sql import functions as F

from corvane.functions import text as T

EDGES = ["A\nB", "x y", "K K", "İstanbul", "a _ b", "__", "\x1c\x1d a", "  \xa0z ", "\x85q", "Straẞe", "a\x0bb", "\U0001f600 hi", "ΑΣ x", None, "", "Who? Me. # x"]


def plain_clean(t):
    t = (t or "").lower()
    for pattern, into in (("[\x00-\x1f\x7f-\x9f]", ""), ("[^\x00-\x7f]+", ""), (r"\s+", " "), ("_+", " ")):
        t = re.sub(pattern, into, t)
    return t.strip()


def test_cleaning(spark):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, t string").select("i", T.clean_text(F.col("t")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in got} == {i: plain_clean(t) for i, t in enumerate(EDGES)}


def test_words_and_punctuation(spark):
    texts = ["Don't stop-me, NOW!", "a b c\x1cd\u0085e", "[x]`y~z{|}", None, "  "]
    plain = lambda t: "".join(c for c in t or "" if c not in r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""").lower().split()
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.plain_words(F.col("t")).alias("w")).collect()
    assert {r["i"]: r["w"] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_paths(spark):
    names = ["a.b.pdf", "x", ".h", "a.", "..a", "...", "d.x/B.DOCX", "d/", ".a.b", "c.Doc"]
    stem, ext = T.stem_and_extension(F.col("p"))
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", stem.alias("s"), ext.alias("e"), T.file_kind(F.col("p")).alias("k")).collect()
    for r in got:
        assert (r["s"], r["e"]) == os.path.splitext(os.path.basename(r["p"])), r
    assert {r["p"]: r["k"] for r in got}["d.x/B.DOCX"] == "word" and {r["k"] for r in got if r["p"] == "a.b.pdf"} == {"pdf"}


def test_display_names_and_labels(spark):
    rows = [("n", "a/b", "n"), ("", "a/b.pdf", "b.pdf"), (None, "a/", "Source Document"), (None, None, "Source Document"), ("", "", "Source Document")]
    got = spark.createDataFrame(rows, "d string, p string, want string").select(T.display_name(F.col("d"), F.col("p")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    labels = spark.createDataFrame([("Latency_ms",), ("BLEU_Score",)], "m string").select(T.metric_label(F.col("m")).alias("l"), T.preview(F.col("m"), 3).alias("p")).collect()
    assert [tuple(r) for r in labels] == [("Latency(ms)", "Lat"), ("BLEU Score", "BLE")]


def test_word_tokens_and_preview(spark):
    rows = [("Don't stop,\nthe ÉTÉ_2!",), (None,), ("a\u00a0b\tc",), ("\u65e5\u672c 5%",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(T.word_tokens(F.col("x"))).collect()]
    assert got == [["don", "'", "t", "stop", ",", "the", "été_2", "!"], [], ["a", "b", "c"], ["\u65e5\u672c", "5", "%"]]
    assert spark.createDataFrame(rows, "x string").select(T.preview(F.col("x"), 3)).first()[0] == "Don"
