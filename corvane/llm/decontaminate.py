"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

One pass over the texts stores a posting (term, document, position) for every training token whose term the benchmark holds,
with terms numbered, and for each document one posting of a mark behind its last word, whose position is the number
of words. All else reads these postings, never the texts. A benchmark window of ten words is looked up from its
rarest terms: its offset-adjusted lists (pos - offset: where the window would have to start) of the two rarest terms are
intersected, and what survives is intersected with the lists of the remaining terms until every term of the window has
confirmed the start. Which terms are rare is counted over all documents.

What the benchmark contributes (terms, windows) is broadcast while it is under a number of rows and bytes, which
are checked; beyond that the same joins shuffle. Hot terms and passages shuffle by document and start, never by the term
alone, and hits are counted per document by distinct positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, maybe_broadcast, materialised, require

#: A word is a run of ASCII letters, digits and anything beyond ASCII; no word is a single break.
BREAK, MARK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "
WINDOW = 10
#: Whose posting it is: 128 bits of the row's id and text. Equal rows share them, and all else is told apart, also where ids repeat or are null.
DOC = ("k1", "k2")


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)  # lower() is then quick, and the same
    cut = F.split(F.when(ascii_only, F.lower(text)).otherwise(ascii_lower(text)), BREAK)
    return F.array_remove(cut, "")


def windows(benchmark: DataFrame, size: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window, terms): every run of ``size`` words of each item, the whole item if it is shorter and not empty; equal runs share one window id."""
    require(benchmark, (item_col, text_col))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    runs = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("terms")).distinct()
    return runs.select("item", F.sha2(F.array_join("terms", " "), 256).alias("window"), "terms")


def keyed(doc: Column, text: Column) -> tuple[Column, Column]:
    own = F.coalesce(text, F.lit(""))
    return F.xxhash64(doc.cast("string"), own).alias("k1"), F.xxhash64(F.lit(1), own, F.coalesce(doc.cast("string"), F.lit(" "))).alias("k2")


def numbered(terms: DataFrame) -> DataFrame:
    """(term, number) of distinct terms; the mark has the number -1. The numbers' order means nothing."""
    dense = terms.select("term").distinct().withColumn("number", F.monotonically_increasing_id())
    return dense.unionByName(terms.sparkSession.createDataFrame([(MARK, -1)], "term string, number long"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(k1, k2, doc, pos, number) of docs (doc, text) for the numbered terms given: the index entries to store. doc is with the mark alone."""
    tokens = docs.select(*keyed(F.col("doc"), F.col("text")), "doc", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(MARK)))).alias("pos", "term"))
    return tokens.join(maybe_broadcast(terms), "term").select(*DOC, F.when(F.col("number") < 0, F.col("doc")).alias("doc"), "pos", "number")


def phrase_hits(index: DataFrame, slots: DataFrame) -> DataFrame:
    """(k1, k2, window, start, length): every exact occurrence of a window. slots: (window, length, off, number), a row for each word of each window."""
    counts = materialised(index.filter("number >= 0").groupBy("number").agg(F.count("*").alias("n")), "term-counts")
    # a window with a term that no document has cannot occur; of the others, the rarest two slots are looked up first
    by_rarity = Window.partitionBy("window").orderBy("n", "number", "off")
    ranked = slots.join(maybe_broadcast(counts), "number").withColumn("rank", F.row_number().over(by_rarity))
    whole = ranked.groupBy("window").agg(F.count("*").alias("present"), F.first("length").alias("full")).filter("present = full").select("window")
    ranked = materialised(ranked.join(whole, "window", "left_semi"), "ranked-slots")

    def starts(rank: int) -> DataFrame:
        probe = ranked.filter(F.col("rank") == rank).select("number", "window", "length", "off")
        return index.join(maybe_broadcast(probe), "number").select(*DOC, "window", "length", (F.col("pos") - F.col("off")).alias("start")).filter("start >= 0")

    first = starts(1)
    both = first.filter("length > 1").join(starts(2).drop("length"), [*DOC, "window", "start"], "left_semi").unionByName(first.filter("length = 1"))
    candidates = materialised(both.distinct(), "candidates")  # a repeated row has the same postings again: each start is confirmed once
    # the remaining terms: the postings of candidate documents, joined to where each candidate needs them
    rest = ranked.filter("rank > 2").select("window", "off", "number")
    needed = candidates.join(maybe_broadcast(rest), "window").select(*DOC, (F.col("start") + F.col("off")).alias("pos"), "number", "window", "start")
    touched = maybe_broadcast(candidates.select(*DOC).distinct())
    lists = index.join(maybe_broadcast(rest.select("number").distinct()), "number", "left_semi").join(touched, [*DOC], "left_semi")
    confirmed = needed.join(lists, [*DOC, "pos", "number"], "left_semi").groupBy(*DOC, "window", "start").agg(F.count("*").alias("found"))
    joined = candidates.join(confirmed, [*DOC, "window", "start"], "left")
    return joined.filter(F.coalesce("found", F.lit(0)) == F.greatest(F.col("length") - 2, F.lit(0))).select(*DOC, "window", "start", "length")


def proximity_hits(docs: DataFrame, a: str, b: str, within: int) -> DataFrame:
    """(doc, pos, other): occurrences of term a with another term b at most ``within`` words away, from the same postings, for each row of docs (doc, text)."""
    terms = docs.sparkSession.createDataFrame([(a, 0), (b, 1), (MARK, -1)], "term string, number long")
    index = postings(docs, terms)
    cell = (F.col("pos") / within).cast("long")
    left = index.filter("number = 0").select(*DOC, "pos", cell.alias("cell")).distinct()
    right = index.filter("number = 1").select(*DOC, F.col("pos").alias("other"), F.explode(F.array(*(cell + d for d in (-1, 0, 1)))).alias("cell")).distinct()
    near = left.join(right, [*DOC, "cell"]).filter((F.abs(F.col("pos") - F.col("other")) <= within) & (F.col("pos") != F.col("other")))
    return index.filter("number = -1").select(*DOC, "doc").join(near, [*DOC]).select("doc", "pos", "other")


def _results(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """(k1, k2, doc, n_words, n_hit, items) per row of docs (doc, text); the last two are null where nothing is hit."""
    runs = materialised(windows(benchmark, size), "windows")
    terms = materialised(numbered(runs.select(F.explode("terms").alias("term"))), "terms")
    index = materialised(postings(docs, terms), "postings")
    spread = runs.select("window", "terms").distinct().select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("off", "term"))
    slots = materialised(spread.join(terms, "term").drop("term"), "slots")
    hits = materialised(phrase_hits(index, slots), "hits")
    covered = hits.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    named = hits.select(*DOC, "window").distinct().join(maybe_broadcast(runs.select("window", "item")), "window").groupBy(*DOC).agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = index.filter("number = -1").select(*DOC, "doc", F.col("pos").cast("long").alias("n_words"))
    return rows.join(covered.join(named, [*DOC]), [*DOC], "left")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) per row of docs.

    n_hit counts the words inside any occurrence of a window, n_items the items with occurring windows; null and empty
    texts have no words and are never hit, nor do null or wordless items contribute. Each row is judged by its own text:
    rows with one id, repeated rows and rows with a null id all get their hits. Texts of any length are read whole. An empty
    benchmark hits nothing; an empty table gives no rows; other columns are ignored.
    """
    require(docs, (id_col, text_col))
    n_hit, items = F.col("n_hit"), F.col("items")
    return _results(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), benchmark, size).select(
        F.col("doc").alias("id"),
        "n_words",
        F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.when(items.isNull(), F.lit(0)).otherwise(F.size(items)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(items, ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(n_hit > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a window of the benchmark, whatever their id; all columns and all other rows kept, repeated ones too."""
    require(docs, ("doc_id", "text"))
    hit = _results(docs.select(F.col("doc_id").alias("doc"), "text"), benchmark, WINDOW).filter("n_hit > 0").select(*(F.col(k).alias(f"__{k}") for k in DOC)).distinct()
    own = docs.select("*", *(k.alias(f"__{n}") for k, n in zip(keyed(F.col("doc_id"), F.col("text")), DOC)))
    return own.join(hit, [f"__{k}" for k in DOC], "left_anti").select(*docs.columns)
