"""Substring dedup by seed and extend.

Seeds: of every window's 5-word grams, the one with the least hash is the window's anchor (winnowing), so equal windows
have equal anchors at equal places, and about one gram in five is an anchor. An anchor carries the run of windows that
chose it, its span. Anchors that only one document holds can't begin a repeat and go first: that is
one grouped count, and one join back.

Extend: documents are joined on anchors, and a match is extended to both sides as far as the words agree. Pairing all occurrences of
an anchor would grow with the square of a passage's copies, so each is matched with the least document alone: occurrences
whose whole span agrees (by hash) extend over all of it and take the least document that has that span; where an
anchor has several different spans, it is extended step by step to each window that holds it, and each window takes the
least document that has it. Matches of a document with one other along one diagonal are then joined up to maximal repeats. Last,
the words of each repeat are fetched from the other document, each distinct passage once, and compared with the document's own,
word by word: only words inside windows that agree are repeats, whatever the hashes said.

A group of copies or a passage of any size costs one row per task and key in each of the counts; the joins back to the
occurrences have two shuffled sides each, so that Spark splits hot keys; texts are joined by document alone, and passages travel
once to each document that repeats them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import in_parts, taken
from .common import materialised, released, require, small_batches

WINDOW, GRAM, PART_BYTES = 13, 5, 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white space characters; null has none."""
    return (text or "").encode("utf-8", "replace").split()


def check_bits(text: str | None) -> int:
    """Sixteen bits of a text's digest: ids may repeat."""
    return zlib.crc32((text or "").encode("utf-8", "replace")) & 0xFFFF


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's and its inverse's powers below the n-th."""
    if len(_POWERS[0]) < n:
        for k, factor in enumerate((_MULTIPLIER, _INVERSE)):
            _POWERS[k] = np.ones(n, np.uint64)
            np.multiply.accumulate(np.full(n - 1, factor), out=_POWERS[k][1:])
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run values[start:end], the same wherever it stands: a difference of sums of values by falling powers."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down[:-1], out=sums[1:])
    return mixed((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64))


class Words:
    """The words of texts (no nulls), all texts in one: their hashes, and at which word each text begins (and the end)."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        inner = np.zeros(len(data) + 2, bool)
        inner[1:-1] = ~_WHITE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(inner[1:] & (~inner[:-1] | edge))
        end = np.flatnonzero(inner[:-1] & (~inner[1:] | edge))
        self.hashes = run_sums(data.astype(np.uint64) + np.uint64(1), start, end)
        self.bounds = np.searchsorted(start, offsets)

    def owner(self) -> np.ndarray:
        """Which text each word is of."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, from the words' hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _MULTIPLIER + h[i : len(h) - n + 1 + i]
    return mixed(out)


def anchors(own: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each anchor's gram hash, place, first window and number of windows; places are counted over all texts."""
    h, per = own.hashes, size - GRAM + 1
    n = len(h) - size + 1
    if n <= 0:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    grams = run_hashes(h, GRAM)
    best, place = grams[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, per):
        other = grams[i : i + n]
        less = other <= best  # of equal hashes the rightmost
        best[less] = other[less]
        place[less] = i
    inside = np.flatnonzero(np.repeat(own.bounds[1:], np.diff(own.bounds))[:n] >= np.arange(n) + size)  # windows of one text
    best, place = best[inside], place[inside] + inside
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, np.int64)
    return best[first], place[first], inside[first], np.diff(np.append(first, len(place)))


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def packed(first: np.ndarray, check: np.ndarray | int, count: np.ndarray | int) -> np.ndarray:
    """A run of windows as one long: its first window, the text's check bits, the number of windows."""
    return (first << 32) | (check << 16) | count


def _parts(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, pa.Array]]:
    at = 0
    for part in in_parts(batch.column(text_at), PART_BYTES):
        yield at, part
        at += len(part)


def _checks(part: pa.Array) -> np.ndarray:
    return np.array([check_bits(t) for t in part.to_pylist()], np.int64)


def occurrences(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(gram, span, id, at): every anchor of docs (id, text); at packs its run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, part in _parts(batch, 1):
                own = Words(part)
                gram, place, first, count = anchors(own, size)
                text = np.searchsorted(own.bounds, first, side="right") - 1
                span = run_sums(own.hashes, first, first + count + size - 1)
                span = mixed(span + (place - first).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
                yield pa.record_batch([_long(gram), _long(span), _long(ids[at + text]), _long(packed(first - own.bounds[text], _checks(part)[text], count))], names=["gram", "span", "id", "at"])

    return docs.mapInArrow(run, "gram long, span long, id long, at long")


def grams_once(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(gram): every anchor hash once for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for _, part in _parts(batch, 1):
                own = Words(part)
                gram, _, first, _ = anchors(own, size)
                text = np.searchsorted(own.bounds, first, side="right")
                order = np.lexsort((gram, text))
                gram, text = gram[order], text[order]
                once = np.concatenate([[True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])])[: len(gram)]
                yield pa.record_batch([_long(gram[once])], names=["gram"])

    return docs.mapInArrow(run, "gram long")


def _runs(column: pa.Array, at: int, part: pa.Array, own: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists of packed runs: those of the part's texts, as text, first window, check bits and number of windows."""
    lists = column.slice(at, len(part))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(part)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    same = (flat >> 16 & 0xFFFF) == _checks(part)[text]
    return text[same], flat[same] >> 32, flat[same] >> 16 & 0xFFFF, flat[same] & 0xFFFF


def window_hashes(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, at, hash, hash2) of every window in the runs ``ats`` of (id, text, ats); at is the window's own run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, part in _parts(batch, 1):
                own = Words(part)
                text, first, check, count = _runs(batch.column(2), at, part, own)
                starts, text, check = taken(first, count), np.repeat(text, count), np.repeat(check, count)
                here = starts + own.bounds[text]
                both = run_hashes(own.hashes, size)[here], run_sums(own.hashes, here, here + size)
                yield pa.record_batch([_long(ids[at + text]), _long(packed(starts, check, 1)), *map(_long, both)], names=["id", "at", "hash", "hash2"])

    return docs.mapInArrow(run, "id long, at long, hash long, hash2 long")


def joined_up(doc: np.ndarray, at: np.ndarray, owner: np.ndarray, owner_at: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Maximal repeats of matched runs: (doc, check, start, words, owner, owner_check, owner_start), of neighbouring runs of one document on one diagonal of one owner."""
    check, owner_check, first, count = at >> 16 & 0xFFFF, owner_at >> 16 & 0xFFFF, at >> 32, at & 0xFFFF
    shift = (owner_at >> 32) - first
    order = np.lexsort((first, shift, owner_check, owner, check, doc))
    doc, check, owner, owner_check, shift, first, count = (x[order] for x in (doc, check, owner, owner_check, shift, first, count))
    if not len(doc):
        return doc, check, first, count, owner, owner_check, first
    other = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (doc, check, owner, owner_check, shift)], axis=0)])
    apart = np.cumsum(other) << 32  # diagonals one behind another, so that the furthest end so far is one running maximum
    furthest = np.maximum.accumulate(apart + first + count + size - 1)
    begins = np.flatnonzero(other | np.concatenate([[True], apart[1:] + first[1:] > furthest[:-1] - size + 1]))
    last = np.append(begins[1:], len(doc)) - 1
    n_words = furthest[last] - apart[last] - first[begins]
    return doc[begins], check[begins], first[begins], n_words, owner[begins], owner_check[begins], (first + shift)[begins]


MATCH = "id long, check int, start int, n_words int, owner long, owner_check int, owner_start int"


def matches(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, check, start, n_words, owner, owner_check, owner_start): for each document of (id, text), its maximal runs of windows that a smaller id (the owner of each window is the least) has too, by hash."""
    many = materialised(grams_once(docs, size).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "shared-grams")
    shared = materialised(occurrences(docs, size).join(many, "gram"), "shared-anchors")
    first = F.min(F.struct("id", "at")).alias("first")
    owners = materialised(shared.groupBy("span", "gram").agg(first, F.max("id").alias("last")), "span-owners")
    found = owners.filter("first.id < last").select("span", "gram", F.col("first.id").alias("owner"), F.col("first.at").alias("owner_at"))
    whole = shared.join(found, ["span", "gram"]).filter("id > owner").select("id", "at", "owner", "owner_at")
    # only anchors with several different spans are left, and of each span its owner alone, wherever that has it
    several = owners.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    apart = owners.join(several, "gram", "left_semi").select("span", "gram", "first.id")
    partial = materialised(shared.join(apart, ["span", "gram", "id"], "left_semi").groupBy("id").agg(F.collect_list("at").alias("ats")), "edges")
    windows = materialised(window_hashes(docs.join(partial, "id").select("id", "text", "ats"), size), "edge-windows")
    least = windows.groupBy("hash", "hash2").agg(first, F.max("id").alias("last")).filter("first.id < last")
    least = materialised(least.select("hash", "hash2", F.col("first.id").alias("owner"), F.col("first.at").alias("owner_at")), "window-owners")
    single = windows.join(least, ["hash", "hash2"]).filter("id > owner").select("id", "at", "owner", "owner_at")
    grouped = whole.unionByName(single).groupBy("id").agg(F.collect_list(F.struct("at", "owner", "owner_at")).alias("found"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.int32()] * 3, pa.int64(), *[pa.int32()] * 2]
        for batch in batches:
            lists = batch.column(1)
            doc = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            out = joined_up(doc, *(x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()), size)
            yield pa.record_batch([pa.array(c).cast(t) for c, t in zip(out, kinds)], names=[c.split()[0] for c in MATCH.split(", ")])

    return materialised(grouped.mapInArrow(join_up, MATCH), "matches")


def passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(owner, owner_check, owner_start, n_words, passage): the words of each distinct passage that the matches ask for, joined by spaces, from its owner's text."""
    asked = found.select("owner", "owner_check", "owner_start", "n_words").distinct().groupBy("owner").agg(F.collect_list(F.struct("owner_check", "owner_start", "n_words")).alias("asked"))
    names, kinds = ["owner", "owner_check", "owner_start", "n_words", "passage"], [pa.int64(), *[pa.int32()] * 3, pa.binary()]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            rows, held = [], 0
            for i, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = text.as_py()
                own, check = words(text), check_bits(text)
                for a in asked.as_py():
                    if a["owner_check"] == check:
                        rows.append((i, check, a["owner_start"], a["n_words"], b" ".join(own[a["owner_start"] : a["owner_start"] + a["n_words"]])))
                        held += len(rows[-1][-1])
                        if held > 4_000_000:
                            yield as_batch(rows)
                            rows, held = [], 0
            if rows:
                yield as_batch(rows)

    own = docs.join(asked, docs["id"] == asked["owner"]).select("id", "text", "asked")
    # rows of one id and one text give a passage more than once
    return own.mapInArrow(cut, "owner long, owner_check int, owner_start int, n_words int, passage binary").dropDuplicates(names[:4])


def confirmed(own: list[bytes], start: int, passage: bytes, size: int) -> Iterator[tuple[int, int]]:
    """(start, words) of what agrees, word by word, between a document from ``start`` on and a passage: maximal stretches of ``size`` words or more."""
    other = passage.split(b" ")
    mine = own[start : start + len(other)]
    if mine == other:
        yield start, len(other)
        return
    begun = None
    for i, same in enumerate([*(a == b for a, b in zip(mine, other)), False]):
        if same and begun is None:
            begun = i
        elif not same and begun is not None:
            if i - begun >= size:
                yield start + begun, i - begun
            begun = None


def _with_passages(docs: DataFrame, size: int) -> DataFrame:
    """docs (id, text) with ``found``: the passages that other documents own of it; null where there are none."""
    found = matches(docs, size)
    # a written side leaves the join two shuffles, of which Spark splits what is hot: a passage may be a third of all rows
    fetched = found.join(materialised(passages(docs, found), "passages"), ["owner", "owner_check", "owner_start", "n_words"])
    grouped = fetched.groupBy("id").agg(F.collect_list(F.struct("check", "start", "owner", "owner_start", "passage")).alias("found"))
    return docs.join(grouped, "id", "left").select("id", "text", "found")


def _stretches(text: str | None, own: list[bytes], found: list[dict] | None, size: int) -> list[tuple[int, int, int, int]]:
    """(start, words, owner, owner_start) of a document's confirmed repeats, in order."""
    if not found:
        return []
    check = check_bits(text)
    return sorted((at, n, f["owner"], f["owner_start"] + at - f["start"]) for f in found if f["check"] == check for at, n in confirmed(own, f["start"], f["passage"], size))


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    require(docs, (id_col, text_col))
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def repeats(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_words, owner, owner_start): maximal repeats of ``size`` words or more that a document shares with one of a smaller id.

    Each window counts with the least id that has it, so neighbouring repeats may have different owners; they may overlap.
    Nulls, short texts, repeated and null ids as in ``remove_repeats``.
    """
    own = _own(docs, id_col, text_col).filter(F.col("id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            rows = []
            for i, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = text.as_py()
                rows += [(i, *s) for s in _stretches(text, words(text), found.as_py(), size)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["id", "start", "n_words", "owner", "owner_start"])

    return _with_passages(own, size).filter("found is not null").mapInArrow(run, "id long, start long, n_words long, owner long, owner_start long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept): every document's words without those covered by a window of ``size`` words whose words also start in a document with a smaller id.

    Null and empty texts have no words; texts of fewer words than a window lose none; windows are judged on the input. Rows
    with one id are documents of which neither is smaller; rows with a null id lose nothing and make no other
    row lose anything. An empty table gives no rows; other columns are ignored. kept is binary UTF-8.
    """
    own = _own(docs, id_col, text_col)
    judged = _with_passages(own.filter(F.col("id").isNotNull()), size)
    rest = own.filter(F.col("id").isNull()).withColumn("found", F.lit(None).cast(judged.schema["found"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            rows = []
            for text, found in zip(batch.column(1), batch.column(2)):
                text = text.as_py()
                split = words(text)
                covered = np.zeros(len(split) + 1, np.int64)
                for at, n, *_ in _stretches(text, split, found.as_py(), size):
                    covered[at] += 1
                    covered[at + n] -= 1
                gone = np.cumsum(covered[:-1]) > 0
                kept = [w for w, g in zip(split, gone.tolist()) if not g] if gone.any() else split
                rows.append((len(split), len(split) - len(kept), b" ".join(kept)))
            n, removed, kept = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_words", "n_removed", "kept"])

    return judged.unionByName(rest).mapInArrow(run, "id long, n_words long, n_removed long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
