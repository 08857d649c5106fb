"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance d meet at a third one halfway. Emitting whole 64-bit balls of radius 2 would
cost 2,081 variants a fingerprint, so the word is first cut into three blocks: of three or fewer differing
bits, at least one falls into the block where most differ, hence some two blocks hold at most two of them.
For each pair of kept blocks a fingerprint emits itself and every one-bit variant of the kept bits (half
the radius of two): 131 variants in all. Fingerprints that link share a variant, whichever it is.
Variants are shuffled, colliding pairs are verified on all 64 bits, and each pair is reported from one
canonical variant only, so no pair needs deduplicating after the shuffle.

Only distinct fingerprints are hashed: a group of copies, of whatever size, is one row here. A bucket of
variants is streamed in sorted order; its members are compared by shifted array comparisons, and what
leaves a bucket are the links alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialised, only_rows, released, require, small_batches

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Bits of each block; a key keeps two of the three.
BLOCKS = ((0, 22), (22, 21), (43, 21))
MASKS = tuple(sum(((1 << n) - 1) << at for i, (at, n) in enumerate(BLOCKS) if i != drop) for drop in range(3))
FULL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, as an unsigned int; null and blank texts give zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp) and the ``keep`` columns: fp the fingerprint as a signed long."""
    require(docs, (id_col, text_col))
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in released(batches):
            yield pd.Series([signed(fingerprint(t)) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"), *keep)


def variants(fps: DataFrame) -> DataFrame:
    """(key, drop, fp) for every distinct fingerprint: the kept bits and their one-bit variants, for each dropped block."""
    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [np.array([0, *(1 << b for b in range(64) if mask >> b & 1)], np.uint64) for mask in MASKS]
        for batch in released(batches):
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fp), 2000):
                part = fp[at : at + 2000]
                for drop, mask in enumerate(MASKS):
                    keys = ((part & np.uint64(mask))[:, None] ^ flips[drop][None, :]).ravel()
                    # the dropped block's bits are free: they carry the number of the drop
                    keys |= np.uint64((1 if drop != 1 else 2) << BLOCKS[drop][0]) if drop else np.uint64(0)
                    yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.repeat(part, len(flips[drop])).view(np.int64))], names=["key", "fp"])

    return fps.mapInArrow(balls, "key long, fp long")


def _canonical(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one key under which the pair (a, b) is reported: first drop that leaves two bits or fewer, the halfway variant."""
    diff = a ^ b
    key, known = np.zeros_like(a), np.zeros(len(a), bool)
    for drop, mask in enumerate(MASKS):
        kept = diff & np.uint64(mask)
        lowest = kept & (~kept + np.uint64(1))
        rest = kept & ~lowest
        two = rest & (~rest + np.uint64(1))
        fits = (rest == two) & ~known
        k = (a & np.uint64(mask)) ^ lowest
        if drop:
            k |= np.uint64((1 if drop != 1 else 2) << BLOCKS[drop][0])
        key[fits] = k[fits]
        known |= fits
    return key, known


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): every pair of distinct fingerprints at ``radius`` or fewer differing bits, once. fps: one column, distinct."""
    if not 0 < radius <= RADIUS:
        raise ValueError("the variants cover 1 to 3 differing bits")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps_ = np.empty(0, np.uint64), np.empty(0, np.uint64)

        def pairs(keys: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            runs = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
            longest = int(np.diff(np.r_[runs, len(keys)]).max(initial=0))
            live = np.arange(len(keys))
            for shift in range(1, longest):
                live = live[live + shift < len(keys)]
                live = live[keys[live] == keys[live + shift]]
                a, b = fp[live], fp[live + shift]
                near = np.bitwise_count(a ^ b) <= radius
                a, b, at = a[near], b[near], keys[live][near]
                key, known = _canonical(a, b)
                own = known & (key == at) & (a != b)
                if own.any():
                    yield pa.record_batch([pa.array(a[own].view(np.int64)), pa.array(b[own].view(np.int64))], names=["a", "b"])

        for batch in released(batches):
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            fps_ = np.concatenate([fps_, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            ends = np.flatnonzero(keys[1:] != keys[:-1])
            if len(ends):  # the last bucket may go on in the next batch
                cut = ends[-1] + 1
                yield from pairs(keys[:cut], fps_[:cut])
                keys, fps_ = keys[cut:], fps_[cut:]
        yield from pairs(keys, fps_)

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return variants(fps).repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(meet, "a long, b long")


def components(docs: DataFrame, id_col: str, text_col: str, radius: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, root, component_id) and the ``keep`` columns per row of docs: root is the component's least fingerprint."""
    own = materialised(fingerprints(docs, id_col, text_col, keep), "simhash")
    groups = materialised(own.groupBy("fp").agg(F.min("id").alias("least")), "simhash-groups")
    roots = connected_components(links(groups.select("fp"))).withColumnsRenamed({"node": "fp"})
    rooted = groups.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) per row of docs: 16 hex digits, and the smallest id reachable over links.

    A null, empty or blank text has fingerprint zero and links like any other; rows with equal texts
    share one fingerprint; repeated ids keep their rows; a null id stays null and names no component
    unless its component has no other id. An empty table gives no rows. Other columns are ignored.
    """
    return components(docs, id_col, text_col, radius).select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """docs without the near-duplicates of an earlier row: of each component one row with the smallest doc_id stays, all its columns kept, and all rows without a doc_id.

    Null, empty and blank texts are near each other. Of rows with the smallest doc_id and different texts that with the least
    digest stays, of repeated rows any one. An empty table gives no rows.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    rows = components(docs.select("doc_id", "text", digest.alias("digest")), "doc_id", "text", RADIUS, ("digest",))
    kept = rows.filter("id = component_id").groupBy("root").agg(F.min(F.struct("id", "digest")).alias("row"))
    return only_rows(docs, kept.select("row.id", "row.digest"), digest)
