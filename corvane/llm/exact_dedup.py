"""Exact duplicates over a cuckoo-filter index of live digests.

The index holds, per bucket of the digest space, the live keys (SHA-256 of the normalised text, its byte
length, the id that stays and the group's size) and a cuckoo filter over them. The filter answers most
"not seen" questions from two cache lines; each of its hits is verified against the bucket's stored
keys, deletions take live digests out of both, and a filter that overflows is rebuilt at twice the
size from the stored keys.

Rows are aggregated by digest before the shuffle, so a group of copies reaches its bucket as one row
per batch, and only ids and digests are joined back (a skewed join that Spark splits), never texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialised, only_rows, released, require


#: Rows given to one bucket of the index, on average and at most.
BUCKET_ROWS = 500_000


def bucket_count(rows: DataFrame) -> int:
    """So many buckets that each gets about ``BUCKET_ROWS`` rows at most, and as many as there are shuffle partitions at least. rows: stored, so that counting reads footers."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))


class CuckooFilter:
    """A set of 64-bit keys with insertion and deletion: 16-bit tags, four to a bucket, two buckets a key."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 1024):
        self.buckets = 1 << max(1, (int(capacity / (self.SLOTS * 0.9)) - 1).bit_length())
        self.tags = np.zeros((self.buckets, self.SLOTS), np.uint16)
        self.count = 0
        self._next = 12345

    def _places(self, key: int) -> tuple[int, int, int]:
        tag = (key >> 48) & 0xFFFF or 1
        first = key & (self.buckets - 1)
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * 0x5BD1E995) & (self.buckets - 1))

    def _put(self, bucket: int, tag: int) -> bool:
        free = np.flatnonzero(self.tags[bucket] == 0)
        if len(free):
            self.tags[bucket, free[0]] = tag
        return bool(len(free))

    def __contains__(self, key: int) -> bool:
        tag, first, second = self._places(key)
        return bool((self.tags[first] == tag).any() or (self.tags[second] == tag).any())

    def insert(self, key: int) -> bool:
        """False if no place was found; the filter then has lost a tag and must be rebuilt from stored keys."""
        tag, first, second = self._places(key)
        if self._put(first, tag) or self._put(second, tag):
            self.count += 1
            return True
        bucket = second
        for _ in range(self.KICKS):
            self._next = (self._next * 1103515245 + 12345) & 0x7FFFFFFF
            slot = (self._next >> 16) % self.SLOTS
            tag, self.tags[bucket, slot] = int(self.tags[bucket, slot]), tag
            bucket = self._other(bucket, tag)
            if self._put(bucket, tag):
                self.count += 1
                return True
        return False

    def delete(self, key: int) -> bool:
        """Takes out a key that was inserted; a key that never was must not be deleted."""
        tag, first, second = self._places(key)
        for bucket in (first, second):
            held = np.flatnonzero(self.tags[bucket] == tag)
            if len(held):
                self.tags[bucket, held[0]] = 0
                self.count -= 1
                return True
        return False


class DigestIndex:
    """One bucket of the index: live digests with the id that stays and the number of rows, behind a cuckoo filter."""

    def __init__(self, capacity: int = 1024):
        self.filter = CuckooFilter(capacity)
        self.live: dict[bytes, list] = {}
        self.resizes = 0
        self.verified = 0
        self.false_hits = 0

    @staticmethod
    def _key(digest: bytes) -> int:
        return int.from_bytes(digest[-8:], "little")

    def find(self, digest: bytes) -> list | None:
        """The live entry of a digest: a filter hit counts only once the stored digest agrees in full."""
        if self._key(digest) not in self.filter:
            return None
        entry = self.live.get(digest)
        self.verified += entry is not None
        self.false_hits += entry is None
        return entry

    def insert(self, digest: bytes, keep: int | None, rows: int = 1) -> bool:
        """True if the digest is new; else its group grows and the larger id stays."""
        entry = self.find(digest)
        if entry is not None:
            entry[0] = keep if entry[0] is None else entry[0] if keep is None else max(entry[0], keep)
            entry[1] += rows
            return False
        self.live[digest] = [keep, rows]
        if not self.filter.insert(self._key(digest)):
            self.resize()
        return True

    def delete(self, digest: bytes) -> bool:
        """Takes a live digest out of the filter and the store; False if it isn't live."""
        if self.find(digest) is None:
            return False
        self.filter.delete(self._key(digest))
        del self.live[digest]
        return True

    def resize(self) -> None:
        """Rebuilds the filter from the stored keys at twice the size, until all fit."""
        slots = self.filter.buckets * CuckooFilter.SLOTS
        while True:
            slots *= 2
            self.resizes += 1
            self.filter = CuckooFilter(slots)
            if all(self.filter.insert(self._key(d)) for d in self.live):
                return


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): the binary SHA-256 of each text with A-Z lower-cased, null as empty."""
    require(docs, (id_col, text_col))
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def build_index(own: DataFrame, buckets: int | None = None) -> DataFrame:
    """(digest, keep_id, group_size): the live entries after inserting every row of ``own`` (id, digest).

    Rows are first combined by digest, batch by batch, where they are read; what a bucket receives is at
    most one row per digest and batch. There are as many buckets as the rows need (``bucket_count``); a bucket's
    filter starts small and grows with what it is given.
    """
    n = buckets or bucket_count(own)

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in released(batches):
            yield part.assign(id=part["id"].astype("Int64")).groupby("digest", as_index=False, sort=False).agg(keep_id=("id", "max"), group_size=("digest", "size"))

    partial = own.mapInPandas(combine, "digest binary, keep_id long, group_size long")

    def insert_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = DigestIndex()
        for part in released(batches):
            for digest, keep, rows in zip(part["digest"], part["keep_id"], part["group_size"]):
                index.insert(bytes(digest), None if pd.isna(keep) else int(keep), int(rows))
        live = list(index.live.items())
        for at in range(0, len(live), 10_000):
            some = live[at : at + 10_000]
            yield pd.DataFrame({"digest": [d for d, _ in some], "keep_id": pd.array([e[0] for _, e in some], dtype="Int64"), "group_size": [e[1] for _, e in some]})

    return partial.repartition(n, "digest").mapInPandas(insert_all, "digest binary, keep_id long, group_size long")


def remove(index: DataFrame, dead: DataFrame, buckets: int | None = None) -> DataFrame:
    """The index without the digests of ``dead`` (digest): each bucket deletes them from its filter and store."""
    n = buckets or bucket_count(index)
    both = index.select("digest", "keep_id", "group_size", F.lit(False).alias("gone")).unionByName(
        dead.select("digest").distinct().select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("gone"))
    )

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live = DigestIndex()
        for part in batches:  # insertions come before deletions: the partition is sorted by gone
            for digest, keep, rows, gone in zip(part["digest"], part["keep_id"], part["group_size"], part["gone"]):
                if gone:
                    live.delete(bytes(digest))
                else:
                    live.insert(bytes(digest), None if pd.isna(keep) else int(keep), int(rows))
        kept: Iterable = list(live.live.items())
        yield pd.DataFrame({"digest": [d for d, _ in kept], "keep_id": pd.array([e[0] for _, e in kept], dtype="Int64"), "group_size": pd.array([e[1] for _, e in kept], dtype="int64")})

    return both.repartition(n, "digest").sortWithinPartitions("gone").mapInPandas(apply, "digest binary, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) per row of docs: of equal normalised texts the largest id stays.

    Null counts as the empty text; null ids never stay while their group has another id. Repeated
    (id, text) rows count in group_size and are all marked kept if their id is the largest. An empty table
    gives no rows; other columns are ignored.
    """
    own = materialised(digests(docs, id_col, text_col), "digests")
    index = build_index(own)
    joined = own.join(index.withColumnRenamed("digest", "known"), F.col("digest") == F.col("known"))
    return joined.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, that with the largest doc_id; all columns kept, and all rows without a doc_id.

    Null and empty texts are equal. Of repeated rows (one id, one text) any one stays. An empty table gives no rows.
    """
    digest = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)
    return only_rows(docs, exact_duplicates(docs.select("doc_id", "text")).filter("kept and id is not null").select("id", "text_sha256"), digest)
