"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector is the product (binding) of its letters' vectors, each
rotated (permuted) by its place; a text's vector is the sum (bundle) of its n-grams' vectors, and so is a
language's prototype over its training texts. A text is given the language whose prototype has the
largest cosine with its vector.

Every letter of any script has a vector of its own, drawn when it is first met from its code point alone, and everything that
isn't a letter is one gap symbol. A text is first counted by trigram, and only the distinct ones are bound and bundled.

Prototypes are fitted on a bounded, hash-chosen sample of the training rows (``sample_rows``); what reaches the
driver is one vector for each language and fitting task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, small_batches

GRAM, DIMENSIONS, SEED = 3, 1024, 20
SAMPLE_ROWS, FIT_TASKS, MAX_LANGUAGES = 20_000, 16, 1000
UNKNOWN = "und"

_ALPHABET: list[np.ndarray] = []


def alphabet() -> np.ndarray:
    """The letter of every code point, in lower case; 0 for what is no letter."""
    if not _ALPHABET:
        out = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                out[c] = ord(s.lower()[0])
        _ALPHABET.append(out)
    return _ALPHABET[0]


class Letters:
    """Random vectors of +1 and -1 of the letters met so far, row by row; the gap symbol is the first."""

    def __init__(self, seed: int = SEED):
        self.seed, self.rows, self.used = seed, np.full(0x110000, -1, np.int32), 0
        self.tables = np.empty((GRAM, 64, DIMENSIONS), np.int8)  # rotated by place
        self.of(np.zeros(1, np.int64))

    def of(self, letters: np.ndarray) -> np.ndarray:
        """The rows of letters."""
        rows = self.rows[letters]
        if (rows < 0).any():
            for c in np.unique(letters[rows < 0]).tolist():
                if self.used == self.tables.shape[1]:
                    self.tables = np.concatenate([self.tables, np.empty_like(self.tables)], axis=1)
                own = np.random.default_rng((self.seed, c)).choice(np.array([-1, 1], np.int8), size=DIMENSIONS)
                self.tables[:, self.used] = [np.roll(own, GRAM - 1 - place) for place in range(GRAM)]
                self.rows[c], self.used = self.used, self.used + 1
            rows = self.rows[letters]
        return rows

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of trigrams: the product of their letters' vectors, each rotated by its place."""
        first, second, third = (self.of(codes >> shift & 0x1FFFFF) for shift in (42, 21, 0))
        return self.tables[0, first] * self.tables[1, second] * self.tables[2, third]


_LETTERS: dict[int, Letters] = {}


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text (runs of gap symbols count as one, trigrams around a gap only are left out), and how often each occurs."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    inner = np.concatenate([[0], alphabet()[points], [0]])
    inner = inner[np.concatenate([[True], (inner[1:] != 0) | (inner[:-1] != 0)])]
    if len(inner) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique((inner[:-2] << 42) | (inner[1:-1] << 21) | inner[2:], return_counts=True)


def vector(text: str | None, seed: int = SEED) -> np.ndarray | None:
    """The bundle of a text's trigrams; None for a text without letters."""
    codes, counts = trigrams(text)
    if not len(codes):
        return None
    if seed not in _LETTERS:
        _LETTERS[seed] = Letters(seed)
    out = np.zeros(DIMENSIONS, np.float32)
    for at in range(0, len(codes), 4096):
        out += counts[at : at + 4096].astype(np.float32) @ _LETTERS[seed].bound(codes[at : at + 4096]).astype(np.float32)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    n = float(np.sqrt(np.square(v, dtype=np.float64).sum()))
    return (v / n).astype(np.float32) if n else v.astype(np.float32)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their unit prototypes. labelled: rows with a non-null language; all of them if at most ``sample_rows``, else about so many by a hash of ``id_col``.

    Each text counts with unit length, so that long texts don't outweigh the others. More than
    ``MAX_LANGUAGES`` languages are refused.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    total = rows.count()
    if total > sample_rows:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / total))

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for part in batches:
            for text, lang in zip(part["text"], part["lang"]):
                v = vector(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + unit(v)
        if len(sums) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": [lang], "v": [v.astype(np.float32).tolist()]})

    parts = rows.drop("id").repartition(FIT_TASKS).mapInPandas(bundle, "lang string, v array<float>").collect()
    known = sorted({r["lang"] for r in parts})
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sums = {lang: np.zeros(DIMENSIONS, np.float64) for lang in known}
    for r in sorted(parts, key=lambda r: (r["lang"], tuple(r["v"][:4]))):  # a fixed order of summation
        sums[r["lang"]] += np.array(r["v"], np.float64)
    return known, np.array([unit(sums[lang]) for lang in known], np.float32).reshape(len(known), DIMENSIONS)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score: the nearest prototype's language and its cosine, cut to 0..1; `und` and 0 for null texts and those without letters.

    Equal cosines go to the language that sorts first; without any languages all is `und`. Texts of any length are read whole;
    repeated rows stay. A kept column named lang_pred or score is left out.
    """
    require(docs, (*keep, text_col))
    keep = tuple(c for c in keep if c.lower() not in ("lang_pred", "score"))
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((languages, prototypes))

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        names, table = model.value
        best, scores = [], []
        for text in texts:
            v = vector(text) if names else None
            if v is None:
                best.append(UNKNOWN)
                scores.append(0.0)
                continue
            cosines = table @ unit(v)
            k = int(cosines.argmax())
            best.append(names[k])
            scores.append(min(1.0, max(0.0, float(cosines[k]))))
        return pd.DataFrame({"lang_pred": best, "score": scores})

    return docs.select(*keep, of(F.col(text_col).cast("string")).alias("__p")).select(*keep, "__p.lang_pred", "__p.score")


def held_out(id_column: Column) -> Column:
    """Whether a row belongs to the fold that models never learn from: crc32 of the id as text, mod 4, is 2; a null id does not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document: fitted on the rows that aren't held out, text and lang alone. Extra columns are ignored; an empty table gives no rows."""
    require(docs, ("doc_id", "text", "lang"))
    flagged = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    languages, prototypes = fit(flagged.filter(~F.col("held_out")))
    return predict(flagged, languages, prototypes, keep=("doc_id", "held_out"))
