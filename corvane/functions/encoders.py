"""Plug-in points for the two encoders of texts, and defaults that need no model: neither is a neural network."""

from __future__ import annotations

import hashlib
import logging
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 384
#: texts -> one row of numbers a text
DenseEncoder = Callable[[list[str]], np.ndarray]
#: text -> weight by term
SparseEncoder = Callable[[str], dict[str, float]]
LOG = logging.getLogger("corvane.encoders")


@lru_cache(maxsize=200_000)
def _places(word: str) -> tuple[np.ndarray, np.ndarray]:
    grams = [f"<{word}>"[i : i + 3] for i in range(len(word))] + [f"={word}"]
    hashes = np.array([int(hashlib.md5(g.encode()).hexdigest()[:8], 16) for g in grams], np.int64)
    return hashes % DIMENSIONS, np.where(hashes >> 16 & 1, 1.0, -1.0)


def hashed_dense(texts: list[str]) -> np.ndarray:
    """Unit vectors of texts: signed hashes of their words and the words' trigrams, each word by the logarithm of its count."""
    out = np.zeros((len(texts), DIMENSIONS))
    for row, text in zip(out, texts):
        for word, n in Counter(text.split()).items():
            at, sign = _places(word)
            np.add.at(row, at, sign * np.log1p(n))
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def dense_vectors(text: Column, encoder: DenseEncoder) -> Column:
    """array<float> of each text, null as empty; what the encoder raises fails the job."""

    @F.pandas_udf("array<float>")
    def of(texts: pd.Series) -> pd.Series:
        found = np.asarray(encoder(list(texts.fillna(""))), np.float32)
        if len(found) != len(texts):
            raise ValueError("the encoder gave another number of vectors than texts")
        return pd.Series(list(found))

    return of(text)


def sparse_vectors(text: Column, encoder: SparseEncoder) -> Column:
    """map<string, float> of each text; a text that the encoder fails on, or gives nothing for, has an empty one."""

    @F.pandas_udf("map<string, float>")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts.fillna(""):
            try:
                out.append({str(k): float(w) for k, w in encoder(t).items() if w})
            except Exception as e:  # whatever a plug-in raises is that text's failure alone
                LOG.warning("a text has no sparse vector: %s", e)
                out.append({})
        return pd.Series(out)

    return of(text)
