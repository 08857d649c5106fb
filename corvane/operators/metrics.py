"""Answer metrics by their papers: BLEU (Papineni 2002, smoothing of Chen & Cherry 2014), ROUGE-L (Lin 2004), BERTScore (Zhang 2020).

Each is one Arrow-batched pass over pairs of texts. Tokens of BLEU are lower-cased words and single signs; ROUGE-L takes runs of
ASCII letters and digits, stemmed when longer than three. BERTScore's token vectors are a plug-in; the default hashes
character trigrams and is no language model.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corvane.functions.porter import stem
from corvane.functions.text import word_tokens
from corvane.operators.common import small_batches

ORDER, SMOOTHING_K, DIMENSIONS = 4, 5, 64
#: Pairs of texts in one Arrow batch: their words are Python objects.
BATCH = 500
#: Distinct words of one side whose cosines are held at a time.
ROWS = 1024


def bleu_score(reference: list[str], candidate: list[str]) -> float:
    """Sentence BLEU up to 4-grams. An order without matches counts as 1 / (2**i * 5 / ln(length)), i counting such orders."""
    if not reference or not candidate:
        return 0.0
    logs, empty = 0.0, 0
    for n in range(1, ORDER + 1):
        own = Counter(zip(*(candidate[i:] for i in range(n))))
        known = Counter(zip(*(reference[i:] for i in range(n))))
        total, hits = max(1, sum(own.values())), float(sum(min(c, known[g]) for g, c in own.items()))
        if not hits:
            if n == 1:
                return 0.0
            if len(candidate) > 1:
                empty += 1
                hits = math.log(len(candidate)) / (2**empty * SMOOTHING_K)
        if hits:
            logs += math.log(hits / total) / ORDER
    return min(1.0, math.exp(1 - len(reference) / len(candidate))) * math.exp(logs)


@lru_cache(maxsize=20_000)
def _stemmed(word: str) -> str:
    return stem(word) if len(word) > 3 else word


def rouge_tokens(text: str | None, stemmed: bool = True) -> list[str]:
    found = re.findall(r"[a-z0-9]+", (text or "").lower())
    return [_stemmed(w) for w in found] if stemmed else found


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit per word of a."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l_score(reference: str | None, candidate: str | None, stemmed: bool = True) -> float:
    a, b = rouge_tokens(reference, stemmed), rouge_tokens(candidate, stemmed)
    n = common_length(a, b)
    return 2 * n / (len(a) + len(b)) if n else 0.0


@lru_cache(maxsize=20_000)
def hashed_vector(word: str) -> np.ndarray:
    """Unit vector of a word's hashed character trigrams."""
    v, padded = np.zeros(DIMENSIONS), f"<{word}>"
    for i in range(len(padded) - 2):
        h = int(hashlib.md5(padded[i : i + 3].encode()).hexdigest()[:8], 16)
        v[h % DIMENSIONS] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def bertscore_f1_score(reference: str | None, candidate: str | None, vector: Callable[[str], np.ndarray] = hashed_vector) -> float:
    """F1 of greedy best cosines both ways."""
    a, b = rouge_tokens(reference, False), rouge_tokens(candidate, False)
    if not a or not b:
        return 0.0
    left, right = (np.stack([vector(w) for w in dict.fromkeys(x)]) for x in (a, b))
    parts = [(c.max(axis=1), c.max(axis=0)) for at in range(0, len(left), ROWS) for c in (left[at : at + ROWS] @ right.T,)]  # of distinct words; each counts as often as it occurs
    weight = lambda words: np.array(list(Counter(words).values()), float)
    recall = float(weight(a) @ np.concatenate([x for x, _ in parts])) / len(a)
    precision = float(weight(b) @ np.max([y for _, y in parts], axis=0)) / len(b)
    return 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0


def _score(kind: Callable, reference: Column, candidate: Column) -> Column:
    small_batches(SparkSession.active(), BATCH)

    @F.pandas_udf("double")
    def of(refs: pd.Series, cands: pd.Series) -> pd.Series:
        return pd.Series([kind(a, b) for a, b in zip(refs, cands)], dtype="float64")

    return of(reference, candidate)


def bleu(reference: Column, candidate: Column) -> Column:
    return _score(lambda a, b: bleu_score(list(a), list(b)), word_tokens(reference), word_tokens(candidate))


def rouge_l(reference: Column, candidate: Column, stemmed: bool = True) -> Column:
    return _score(lambda a, b: rouge_l_score(a, b, stemmed), reference, candidate)


def bertscore_f1(reference: Column, candidate: Column, vector: Callable[[str], np.ndarray] = hashed_vector) -> Column:
    return _score(lambda a, b: bertscore_f1_score(a, b, vector), reference, candidate)
