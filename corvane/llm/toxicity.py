"""Toxicity: a bidirectional gated recurrent network with attention pooling over characters and words, trained in numpy.

Each distinct word is read by a small bidirectional GRU over its characters, pooled by attention. That, a learned word vector
(one shared by all words rare in training) and the word's evidence are its input to a second bidirectional GRU
over a window of words, again pooled by attention and mapped to one logit. A text is cut into overlapping
windows that cover all of it; its score is the calibrated maximum over all its windows.

Evidence is counted over the training texts: in how many toxic and how many clean ones a word occurs, and in how many a word that
begins with its first three to eight letters; what counts is the strongest of these shares, drawn towards the share of toxic
texts by ``DRAWN`` texts' worth. While the network trains, a text's own share in the counts is left out, so that it
sees of its own words what it will see of a new text's. This is how few labels of a language go far.

The network learns from a bounded sample of labelled rows (``SAMPLE_ROWS`` rows by hash of the id) with every window of each;
scoring reads every window of every text. Labels of texts stand in for those of windows: batches draw, of each toxic text, windows
by their evidence, and later those that the network itself suspects most; of clean texts, any window
and those that it suspects. Platt scaling on a quarter of the texts, of which nothing is learnt before, sets the scale, from
the maximum over all their windows as in scoring. Texts are drawn alike, whatever their number of windows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import taken
from .common import released, require, small_batches
from .language_id import held_out

WINDOW, STRIDE = 64, 48
SAMPLE_ROWS = 8_000
WORD_VECTORS, LEAST_WINDOWS, LONGEST_WORD = 4000, 12, 11
#: Letters of a word's beginnings that are counted, the weight of the general share, evidence below which a beginning is forgotten, and the size of the features.
BEGINNINGS, DRAWN, LEAST_EVIDENCE, FEATURES = range(3, 9), 3.0, 0.3, 2
D_WORD, D_CHAR, H_CHAR, H_WORD, CHARS = 8, 8, 8, 8, 72
BATCH, STEPS, RATE, SEED = 64, 500, 0.01, 7
THRESHOLD = 0.3
#: Rows of the table of word inputs kept in a worker.
TABLE_ROWS = 100_000

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of word characters, in pieces of 11 characters at most."""
    found = _WORD.findall((text or "").lower())
    if any(len(w) > LONGEST_WORD for w in found):
        found = [w[i : i + LONGEST_WORD] for w in found for i in range(0, len(w), LONGEST_WORD)]
    return found


def window_starts(n: int) -> list[int]:
    """Starts of the windows that cover n words, each sharing words with the next."""
    return list(range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)) if n else []


def spell(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of words (a row a word) and their mask."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    longest = int(lengths.max(initial=1))  # behind class 0, which marks the start of a word
    points = np.frombuffer("".join(tokens).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    inside = np.arange(longest) < lengths[:, None]
    out = np.zeros(inside.shape, np.int64)
    out[inside] = np.where((points >= 97) & (points <= 122), points - 96, np.where((points >= 48) & (points <= 57), points - 48 + 27, 37 + points % (CHARS - 37)))
    return np.pad(out, ((0, 0), (1, 0))), np.pad(inside.astype(np.float32), ((0, 0), (1, 0)), constant_values=1)


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


# --- the network: parameters are a dict of arrays; index 0 of an axis of two is the forward direction -----------------


def initial(n_words: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    d = D_WORD + 2 * H_CHAR
    return {
        "chars": normal(CHARS, D_CHAR, scale=0.5), "cw": normal(2, D_CHAR, 3 * H_CHAR, scale=D_CHAR**-0.5), "cb": np.zeros((2, 1, 3 * H_CHAR), np.float32), "cu": normal(2, H_CHAR, 3 * H_CHAR, scale=H_CHAR**-0.5), "ca": normal(2 * H_CHAR, scale=0.3),
        "ws": normal(2, FEATURES, 3 * H_WORD, scale=0.5), "words": normal(n_words + 1, D_WORD, scale=0.3), "ww": normal(2, d, 3 * H_WORD, scale=d**-0.5), "wb": np.zeros((2, 1, 3 * H_WORD), np.float32), "wu": normal(2, H_WORD, 3 * H_WORD, scale=H_WORD**-0.5), "wa": normal(2 * H_WORD, scale=0.3),
        "out": normal(2 * H_WORD, scale=0.3), "bias": np.full(1, -1.0, np.float32),
    }


def gru(x, u, mask):
    """x: (2, T, N, 3H) input projections, each direction in its own order of time; mask: (2, T, N, 1). States (2, T+1, N, H) and what the gradient needs."""
    _, steps, n, h3 = x.shape
    h = h3 // 3
    states = np.zeros((2, steps + 1, n, h), np.float32)
    saved = []
    for t in range(steps):
        last = states[:, t]
        rec = last @ u
        zr = sigmoid(x[:, t, :, : 2 * h] + rec[:, :, : 2 * h])
        z, r = zr[:, :, :h], zr[:, :, h:]
        new = np.tanh(x[:, t, :, 2 * h :] + r * rec[:, :, 2 * h :])
        m = mask[:, t]
        states[:, t + 1] = last + m * (1 - z) * (new - last)
        saved.append((z, r, new, rec[:, :, 2 * h :]))
    return states, saved


def gru_back(d_states, states, saved, u, mask):
    """Gradients for x and u, given those for each state."""
    steps, h = len(saved), u.shape[1]
    dx = np.empty((2, steps, states.shape[2], 3 * h), np.float32)
    du, carry = np.zeros_like(u), np.zeros_like(states[:, 0])
    u_back = u.transpose(0, 2, 1)
    for t in reversed(range(steps)):
        z, r, new, rec = saved[t]
        last, m = states[:, t], mask[:, t]
        d = carry + d_states[:, t]
        dm = d * m
        d_new = dm * (1 - z) * (1 - new * new)
        dz = dm * (last - new) * z * (1 - z)
        dr = d_new * rec * r * (1 - r)
        dx[:, t] = np.concatenate([dz, dr, d_new], axis=2)
        d_rec = np.concatenate([dz, dr, d_new * r], axis=2)
        du += last.transpose(0, 2, 1) @ d_rec
        carry = d * (1 - m) + dm * z + d_rec @ u_back
    return dx, du


def both_ways(a):
    """(T, N, ...) as (2, T, N, ...): as it is, and reversed in time."""
    return np.stack([a, a[::-1]])


def pooled(states, attention, mask):
    """Attention-weighted sum of both directions' states; also the states side by side and the weights."""
    side = np.concatenate([states[0, 1:], states[1, 1:][::-1]], axis=2)
    scores = np.where(mask > 0, side @ attention, -1e9)
    weights = np.exp(scores - scores.max(axis=0)) * (mask > 0)
    weights /= np.maximum(weights.sum(axis=0), 1e-9)
    return (weights[:, :, None] * side).sum(axis=0), side, weights


def pooled_back(d_pool, side, weights, attention):
    """Gradients for the states (2, T, N, H) and the attention vector."""
    d_weights = (side * d_pool[None]).sum(axis=2)
    d_scores = weights * (d_weights - (weights * d_weights).sum(axis=0))
    d_side = weights[:, :, None] * d_pool[None] + d_scores[:, :, None] * attention
    h = side.shape[2] // 2
    return np.stack([d_side[:, :, :h], d_side[::-1, :, h:]]), (d_scores[:, :, None] * side).sum(axis=(0, 1))


def gathered_back(index, d, n):
    """Sums of the rows of d (K, ...) by index (K,): the gradient of a gather from n rows."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    out = np.zeros((n, *d.shape[1:]), np.float32)
    if len(first):
        out[ordered[first]] = np.add.reduceat(d[order], first, axis=0)
    return out


def read_chars(p, chars, mask):
    x = (p["chars"] @ p["cw"] + p["cb"])[:, chars.T]  # (2, L, N, 3H)
    x[1] = x[1][::-1]
    m = both_ways(mask.T[:, :, None])
    states, saved = gru(x, p["cu"], m)
    pool, side, weights = pooled(states, p["ca"], mask.T)
    return pool, (m, states, saved, side, weights)


def word_inputs(p, ids, chars, mask):
    """(2, N, 3H) projections of words, from their vectors and characters."""
    pool, kept = read_chars(p, chars, mask)
    joined = np.concatenate([p["words"][ids], pool], axis=1)
    return joined @ p["ww"] + p["wb"], joined, kept


def loss_and_gradient(p, index, mask, ids, chars, char_mask, labels, evidence):
    """index: (N, T) rows of the distinct words; ids, chars, char_mask: the distinct words; labels: (N,); evidence: (N, T, FEATURES)."""
    table, joined, (cm, c_states, c_saved, c_side, c_weights) = word_inputs(p, ids, chars, char_mask)
    shown = evidence.transpose(1, 0, 2)
    x = table[:, index.T] + np.stack([shown @ u for u in p["ws"]])
    x[1] = x[1][::-1]
    m = both_ways(mask.T[:, :, None])
    states, saved = gru(x, p["wu"], m)
    pool, side, weights = pooled(states, p["wa"], mask.T)
    logits = pool @ p["out"] + p["bias"][0]
    loss = float(np.mean(np.logaddexp(0, logits) - labels * logits))
    d_logit = ((sigmoid(logits) - labels) / len(labels)).astype(np.float32)
    g = {"out": pool.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
    d_states, g["wa"] = pooled_back(d_logit[:, None] * p["out"], side, weights, p["wa"])
    dx, g["wu"] = gru_back(d_states, states, saved, p["wu"], m)
    dx[1] = dx[1][::-1].copy()
    g["ws"] = np.stack([np.tensordot(shown, d, ((0, 1), (0, 1))) for d in dx])
    flat = dx.transpose(1, 2, 0, 3).reshape(-1, 2, dx.shape[3])
    d_table = gathered_back(index.T.ravel(), flat, len(ids)).transpose(1, 0, 2)
    g["ww"], g["wb"] = joined.T @ d_table, d_table.sum(axis=1, keepdims=True)
    d_joined = (d_table @ p["ww"].transpose(0, 2, 1)).sum(axis=0)
    g["words"] = gathered_back(ids, d_joined[:, :D_WORD], len(p["words"]))
    d_states, g["ca"] = pooled_back(d_joined[:, D_WORD:], c_side, c_weights, p["ca"])
    dx, g["cu"] = gru_back(d_states, c_states, c_saved, p["cu"], cm)
    dx[1] = dx[1][::-1].copy()
    flat = dx.transpose(1, 2, 0, 3).reshape(-1, 2, dx.shape[3])
    d_table = gathered_back(chars.T.ravel(), flat, CHARS).transpose(1, 0, 2)
    g["cw"], g["cb"] = p["chars"].T @ d_table, d_table.sum(axis=1, keepdims=True)
    g["chars"] = (d_table @ p["cw"].transpose(0, 2, 1)).sum(axis=0)
    return loss, g


# --- the model ---------------------------------------------------------------------------------------------------------


def strength(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """How far the share of toxic texts among those with a word lies above the general one: a difference of logits, 0 at least, in thirds."""
    drawn = np.clip((np.maximum(toxic, 0) + DRAWN * share) / (np.maximum(toxic, 0) + np.maximum(clean, 0) + DRAWN), 1e-6, 1 - 1e-6)
    return np.maximum(np.log(drawn / (1 - drawn)) - np.log(share / (1 - share)), 0) / 3


@dataclass
class Model:
    params: dict[str, np.ndarray]
    vocabulary: dict[str, int]
    #: The keys of words and beginnings with some evidence, in order, and how much.
    evidence: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.float32))
    slope: float = 1.0
    shift: float = 0.0
    empty: float = -3.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def probability(self, logit: float) -> float:
        return float(min(1.0, max(0.0, sigmoid(self.slope * logit + self.shift))))


_FACTOR, _WHOLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)


def key_hashes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(N, 12): hashes of each word's first 0 to 11 letters, and the words' lengths."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    inside = np.arange(LONGEST_WORD) < lengths[:, None]
    letters = np.zeros(inside.shape, np.uint64)
    letters[inside] = np.frombuffer("".join(tokens).encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros((len(tokens), LONGEST_WORD + 1), np.uint64)
    for n in range(LONGEST_WORD):
        h = (out[:, n] ^ letters[:, n]) * _FACTOR
        out[:, n + 1] = h ^ (h >> np.uint64(29))
    return out, lengths


def word_keys(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(N, 7): the keys under which a word is counted, its own and those of its beginnings, and which of them it has."""
    hashes, lengths = key_hashes(tokens)
    own = hashes[np.arange(len(tokens)), lengths] ^ _WHOLE
    there = np.concatenate([np.ones((len(tokens), 1), bool), lengths[:, None] >= np.array(BEGINNINGS)], axis=1)
    return np.concatenate([own[:, None], hashes[:, BEGINNINGS.start : BEGINNINGS.stop]], axis=1), there


class Evidence:
    """A model's evidence by keys: most words have none, which a table of marks says first."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.marks = np.zeros(1 << 22, bool)
        self.marks[keys >> np.uint64(42)] = True

    def features(self, tokens: list[str]) -> np.ndarray:
        """(N, FEATURES): the evidence of words themselves, and the most that they or their beginnings have."""
        asked, there = word_keys(tokens)
        found = np.zeros(asked.shape, np.float32)
        at = np.nonzero(there & self.marks[asked >> np.uint64(42)])
        if len(at[0]) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, asked[at]), len(self.keys) - 1)
            found[at] = np.where(self.keys[place] == asked[at], self.values[place], 0)
        return np.stack([found[:, 0], found.max(axis=1)], axis=1)


class Counts:
    """In how many toxic and clean texts each word and each beginning of a word occurs; words are given by number."""

    def __init__(self, names: list[str]):
        keys, per = [], []
        for at in range(0, len(names), 50_000):
            some, there = word_keys(names[at : at + 50_000])
            keys.append(some[there])
            per.append(there.sum(axis=1))
        self.per = np.concatenate(per)
        self.first = np.cumsum(self.per) - self.per
        self.keys, self.flat = np.unique(np.concatenate(keys), return_inverse=True)
        self.flat = self.flat.astype(np.int32)
        self.texts = np.zeros((2, len(self.keys)), np.int32)
        self.n = [0, 0]

    def add(self, words: np.ndarray, toxic: bool) -> None:
        self.texts[int(toxic), np.unique(self.flat[taken(self.first[words], self.per[words])])] += 1
        self.n[int(toxic)] += 1

    def strength(self, own_clean: int = 0, own_toxic: int = 0) -> np.ndarray:
        """Each key's evidence, with so many texts taken out of its counts; below ``LEAST_EVIDENCE`` it is none."""
        out = strength(self.texts[1] - own_toxic, self.texts[0] - own_clean, self.n[1] / max(1, sum(self.n))).astype(np.float32)
        out[out < LEAST_EVIDENCE] = 0
        return out

    def features(self, own_clean: int, own_toxic: int) -> np.ndarray:
        """(words, FEATURES) as a text sees them whose own part in the counts is taken out."""
        force = self.strength(own_clean, own_toxic)
        return np.stack([force[self.flat[self.first]], np.maximum.reduceat(force[self.flat], self.first)], axis=1)

    def evidence(self) -> tuple[np.ndarray, np.ndarray]:
        force = self.strength()
        return self.keys[force > 0], force[force > 0]


class Scorer:
    """Logits of texts; keeps the inputs of words it has seen, up to ``TABLE_ROWS`` of them."""

    def __init__(self, model: Model):
        self.model, self.evidence = model, Evidence(*model.evidence)
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.fresh: list[str] = []
        self.table = np.empty((2, 0, 3 * H_WORD), np.float32)
        self.used = 0

    def _row(self, word: str) -> int:
        found = self.rows.get(word)
        if found is None:
            found = self.rows[word] = len(self.rows)
            self.fresh.append(word)
        return found

    def _learn(self) -> None:
        if not self.fresh:
            return
        need = self.used + len(self.fresh)
        if need > self.table.shape[1]:
            grown = np.empty((2, max(need, 2 * self.table.shape[1], 4096), 3 * H_WORD), np.float32)
            grown[:, : self.used] = self.table[:, : self.used]
            self.table = grown
        fresh = sorted(range(len(self.fresh)), key=lambda i: len(self.fresh[i]))
        for at in range(0, len(fresh), 2048):
            some = fresh[at : at + 2048]
            tokens = [self.fresh[i] for i in some]
            ids = np.array([self.model.vocabulary.get(w, 0) for w in tokens])
            p = self.model.params
            self.table[:, self.used + np.array(some)] = word_inputs(p, ids, *spell(tokens))[0] + self.evidence.features(tokens) @ p["ws"]
        self.used = need
        self.fresh = []

    def _windows(self, lists: list[np.ndarray]) -> np.ndarray:
        """Logits of windows, each the rows of its words."""
        p, out = self.model.params, np.empty(len(lists), np.float32)
        order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
        h = H_WORD
        for at in range(0, len(order), 2048):
            some = order[at : at + 2048]
            steps = len(lists[some[-1]])
            index = np.zeros((steps, len(some)), np.int64)
            mask = np.zeros((steps, len(some)), np.float32)
            for k, i in enumerate(some):
                index[: len(lists[i]), k] = lists[i]
                mask[: len(lists[i]), k] = 1
            ragged = len(lists[some[0]]) != steps
            states = np.zeros((2, steps + 1, len(some), h), np.float32)
            for t in range(steps):
                last = states[:, t]
                rec = last @ p["wu"]
                x = np.stack([self.table[0, index[t]], self.table[1, index[steps - 1 - t]]])
                zr = sigmoid(x[:, :, : 2 * h] + rec[:, :, : 2 * h])
                new = np.tanh(x[:, :, 2 * h :] + zr[:, :, h:] * rec[:, :, 2 * h :])
                step = (1 - zr[:, :, :h]) * (new - last)
                if ragged:
                    step *= np.stack([mask[t], mask[steps - 1 - t]])[:, :, None]
                states[:, t + 1] = last + step
            pool, _, _ = pooled(states, p["wa"], mask)
            out[some] = pool @ p["out"] + p["bias"][0]
        return out

    def logits(self, texts: list[str | None]) -> list[float]:
        """The largest window logit of each text; the model's ``empty`` for texts without words."""
        out = [self.model.empty] * len(texts)
        waiting: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            self._learn()
            for (i, _), logit in zip(waiting, self._windows([w for _, w in waiting])):
                best[i] = max(best.get(i, -np.inf), float(logit))
            waiting.clear()

        best: dict[int, float] = {}
        for i, text in enumerate(texts):
            found = words(text)
            for at in range(0, len(found), 48_000):  # a very long text goes through in parts that share a window's words
                rows = np.fromiter(map(self._row, found[at : at + 48_000 + WINDOW - STRIDE]), np.int64)
                waiting += [(i, rows[s : s + WINDOW]) for s in window_starts(len(rows))]
                if len(waiting) >= 8192 or len(self.fresh) > 20_000:
                    flush()
                    if len(self.rows) > TABLE_ROWS:
                        self.reset()
        if waiting:
            flush()
        for i, logit in best.items():
            out[i] = logit
        if len(self.rows) > TABLE_ROWS:
            self.reset()
        return out


_SCORERS: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def tops(model: Model, coded: list[np.ndarray], names: list[str], some: np.ndarray) -> np.ndarray:
    """Logits of the windows ``some``."""
    own, out = Scorer(model), np.empty(len(some), np.float32)
    for at in range(0, len(some), 8192):
        part = some[at : at + 8192]
        rows = [np.fromiter((own._row(names[j]) for j in coded[i]), np.int64, len(coded[i])) for i in part]
        own._learn()
        out[at : at + 8192] = own._windows(rows)
        if len(own.rows) > TABLE_ROWS:
            own.reset()
    return out


def train(texts: list[str], text_labels: np.ndarray, numbers: np.ndarray) -> Model:
    """Learns from texts (their words, joined by spaces) with their labels and numbers; texts of one number stay together."""
    distinct: dict[str, int] = {}
    coded, origin, whole = [], [], []
    for i, text in enumerate(texts):
        found = np.array([distinct.setdefault(w, len(distinct)) for w in text.split()], np.int32)
        whole.append(np.unique(found))
        for s in window_starts(len(found)):
            coded.append(found[s : s + WINDOW])
            origin.append(i)
    owner = np.array(origin, np.int64)
    labels, rows = text_labels[owner], numbers[owner]
    if not len(coded) or labels.min() == labels.max():
        base = float(labels.mean()) if len(labels) else 0.0
        return Model(initial(0) | {"out": np.zeros(2 * H_WORD, np.float32)}, {}, slope=0.0, shift=float(np.log(max(base, 1e-3) / max(1 - base, 1e-3))))
    rng = np.random.default_rng(SEED)
    apart = pd.Series(rng.permutation(len(set(numbers.tolist()))))  # a quarter of the toxic and of the clean texts sets the scale
    text_apart = np.zeros(len(texts), bool)
    for label in (0, 1):
        own = np.unique(numbers[text_labels == label])
        text_apart |= np.isin(numbers, own[np.argsort(apart[own], kind="stable")[: len(own) // 4]]) & (text_labels == label)
    text_apart = np.isin(numbers, numbers[text_apart])
    if (text_labels[~text_apart] > 0).all() or (text_labels[~text_apart] == 0).all():
        text_apart[:] = False
    fitting = np.flatnonzero(~text_apart[owner])
    names, seen = list(distinct), np.zeros(len(distinct), np.int64)
    np.add.at(seen, np.concatenate([np.unique(coded[i]) for i in fitting]), 1)
    often = sorted(np.flatnonzero(seen >= LEAST_WINDOWS), key=lambda i: (-seen[i], names[i]))[:WORD_VECTORS]
    vocabulary = {names[k]: i for i, k in enumerate(often, 1)}

    counts = Counts(names)
    for i in np.flatnonzero(~text_apart):
        counts.add(whole[i], text_labels[i] > 0)
    seen_of = np.stack([counts.features(1, 0), counts.features(0, 1)])  # by clean and by toxic texts of the training
    evidence = counts.evidence()

    weight = 1 / np.bincount(owner)[owner]  # of a text's draws, what each of its windows gets
    toxic, clean = fitting[labels[fitting] > 0], fitting[labels[fitting] == 0]
    shown = np.array([np.sort(seen_of[1, coded[i], 1])[-3:].sum() for i in toxic])
    raised = np.exp(3 * (shown - pd.Series(shown).groupby(owner[toxic]).transform("max").to_numpy()))
    pools = [(toxic, raised / pd.Series(raised).groupby(owner[toxic]).transform("sum").to_numpy()), (clean, weight[clean])]

    def drawn_from(pool: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        ends = np.cumsum(weights)
        return pool[np.minimum(np.searchsorted(ends, rng.random(n) * ends[-1], side="right"), len(pool) - 1)]

    p = initial(len(vocabulary))
    spelled, spelled_mask = (np.zeros((len(names), LONGEST_WORD + 1), np.uint8) for _ in range(2))
    for at in range(0, len(names), 50_000):
        for whole_table, part in zip((spelled, spelled_mask), spell(names[at : at + 50_000])):
            whole_table[at : at + len(part), : part.shape[1]] = part
    ids = np.array([vocabulary.get(w, 0) for w in names])
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    half = BATCH // 2
    for step in range(STEPS):
        if step == STEPS // 2:
            # from now on, of toxic texts windows by how the network sees them, and every second clean window one that it suspects
            now = Model(p, vocabulary, evidence)
            logits, usual = tops(now, coded, names, toxic), tops(now, coded, names, clean)
            raised = np.exp(np.minimum(0, logits - pd.Series(logits).groupby(owner[toxic]).transform("max").to_numpy()))
            pools[0] = (toxic, raised / pd.Series(raised).groupby(owner[toxic]).transform("sum").to_numpy())
            hard = weight[clean] * sigmoid(usual)
            pools[1] = (clean, weight[clean] / weight[clean].sum() + hard / hard.sum())
        batch = np.concatenate([drawn_from(*pool, half) for pool in pools])  # toxic windows are few: half of each batch are such
        longest = max(len(coded[i]) for i in batch)
        index, mask = np.zeros((len(batch), longest), np.int64), np.zeros((len(batch), longest), np.float32)
        for k, i in enumerate(batch):
            index[k, : len(coded[i])] = coded[i]
            mask[k, : len(coded[i])] = 1
        used, local = np.unique(index, return_inverse=True)
        some = np.where(rng.random(len(used)) < 0.5, 0, ids[used])  # now and then a word must be told by its characters
        long = int(spelled_mask[used].sum(axis=1).max())
        marks = labels[batch].astype(np.float32)
        facts = seen_of[(marks > 0).astype(np.int64)[:, None], index] * mask[:, :, None]
        _, g = loss_and_gradient(p, local.reshape(index.shape), mask, some, spelled[used][:, :long].astype(np.int64), spelled_mask[used][:, :long].astype(np.float32), marks, facts)
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = RATE * min(1, (step + 1) / 20) * (1 - 0.9 * step / STEPS)
        for k, a in g.items():
            a = a * min(1, 1 / (norm + 1e-9))
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.001 * (a * a - v[k])
            p[k] -= (rate * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.999 ** (step + 1))) + 1e-8)).astype(np.float32) + 1e-4 * rate * p[k]
    model = Model(p, vocabulary, evidence)
    held = np.flatnonzero(text_apart[owner]) if text_apart.any() else np.arange(len(owner))
    logits = tops(model, coded, names, held)
    top = pd.DataFrame({"row": rows[held], "logit": logits, "label": labels[held]}).groupby("row").max()
    model.empty = float(np.median(logits[labels[held] == 0])) if (labels[held] == 0).any() else 0.0
    model.slope, model.shift = platt(top["logit"].to_numpy(), top["label"].to_numpy())
    for i in np.flatnonzero(text_apart):  # what scoring uses at last has the texts apart too
        counts.add(whole[i], text_labels[i] > 0)
    model.evidence = counts.evidence()
    return model


def platt(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (0.05 at least) and shift of the logistic curve of labels over logits, by damped Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        grad = x.T @ (q - labels) + 1e-2 * np.array([a - 1, b])
        hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        d = np.linalg.solve(hess, grad)
        d *= min(1, 2 / np.abs(d).max()) if np.abs(d).max() > 0 else 1
        a, b = max(0.05, a - d[0]), b - d[1]
    return float(a), float(b)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from rows with a 0/1 label; null labels are left out. Without rows of both labels the score is the share of toxic rows."""
    rows = labelled.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    total = rows.count()
    if total > sample_rows:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / total))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"id": part["id"], "words": [" ".join(words(text)) for text in part["text"]], "label": part["label"]})

    id_type = rows.schema["id"].dataType.simpleString()
    small_batches(rows.sparkSession)
    sample = rows.mapInPandas(read, f"id {id_type}, words string, label int").toPandas().sort_values(["id", "words"], kind="stable")
    model = train(list(sample["words"]), sample["label"].to_numpy(), pd.factorize(sample["id"], use_na_sentinel=False)[0])
    list(released(()))  # the driver's process lives on
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns, score (0..1, six decimals) and predicted (1 from ``threshold`` on) of every text.

    Null and wordless texts score like a clean window; texts of any length are read to their end; equal texts score alike
    and repeated rows stay. A kept column named score or predicted is left out.
    """
    require(docs, (*keep, text_col))
    keep = tuple(c for c in keep if c.lower() not in ("score", "predicted"))
    return docs.select(*keep, probability(docs, model, F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def probability(docs: DataFrame, model: Model, text: Column) -> Column:
    """The score of a text column of docs."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shipped.value
        for texts in released(batches):
            yield pd.Series([round(own.probability(x), 6) for x in scorer(own).logits(list(texts))], dtype="float64")

    return of(text.cast("string"))


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the documents with labels that aren't held out. A document with several labels counts as toxic if any says so."""
    own = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return fit(docs.select("doc_id", "text").join(own, "doc_id"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learnt from the labels of those that aren't held out.

    Null and empty texts have a score too; a null id isn't held out; repeated ids and rows are all scored; extra columns are
    ignored; an empty table gives no rows, and without labels of both kinds the score is the share of toxic rows.
    """
    require(docs, ("doc_id", "text"))
    require(labels, ("doc_id", "toxic"))
    model = fit_on(docs, labels)
    return score(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model, keep=("doc_id", "held_out"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows predicted toxic: all columns kept, whatever their names, and all other rows, repeated ones and those with null ids or texts too."""
    require(docs, ("doc_id", "text"))
    require(labels, ("doc_id", "toxic"))
    scored = docs.withColumn("__toxicity", probability(docs, fit_on(docs, labels), F.col("text")))
    return scored.filter(F.col("__toxicity") < threshold).select(*docs.columns)
