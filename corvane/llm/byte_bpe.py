"""Byte-level BPE encoding and decoding with exact merges in linear time.

A rank file gives tokens as bytes. Bytes are mapped to Latin-1 characters so that pyahocorasick, which works on
strings, finds the longest token at a position in time bounded by the longest token. Encoding walks left to right with the longest match first. A token may follow another only if the two are
compatible, that is if BPE, given their joined bytes, would give back just these two; a token that isn't is
replaced by its longest proper prefix token, and when none fits the walk backtracks by one token and marks
the position as dead, so that no position is left twice. Compatibility is decided by undoing merges on both
sides of the seam, and memoised. The result equals what merging pairs in rank order gives. (That compatible neighbours make
an encoding unique, and the walk by backtracking, are described with the public Rust crate ``bpe`` of 2024.)

Texts are cut where the pattern must begin a new piece whatever stands around, by comparing bytes with their neighbours; the
distinct chunks of a batch are looked up, and those not seen before are split by the pattern and encoded together: the
longest matches of all of them in one walk, each distinct pair of neighbours checked once, and only pieces with a
pair that isn't compatible go through the backtracking walk. What is known of chunks is kept up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, require, small_batches

#: \s in tokenizer patterns is Unicode's White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space beside white space or an end of the text; a space that isn't.
DOUBLE, SINGLE = regex.compile(rf"^ | $| [{SPACE}]|[{SPACE}] "), regex.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
SPACED = regex.compile(r"(?:'\w+\|)* \?\\p\{L\}\+\| \?\\p\{N\}\+\| \?\[\^\\s\\p\{L\}\\p\{N\}\]\+\|\\s\+\(\?!\\S\)\|\\s\+")
PIECES_KEPT, PAIRS_KEPT, LONGEST_KEPT = 50_000, 300_000, 64
#: Bytes of texts taken at once, and of chunks and their ids kept in a codec.
PART_BYTES, KEPT_BYTES, CHUNKS_KEPT = 4_000_000, 40_000_000, 300_000
#: A character in no token.
MARK = "\u0100"
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with \\s and \\S spelled out, as the Unicode property has them."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            if two == r"\s":
                two = SPACE if inside else f"[{SPACE}]"
            elif two == r"\S":
                if inside:
                    raise ValueError(r"\S inside a class isn't supported")
                two = f"[^{SPACE}]"
            out.append(two)
            i += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        i += 1
    return regex.compile("".join(out))


def read_ranks(data: bytes) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks must be 0, 1, 2, ..."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in data.splitlines() if line))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in pairs]


def taken(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... (count of them) of each run, one run after another."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def in_parts(texts: pa.Array, size: int | None = None) -> Iterator[pa.Array]:
    """Slices of texts of about ``size`` bytes, or of one text where that is longer; null is empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    at, size = 0, size or PART_BYTES
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield texts.slice(at, end - at)
        at = end


class Chunks:
    """Texts (no nulls) cut where a piece begins in every pattern of the usual family: the distinct chunks, which chunk is where, and where texts begin.

    A piece is a word, number or run of signs, with one space before it if there is one, or white space; of a run of white space
    before something else the last character stands apart. So a piece begins where white space begins, at the last
    character of a longer run that something follows, and behind white space other than a space. ``odd`` are the texts
    with white space beyond ASCII, which are not cut here.
    """

    def __init__(self, texts: pa.Array):
        data, offsets = self._bytes(texts)
        self.odd = self._with_other_white(data, offsets)
        if self.odd:
            data, offsets = self._bytes(pc.if_else(pa.array(np.isin(np.arange(len(texts)), self.odd)), "", texts))
        n = len(data)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        some = offsets[1:] > offsets[:-1]
        first[offsets[:-1][some]] = True
        last[offsets[1:][some] - 1] = True
        white = _WHITE[data]
        before, after, spaced = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        before[1:], spaced[1:], after[:-1] = white[:-1], data[:-1] == 32, ~white[1:]
        before &= ~first
        cut = np.flatnonzero(first | white & ~before | white & before & after & ~last | ~white & before & ~spaced)
        found = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(np.append(cut, n).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        self.distinct: list[bytes] = found.dictionary.to_pylist()
        self.index = found.indices.to_numpy()
        self.bounds = np.searchsorted(cut, offsets)

    @staticmethod
    def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]

    @staticmethod
    def _with_other_white(data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The texts with white space of two or three bytes."""
        lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
        if not len(lead):
            return []
        b0, b1, b2 = (data[np.minimum(lead + i, len(data) - 1)] for i in range(3))
        white = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80) | (b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)
        white |= (b0 == 0xE2) & ((b1 == 0x80) & ((b2 >= 0x80) & (b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF)) | (b1 == 0x81) & (b2 == 0x9F))
        return np.unique(np.searchsorted(offsets, lead[white], side="right") - 1).tolist()


class Runs:
    """Runs of ids, numbered as they are added."""

    def __init__(self):
        self.flat, self.used, self.n = np.empty(1 << 16, np.uint32), 0, 0
        self.start, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def add(self, flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(flat)), np.uint32)])
        if self.n + len(start) > len(self.start):
            more = max(len(self.start), len(start))
            self.start, self.count = (np.concatenate([x, np.empty(more, np.int64)]) for x in (self.start, self.count))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[self.n : self.n + len(start)], self.count[self.n : self.n + len(start)] = start + self.used, count
        self.used, self.n = self.used + len(flat), self.n + len(start)

    def of(self, runs: np.ndarray) -> np.ndarray:
        return self.flat[taken(self.start[runs], self.count[runs])]


class Splitter:
    """Distinct chunks and the numbers of their pieces under one pattern, kept up to a bound; codecs of one pattern may share it."""

    def __init__(self, findall):
        self.findall, self.age = findall, 0
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.numbers: dict[str, int] = {}
        self.runs, self.held, self.age = Runs(), 0, self.age + 1

    def pieces_of(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pieces of distinct chunks, one chunk after another, and where each chunk's begin (and the end)."""
        if len(self.known) > CHUNKS_KEPT or self.held > KEPT_BYTES:
            self.reset()
        known = self.known
        rows = np.fromiter((known.get(c, -1) for c in chunks), np.int64, len(chunks))
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            rows[fresh] = np.arange(len(known), len(known) + len(fresh))
            self._add([chunks[i] for i in fresh.tolist()])
        return self.runs.of(rows), np.concatenate([[0], np.cumsum(self.runs.count[rows])])

    def _add(self, chunks: list[bytes]) -> None:
        # white space is split on its own; all else is joined by line breaks, each of which then is a piece and nothing else is
        white = np.fromiter((c[-1] in b"\t\n\x0b\x0c\r " for c in chunks), bool, len(chunks))
        plain = [c for c, w in zip(chunks, white.tolist()) if not w]
        numbers = self.numbers
        number = lambda p: numbers.setdefault(p, len(numbers))
        found = np.fromiter(map(number, self.findall(b"\n".join(plain).decode("utf-8"))), np.int64)
        breaks = found == numbers.get("\n", -1)
        pieces = [found[~breaks]]
        per = np.zeros(len(chunks), np.int64)
        per[~white] = np.bincount(np.cumsum(breaks)[~breaks], minlength=len(plain)) if plain else 0
        order = np.argsort(white, kind="stable")
        for i in np.flatnonzero(white).tolist():
            own = self.findall(chunks[i].decode("utf-8"))
            per[i] = len(own)
            pieces.append(np.array([number(p) for p in own], np.int64))
        start = np.empty(len(chunks), np.int64)
        start[order] = np.cumsum(per[order]) - per[order]
        used = np.concatenate(pieces)
        self.runs.add(used, start, per)
        self.held += 4 * len(used) + 2 * sum(map(len, chunks))
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))


class ByteBPE:
    """Encodes and decodes with the ranks given; ``pattern`` None takes each text as one piece."""

    def __init__(self, tokens: list[bytes], pattern: str | None):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no token")
        self.findall = compiled(pattern).findall if pattern else (lambda text: [text] if text else [])
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.latin_ids = {t.decode("latin-1"): i for i, t in enumerate(tokens)}
        self.lengths = [len(t) for t in tokens]
        self.longest = max(self.lengths)
        self.prefix = [self._longest_prefix(t) for t in tokens]
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        for i, t in enumerate(tokens):  # in rank order: a split only needs merges of lower rank
            a = self.prefix[i]
            while a >= 0:
                b = self.ids.get(t[self.lengths[a] :], -1)
                if b >= 0 and a < i and b < i and self._compatible(a, b):
                    self.left[i], self.right[i] = a, b
                    self.merged[a, b] = i
                    break
                a = self.prefix[a]
        self.fits.clear()
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.array = pa.array(tokens, pa.binary())
        self.sizes, self.prefixes = np.array(self.lengths, np.int64), np.array(self.prefix, np.int64)
        self.splitter, self.age, self.runs = Splitter(self.findall), None, Runs()
        #: Whether the pattern is of the family in which a word takes one space before it and no piece has one elsewhere but in runs of white space.
        self.spaced = pattern is not None and SPACED.fullmatch(pattern) is not None

    def _longest_prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (i := self.ids.get(token[:n], -1)) >= 0:
                return i
        return -1

    def _compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the joined bytes keeps a and b apart: no merge across the seam comes before theirs."""
        left, right, merged = self.left, self.right, self.merged
        limit = 1 << 60
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if a > b:  # undo the later of the two merges; a token that is no merge stays
                if right[a] != a:
                    limit, a = a, right[a]
                elif left[b] != b:
                    limit, b = b + 1, left[b]
                else:
                    return True
            elif left[b] != b:
                limit, b = b + 1, left[b]
            elif right[a] != a:
                limit, a = a, right[a]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            known = self.fits[pair] = self._compatible(a, b)
        return known

    def longest_at(self, text: str, at: int) -> int:
        """The longest token that starts there: on the trie's path, the last node that ends one."""
        ahead = text[at : at + self.longest]
        depth, get = self.automaton.longest_prefix(ahead), self.latin_ids.get
        while (token := get(ahead[:depth], -1)) < 0:
            depth -= 1
        return token

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, lengths, prefix, text = len(piece), self.lengths, self.prefix, piece.decode("latin-1")
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, -1
        while at < n:
            if token < 0:
                token = self.longest_at(text, at)
            end = at + lengths[token]
            if not dead[end]:
                if out:
                    fit = self.compatible(out[-1], token)
                else:
                    fit = True
                if fit:
                    out.append(token)
                    at, token = end, -1
                    continue
            token = prefix[token]
            if token < 0:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
        return out

    def encode_packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; null is empty.

        A space between two other characters that aren't white space always begins a piece, so texts are cut there
        and what follows each such space is looked up whole.
        """
        if not text:
            return b""
        if self.spaced:
            chunks = SINGLE.split(text) if DOUBLE.search(text) else text.split(" ")
        else:
            chunks = [text]
        parts = [self._pieces(chunks[0])]
        known = self.chunks.get
        for chunk in chunks[1:]:
            packed = known(chunk)
            if packed is None:
                packed = self._pieces(" " + chunk)
                if len(chunk) <= LONGEST_KEPT:
                    if len(self.chunks) >= PIECES_KEPT:
                        self.chunks.clear()
                    self.chunks[chunk] = packed
            parts.append(packed)
        return b"".join(parts)

    def _pieces(self, text: str) -> bytes:
        cache, parts = self.cache, []
        for piece in self.findall(text):
            packed = cache.get(piece)
            if packed is None:
                packed = array("I", self.encode_piece(piece.encode("utf-8"))).tobytes()
                if len(piece) <= LONGEST_KEPT:
                    if len(cache) >= PIECES_KEPT:
                        cache.clear()
                    cache[piece] = packed
            parts.append(packed)
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.encode_packed(text)).tolist()

    def piece_runs(self, splitter: Splitter) -> Runs:
        """The ids of all pieces that the splitter has numbered; new ones are encoded."""
        if self.age != (id(splitter), splitter.age):
            self.age, self.runs = (id(splitter), splitter.age), Runs()
        if self.runs.n < len(splitter.numbers):
            self.runs.add(*self._encoded(list(islice(splitter.numbers, self.runs.n, None))))
        return self.runs

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, and where each piece's begin and how many they are."""
        latin = [p if p.isascii() else p.encode("utf-8").decode("latin-1") for p in pieces]
        whole = np.fromiter((self.latin_ids.get(p, -1) for p in latin), np.int64, len(latin))
        parts = np.flatnonzero(whole < 0)
        start, count = np.arange(len(pieces)), np.ones(len(pieces), np.int64)
        if not len(parts):
            return whole.astype(np.uint32), start, count
        some = [latin[i] for i in parts.tolist()]
        # the longest matches of all of them in one walk: the mark between them is in no token
        hits = np.fromiter(chain.from_iterable(self.automaton.iter_long(MARK.join(some))), np.int64).reshape(-1, 2)
        lengths = np.fromiter(map(len, some), np.int64, len(some))
        owner = np.searchsorted(np.cumsum(lengths + 1) - 1, hits[:, 0])
        ids = hits[:, 1]
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = np.bincount(owner, weights=self.sizes[ids], minlength=len(some)) != lengths  # a walk that left a gap
        bad[owner[inner[~self.fitting(ids[inner], ids[inner + 1])]]] = True
        good = ~bad[owner]
        flat = [whole.astype(np.uint32), ids[good].astype(np.uint32)]
        count[parts] = np.bincount(owner[good], minlength=len(some))
        start[parts] = len(pieces) + np.cumsum(count[parts]) - count[parts]
        at = len(pieces) + len(flat[1])
        short = np.flatnonzero(bad & (lengths <= LONGEST_KEPT))
        if len(short):
            own, sizes = self._walk([some[i] for i in short.tolist()], lengths[short])
            flat.append(own)
            start[parts[short]], count[parts[short]] = at + np.cumsum(sizes) - sizes, sizes
            at += len(own)
        for i in np.flatnonzero(bad & (lengths > LONGEST_KEPT)).tolist():
            flat.append(np.array(self.encode_piece(some[i].encode("latin-1")), np.uint32))
            start[parts[i]], count[parts[i]] = at, len(flat[-1])
            at += len(flat[-1])
        return np.concatenate(flat), start, count

    def fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is compatible; each distinct pair is looked up once."""
        pairs, back = np.unique(a << 32 | b, return_inverse=True)
        return np.fromiter((self.compatible(k >> 32, k & 0xFFFFFFFF) for k in pairs.tolist()), bool, len(pairs))[back]

    def _walk(self, pieces: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short pieces, one after another, and how many each has: the walk of ``encode_piece`` for all of them in step."""
        base = np.cumsum(lengths + 1) - lengths - 1
        text = MARK.join(pieces)
        longest = np.full(len(text) + 1, -1)
        hits = np.fromiter(chain.from_iterable(self.automaton.iter_long(text)), np.int64).reshape(-1, 2)
        longest[hits[:, 0] - self.sizes[hits[:, 1]] + 1] = hits[:, 1]
        dead = np.zeros(len(longest), bool)
        stack, depth = np.empty((len(pieces), int(lengths.max())), np.int64), np.zeros(len(pieces), np.int64)
        at, token = np.zeros(len(pieces), np.int64), np.full(len(pieces), -1)
        live = np.arange(len(pieces))
        while len(live):
            here, tok = at[live], token[live]
            new = tok < 0
            places = base[live[new]] + here[new]
            for x in places[longest[places] < 0].tolist():
                longest[x] = self.longest_at(text, x)
            tok[new] = longest[places]
            end = here + self.sizes[tok]
            fit = ~dead[base[live] + end]
            inner = np.flatnonzero(fit & (depth[live] > 0))
            fit[inner] = self.fitting(stack[live[inner], depth[live[inner]] - 1], tok[inner])
            took = live[fit]
            stack[took, depth[took]] = tok[fit]
            depth[took] += 1
            at[took], token[took] = end[fit], -1
            left, shorter = live[~fit], self.prefixes[tok[~fit]]
            token[left] = shorter
            back = left[shorter < 0]  # nothing fits here: the place is dead, and the token before it goes
            dead[base[back] + at[back]] = True
            depth[back] -= 1
            token[back] = stack[back, depth[back]]
            at[back] -= self.sizes[token[back]]
            live = live[at[live] < lengths[live]]
        return stack[np.arange(stack.shape[1]) < depth[:, None]].astype(np.uint32), depth

    def counts(self, texts: pa.Array, cut: Chunks | None = None, splitter: Splitter | None = None) -> np.ndarray:
        """The number of ids of each text (no nulls); ``cut`` if they have been cut already, ``splitter`` if its pieces are known there."""
        if not self.spaced:
            return np.array([len(self.encode_packed(t.as_py())) // 4 for t in texts], np.int64)
        cut, splitter = cut or Chunks(texts), splitter or self.splitter
        pieces, ends = splitter.pieces_of(cut.distinct)
        sums = np.concatenate([[0], np.cumsum(self.piece_runs(splitter).count[pieces])])
        sums = np.concatenate([[0], np.cumsum(np.diff(sums[ends])[cut.index])])
        out = sums[cut.bounds[1:]] - sums[cut.bounds[:-1]]
        for i in cut.odd:
            out[i] = len(self.encode_packed(texts[i].as_py())) // 4
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (no nulls), one text after another, and where each text's begin (and the end)."""
        if not self.spaced:
            lists = [np.frombuffer(self.encode_packed(t.as_py()), np.uint32) for t in texts]
        else:
            cut = Chunks(texts)
            pieces, ends = self.splitter.pieces_of(cut.distinct)
            runs = self.piece_runs(self.splitter)
            starts = np.concatenate([[0], np.cumsum(runs.count[pieces])])[ends]
            count = np.diff(starts)[cut.index]
            flat = runs.of(pieces)[taken(starts[:-1][cut.index], count)]
            bounds = np.concatenate([[0], np.cumsum(count)])[cut.bounds]
            if not cut.odd:
                return flat, bounds
            lists = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
            for i in cut.odd:
                lists[i] = np.frombuffer(self.encode_packed(texts[i].as_py()), np.uint32)
        return np.concatenate([np.empty(0, np.uint32), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes of each run of ids between bounds."""
        tokens = self.array.take(pa.array(ids))
        offsets = np.frombuffer(tokens.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets[bounds]), tokens.buffers()[2]])

    def decode_packed(self, packed: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in array("I", packed)])

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_packed(array("I", ids).tobytes())


_KNOWN: dict[tuple[str, str | None], ByteBPE] = {}


def codec(data: bytes, pattern: str | None) -> ByteBPE:
    """The codec of a rank file's bytes, built once in each Python worker."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _KNOWN:
        _KNOWN[key] = ByteBPE(read_ranks(data), pattern)
    return _KNOWN[key]


def shipped(docs: DataFrame, path: str):
    """The rank file at ``path`` on the driver, broadcast (under 10 MB, or it is refused)."""
    with open(path, "rb") as f:
        data = f.read(10_000_001)
    if len(data) > 10_000_000:
        raise ValueError("rank file over 10 MB")
    return docs.sparkSession.sparkContext.broadcast(data)


def encode(docs: DataFrame, path: str, pattern: str | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), round_trip: bool = False) -> DataFrame:
    """The ``keep`` columns, n_tokens and ids (binary: little-endian u32), and with ``round_trip`` decoded (binary).

    Null and empty texts have no ids; texts of any length are read whole, some megabytes of them at a time; repeated rows
    stay, each with its ids; an empty table gives no rows. A kept column named like one of the new ones is left out.
    """
    require(docs, (*keep, text_col))
    small_batches(docs.sparkSession)
    ranks = shipped(docs, path)
    new = ["n_tokens", "ids", *["decoded"] * round_trip]
    keep = tuple(c for c in keep if c.lower() not in new)
    carried = docs.select(F.struct(F.lit(True).alias("__row"), *keep).alias("kept"), F.col(text_col).cast("string").alias("text"))
    schema = f"kept {carried.schema['kept'].dataType.simpleString()}, n long, ids binary" + ", decoded binary" * round_trip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks.value, pattern)
        for batch in released(batches):
            at = 0
            for part in in_parts(batch.column(1)):
                ids, bounds = bpe.encode_all(part)
                packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids)])
                columns = [batch.column(0).slice(at, len(part)), pa.array(np.diff(bounds)), packed, *[bpe.decode_all(ids, bounds)] * round_trip]
                yield pa.record_batch(columns, names=["kept", "n", "ids", *["decoded"] * round_trip])
                at += len(part)

    out = carried.mapInArrow(run, schema)
    return out.select(*(F.col("kept").getField(c).alias(c) for c in keep), F.col("n").alias("n_tokens"), *new[1:])


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its packed ids in ``out_col``; null ids decode to null."""
    ranks = shipped(encoded, path)

    @F.pandas_udf("binary")
    def run(ids):
        bpe = codec(ranks.value, None)
        return ids.map(lambda x: None if x is None else bpe.decode_packed(bytes(x)))

    return encoded.withColumn(out_col, run(F.col(ids_col)))


def digests(docs: DataFrame, path: str, pattern: str | None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: the digests of encode's and decode's output."""
    both = encode(docs, path, pattern, round_trip=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
