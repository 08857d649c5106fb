"""Overlapping chunks of texts, by a hierarchy of separators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The separators in order of preference, and the sizes in characters.
SEPARATORS = ("# ", "## ", "### ", "\n\n", "\n", ". ", "! ", "? ", " ")
SIZE, OVERLAP = 600, 150


def merged(pieces: list[str], separator: str, size: int, overlap: int) -> list[str]:
    """Pieces joined up to ``size``; each chunk starts with what fits of the last one's tail, up to ``overlap``."""
    out, held, length, gap = [], [], 0, len(separator)

    def emit() -> None:
        text = separator.join(held).strip()
        if text:
            out.append(text)

    for piece in pieces:
        if held and length + gap + len(piece) > size:
            emit()
            while held and (length > overlap or length + gap + len(piece) > size):
                length -= len(held.pop(0)) + (gap if held else 0)
        length += len(piece) + (gap if held else 0)
        held.append(piece)
    if held:
        emit()
    return out


def chunks(text: str | None, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The chunks of a text. The first separator that occurs splits it (the last one if none does) and is not kept; pieces
    of ``size`` or more are split by the separators after it, and stay whole when none is left."""
    text = text or ""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, rest = separators[at], separators[at + 1 :]
    out: list[str] = []
    fitting: list[str] = []
    for piece in filter(None, text.split(separator)):
        if len(piece) < size:
            fitting.append(piece)
            continue
        out += merged(fitting, separator, size, overlap)
        fitting = []
        out += chunks(piece, size, overlap, rest) if rest else [piece]
    return out + merged(fitting, separator, size, overlap)


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row a chunk: all columns of docs but the text, chunk_ix from 0 and page_content. Null and empty texts give none; no shuffle."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunks")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t, size, overlap))

    others = [c for c in docs.columns if c != text_col]
    return docs.select(*others, F.posexplode(cut(F.col(text_col))).alias("chunk_ix", "page_content"))


def chunk_id(path, ix, content):
    """A key that the same chunk has again when it is ingested again."""
    return F.sha2(F.concat_ws("|", path, ix.cast("string"), content), 256)


def batches(frame: DataFrame, rows: int = 100) -> Iterator[list]:
    """Rows in lists of ``rows`` for sinks that take batches; one partition at a time is held."""
    held: list = []
    for row in frame.toLocalIterator():
        held.append(row)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held
