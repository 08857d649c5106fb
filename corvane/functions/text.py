"""Text and path expressions: all of them plain Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split() has it, beyond what Java's \s matches.
SPACES = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x00-\x20\x7F-\xA0]"
UNKNOWN_SOURCE = "Source Document"


def clean_text(text: Column) -> Column:
    """Lower case; control characters and then all beyond ASCII deleted; white space runs and then underscore runs as one space; trimmed. Null is empty.

    The order matters: a line break is deleted, not spaced, and underscores may leave several spaces.
    """
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, into in ((r"[\x00-\x1F\x7F-\x9F]", ""), (r"[^\x00-\x7F]+", ""), (r"\s+", " "), (r"_+", " ")):
        out = F.regexp_replace(out, pattern, into)
    return F.trim(out)


def terms(cleaned: Column) -> Column:
    """The words of a cleaned text."""
    return F.array_remove(F.split(cleaned, " "), "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, and each other sign by itself; white space and control characters are left out."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def plain_words(text: Column) -> Column:
    """Words without ASCII punctuation, in lower case; punctuation goes first, so that "don't" is "dont"."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), PUNCTUATION, ""))
    return F.array_remove(F.split(bare, SPACES), "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_and_extension(path: Column) -> tuple[Column, Column]:
    """File name without and with only its last extension; dots at the start of a name begin no extension."""
    name, pattern = base_name(path), r"^(\.*[^.].*?|\.*)(\.[^.]*)?$"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)


def file_kind(path: Column) -> Column:
    """pdf, word (.doc, .docx) or other, whatever the case."""
    extension = F.lower(stem_and_extension(path)[1])
    return F.when(extension == ".pdf", "pdf").when(extension.isin(".doc", ".docx"), "word").otherwise("other")


def local_date(ts: Column) -> Column:
    """yyyy-MM-dd in the session's time zone."""
    return F.date_format(ts, "yyyy-MM-dd")


def display_name(doc_name: Column, path: Column) -> Column:
    """The document's name, else the path's last part, else a fixed label; empty counts as missing."""
    return F.coalesce(F.nullif(doc_name, F.lit("")), F.nullif(base_name(path), F.lit("")), F.lit(UNKNOWN_SOURCE))


def metric_label(name: Column) -> Column:
    """Column name as a label: underscores as spaces, units in brackets."""
    return F.replace(F.replace(F.replace(name, F.lit("_"), F.lit(" ")), F.lit(" ms"), F.lit("(ms)")), F.lit(" mb"), F.lit("(MB)"))


def preview(text: Column, length: int = 200) -> Column:
    return F.substring(text, 1, length)
