"""The suffix stripper of Porter (1980), as published: five steps over the measure of a stem."""

from __future__ import annotations

import re

#: Suffixes and what replaces them where the stem before has a measure above zero.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
#: Suffixes dropped where the measure is above one.
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """v or c for each letter; y is a vowel behind a consonant."""
    out: list[str] = []
    for c in word:
        out.append("v" if c in "aeiou" or c == "y" and out and out[-1] == "c" else "c")
    return "".join(out)


def measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall(r"v+c+", shape(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, table) -> tuple[str, str] | None:
    found = [(s, r) for s, r in table if word.endswith(s)]
    return max(found, key=lambda x: len(x[0])) if found else None


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
        if cut is not None and "v" in shape(cut):
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        if (hit := _longest(word, table)) and measure(word[: -len(hit[0])]) > 0:
            word = word[: -len(hit[0])] + hit[1]
    if hit := _longest(word, [(s, "") for s in STEP4]):
        base = word[: -len(hit[0])]
        if measure(base) > 1 and (hit[0] != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word
