import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.operators.chunk import SEPARATORS, batches, chunk_documents, chunks


def test_prefers_the_first_separator_that_occurs():
    assert chunks("aaa. bbb! ccc", 8, 0) == ["aaa", "bbb! ccc"]
    assert chunks("## x # y", 4, 0) == ["#", "x", "y"]  # "# " comes before "## " and is part of it


def test_overlap_comes_from_the_tail():
    assert chunks("a b c d e f", 5, 3, (" ",)) == ["a b c", "b c d", "c d e", "d e f"]
    assert chunks("a b c d e f", 5, 0, (" ",)) == ["a b c", "d e f"]


def test_oversize_pieces_stay_whole():
    assert chunks("x " + "y" * 30 + " z", 10, 2) == ["x", "y" * 30, "z"]
    assert chunks("y" * 700) == ["y" * 700]


def test_nothing_from_nothing():
    assert chunks(None) == chunks("") == chunks("   ") == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab#.!?\n ", max_size=9), max_size=40).map("".join), st.integers(5, 40), st.integers(0, 4))
def test_bounds_and_order(text, size, overlap):
    got = chunks(text, size, overlap)
    longest = max((len(w) for w in text.split(" ")), default=0)
    assert all(len(c) <= max(size, longest) for c in got)
    for c in got:  # trimmed, never empty, and its letters are a run of the text's
        assert c.strip() == c and c
        letters = [x for x in c if x in "ab"]
        assert "".join(letters) in "".join(x for x in text if x in "ab")
    if overlap == 0:
        assert "".join(x for c in got for x in c if x in "ab") == "".join(x for x in text if x in "ab")


def test_rows(spark):
    docs = spark.createDataFrame([(1, "word " * 300, "x"), (2, None, "y"), (3, "short", "z")], "id long, text string, chunk string")
    got = chunk_documents(docs, "id", "text").orderBy("id", "chunk_ix").collect()
    assert [r["chunk_ix"] for r in got if r["id"] == 1] == list(range(len(chunks("word " * 300)))) and len(got[0]["page_content"]) <= 600
    assert [r["page_content"] for r in got if r["id"] == 3] == ["short"] and not [r for r in got if r["id"] == 2]
    assert [len(b) for b in batches(docs, 2)] == [2, 1]
    with pytest.raises(ValueError):
        chunk_documents(docs, "id", "text", 10, 10)
    assert SEPARATORS[-1] == " "
