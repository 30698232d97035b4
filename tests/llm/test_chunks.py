from __future__ import annotations

import re

from hypothesis import given
from hypothesis import strategies as st

from foliant.llm.chunks import chunks, pieces


def sentences(text):
    return [m.span() for m in re.finditer(r"[^.\s][^.]*\.?", text)]


def test_kinds():
    word = "abcd " * 20
    assert pieces("One two. Three four.", sentences("One two. Three four."), 12, 4)[1] == "sentence"
    text = "One two three, four five six. Seven."
    assert pieces(text, sentences(text), 20, 4)[1] == "clause"
    assert pieces(word, sentences(word), 30, 5)[1] == "word"
    assert pieces("x" * 100, [(0, 100)], 30, 5)[1] == "char"
    assert pieces("short.", [(0, 6)], 30, 5) == ([(0, 0, 6)], None)
    assert pieces(" \n ", [], 30, 5) == ([], None)


@given(st.text(alphabet="ab. ,\n", max_size=300), st.integers(12, 60), st.integers(0, 8))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    own, _ = pieces(text, sentences(text), limit, overlap)
    assert all(b - f <= limit and f <= a < b for f, a, b in own)
    assert all(a - f <= overlap for f, a, _ in own)
    covered = "".join(text[a:b] for _, a, b in own)
    assert "".join(covered.split()) == "".join(text.split())
    assert all(x[2] <= y[1] for x, y in zip(own, own[1:]))


def test_headings_and_lists_are_cut_first(spark):
    text = "# Head\nOne two three.\n\n- item one is here.\n- item two is here.\n\nLast words."
    out = chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "id bigint, text string"), "id", limit=40, overlap=5).orderBy("piece_no").collect()
    assert [r.id for r in out] == [1] * len(out) and out[0].piece.startswith("# Head") and all(len(r.piece) <= 40 for r in out)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y")], "utt_id bigint, text string, piece string, kind string")
    assert [tuple(r) for r in chunks(df, "utt_id").collect()] == [(1, 0, None, 0, 0, 3, "a b")]
