from __future__ import annotations

import pytest

from foliant.llm.lookalike import Trie, by_table, canonical, canonical_text, p2_found, symbols


def look(t):
    return canonical_text(t, by_table)


@pytest.mark.parametrize(("a", "b"), [("ｗｉｄｅ １２", "wide 12"), ("café", "café"), ("a​b­c", "abc"), ("a  b", "a b"), ("pаge", "page"), ("ﬁne ﬆone", "fine stone"), ("a‑b‐c", "a-b-c"), (" x \n\n\n\n y ", "x\n\ny"), ("ὤ", "ὤ")])
def test_same_look(a, b):
    assert look(a) == look(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("é", "e"), ("2²", "22"), ("a–b", "a-b"), ("“a”", '"a"'), ("a.", "a,"), ("ı", "i"), ("a\nb", "a b")])
def test_visible_differences_stay(a, b):
    assert look(a) != look(b)


def test_trie_takes_the_most_frequent_spelling_and_weighs_edits():
    trie = Trie([("сор", 2), ("cop", 5), ("stone", 3)])
    assert trie.best("ﬆone") == "stone" and trie.best("со​р") == "cop" and trie.best("stne") is None
    assert trie.best("stne", 1) == "stone" and trie.best("sto", 1) is None and trie.best("cat", 2) == "cop"
    assert Trie([]).best("x") is None and symbols("​") == ""


def test_canonical_handles_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "ｏne", "x"), (2, None, "y"), (3, "", "z"), (4, "​", "w")], "id int, text string, canonical string")
    assert [tuple(r) for r in canonical(df).select("id", "canonical").orderBy("id").collect()] == [(1, "one"), (2, None), (3, ""), (4, "")]
    empty = spark.createDataFrame([], "id int, text string")
    assert canonical(empty).count() == 0


def test_p2_found_pairs_different_strings_only(spark, tmp_path):
    e = [(1, "Same text"), (2, "Ｓame text"), (3, "Same text"), (3, "Same text"), (4, None), (5, " "), (6, "same text")]
    s = [(7, "P one"), (8, "P one"), (9, None)]
    spark.createDataFrame(e, "entry_id bigint, text string").write.parquet(f"{tmp_path}/bibliography.parquet")
    spark.createDataFrame(s, "section_id bigint, text string").write.parquet(f"{tmp_path}/sections.parquet")
    assert sorted(tuple(r) for r in p2_found(spark, str(tmp_path)).collect()) == [("entry", 1, 2), ("entry", 2, 3), ("section", 7, 8)]
