from __future__ import annotations

import pickle
import re
from collections import Counter

import pytest

from foliant.llm import scans as S

CLEAN = [
    "The scribes copied the missing manuscript in the valley. A well-known report was kept by the lay-brothers. There is a pre- and post-exilic margin in the chapel.",
    "Whoever explained the second chronicle must also have known the well-known settlement. The merchants described the post-exilic controversy during the winter.",
    "Hanul praised the chronicle while the merchants rejected the manuscript. The lay-brothers copied a pre- and post-exilic report in the winter. Orvandale burned.",
] * 30
TITLES = ["On the Missing Manuscript", "The Second Chronicle"]


@pytest.fixture(scope="module")
def editor():
    words = Counter()
    for t in CLEAN:
        for w in t.split():
            w = re.sub(r"^\W+|\W+$", "", w).lower()
            words.update({w, *[p for p in w.split("-") if p]})
    return S.train(S.Lexicon({w: n for w, n in words.items() if n > 1}), CLEAN)


def test_findings(editor):
    text = "The scribes copied the manu-\nscript in the val1ey. A well-\n\nTHE SECOND CHRONICLE | 12\n\nknown report was wintcr. There is a pre-\nand post-exilic margin. Kasul sur\n- 13 -"
    assert sorted(S.read(text, TITLES, editor)[0]) == [(0, "broken_word"), (1, "broken_compound"), (1, "misread"), (3, "furniture"), (5, "misread"), (7, "furniture")]


def test_split_words_and_names(editor):
    assert S.read("the man uscript of Kasul", [], editor)[0] == [(0, "misread")]
    assert S.read("Kasul and Bremol praised Dromak", [], editor)[0] == []


def test_paragraphs_are_repaired(editor):
    text = "The scribes copied the manu-\nscript in the val1ey. A well-\n\n12\n\nknown report.[^n1]\n\nWhoever"
    assert S.paragraphs(text, TITLES, editor) == "The scribes copied the manuscript in the valley. A well-known report.[^n1]\n\nWhoever"


def test_defined_results(editor):
    assert S.read(None, [], editor) == ([], []) and S.read("", [], editor) == ([], []) and S.paragraphs(None, [], editor) is None
    assert S.read("\n\n", TITLES, editor)[0] == []
    assert S.furniture(["in the year", "1573", "xvi", "vol. 5", "12).", "On the Missing Manuscript"], TITLES) == {1, 2, 5}


def test_running_header_of_an_untitled_section():
    lines = ["the text goes", "- 5 -", "What the Resin Knew", "on here", "Galder the wardens", "[6]"]
    assert S.furniture(lines, ["The Gilded Colophon"]) == {1, 2, 5} and S.furniture(lines, ["The Gilded Colophon", "Other"]) == {1, 5}


def test_editor_pickles(editor):
    again = pickle.loads(pickle.dumps(editor))
    assert again.word("wintcr")[0] == "winter" and again.word("Hanul")[0] == "Hanul"


def test_stamps_stand_next_to_furniture():
    lines = ["text of a page", "[3]", "Property of the Reading Room", "more text"]
    assert S.stamp_candidates(lines, []) == [(S.title_key("Property of the Reading Room"), True)]
    assert 2 in S.furniture(lines, [], frozenset([S.title_key("Property of the Reading Room")]))


def test_whole_query(spark, tmp_path):
    sections = [(i, 1 + i % 2, "T", CLEAN[i % 3] if i % 2 else "The scribes copied the manu-\nscript in the val1ey.\n- 3 -", [("n", "a well-\nknown report")]) for i in range(40)]
    spark.createDataFrame(sections, "section_id bigint, doc_id bigint, title string, text string, footnotes array<struct<ref:string,text:string>>").write.parquet(f"{tmp_path}/sections.parquet")
    spark.createDataFrame([(1, ".pdf", None), (2, ".epub", "B"), (2, ".epub", "B")], "doc_id bigint, suffix string, title string").write.parquet(f"{tmp_path}/doc_meta.parquet")
    rows = {tuple(r) for r in S.p4_found(spark, str(tmp_path)).where("section_id = 0").collect()}
    assert {(0, "", 0, "broken_word"), (0, "", 2, "furniture"), (0, "n", 0, "broken_compound")} <= rows


def test_every_stamp_is_furniture_however_many_there_are(spark, tmp_path):
    codes = ["".join("adgkmpxz"[n >> 3 * i & 7] for i in range(5)) for n in range(10_005)]
    page = "\n".join(f"[3]\nRoom {c}" for c in codes)
    sections = [(b, b, "T", page, [("n", "Room aaaaa"), ("m", "Room zzzzz")]) for b in (1, 2, 3)] + [(9, 9, "T", CLEAN[0], [])]
    spark.createDataFrame(sections, "section_id bigint, doc_id bigint, title string, text string, footnotes array<struct<ref:string,text:string>>").write.parquet(f"{tmp_path}/sections.parquet")
    spark.createDataFrame([(1, ".pdf", "A"), (2, ".pdf", "B"), (3, ".pdf", "C"), (9, ".epub", "D")], "doc_id bigint, suffix string, title string").write.parquet(f"{tmp_path}/doc_meta.parquet")
    found = S.p4_found(spark, str(tmp_path)).where("kind = 'furniture'")
    assert {r[0]: r[1] for r in found.where("ref = ''").groupBy("section_id").count().collect()} == dict.fromkeys((1, 2, 3), 2 * len(codes))
    assert sorted((r.section_id, r.ref) for r in found.where("ref <> ''").collect()) == [(1, "n"), (2, "n"), (3, "n")]
