from __future__ import annotations

from foliant.operators import bibliography as B


def test_fields():
    p = B.parsed("Harland, Philip A. and Mary Beard. “Rites of the Sea.” Journal of Votive History 12 (1998): 4–19.")
    assert (p["authors"], p["title"], p["container"], p["year"], p["pages"]) == (["Harland, Philip A.", "Mary Beard"], "Rites of the Sea", "Journal of Votive History", "1998", "4–19")
    p = B.parsed("Cassius Dio. Roman History. Translated by Earnest Cary. London: Heinemann, 1914.")
    assert (p["authors"], p["year"]) == (["Cassius Dio"], "1914") and p["title"].startswith("Roman History")
    p = B.parsed("Horst, Pieter Willem, trans. Chaeremon. Leiden: Brill, 1984.")
    assert (p["authors"], p["translators"], p["title"]) == ([], ["Horst, Pieter Willem"], "Chaeremon")
    p = B.parsed("Doe, Jane. “A Part.” Pages 3–9 in The Whole. Edited by John S. Roe and Ann B. Poe. Oxford: Press, 2001.")
    assert (p["pages"], p["container"], p["editors"], p["year"]) == ("3–9", "The Whole", ["John S. Roe", "Ann B. Poe"], "2001")
    p = B.parsed("———, ed. The Book. Ghent: House, 1950².")
    assert (p["carried"], p["role"], p["title"], p["year"]) == (True, "ed", "The Book", "1950")
    assert B.parsed("Habolaran Commission for Comparative Liturgy. Lists. Quarn: House, 1904.")["authors"] == ["Habolaran Commission for Comparative Liturgy"]


def test_defined_results():
    for text in (None, "", "no entry at all", "———", "“", "x" * 5000, ", , ,"):
        assert B.parsed(text)["authors"] == []


def test_carried_names_and_classes(spark):
    rows = spark.createDataFrame([(1, 1, "Doe, Jane. One. Ghent: House, 1950."), (2, 1, "———. Two. Ghent: House, 1951."), (3, 1, None), (4, 1, "———, trans. Three. Ghent: House, 1952."), (5, 2, "———. Four. Ghent: House, 1953."), (6, 2, "Cassius Dio. History. Translated by E. Cary. London: House, 1914.")], "entry_id bigint, doc_id bigint, text string")
    parsed = B.parsed_entries(rows, "entry_id").join(rows, "entry_id")
    out = {r.entry_id: r for r in B.classified(B.with_carried_names(parsed, ["doc_id"], ["entry_id"])).collect()}
    assert [out[i].authors for i in (1, 2, 3, 4, 5)] == [["Doe, Jane"], ["Doe, Jane"], [], [], []]
    assert out[4].translators == ["Doe, Jane"] and out[4].role is None
    assert [i for i in out if out[i].is_primary] == [4, 6]


def test_style_needs_enough_entries(spark):
    rows = spark.createDataFrame([(i, 1, f"Doe, Jane. Title {i}. Ghent: House, 195{i}.") for i in range(6)] + [(9, 1, "———. X. Ghent: House, 1950."), (10, 2, "Roe, J. 1950. Other.")], "entry_id bigint, doc_id bigint, text string")
    assert {r.doc_id: (r.entries, r.tail, r.head, r.mark, r.recognised) for r in B.styles(rows, "doc_id").collect()} == {1: (7, 6, 0, "———", True), 2: (1, 0, 1, None, False)}
