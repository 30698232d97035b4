from __future__ import annotations

from foliant.operators import providers as V
from foliant.plans.pipeline import recited, redacted


def test_chain(spark):
    rows = spark.createDataFrame([(1, "The end of\n\na line[^n] here. See 1 Cor 2:10.\n\nThe word λόγος is old.", [("n", "A note.")]), (2, None, None), (3, "", [])], "section_id bigint, text string, footnotes array<struct<ref:string,text:string>>")
    book = [(r.text, r.manner, r.lang) for r in redacted(rows).orderBy("section_id", "utt_idx").collect()]
    assert book == [("The end of a line here.", "body", "en"), ("See First Corinthians two, ten.", "body", "en"), ("The word", "body", "en"), ("λόγος", "body", "grc"), ("is old.", "body", "en")]
    woven = [(r.text, r.manner) for r in redacted(rows, verbatim_notes=True).orderBy("section_id", "utt_idx").collect()]
    assert woven[:3] == [("The end of a line here.", "body"), ("A note.", "digression"), ("See First Corinthians two, ten.", "body")]
    plan = recited(redacted(rows, verbatim_notes=True), ["section_id"]).orderBy("utt_idx").collect()
    assert [r.pause for r in plan][:3] == [0.0, 0.35, 0.35] and plan[0].chunks == ["The end of a line here."]


class Liar:
    label = "liar"

    def ask(self, paragraph, notes):
        return [("Something else.", "body")] if "lie" in paragraph else None if "none" in paragraph else [("One", "body"), ("respoken", "digression"), ("two.", "body")]


def test_glosses_come_from_cache_model_or_the_plain_weave(spark):
    rows = spark.createDataFrame([(1, "One[^a] two.", [("a", "N.")]), (2, "A lie[^a].", [("a", "N.")]), (3, "none[^a].", [("a", "N.")]), (4, "No anchor.", None), (5, None, None)], "id bigint, paragraph string, notes array<struct<ref:string,text:string>>")
    first = V.glossed(rows, "id", Liar())
    got = {r.id: (r.origin, [(p.text, p.manner) for p in r.pieces]) for r in first.collect()}
    assert got == {1: ("model", [("One", "body"), ("respoken", "digression"), ("two.", "body")]), 2: ("verbatim", [("A lie.", "body"), ("N.", "digression")]), 3: ("verbatim", [("none.", "body"), ("N.", "digression")]), 4: ("plain", [("No anchor.", "body")])}
    again = V.glossed(rows, "id", Liar(), first.where("origin = 'model'"))
    assert {r.id: r.origin for r in again.collect()} == {1: "cache", 2: "verbatim", 3: "verbatim", 4: "plain"}


def test_switches_are_found_or_dropped():
    assert V.switched("He said a  priori so.", "en", [("a priori", "LA"), ("not there", "fr"), ("", "de"), ("priori so", "it")]) == [("He said", "en"), ("a  priori", "la"), ("so.", "en")]
    assert V.switched("Plain.", "en", []) == [("Plain.", "en")]
    assert V.faithful("a[^x] b", [("a", "body"), ("N", "digression"), ("b", "body")]) and not V.faithful("a b", [("a", "body")])
