"""Nulls, empty tables, ties and clashing names of the relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import notes as N
from foliant.operators import pages as P
from foliant.operators import relations as R
from foliant.operators import sections as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_text_functions_keep_nulls_and_match_the_golden_cases(spark):
    df = spark.createDataFrame([("Greek Medicine Men 137",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.repetition_key("t")).collect()] == ["greekmedicinemen", None, ""]
    for f in (T.flattened, T.collapsed, T.without_anchors, T.anchors, T.slug, T.heading_like, T.locator_words, T.first_letter, T.escaped_metadata):
        assert df.where("t is null").select(f("t")).first()[0] is None
    one = spark.range(1)
    say = lambda c: one.select(c).first()[0]
    assert say(T.locator_words(F.lit("32.9.6-10"))) == "thirty-two, nine, six to ten"
    assert [say(T.spelled(F.lit(n))) for n in (0, 13, 40, 99, 100, 112, 1000, 21015, 999999, 1000000, -1)] == ["zero", "thirteen", "forty", "ninety-nine", "one hundred", "one hundred twelve", "one thousand", "twenty-one thousand fifteen", "nine hundred ninety-nine thousand nine hundred ninety-nine", None, None]
    assert say(T.stem(F.lit(3), F.lit("Eros & Magic!"))) == "03_eros_magic" and say(T.stem(F.lit(120), F.lit("??"))) == "120_document"
    assert say(T.flattened(F.lit("a co-\nded li­ ne\x07  here"))) == "a coded line here"
    assert say(T.without_anchors(F.lit("word[^p1-n2] next"))) == "word next"
    assert say(T.playlist_title(F.lit("A, B"))) == "A‚ B" and say(T.spelled_digits(F.lit("2a46"))) == "two-four-six"


def test_furniture_threshold_and_nulls(spark):
    pages = [(1, p, b, f"Head {p}" if b == 0 and p < 3 else f"text {p} {b} " + "x" * 90) for p in range(40) for b in range(3)] + [(1, 40, 0, None), (2, 0, 0, "   "), (2, 0, 1, "9")]
    df = spark.createDataFrame(pages, "doc_id bigint, page_no bigint, block_no bigint, text string")
    keys = P.furniture(df)
    assert rows(keys) == [(1, "head", "edge"), (1, "head", "everywhere")]
    kept = P.without_furniture(df, keys)
    assert kept.columns == df.columns and kept.where("text like 'Head%' or text = '9'").count() == 0 and kept.where("text is null").count() == 1
    assert P.furniture(df.limit(0)).count() == 0 and P.without_furniture(df, keys.limit(0)).where("doc_id = 1").count() == 121


def test_fonts_take_the_first_of_ties(spark):
    spans = [(1, 1, 1, 1, 10.0, "abcd", False), (1, 1, 1, 2, 12.0, "abcd", False), (1, 1, 2, 3, 8.0, "ab", False), (1, 1, 3, 4, 8.0, "ab", True)]
    df = spark.createDataFrame(spans, "doc_id bigint, page_no bigint, block_no bigint, span_no bigint, size double, text string, superscript boolean")
    assert rows(P.font_profile(df)) == [(1, 10.0, 8.0)]
    sizes = P.dominant_size(df, "doc_id", "page_no", "block_no")
    assert rows(sizes) == [(1, 1, 1, 10.0), (1, 1, 2, 8.0), (1, 1, 3, 0.0)]
    assert rows(P.block_roles(sizes, P.font_profile(df)).select("block_no", "is_heading", "is_note", "is_note_kept")) == [(1, False, False, False), (2, False, True, True), (3, False, True, True)]


def test_outline_and_ranges(spark):
    outline = spark.createDataFrame([(1, 1, 1, "A", 1), (1, 2, 2, "B", 1), (1, 3, 1, "C", 5), (1, 4, 1, "D", 3)], "doc_id int, entry_no int, level int, title string, page int")
    leaves = P.outline_leaves(outline)
    assert [r.title for r in leaves.orderBy("entry_no").collect()] == ["B", "C", "D"]
    starts = P.section_bounds(P.advancing(leaves, "doc_id", "entry_no", "page"), "doc_id", "entry_no", "page", F.lit(9)).withColumnRenamed("page", "start_page").drop("level")
    assert [(r.title, r.start_page, r.end_page) for r in starts.orderBy("entry_no").collect()] == [("B", 1, 4), ("C", 5, 9)]
    notes = spark.createDataFrame([("n1", 1, 4), ("n2", 1, 5), ("n3", 1, 12), ("n4", 2, 1), ("n5", 1, None)], "note string, doc_id int, page int")
    assert rows(P.in_page_range(notes, starts, "doc_id", "page", "start_page", "end_page").select("note", "title")) == [("n1", "B"), ("n2", "C")]


def test_notes(spark):
    df = spark.createDataFrame([(1, 1, "a[^x] b[^y] c[^x]", [("x", "old"), ("x", "new"), ("z", "left")]), (2, 1, None, None), (3, 1, "", [])], "section_id bigint, doc_id bigint, text string, footnotes array<struct<ref:string,text:string>>")
    a, n = N.anchor_rows(df), N.note_rows(df)
    assert rows(N.anchored(a, n).select("anchor_no", "ref", "note")) == [(0, "x", "new"), (1, "y", None), (2, "x", "new")]
    assert rows(N.leftover(a, n).select("ref", "note")) == [("z", "left")]
    assert rows(N.pairing_gate(a.withColumn("doc_id", F.lit(1)), n.withColumn("doc_id", F.lit(1)), "doc_id")) == [(1, 2, 1, True)]
    lines = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 2, None), (1, 2, 1, None), (1, 3, 1, None), (2, 1, 1, None)], "doc int, page int, line int, number int")
    assert [(r.note_page, r.note_line) for r in N.continued_notes(lines, "doc", "page", "line", F.col("number")).orderBy("doc", "page", "line").collect()] == [(1, 1), (1, 1), (1, 1), (None, None), (None, None)]


def test_relations(spark):
    cites = spark.createDataFrame([("A", None, 1, "x"), ("A", None, 2, "y"), ("A", "S", 3, "z"), (None, "S", 4, "w")] + [("B", "T", i, str(i)) for i in range(5)], "author string, siglum string, at int, ref string")
    assert {(r.author, r.siglum): (r.n, [x.ref for x in r["sample"]]) for r in R.paired_sigla(cites, "at", "ref").collect()} == {("A", None): (2, ["x", "y"]), ("A", "S"): (1, ["z"]), (None, "S"): (1, ["w"]), ("B", "T"): (5, ["0", "1", "2"])}
    assert rows(R.colliding_sigla(spark.createDataFrame([("Ann", "Tacitus"), ("Ann", "Suetonius"), ("Ann", "Tacitus"), (None, "X"), (None, "Y"), ("B", None)], "siglum string, author string"))) == [("Ann", ["Suetonius", "Tacitus"])]
    tier = lambda *r: spark.createDataFrame(list(r), "siglum string, spoken string")
    assert rows(R.overlaid(tier(("a", "1"), ("b", "1")), tier(("a", "2"), ("b", "")), tier(("c", None)))) == [("a", "2", 1), ("b", "1", 0)]
    assert rows(R.promoted(tier(("a", "1"), ("_b", "1"), ("c", ""), ("d", "1")), tier(("d", None)))) == [("a", "1")]
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert rows(R.cache_state(keys("a", "b", "b", None), keys("b", "c"), "key")) == [("a", "miss"), ("b", "hit"), ("c", "stale")]
    u = spark.createDataFrame([(1, 1, "a", "body"), (1, 2, "", "body"), (1, 3, "b", "digression"), (1, 4, "c", "body"), (1, 5, "d", "body")], "s int, i int, text string, manner string")
    assert [r.pause for r in R.pauses(u, ["s"], "i", F.col("text") != "").orderBy("i").collect()] == [0.0, 0.35, 0.35, 0.6]
    sig = R.signatures(u, ["s"], "i", "text", "manner")
    assert R.changed(sig, sig, ["s"]).count() == 0 and R.changed(sig, sig.limit(0), ["s"]).count() == 1
    assert R.output_average(spark.createDataFrame([(10, 1, 1)], "output_tokens bigint, calls bigint, truncated bigint")).first()[0] is None
    assert rows(R.term_counts(spark.createDataFrame([("a b a",), ("A ab",), (None,)], "text string"), spark.createDataFrame([("a",), ("a",), ("q",)], "term string"))) == [("a", 2, 1)]


def test_sections(spark):
    df = spark.createDataFrame([(1, 2, "b\n\n \n\nc", 9), (1, 1, "a", 9), (1, 3, None, 9), (1, 4, "", 9)], "doc int, idx int, text string, paragraph_no int")
    out = S.paragraphs(df)
    assert out.columns == ["doc", "idx", "text", "paragraph_no", "paragraph"] and rows(out.select("idx", "paragraph_no", "paragraph")) == [(1, 0, "a"), (2, 0, "b"), (2, 2, "c")]
    assert rows(S.whole_text(df, ["doc"], ["idx"])) == [(1, "a\n\nb\n\n \n\nc")]
    assert rows(N.reciprocal_links(spark.createDataFrame([(1, 2), (2, 1), (1, 3), (4, 4), (1, 2), (None, 1)], "source int, target int"))) == [(1, 2)]
