from __future__ import annotations

from foliant.operators import assembly as A


def spans(spark):
    rows = []

    def block(page, no, lines, size=10.0):
        for ln, line in enumerate(lines):
            parts = line if isinstance(line, list) else [(line, False)]
            for sn, (text, sup) in enumerate(parts):
                rows.append((1, page, str(page + 4), no, ln, page * 1000 + no * 100 + ln * 10 + sn, text, 6.0 if sup else size, sup))

    for page in range(1, 5):
        block(page, 0, [f"The Running Head {page}"], 8.0)
        block(page, 1, [f"Chapter {page}"], 16.0)
        block(page, 2, [[("Body text of the page that is set in the body size and bro-", False)], [("ken over lines", False), ("1", True), (" it ends.", False)]] * 6)
        if page == 1:
            block(page, 3, ["1. First note", "goes on"], 8.0)
        if page == 2:
            block(page, 3, ["and ends here.", "1 Second note."], 8.0)
        block(page, 9, [str(page)], 10.0)
    return spark.createDataFrame(rows, "doc_id bigint, page_no int, page_label string, block_no int, line_no int, span_no int, text string, size double, superscript boolean")


def test_book_from_spans(spark):
    paragraphs, notes = A.assembled(spans(spark))
    texts = {(r.page_no, r.block_no): r.text for r in paragraphs.collect()}
    assert texts[1, 1] == "Chapter 1" and texts[1, 2].startswith("Body text of the page that is set in the body size and broken over lines[^p5-n1] it ends. Body")
    assert not any("Running" in t or t.isdigit() for t in texts.values())
    assert sorted((r.page_no, r.ref, r.text) for r in notes.collect()) == [(1, "p5-n1", "First note goes on and ends here."), (2, "p6-n1", "Second note.")]
    outline = spark.createDataFrame([(1, 0, 1, "Cover", 1), (1, 1, 1, "Part One", 2), (1, 2, 2, "Chapter  2", 2), (1, 3, 2, "Chapter 4", 4), (1, 4, 1, "Blank", 1), (1, 5, 1, "Gone", 99)], "doc_id bigint, entry_no int, level int, title string, page int")
    last = spark.createDataFrame([(1, 4)], "doc_id bigint, last_page int")
    out = {r.section_idx: (r.title, r.text[:9], [n.ref for n in r.footnotes or []]) for r in A.split_sections(paragraphs, notes, outline, last).collect()}
    assert out == {-1: ("Front matter", "Chapter 1", ["p5-n1"]), 2: ("Chapter 2", "Chapter 2", ["p6-n1"]), 3: ("Chapter 4", "Chapter 4", [])}
    whole = A.split_sections(paragraphs, notes, outline.limit(0), last).collect()
    assert [(r.title, len(r.footnotes)) for r in whole] == [("Text", 2)]
    assert A.assembled(spans(spark).limit(0))[0].count() == 0


def test_endnotes(spark):
    blocks = [(1, 5, 0, "h1", "Notes"), (1, 5, 1, "p", "9. No section yet"), (1, 5, 2, "p", "Chapter 4"), (1, 5, 3, "p", "1. First"), (1, 5, 4, "p", "more"), (1, 5, 5, "p", "Introduction"), (1, 5, 6, "p", "lost line"), (1, 5, 7, "p", "1 Old"), (1, 5, 8, "p", "1 New"), (1, 6, 0, "h1", "Index"), (1, 6, 1, "p", "2. x")]
    notes = A.endnotes(spark.createDataFrame(blocks, "doc_id int, file_no int, unit_no int, tag string, text string"))
    assert sorted((r.ref, r.text) for r in notes.collect()) == [("chapter-4-n1", "First\nmore"), ("introduction-n1", "New")]
    anchors = spark.createDataFrame([(1, 1, 7, "1"), (1, 2, 8, "1"), (1, 3, 9, "1"), (1, 3, 10, "2")], "doc_id int, file_no int, place int, number string")
    headings = spark.createDataFrame([(1, 1, "Introduction"), (1, 2, "4| Magic"), (1, 3, None)], "doc_id int, file_no int, text string")
    assert sorted((r.place, r.ref) for r in A.anchored_endnotes(anchors, headings, notes).collect()) == [(7, "introduction-n1"), (8, "chapter-4-n1"), (9, "chapter-4-n1")]


def test_upsert_and_draft(spark):
    tier = lambda *r: spark.createDataFrame(list(r), "siglum string, spoken string")
    got = A.upserted(tier(("a", "1"), ("b", None), ("c", None)), tier(("a", "2"), ("b", "2"), ("c", None), ("d", None), ("e", "5")))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([("a", "1"), ("b", "2"), ("c", None), ("d", None), ("e", "5")], key=str)
    found = spark.createDataFrame([("x", 1, "lang", "de"), ("x", 2, "as", "eks"), ("y", 3, "as", "why"), ("old", 4, "as", "o")], "term string, order int, mechanism string, value string")
    out = A.drafted_lexicon(spark.createDataFrame([("old",)], "term string"), found, spark.createDataFrame([("y", 5)], "term string, n int"))
    assert [tuple(r) for r in out.collect()] == [("y", "as", "why", 5), ("x", "lang", "de", 0)]
