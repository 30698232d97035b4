from __future__ import annotations

import zipfile

import pytest

from foliant.sources import epub


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    doc = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>x</title></head><body>{}</body></html>'
    with zipfile.ZipFile(folder / "Minimal.EPUB", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        z.writestr(
            "OEBPS/book.opf",
            '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><metadata><dc:title> On Rites </dc:title>'
            '<dc:creator opf:role="aut">A. One</dc:creator><dc:creator>B. Two</dc:creator><dc:creator opf:role="trl">C. Three</dc:creator><dc:date>1987-05-01</dc:date><dc:language>en</dc:language></metadata>'
            '<manifest><item id="f" href="front.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a%20one.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/>'
            '<item id="c" href="cover.xhtml" media-type="application/xhtml+xml"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest>'
            '<spine><itemref idref="c" linear="no"/><itemref idref="f"/><itemref idref="a"/><itemref idref="b"/></spine></package>',
        )
        z.writestr("OEBPS/toc.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Part</text></navLabel><content src="a%20one.xhtml"/><navPoint><navLabel><text>Chapter  One</text></navLabel><content src="a%20one.xhtml#top"/></navPoint></navPoint></navMap></ncx>')
        z.writestr("OEBPS/front.xhtml", doc.format("<p>Before.</p>"))
        z.writestr("OEBPS/a one.xhtml", doc.format('<h1 id="top">One</h1><div>First <i>text</i>.<a epub:type="noteref" href="#n1">1</a> <p>Inner.</p> tail</div><aside epub:type="footnote" id="n1"><p>The note.</p></aside>'))
        z.writestr("OEBPS/b.xhtml", doc.format("<p>Goes on.</p>loose"))
        z.writestr("OEBPS/cover.xhtml", doc.format("<p>Cover</p>"))
    (folder / "broken.epub").write_bytes(b"no zip")
    return str(folder)


def test_book(spark, book):
    rows = epub.read(spark, book)
    assert [tuple(r)[1:] for r in epub.metadata(rows).collect()] == [("On Rites", "A. One; B. Two", "en", "1987", None)]
    sections = [tuple(r)[1:] for r in epub.sections(rows).orderBy("section_idx").collect()]
    assert sections == [(0, "Front matter", "Before."), (1, "Chapter One", "One\n\nFirst text.[^n1]\n\nInner.\n\ntail\n\nGoes on.")]
    assert [tuple(r)[1:] for r in epub.footnotes(rows).collect()] == [("n1", "The note.")]
    assert [r.path.rsplit("/", 1)[1] for r in rows.where("kind = 'problem'").collect()] == ["broken.epub"]


def test_units_and_dispatch(spark):
    assert epub.units(None) == [] and epub.units("") == [] and epub.units("loose") == []
    assert [u[3] for u in epub.units("<div>a<p>b</p>c</div>")] == ["a", "b", "c"]
    assert [u[3] for u in epub.units("<p>open <b>never closed")] == ["open never closed"]
    df = spark.createDataFrame([("x/A.EPUB",), ("y.pdf",), ("z.txt",), ("none",)], "path string")
    assert [(r.suffix, r.supported) for r in epub.dispatched(df).collect()] == [(".epub", True), (".pdf", True), (".txt", False), ("", False)]
    assert epub.pdf_year("D:19990101") == "1999" and epub.pdf_year(None) is None
