"""EPUB files as rows (SC1-SC8, T1-T3): files are read as binary, opened in Arrow batches with the standard library.

A file that is no EPUB, or broken, gives no rows and one in `problems`. Nothing is written to disk."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from posixpath import dirname, join, normpath
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags that hold a paragraph, note types, supported suffixes.
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote div".split())
NOTES = frozenset("footnote endnote rearnote doc-footnote doc-endnote".split())
NOTEREFS = frozenset("noteref doc-noteref".split())
SUFFIXES = (".epub", ".pdf")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

META = "title string, author string, lang string, year string, publisher string"
FILES = f"path string, kind string, position bigint, href string, label string, fragment string, html string, {META}"
UNITS = "tag string, unit_id string, classes string, text string, note_ref string"


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def opened(content: bytes) -> list[dict]:
    """The rows of one file: its metadata, its documents in reading order, its outline's leaves."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package_path = next(e.get("full-path") for e in container.iter() if local(e.tag) == "rootfile")
        package = ElementTree.fromstring(z.read(package_path))
        base = dirname(package_path)
        at = lambda href: normpath(join(base, unquote(href)))

        def first(name: str) -> str | None:
            found = next((e for e in package.iter() if local(e.tag) == name and (e.text or "").strip()), None)
            return found.text.strip() if found is not None else None

        role_of = {e.get("refines", "").lstrip("#"): (e.text or "").strip() for e in package.iter() if local(e.tag) == "meta" and e.get("property") == "role"}
        creators = []
        for e in package.iter():
            if local(e.tag) == "creator" and (e.text or "").strip():
                role = next((v for k, v in e.attrib.items() if local(k) == "role"), None) or role_of.get(e.get("id", ""))
                if role in (None, "", "aut"):
                    creators.append(e.text.strip())
        date = first("date") or ""
        out = [{"kind": "book", "title": first("title"), "author": "; ".join(creators) or None, "lang": first("language"), "year": date[:4] if date[:4].isdigit() and len(date) >= 4 else None, "publisher": first("publisher")}]
        manifest = {e.get("id"): e for e in package.iter() if local(e.tag) == "item"}
        spine = [e for e in package.iter() if local(e.tag) == "itemref" and e.get("linear") != "no" and e.get("idref") in manifest]
        paths = [at(manifest[e.get("idref")].get("href")) for e in spine if manifest[e.get("idref")].get("media-type") == "application/xhtml+xml"]
        out += [{"kind": "document", "position": n, "href": p, "html": z.read(p).decode("utf-8", "replace")} for n, p in enumerate(paths)]
        ncx = next((e for e in manifest.values() if e.get("media-type") == "application/x-dtbncx+xml"), None)
        if ncx is not None:
            ncx_path = at(ncx.get("href"))
            tree = ElementTree.fromstring(z.read(ncx_path))
            points = [e for e in tree.iter() if local(e.tag) == "navPoint" and not any(local(c.tag) == "navPoint" for c in e)]
            for n, e in enumerate(points):
                label = " ".join("".join(t.text or "" for x in e if local(x.tag) == "navLabel" for t in x.iter() if local(t.tag) == "text").split())
                src = next((x.get("src") for x in e if local(x.tag) == "content"), None)
                if label and src:
                    href, _, fragment = src.partition("#")
                    out.append({"kind": "leaf", "position": n, "href": normpath(join(dirname(ncx_path), unquote(href))), "label": label, "fragment": fragment})
    return out


class Units(HTMLParser):
    """The paragraph units of a document, in order: text under a block tag, cut where a block begins or ends; inline tags
    are seen through; text outside every block is dropped. Notes (by `epub:type` or `role`) come out as units with a ref,
    and references to them as `[^ref]`."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str, str, str | None]] = []
        self.open: list[dict] = []
        self.buffer: list[str] = []
        self.skip = 0

    def owner(self) -> dict | None:
        return next((t for t in reversed(self.open) if t["tag"] in BLOCKS or t["note"]), None)

    def note(self) -> dict | None:
        return next((t for t in self.open if t["note"]), None)

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        owner, note = self.owner(), self.note()
        if not text or owner is None:
            return
        if note is not None:
            note["text"].append(text)
        else:
            self.out.append((owner["tag"], owner["id"], owner["class"], text, None))

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        types = set(a.get("epub:type", "").split()) | set(a.get("role", "").split())
        if self.skip:
            self.skip += tag not in VOID
            return
        if types & NOTEREFS:
            self.buffer.append(f"[^{a.get('href', '').rpartition('#')[2]}]")
            self.skip = 1
            return
        note = bool(types & NOTES) and self.note() is None
        if tag in BLOCKS or note:
            self.flush()
        if tag not in VOID:
            self.open.append({"tag": tag, "id": a.get("id", ""), "class": a.get("class", ""), "note": note, "text": []})

    def handle_endtag(self, tag):
        if self.skip:
            self.skip -= tag not in VOID
            return
        if not any(t["tag"] == tag for t in self.open):
            return
        while self.open:
            top = self.open[-1]
            if top["tag"] in BLOCKS or top["note"]:
                self.flush()
            self.open.pop()
            if top["note"]:
                self.out.append((top["tag"], top["id"], top["class"], " ".join(top["text"]), top["id"]))
            if top["tag"] == tag:
                break

    def handle_data(self, data):
        if not self.skip:
            self.buffer.append(data)

    def close(self):
        super().close()
        while self.open:
            self.handle_endtag(self.open[-1]["tag"])


def units(html: str | None) -> list[tuple[str, str, str, str, str | None]]:
    """(tag, id, classes, text, note ref) of a document's units."""
    if not html:
        return []
    parser = Units()
    parser.feed(html)
    parser.close()
    return parser.out


def dispatched(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds suffix and supported: SC1, SC2, by the lower-cased ending."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return files.withColumn("suffix", suffix).withColumn("supported", suffix.isin(*SUFFIXES))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind (`book`, `document`, `leaf`, `problem`) and their columns, of all `.epub` files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    names = [c.split()[0] for c in FILES.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"]):
                try:
                    rows += [{"path": path, **r} for r in opened(content)]
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
                    rows.append({"path": path, "kind": "problem", "label": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return files.mapInPandas(run, FILES)


def blocks(documents: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """`keep`, unit_no and a unit's columns, one row per unit of each document. Narrow."""
    kind = "array<struct<" + ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in UNITS.split(", ")) + ">>"
    names = [c.split()[0] for c in UNITS.split(", ")]

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, u)) for u in units(h)] for h in s], dtype=object)

    rows = documents.select(*keep, F.pandas_udf(run, kind)(F.col(html)).alias("u"))
    return rows.select(*keep, F.posexplode("u").alias("unit_no", "x")).select(*keep, "unit_no", "x.*")


def sections(rows: DataFrame) -> DataFrame:
    """path, section_idx, title, text: T4. Documents under the outline's leaves; one without a leaf goes on with the leaf
    before it (W10), those before the first are front matter; a book without outline is one section, "Full text"."""
    from pyspark.sql import Window

    documents = rows.where("kind = 'document'").select("path", "position", "href", "html")
    leaves = rows.where("kind = 'leaf'").groupBy("path", "href").agg(F.min_by("label", "position").alias("label"))
    joined = documents.join(leaves, ["path", "href"], "left")
    order = Window.partitionBy("path").orderBy("position")
    named = joined.withColumn("section_idx", F.count("label").over(order)).withColumn("own", F.last("label", ignorenulls=True).over(order)).withColumn("any", F.max("label").over(Window.partitionBy("path")))
    title = F.when(F.col("any").isNull(), "Full text").when(F.col("own").isNull(), "Front matter").otherwise(F.col("own"))
    parts = blocks(named.withColumn("title", title), "path", "section_idx", "title", "position").where("note_ref is null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "unit_no", "text"))), lambda x: x["text"]), "\n\n")
    return parts.groupBy("path", "section_idx", "title").agg(text.alias("text"))


def footnotes(rows: DataFrame) -> DataFrame:
    """path, ref, text: T2, the notes of all documents."""
    return blocks(rows.where("kind = 'document'"), "path").where("note_ref is not null").select("path", F.col("note_ref").alias("ref"), "text")


def metadata(rows: DataFrame) -> DataFrame:
    """path and the book's metadata: SC5."""
    return rows.where("kind = 'book'").select("path", "title", "author", "lang", "year", "publisher")


def pdf_year(date: str | None) -> str | None:
    """SC10: the year of a PDF date."""
    found = re.match(r"D:(\d{4})", date or "")
    return found.group(1) if found else None
