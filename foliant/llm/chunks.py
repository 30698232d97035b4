"""Splitting oversized texts at natural boundaries (problem 6).

Method: structure-tree packing. A text is parsed into a tree: headings with what follows them, blocks between blank
lines, list items and lines, sentences, clauses, words, characters. Sibling subtrees are merged, first to last, up to
the limit; only a node that is too long itself is descended into. Each piece after the first repeats about the last
`overlap` characters of the text before it, from a word's start, as far as the limit leaves room.

`kind` is the deepest level descended into: `sentence`, `clause`, `word` or `char`; null where the text needs no cut.
Defined results: null and blank texts give no piece; a text up to the limit is one piece; lengths are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.sentences import spans
from foliant.sources.tables import table

LIMIT, OVERLAP = 380, 40
KINDS = ("sentence", "clause", "word", "char")
# Marks that end a clause when white space follows; full-width ones always do.
CLAUSE = re.compile(r"[,;:·،؛፣፤፥፦՝՚;·](?=\s)|[，；：、､﹐﹔﹕]")
HEADING = re.compile(r"^(#{1,6})\s+\S|^([IVXLCDM]+\.|\d+(?:\.\d+)*\.?)\s+\S[^\n]{0,80}$")
ITEM = re.compile(r"^\s*(?:[-*•–—]|\d{1,3}[.)]|[a-z][.)])\s+\S", re.M)
Span = tuple[int, int]


def trimmed(text: str, a: int, b: int) -> Span:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def cut_at(text: str, span: Span, places: list[int]) -> list[Span]:
    edges = [span[0], *[p for p in places if span[0] < p < span[1]], span[1]]
    parts = [trimmed(text, a, b) for a, b in zip(edges, edges[1:])]
    return [p for p in parts if p[0] < p[1]]


class Tree:
    """The levels of one text; `children(span, level)` gives a node's children one level down."""

    LEVELS = ("section", "block", "line", "sentence", "clause", "word", "char")

    def __init__(self, text: str, sentences: list[Span]):
        self.text, self.sentences = text, sentences
        self.begins = {a for a, _ in sentences}

    def children(self, span: Span, level: str, room: int) -> list[Span]:
        text, (a, b) = self.text, span
        if level == "section":  # a heading opens a subtree
            lines = [m.start() for m in re.finditer(r"^.+$", text[a:b], re.M)]
            return cut_at(text, span, [a + p for p in lines if a + p in self.begins and HEADING.match(text[a + p : b].split("\n", 1)[0])])
        if level == "block":
            return cut_at(text, span, [a + m.end() for m in re.finditer(r"\n[^\S\n]*\n", text[a:b])])
        if level == "line":  # only list items stand alone; other line ends are layout
            return cut_at(text, span, [p for m in ITEM.finditer(text[a:b]) if (p := trimmed(text, a + m.start(), b)[0]) in self.begins]) if "\n" in text[a:b] else [span]
        if level == "sentence":
            return cut_at(text, span, [s for s, _ in self.sentences])
        if level == "clause":
            return cut_at(text, span, [a + m.end() for m in CLAUSE.finditer(text[a:b])])
        if level == "word":
            return [(a + m.start(), a + m.end()) for m in re.finditer(r"\S+", text[a:b])]
        return cut_at(text, span, list(range(a + room, b, room)))


def pieces(text: str, sentences: list[Span], limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], str | None]:
    """((overlap start, start, end) of each piece, kind)."""
    tree, deepest = Tree(text, sentences), -1
    whole = trimmed(text, 0, len(text))
    if whole[0] == whole[1]:
        return [], None
    if whole[1] - whole[0] <= limit:
        return [(whole[0], *whole)], None

    def pack(span: Span, level: int, out: list[Span]) -> None:
        """Appends the subtree's units, merged with the last ones of `out` by the caller."""
        nonlocal deepest
        if span[1] - span[0] <= limit:
            out.append(span)
            return
        name = Tree.LEVELS[level]
        deepest = max(deepest, level)
        merged: list[Span] = []
        for child in tree.children(span, name, limit - overlap):
            if child[1] - child[0] > limit:
                pack(child, level + 1, merged)
            else:
                # Siblings are merged up to what a piece holds besides its overlap; the very first piece has none.
                room = limit if merged and merged[-1][0] == whole[0] else limit - overlap - 1
                if merged and child[1] - merged[-1][0] <= room:
                    merged[-1] = (merged[-1][0], child[1])
                else:
                    merged.append(child)
        out += merged

    units: list[Span] = []
    pack(whole, 0, units)
    out = []
    for k, (a, b) in enumerate(units):
        start = a
        if k:
            least = max(units[k - 1][0], a - overlap, b - limit)
            start = least
            while start < a and start > 0 and not text[start - 1].isspace() and not text[start].isspace():
                start += 1  # to the start of a word
            while start < a and text[start].isspace():
                start += 1
            if start >= a and not re.search(r"\s", text[least:a]):
                start = least  # a run without white space: any character will do
        out.append((start, a, b))
    return out, KINDS[max(deepest - 3, 0)]


def chunks(df: DataFrame, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """`key`, piece_no, kind, from_at, start_at, end_at, piece: `piece` is the text from from_at to end_at, of which
    the characters before start_at repeat the piece before. Narrow; sentences are found in SQL expressions."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, t, found in zip(part["key"], part["text"], part["spans"]):
                own, kind = pieces(t, [(s["start_at"], s["end_at"]) for s in found] if found is not None else [], limit, overlap)
                out += [(k, n, kind, f, a, b, t[f:b]) for n, (f, a, b) in enumerate(own)]
            yield pd.DataFrame(out, columns=["key", "piece_no", "kind", "from_at", "start_at", "end_at", "piece"])

    long = F.length(text) > limit
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.when(long, spans(F.when(long, F.col(text)))).alias("spans"))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(cut, f"key {kind}, piece_no bigint, kind string, from_at bigint, start_at bigint, end_at bigint, piece string").withColumnRenamed("key", key)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """utt_id, kind of the utterances whose text has over 380 code points."""
    long = table(spark, folder, "utterances").where(F.length("text") > LIMIT)
    return chunks(long, "utt_id").where("piece_no = 0").select("utt_id", F.coalesce("kind", F.lit("sentence")).alias("kind")).distinct()


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """utt_id, piece_no, kind, from_at, start_at, end_at, piece of all utterances."""
    return chunks(table(spark, folder, "utterances"), "utt_id").distinct()
