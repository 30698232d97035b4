"""Citations: found by siglum and locator, spoken in words.

A scan goes through a text once, from word start to word start. At each it tries the sigla that stand there, the longest
first, then by the priority of their systems; the first whose locator shape fits is the citation, and the scan goes on
behind it. Document numbers of caves, which have no siglum, are tried last. The vocabulary is a driver-side list with a
checked bound; the scan runs in Arrow batches over whole texts and never compares texts with texts.
Null texts give null; texts without citations come back as they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.vocabularies import SCROLLS, pairs, vocabulary

MOST_SIGLA = 200_000
CONTEXT = 30

# Locator shapes; a range dash may be followed by a zero-width space.
DASH = "[-–−]​?"
NUMBER = r"\d+(?:[.:]\d+)*"
SHAPES = {"number": f"{NUMBER}(?:{DASH}{NUMBER})?", "stephanus": rf"\d+[a-e]\d*(?:{DASH}\d+[a-e]\d*)?", "fragment": r"\d+\s?[AB]\s?\d+"}
NAMED = dict(pairs(SCROLLS))
CAVE = re.compile(rf"(\d{{1,2}})Q({'|'.join(sorted(NAMED, key=len, reverse=True))}|\d{{1,4}})([a-z]?)(?: ({SHAPES['number']}))?\b")

ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def in_words(n: int) -> str:
    """Groups of three digits from the left, each spelled, then "thousand" as often as groups follow."""
    if n < 20:
        return ONES[n]
    said = []
    if n >= 1000:
        said.append(in_words(n // 1000) + " thousand")
        n %= 1000
    if n >= 100:
        said.append(ONES[n // 100] + " hundred")
        n %= 100
    if 0 < n < 20:
        said.append(ONES[n])
    elif n:
        said.append(TENS[n // 10 - 2] + ("-" + ONES[n % 10] if n % 10 else ""))
    return " ".join(said)


def by_digit(digits: str) -> str:
    """E2."""
    return "-".join(ONES[int(d)] for d in digits)


SAID = {".": ", ", ":": ", ", "-": " to ", "–": " to ", "−": " to "}


def number_locator(locator: str) -> str:
    """E4."""
    return re.sub(r"\d+|.", lambda m: in_words(int(m.group())) if m.group()[0].isdigit() else SAID.get(m.group(), ""), locator)


def stephanus_locator(locator: str) -> str:
    """E5: page, letter, line; ranges with "to"."""
    return " to ".join(in_words(int(page)) + f" {letter.upper()}" + (f", {in_words(int(line))}" if line else "") for page, letter, line in re.findall(r"(\d+)([a-e])(\d*)", locator))


def fragment_locator(locator: str) -> str:
    """Chapter, letter, item."""
    return ", ".join(in_words(int(x)) if x.isdigit() else x for x in re.findall(r"\d+|[AB]", locator))


def cave_document(found: re.Match) -> str:
    """Cave by digit, the scroll's name or its number by digit, the copy's letter, the locator."""
    cave, document, copy, locator = found.groups()
    said = f"{by_digit(cave)} Q, {NAMED.get(document) or by_digit(document)}"
    return said + (f" {copy.upper()}" if copy else "") + (f", {number_locator(locator)}" if locator else "")


SPEAK = {"number": number_locator, "stephanus": stephanus_locator, "fragment": fragment_locator}
TAILS = {k: re.compile(rf"[,.]? ({v}(?:[;,] {v})*)\b") for k, v in SHAPES.items()}
UNITS = {k: re.compile(v) for k, v in SHAPES.items()}
WORD_START = re.compile(r"\b(?=\w)")
NEAR_GAP = re.compile(r"[,.\s]{0,2}\d")


class Scanner:
    def __init__(self, entries: list[tuple[str, int, int, str, str, str]]):
        if len(entries) > MOST_SIGLA:
            raise ValueError(f"{len(entries)} sigla: over the bound of {MOST_SIGLA}")
        self.by_start: dict[str, list[tuple]] = defaultdict(list)
        for e in sorted(entries, key=lambda e: (-len(e[3]), e[1], e[2])):
            if e[3]:
                self.by_start[e[3][:2]].append(e)

    def find(self, text: str) -> list[tuple[int, int, str, str, str]]:
        """(start, end, system, siglum, spoken) of the citations, left to right."""
        out, after = [], 0
        for m in WORD_START.finditer(text):
            at = m.start()
            if at < after:
                continue
            for system, _, _, siglum, spoken, shape in self.by_start.get(text[at : at + 2], ()):
                if text.startswith(siglum, at) and (tail := TAILS[shape].match(text, at + len(siglum))):
                    units = [SPEAK[shape](u) for u in UNITS[shape].findall(tail.group(1))]
                    out.append((at, tail.end(), system, siglum, f"{spoken} {'; '.join(units)}"))
                    after = tail.end()
                    break
            else:
                if text[at].isdigit() and (found := CAVE.match(text, at)):
                    out.append((at, found.end(), "qumran", "Q", cave_document(found)))
                    after = found.end()
        return out

    def speak(self, text: str | None) -> str | None:
        """T9."""
        if not text:
            return text
        parts, at = [], 0
        for start, end, _, _, spoken in self.find(text):
            parts += [text[at:start], spoken]
            at = end
        return "".join(parts) + text[at:] if parts else text

    def near(self, text: str | None) -> list[tuple[str, str, str]]:
        """(system, siglum, context) of sigla with a digit close by that are part of no citation; a place once, for
        the longest siglum."""
        if not text:
            return []
        covered = [(a, b) for a, b, *_ in self.find(text)]
        hits: dict[tuple[int, int], tuple] = {}
        for m in WORD_START.finditer(text):
            at = m.start()
            for entry in self.by_start.get(text[at : at + 2], ()):
                siglum = entry[3]
                end = at + len(siglum)
                if not text.startswith(siglum, at) or (at, end) in hits or any(a < end and at < b for a, b in covered):
                    continue
                # The siglum ends a word, or a digit follows at once.
                whole = (text[end - 1].isalnum() or text[end - 1] == "_") != (end < len(text) and (text[end].isalnum() or text[end] == "_"))
                if (whole or text[end : end + 1].isdigit()) and NEAR_GAP.match(text[end : end + 8]):
                    hits[(at, end)] = entry
        order = sorted(hits.items(), key=lambda x: (-len(x[1][3]), x[1][1], x[1][2], x[0]))
        return [(e[0], e[3], " ".join(text[max(0, a - CONTEXT) : b + CONTEXT].split())) for (a, b), e in order]


def _scan(df: DataFrame, key: str, text: str, make, fields: str, entries) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(entries or vocabulary())
    names = [f.split()[0] for f in fields.split(", ")]
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(shared.value)
        for part in parts:
            out = [(k, *row) for k, t in zip(part["key"], part["text"]) for row in make(scanner, t)]
            yield pd.DataFrame(out, columns=["key", *names])

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, {fields}").withColumnRenamed("key", key)


def citations(df: DataFrame, key: str, text: str = "text", entries=None) -> DataFrame:
    """`key`, start_at, end_at, system, siglum, spoken: one row per citation. Narrow."""
    return _scan(df, key, text, lambda s, t: s.find(t), "start_at bigint, end_at bigint, system string, siglum string, spoken string", entries)


def near_misses(df: DataFrame, key: str, text: str = "text", entries=None) -> DataFrame:
    """`key`, system, siglum, context: one row per near miss. Narrow."""
    return _scan(df, key, text, lambda s, t: s.near(t), "system string, siglum string, context string", entries)


def spoken(text: Column, entries=None) -> Column:
    """The text with its citations in words, as a column."""
    entries = entries or vocabulary()

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(entries)
        for part in parts:
            yield part.map(scanner.speak)

    return run(text)
