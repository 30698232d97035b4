"""Bibliography entries parsed into fields (B1-B11): style by document, fields by entry, carried names between entries.

The head of an entry is an author list, found as the longest prefix that reads as one and leaves something that can follow
(a role, a quotation, a publication clause). Entries of a document whose style is not recognised keep their text only.
Null and blank entries give null fields; the text itself is never changed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits and patterns of the styles.
LEAST, RATIO, COVERAGE = 5, 2, 0.3
DASHES = "—–-"
YEAR_IN_PARENS = re.compile(r"\((\d{4})\)")
LAST_YEAR = re.compile(r"(\d{4})(?:[–—-]\d{2,4})?[¹²³⁴-⁹]?\.?(?:\s+\d+ pp?\.?)?\s*$")
AFTER_COLON = re.compile(r":\s*([ivxlc\d][ivxlc\d,.\-–—\s]*)")
CHAPTER = re.compile(r"^Pages?\s+([ivxlc\d][ivxlc\d,.\-–—\s]*?)\s+in\s+", re.I)
EDITED_BY = re.compile(r"Edited(?:\s+and\s+translated)?\s+by\s+", re.I)
PUBLICATION = re.compile(r"\s*(?:[^\W\d_a-z][^.:]*\d+\.\s+)?(?:[^\W\d_a-z][^.:]*:\s*)?[^\W\d_a-z][^.:]*[,.]\s*(\d{4})(?:[–—-]\d{2,4})?[¹²³⁴-⁹]?\.?(?:\s+\d+ pp?\.?)?\s*$")
ROLE = re.compile(r"^,?\s*(eds?|trans)\.,?\s*")
CREDIT = re.compile(r"Translated by|Edited by")
SERIES = (r"\bLCL\b", "Loeb Classical Library", "Ancient Christian Writers")

PARTICLE = r"(?:(?:de|du|des|von|van|ter|ten|den|der|della|di|da|dos|la|le|al|el) )*"
WORD = r"(?:(?:[A-ZÀ-ÞŁŠŽ]\.-?)+|[A-ZÀ-ÞŁŠŽ][\w’'\-]*)"
GIVEN = rf"{WORD}(?: {WORD}){{0,3}}"
SURNAME = rf"{PARTICLE}{WORD}(?: {WORD})?"
INVERTED = rf"{SURNAME} ?, {GIVEN}(?: {PARTICLE[:-1]})?"
NATURAL = rf"{GIVEN} {PARTICLE}{WORD}"
BODY = rf"(?:The )?(?:{WORD} )*(?:Academy|Acad\.|Institute|Inst\.|Centre|Center|Ctr\.|Society|Soc\.|Commission|Comm\.|University|Museum|Council)(?: (?:for|of|and|the|&|[A-Za-z]{{1,6}}[bcdfghjklmnpqrtvwxz]\.|[\w’'-]+))*"
FIRST = re.compile(rf"(?:{INVERTED}|{BODY}(?:, {WORD})?|{NATURAL}|{WORD}(?: {WORD}){{0,3}})")
ONE = re.compile(rf"{INVERTED}|{BODY}(?:, {WORD})?|{NATURAL}")
LINK = re.compile(r",? and |, ")


def name_list(text: str) -> list[str] | None:
    """The authors of a text that is an author list and nothing else."""
    if not (m := FIRST.match(text)):
        return None
    ends = [m.end()] + [i for i in range(m.end() - 1, 1, -1) if text[i : i + 1] in ",. " or text[i - 1] == "."]
    for end in ends:
        first, rest = text[:end], text[end:]
        if not rest:
            if ONE.fullmatch(first) or FIRST.fullmatch(first):
                return [first]
            continue
        if not FIRST.fullmatch(first):
            continue
        link = LINK.match(rest)
        if link and (more := name_list(rest[link.end() :])) and all(ONE.fullmatch(n) for n in more):
            return [first, *more]
    return None


def follows(rest: str) -> bool:
    """Whether this can stand behind an author list."""
    return rest.startswith("“") or bool(ROLE.match(rest)) or bool(PUBLICATION.search(rest) or LAST_YEAR.search(rest))


def heads(text: str) -> tuple[list[str], str] | None:
    """The author list at the start and the rest: the longest list that leaves what can follow, up to the title."""
    stops = [m for m in re.finditer(r"\. |, (?=(?:eds?|trans)\.)", text[:400])]
    quote = text.find("“")
    best = None
    for m in stops:
        if 0 <= quote < m.start():
            break
        end = m.start() + 1 if re.search(r"(?:^|[ .\-])[A-ZÀ-Þ]$", text[: m.start()]) and text[m.start()] == "." else m.start()
        for e in {m.start(), end}:
            names = name_list(text[:e])
            if names and follows(text[m.end() :]):
                best = (names, text[m.end() :])
    return best


def cleaned(pages: str) -> str:
    return re.sub(r"\s+", "", pages).rstrip(".")


def parsed(text: str | None) -> dict:
    """The fields of one entry; `carried` where it opens with a same-author mark, whose names the entry before gives."""
    out: dict = {"authors": [], "role": None, "translators": [], "editors": [], "title": None, "container": None, "year": None, "pages": None, "carried": False}
    text = re.sub(r"\s", " ", re.sub("[\u00ad\u200b-\u200d\u2060\ufeff]", "", text or "")).strip()
    mark = re.match(rf"([{DASHES}])\1*[.,:]?\s*", text)
    if mark and mark.end():
        out["carried"], rest = True, text[mark.end() :]
        if text[mark.end() - 2 : mark.end()].startswith(","):
            rest = ", " + rest
    elif head := heads(text):
        out["authors"], rest = head
    else:
        return out
    if role := ROLE.match(rest):
        rest = rest[role.end() :]
        if role.group(1) == "trans":
            out["translators"], out["authors"] = out["authors"], []
        out["role"] = role.group(1)
    if rest.startswith("“"):
        close = rest.rfind("”") if rest.count("“") == rest.count("”") == 1 else rest.find("”")
        if close < 0:
            return out
        out["title"], tail = rest[1:close].rstrip(".,"), rest[close + 1 :].strip()
        if year := YEAR_IN_PARENS.search(tail):
            out["year"], out["container"] = year.group(1), re.sub(r"\s+\d+\s*$", "", tail[: year.start()].strip())
            if pages := AFTER_COLON.search(tail[year.end() :]):
                out["pages"] = cleaned(pages.group(1))
        elif chapter := CHAPTER.match(tail):
            out["pages"], within = cleaned(chapter.group(1)), tail[chapter.end() :]
            credit, clause = EDITED_BY.search(within), PUBLICATION.search(within)
            out["container"] = within[: credit.start() if credit else clause.start() if clause else len(within)].rstrip(". ")
            if credit:
                out["editors"] = [n.strip() for n in re.split(r",? and |, ", re.split(r"\. (?=[A-ZÀ-Þ][\w-]+[:,])", within[credit.end() :])[0]) if ONE.fullmatch(n.strip().rstrip("."))]
        if out["year"] is None and (year := LAST_YEAR.search(tail)):
            out["year"] = year.group(1)
    else:
        clause = PUBLICATION.search(rest)
        out["title"] = (rest[: clause.start()] if clause else rest).rstrip(". ") or None
        if clause:
            out["year"] = clause.group(1)
    return out


FIELDS = "authors array<string>, role string, translators array<string>, editors array<string>, title string, container string, year string, pages string, carried boolean"


def parsed_entries(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`key` and the fields of each entry. Narrow."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([[k, *[p[n] for n in names]] for k, t in zip(part["key"], part["text"]) for p in [parsed(t)]], columns=["key", *names], dtype=object)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, {FIELDS}").withColumnRenamed("key", key)


def with_carried_names(entries: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Entries under a same-author mark get the names of the last entry that has some, as translators where their
    role says so."""
    named = F.concat("authors", "translators")
    last = F.last(F.when(~F.col("carried") & (F.size(named) > 0), named), ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order))
    as_translator = F.col("role") == "trans"
    filled = F.coalesce(last, F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return entries.withColumn("__n", filled).withColumns({
        "authors": F.when(F.col("carried") & ~F.coalesce(as_translator, F.lit(False)), F.col("__n")).when(F.col("carried"), none).otherwise(F.col("authors")),
        "translators": F.when(F.col("carried") & F.coalesce(as_translator, F.lit(False)), F.col("__n")).otherwise(F.col("translators")),
    }).drop("__n").withColumn("role", F.when(~F.coalesce(as_translator, F.lit(False)), F.col("role")))


def styles(entries: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """`doc`, entries, tail, head, mark, recognised: B1, A8, F17. Years behind the title against years behind the names,
    without the entries under a same-author mark; the most frequent mark, ties to the first by text."""
    plain = ~F.col(text).rlike(rf"^[{DASHES}]+[.,:]")
    tail = F.col(text).rlike(r"\b\d{4}[^\d]{0,3}(?:\s*\d+ pp?\.)?$|\(\d{4}\):")
    head = F.col(text).rlike(r"^[^“]{0,120}?\. \d{4}\. ")
    mark = F.when(~plain, F.regexp_extract(text, rf"^([{DASHES}]+)", 1))
    counted = entries.groupBy(doc).agg(F.count("*").alias("entries"), F.count_if(plain & tail).alias("tail"), F.count_if(plain & head).alias("head"))
    marks = entries.select(doc, mark.alias("mark")).where("mark is not null").groupBy(doc, "mark").agg(F.count("*").alias("n"))
    top = marks.withColumn("k", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("n"), "mark"))).where("k = 1").select(doc, "mark")
    known = (F.col("tail") >= LEAST) & (F.col("tail") > RATIO * F.col("head")) & (F.col("tail") >= COVERAGE * F.col("entries"))
    return counted.join(top, doc, "left").withColumn("recognised", known)


def classified(entries: DataFrame, text: str = "text") -> DataFrame:
    """Adds is_primary: B11, F16. Translated works, and works under one bare name whose text shows an edition's apparatus."""
    first = F.get("authors", F.lit(0))
    apparatus = F.col(text).rlike(CREDIT.pattern) | F.col(text).rlike("|".join(SERIES))
    bare = first.isNotNull() & ~F.contains(first, F.lit(",")) & apparatus
    return entries.withColumn("is_primary", (F.size("translators") > 0) | F.coalesce(bare, F.lit(False)))
