"""What a model is asked for, behind a protocol: respoken notes (T8) and language switches.

A provider answers a request with pieces, or with none when it cannot. What it says is never trusted over the author's
text: pieces that do not give the paragraph back word for word are dropped for the plain weave, and a switch whose text is
not found is no switch. Only an offline provider comes with the library; hosted ones are the caller's."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.scripts import ANCHOR, _map, woven

Piece = tuple[str, str]  # text, manner
PIECES = "array<struct<text string, manner string>>"
INVISIBLE = re.compile("[­​-‍⁠﻿]")


class Provider(Protocol):
    """`label` names the model in cache keys and usage logs; `ask` gives the pieces of a paragraph with its notes, or None."""

    label: str

    def ask(self, paragraph: str, notes: dict[str, str]) -> list[Piece] | None: ...


class Offline:
    """Speaks the notes as they are, at the ends of their sentences; deterministic, without a network."""

    label = "offline"

    def ask(self, paragraph: str, notes: dict[str, str]) -> list[Piece] | None:
        return [(text, manner) for text, manner, _ in woven(paragraph, notes)]


def plain(text: str) -> str:
    return " ".join(INVISIBLE.sub("", text).split())


def faithful(paragraph: str, pieces: list[Piece]) -> bool:
    """the body pieces in a row are the paragraph without its anchors, white space and invisible characters aside."""
    said = [plain(text) for text, manner in pieces if manner == "body"]
    return " ".join(s for s in said if s) == plain(ANCHOR.sub("", paragraph))


def gloss_key(label: str, paragraph: Column, notes: Column) -> Column:
    """The cache key: model, paragraph and notes, nothing else."""
    return F.sha2(F.to_json(F.struct(F.lit(label).alias("label"), paragraph.alias("paragraph"), notes.alias("notes"))), 256)


def glossed(paragraphs: DataFrame, key: str, provider: Provider, cache: DataFrame | None = None) -> DataFrame:
    """`key`, gloss_key, pieces, origin (`cache`, `model`, `verbatim`, `plain`): T8, J11. `paragraphs` holds key, paragraph and
    notes (array<struct<ref, text>>). Known keys come from `cache` (gloss_key, pieces) by a left join; the provider is asked
    in batches for the others; answers that are not faithful and paragraphs without one are woven as they are."""
    rows = paragraphs.select(F.col(key).alias("key"), "paragraph", F.coalesce("notes", F.expr("array()").cast("array<struct<ref:string,text:string>>")).alias("notes"))
    rows = rows.where("paragraph is not null").withColumn("gloss_key", gloss_key(provider.label, F.col("paragraph"), F.col("notes")))
    known = cache.select("gloss_key", F.col("pieces").cast(PIECES).alias("cached")).dropDuplicates(["gloss_key"]) if cache is not None else None
    rows = rows.join(known, "gloss_key", "left") if known is not None else rows.withColumn("cached", F.lit(None).cast(PIECES))
    kind = paragraphs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, gk, text, listed, cached in part[["key", "gloss_key", "paragraph", "notes", "cached"]].itertuples(index=False):
                notes = {n["ref"]: n["text"] for n in listed}
                pieces, origin = [(p["text"], p["manner"]) for p in cached] if cached is not None else None, "cache"
                if not ANCHOR.search(text):
                    pieces, origin = [(text, "body")], "plain"
                elif pieces is None:
                    pieces, origin = provider.ask(text, notes), "model"
                    if pieces is None or not faithful(text, pieces):
                        pieces, origin = [(t, m) for t, m, _ in woven(text, notes)], "verbatim"
                out.append([k, gk, [{"text": t, "manner": m} for t, m in pieces if t.strip()], origin])
            yield pd.DataFrame(out, columns=["key", "gloss_key", "pieces", "origin"], dtype=object)

    return rows.mapInPandas(run, f"key {kind}, gloss_key string, pieces {PIECES}, origin string").withColumnRenamed("key", key)


def place(text: str, said: str) -> tuple[int, int] | None:
    """Where the switch stands: word for word, or with other white space."""
    if not said.strip():
        return None
    at = text.find(said)
    if at >= 0:
        return at, at + len(said)
    found = re.search(r"\s+".join(map(re.escape, said.split())), text)
    return found.span() if found else None


def switched(text: str, lang: str, switches: list[tuple[str, str]]) -> list[Piece]:
    """(text, lang) of the pieces; switches are placed in the order given, later ones that overlap are dropped."""
    spans: list[tuple[int, int, str]] = []
    for said, own in switches:
        span = place(text, said)
        if span and not any(a < span[1] and span[0] < b for a, b, _ in spans):
            spans.append((*span, own.lower()))
    if not spans:
        return [(text, lang)]
    out, at = [], 0
    for a, b, own in sorted(spans):
        out += [(text[at:a].strip(), lang), (text[a:b], own)]
        at = b
    out.append((text[at:].strip(), lang))
    return [p for p in out if p[0]]


def switched_column(text: Column, switches: Column) -> Column:
    """array<struct<text, lang>> of an English utterance and its array<struct<text, lang>> of switches."""
    f: Callable = lambda t, s: [{"text": x, "lang": y} for x, y in switched(t, "en", [(i["text"], i["lang"]) for i in s if i["text"] and i["lang"]])]
    return _map(f, "array<struct<text string, lang string>>", text, switches)
