"""Evaluation passages inside training documents (problem 8).

Method: the n-grams of the normalised test items form a hash set that is broadcast (the items are a fixed, checked
number); every document is normalised the same way, its token windows are looked up, and each (document, item) with
enough hits is verified by aligning the two texts. Verified spans can be cut out of the text (`remove_spans`).

A hit (w words at item position i, document position j) belongs to a stretch; a stretch may bend by small changes of
wording. The leak is the largest number of item words that at most three stretches hold in order; words equal at the same
place count, and so do single changed words between two equal ones.
Defined results: null and blank texts and items have no leaks; an item twice in a document is one leak.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from foliant.llm.lookalike import CLASSES
from foliant.sources.tables import table

WINDOW = 4  # words of a window
STRETCHES = 3
BEND = 3  # words that a stretch may lose, gain or change at a time
SHORTEST = 8  # words a stretch holds at least; sentence patterns that all texts share give shorter ones
SHARE = 0.4
CANDIDATE = 0.15  # windows found per word of the item, from which the texts are aligned
#: The broadcast set holds at most this many words of items; more are refused, not cut.
MOST_WORDS = 5_000_000


class Folded(dict):
    """Translation of code points to lower-case base letters, white space for everything between words."""

    def __missing__(self, point: int) -> str:
        out = ""
        for c in CLASSES[chr(point)]:
            c = c.casefold()
            kinds = {unicodedata.category(x)[0] for x in c}
            out += c if kinds <= {"L", "N"} else "" if kinds <= {"M"} or c in "'’" else " "
        self[point] = out
        return out


FOLDED = Folded()


def words(text: str | None) -> list[str]:
    return text.translate(FOLDED).split() if text else []


class Index:
    """Windows of all items by hash, with their places."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = {}
        self.items: dict[int, np.ndarray] = {}
        places = []
        for item, text in items:
            own = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)], dtype=np.int64)
            self.items[item] = own
            places += [(h, item, i) for i, h in enumerate(self.hashes(own).tolist())]
        places.sort()
        self.hash = np.array([p[0] for p in places], dtype=np.int64)
        self.item = np.array([p[1] for p in places], dtype=np.int64)
        self.at = np.array([p[2] for p in places], dtype=np.int64)
        self.keys = np.unique(self.hash)

    @staticmethod
    def hashes(ids: np.ndarray) -> np.ndarray:
        """0 where a window holds a word that no item has."""
        if len(ids) < WINDOW:
            return np.zeros(0, dtype=np.int64)
        n = len(ids) - WINDOW + 1
        out, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
        for k in range(WINDOW):
            part = ids[k : k + n]
            known &= part > 0
            out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.where(known, out.view(np.int64) | 1, 0)

    def scan(self, ids: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, share, first word, last word + 1) of the leaks in a document."""
        found = self.hashes(ids)
        hit = np.flatnonzero(found)
        if not len(hit) or not len(self.keys):
            return []
        hit = hit[self.keys[np.minimum(np.searchsorted(self.keys, found[hit]), len(self.keys) - 1)] == found[hit]]
        low, high = np.searchsorted(self.hash, found[hit]), np.searchsorted(self.hash, found[hit], "right")
        n = high - low
        if not n.sum():
            return []
        places = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        at, item, i = np.repeat(hit, n), self.item[places], self.at[places]
        out = []
        own_ids, count = np.unique(item, return_counts=True)
        for own in own_ids[count >= CANDIDATE * np.array([len(self.items[x]) for x in own_ids.tolist()])]:
            mine = item == own
            if len(np.unique(i[mine])) >= CANDIDATE * len(self.items[own]) and (leak := self.verify(own, i[mine], at[mine], ids)):
                out.append((int(own), *leak))
        return out

    def verify(self, item: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> tuple[float, int, int] | None:
        size = len(self.items[item])
        stretches = self.stretches(i, j)
        best: list[list[tuple[int, int, int]]] = []  # per stretch, by number of stretches up to it: words, first and last place
        top = (0, 0, 0)
        for i0, i1, j0, j1, held in stretches:
            own = [(held, j0, j1)]
            for count in range(STRETCHES - 1):
                before = [(b[count][0] + max(0, held - max(0, s[1] - i0, s[3] - j0)), b[count][1], j1) for b, s in zip(best, stretches) if len(b) > count and s[0] < i0 and s[1] < i1 and s[2] < j0 and s[3] < j1]
                if not before:
                    break
                own.append(max(before))
            best.append(own)
            top = max(top, *own)
        return (top[0] / size, top[1], top[2]) if top[0] >= SHARE * size else None

    def stretches(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(first and last item word, first and last document word, item words held), by document place."""
        open_: list[list[int]] = []
        done = []
        for a, b in sorted(zip(i.tolist(), j.tolist()), key=lambda p: (p[1], p[0])):
            rest, into = [], None
            for s in open_:
                if b - s[3] > BEND:
                    done.append(s)
                else:
                    rest.append(s)
                    if s[1] - WINDOW < a <= s[1] + BEND and s[3] - WINDOW < b and (into is None or abs((a - s[1]) - (b - s[3])) < abs((a - into[1]) - (b - into[3]))):
                        into = s
            open_ = rest
            if into is None:
                open_.append([a, a + WINDOW, b, b + WINDOW, WINDOW])
            else:
                gap = max(0, a - into[1])
                into[4] += min(WINDOW, a + WINDOW - into[1]) + (gap if gap <= 2 and abs(gap - (b - into[3])) <= 1 else 0)
                into[1], into[3] = a + WINDOW, max(into[3], b + WINDOW)
        return sorted((tuple(s) for s in done + open_ if s[4] >= SHORTEST), key=lambda s: (s[2], s[0]))

    def documents(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int]]]:
        get = self.ids.get
        return [self.scan(np.fromiter(map(get, w, repeat(0)), dtype=np.int64, count=len(w))) if (w := words(t)) else [] for t in texts]


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """`item_id`, `doc_id`, `share`, `first_word`, `last_word` of every leak. Narrow over the documents; the items,
    whose total size is checked, are broadcast."""
    spark = documents.sparkSession
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    size = rows.selectExpr("sum(length(text))").first()[0] or 0
    if size > MOST_WORDS * 6:
        raise ValueError(f"{size} characters of test items: scan them in parts")
    shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in rows.collect()])

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(shared.value)
        for part in parts:
            out = [(item, doc, share, first, last) for doc, found in zip(part["doc_id"], index.documents(part["text"].tolist())) for item, share, first, last in found]
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "share", "first_word", "last_word"])

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(scan, "item_id bigint, doc_id bigint, share double, first_word bigint, last_word bigint")


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (word numbers, end exclusive), white space around them kept once."""
    places, offset = [], 0
    for m in re.finditer(r"\S+", text):
        n = len(words(m.group()))
        places.append((offset, offset + n, m.start(), m.end()))
        offset += n
    cut = [(p[2], p[3]) for p in places if p[1] > p[0] and any(a < p[1] and p[0] < b for a, b in spans)]
    out, at = [], 0
    for a, b in cut:
        out.append(text[at:a])
        at = b
    return re.sub(r"[^\S\n]{2,}", " ", "".join(out) + text[at:]).strip()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, doc_id of every leak in all documents."""
    documents = table(spark, folder, "documents")
    return leaks(documents, table(spark, folder, "test_items")).select("item_id", "doc_id").distinct()
