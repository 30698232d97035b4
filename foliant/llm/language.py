"""Languages of texts and of the stretches inside them (problem 5).

Method: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy, and
calibrated rejection. A word is the mean of the embeddings of its hashed character n-grams, a text the mean of its
words; since the softmax is linear, a text's scores are the mean of its words' scores, so each distinct word is scored
once. Stretches are found by the most likely path over the words' scores at a fixed cost for each change of language.

The labels are the lang fields themselves, brought to one notation. They are wrong in places: the model is trained,
rows it contradicts are left out, and it is trained again. The temperature is fitted on rows held out; texts whose
confidence is below the threshold are rejected (no language is claimed).

Bounds: PER_LANGUAGE labelled rows a language and table, chosen by hash, train the model (some megabytes, broadcast);
every text is scored whole. Defined results: null, blank, short and wordless texts get no language.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.lookalike import by_table
from foliant.sources.tables import table

LANGUAGES = "en de fr it es pt nl la grc ru he ar hi hy am zh ja".split()
# Notations of the languages (codes of two and three letters, names); what follows - or _ is a region or script.
NOTATIONS = {
    "en": "eng english englisch anglais inglese", "de": "deu ger german deutsch allemand tedesco", "fr": "fra fre french français francais französisch", "it": "ita italian italiano italienisch", "es": "spa spanish español espanol castilian",
    "pt": "por portuguese português portugues", "nl": "nld dut dutch nederlands", "la": "lat latin latein latina latine", "grc": "el ell gre greek ancientgreek griechisch", "ru": "rus russian русский russisch", "he": "heb hebrew iw ivrit hbo עברית", "ar": "ara arabic العربية arabisch",
    "hi": "hin hindi हिन्दी", "hy": "hye arm armenian xcl հայերեն", "am": "amh amharic አማርኛ", "zh": "zho chi chinese cmn mandarin lzh 中文 汉语", "ja": "jpn japanese jp 日本語",
}
CODES = {x: code for code, names in NOTATIONS.items() for x in [code, *names.split()]}

PER_LANGUAGE = 600
BUCKETS, WIDTH = 1 << 15, 20
EPOCHS, RATE, BATCH = 5, 1.5, 128
LEAST_ROWS = 400
CONFIDENCE = 0.6
CLEAR = 0.95  # confidence from which a long text's mean needs no look at its windows
MARGIN = 1.0  # by which each of FEWEST_WORDS words of a stretch must favour its language over the main one
CHANGE = 7.0  # nats that a change of language costs
FEWEST_WORDS, FEWEST_LETTERS = 4, 12
LONG = 25  # letters from which a run without spaces is read as unspaced writing

UNSPACED = r"぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
#: A word of spaced writing (letters, marks and invisible characters inside) or one character of unspaced writing.
WORD = re.compile(rf"[{UNSPACED}]|[^\W\d_{UNSPACED}](?:[^\W\d_{UNSPACED}]|[\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f\u0962-\u0963\u200b-\u200d\u2060\u00ad\ufeff])*")
PLAIN_WORD = re.compile(r"[^\W\d_]+")
#: Characters for which a word takes more than a run of letters.
HARD = re.compile(r"[\u00ad\u0300-\u036f\u0590-\u1fff\u200b-\u200d\u2060\u2e80-\uffff]")
INVISIBLE = re.compile("[​‌‍⁠­﻿]")
QUOTED = re.compile(r'“[^”]*”|„[^“”]*[“”]|«[^»]*»|»[^«]*«|「[^」]*」|『[^』]*』|"[^"]*"')
MIXED = re.compile(r"(?=.*[A-Za-z])(?=.*[Ѐ-ӿͰ-Ͽɐ-ʯ＀-￯])")


def code(lang: str | None) -> str | None:
    """The language a field names; None where it names none."""
    if lang is None:
        return None
    return CODES.get(re.split(r"[-_]", lang.strip().lower())[0])


def words(text: str) -> list[tuple[str, int]]:
    """Words with their places. Runs of LONG letters and more without a space are read in pieces of six."""
    out = []
    for m in WORD.finditer(text):
        w = m.group()
        if len(w) < LONG:
            out.append((w, m.start()))
        else:
            out += [(w[i : i + 6], m.start() + i) for i in range(0, len(w), 6)]
    return out


def bare_words(text: str) -> list[str]:
    """The words of `words`, without places."""
    found = (WORD if HARD.search(text) else PLAIN_WORD).findall(text)
    if found and max(map(len, found)) >= LONG:
        return [p for w in found for p in ([w] if len(w) < LONG else [w[i : i + 6] for i in range(0, len(w), 6)])]
    return found


def shape(word: str) -> str:
    w = INVISIBLE.sub("", word)
    if not w.isascii():
        w = unicodedata.normalize("NFC", by_table(w) if MIXED.match(w) else unicodedata.normalize("NFKC", w))
    return w.lower()


def features(word: str) -> list[int]:
    """Hashed n-grams of 1 to 4 characters with word ends, the word, and its writing system."""
    w = f"<{word}>"
    out = {w, "script:" + unicodedata.name(word[:1] or " ", "?").split()[0]}
    for n in (1, 2, 3, 4):
        out.update(w[i : i + n] for i in range(len(w) - n + 1))
    out.discard("<")
    out.discard(">")
    return [zlib.crc32(x.encode()) % BUCKETS for x in sorted(out)]


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)
        self.w = np.zeros((WIDTH, len(LANGUAGES)), dtype=np.float32)
        self.b = np.zeros(len(LANGUAGES), dtype=np.float32)
        self.heat = 1.0
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(LANGUAGES)), dtype=np.float32)
        self.new: list[np.ndarray] = []

    def __getstate__(self):
        return {"e": self.e.astype(np.float16), "w": self.w, "b": self.b, "heat": self.heat}

    def __setstate__(self, state):
        self.__init__()
        self.e, self.w, self.b, self.heat = state["e"].astype(np.float32), state["w"], state["b"], state["heat"]

    # Training.

    def train(self, rows: list[list[str]], labels: np.ndarray, seed: int = 11) -> None:
        """A short and a longer window of each row, each epoch other ones; each language weighs the root of its rows."""
        rng = np.random.default_rng(seed)
        ids: dict[str, int] = {}
        coded = [np.array([ids.setdefault(w, len(ids)) for w in r], dtype=np.int64) for r in rows]
        feats = [np.array(features(shape(w)), dtype=np.int64) for w in ids]
        size = np.array([len(f) for f in feats])
        count = np.bincount(labels, minlength=len(LANGUAGES)).astype(np.float64)
        weight = 1 / np.sqrt(np.maximum(count, 1))
        weight /= (weight[labels]).mean()
        # Rare languages come up several times an epoch, with other windows each time.
        again = np.concatenate([np.zeros(0, dtype=np.int64), *[np.resize(np.flatnonzero(labels == k), LEAST_ROWS - int(c)) for k, c in enumerate(count) if 0 < c < LEAST_ROWS]])
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(np.concatenate([np.arange(len(coded)), again]) if len(again) else len(coded))
            for start in range(0, len(order), BATCH):
                parts, ys = [], []
                for k in order[start : start + BATCH]:
                    r = coded[k]
                    for n in (int(rng.integers(1, 7)), int(rng.integers(4, 17))):
                        at = int(rng.integers(0, max(1, len(r) - n + 1)))
                        parts.append(r[at : at + n])
                        ys.append(labels[k])
                self.step(parts, np.array(ys), feats, size, weight, rate)

    def step(self, parts, ys, feats, size, weight, rate) -> None:
        n = np.array([len(p) for p in parts])
        used, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        index, own = np.concatenate([feats[u] for u in used]), size[used]
        vec = np.add.reduceat(self.e[index], np.cumsum(own) - own) / own[:, None]
        starts = np.cumsum(n) - n
        x = np.add.reduceat(vec[inverse], starts) / n[:, None]
        z = x @ self.w + self.b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(ys)), ys] -= 1
        p *= (weight[ys] / len(ys) * 8)[:, None]
        dx = (p @ self.w.T) / n[:, None]
        self.w -= rate * (x.T @ p).astype(np.float32)
        self.b -= rate * p.sum(0).astype(np.float32)
        dvec = np.zeros_like(vec)
        np.add.at(dvec, inverse, np.repeat(dx, n, axis=0).astype(np.float32))
        np.add.at(self.e, index, np.repeat(-rate * 4 * dvec / own[:, None], own, axis=0).astype(np.float32))

    # Use.

    def ids(self, raw: list[str]) -> np.ndarray:
        """Rows of `scores` of the words as they are typed; a new word is scored once."""
        known = self.known
        out = list(map(known.get, raw))
        if None in out:
            fresh = [w for w in dict.fromkeys(raw) if w not in known]
            base = len(known)
            if base + len(fresh) > len(self.scores):
                grown = np.zeros((max(base + len(fresh), 2 * len(self.scores), 4096), len(LANGUAGES)), dtype=np.float32)
                grown[:base] = self.scores[:base]
                self.scores = grown
            for w in fresh:
                self.scores[len(known)] = self.e[features(shape(w))].mean(0) @ self.w
                known[w] = len(known)
            out = list(map(known.get, raw))
        return np.array(out, dtype=np.int64)

    def scored(self, shapes: list[str]) -> np.ndarray:
        """Scores (words, languages); the memory of words is emptied when it grows beyond a bound."""
        if len(self.known) > 400_000:
            self.known.clear()
        ids = self.ids(shapes)
        return self.scores[ids]

    def judge(self, mean: np.ndarray) -> tuple[int, float]:
        """Language and confidence of mean scores."""
        z = (mean + self.b) / self.heat
        p = np.exp(z - z.max())
        k = int(z.argmax())
        return k, float(p[k] / p.sum())

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The most likely language of each word, changes at a cost."""
        z = scores + self.b
        z = z - z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        n = len(z)
        back = np.empty(z.shape, dtype=np.int8)
        best = z[0].copy()
        for i in range(1, n):
            top = int(best.argmax())
            change = best[top] - CHANGE
            back[i] = np.where(best >= change, np.arange(z.shape[1]), top)
            best = np.maximum(best, change) + z[i]
        out = np.empty(n, dtype=np.int64)
        out[-1] = best.argmax()
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i][out[i]]
        return out

    def text(self, text: str | None, segments: bool) -> tuple[str | None, float, list[tuple[str, float, int, int]]]:
        """(main language, confidence, foreign stretches) of a text."""
        found = words(text) if text else []
        if not found:
            return None, 0.0, []
        scores = self.scored([w for w, _ in found])
        window = np.cumsum(np.vstack([np.zeros((1, scores.shape[1]), dtype=np.float64), scores]), axis=0)
        n = len(found)
        i = np.arange(n)
        low, high = np.maximum(i - 3, 0), np.minimum(i + 4, n)
        near = ((window[high] - window[low]) / (high - low)[:, None] + self.b).argmax(1)
        runs = near
        if (near != near[0]).any():
            runs = self.path(scores)
        letters = np.array([len(w) if len(w) > 1 else 1 for w, _ in found])
        unspaced = np.array([LANGUAGES[k] in ("zh", "ja") for k in runs])
        # Main language: of the words outside quotations, where there are enough; unspaced characters weigh a third of a word.
        worth = np.where(unspaced, 0.34, 1.0)
        votes_for = np.ones(n, dtype=bool)
        if (runs != runs[0]).any():
            at = np.array([s for _, s in found])
            for m in QUOTED.finditer(text):
                votes_for &= ~((at >= m.start()) & (at < m.end()))
            for k in self.blocks(text, found):
                votes_for[k] = False
            if worth[votes_for].sum() < 2:
                votes_for[:] = True
        votes = np.bincount(runs[votes_for], weights=worth[votes_for], minlength=len(LANGUAGES))
        main = int(votes.argmax())
        mine = runs == main
        enough = letters[mine].sum() >= FEWEST_LETTERS if LANGUAGES[main] in ("zh", "ja") else n >= FEWEST_WORDS
        kind, sure = self.judge(scores[mine].mean(0))
        if kind != main:
            sure = 1 - sure
        out = []
        if segments and enough:
            edges = np.flatnonzero(np.diff(runs)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n]):
                lang = int(runs[a])
                if lang == main:
                    continue
                kind, conf = self.judge(scores[a:b].mean(0))
                long = letters[a:b].sum() >= FEWEST_LETTERS if LANGUAGES[lang] in ("zh", "ja") or (letters[a:b] == 6).mean() > 0.7 else b - a >= FEWEST_WORDS
                favour = scores[a:b, lang] + self.b[lang] > scores[a:b, main] + self.b[main] + MARGIN
                backed = int(favour.sum()) if (letters[a:b][favour] > 2).sum() >= min(FEWEST_WORDS - 1, b - a) or LANGUAGES[lang] in ("zh", "ja") else 0
                if long and kind == lang and conf >= CONFIDENCE and backed >= min(FEWEST_WORDS, b - a):
                    out.append((LANGUAGES[lang], conf, found[a][1], found[b - 1][1] + len(found[b - 1][0])))
        return (LANGUAGES[main] if enough else None), sure, out

    def batch(self, texts: list[str | None], segments: list[bool]) -> list[tuple[str | None, float, list]]:
        """`text` of many texts: those that all windows find in one language need no path."""
        if len(self.known) > 400_000:
            self.known.clear()
        out: list = [(None, 0.0, [])] * len(texts)
        done = 0
        while done < len(texts):  # some hundred thousand words at a time
            cut, raw, n = [], [], 0
            while done < len(texts) and n < 200_000:
                found = bare_words(texts[done]) if texts[done] else []
                if found:
                    cut.append((done, len(found)))
                    raw += found
                    n += len(found)
                done += 1
            if not cut:
                continue
            ids = self.ids(raw)
            scores = self.scores[ids]
            size = np.array([c for _, c in cut])
            start = np.cumsum(size) - size
            mean = np.add.reduceat(scores, start, axis=0) / size[:, None]
            z = (mean + self.b) / self.heat
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            top, sure = z.argmax(1), p.max(1)
            clear = (sure >= CLEAR) & (size >= 40) & ~np.array([segments[row] for row, _ in cut])
            # Of the others, the windows of seven words: three in a row for another language call for the path.
            left = np.flatnonzero(~clear)
            if len(left):
                of = np.repeat(~clear, size)
                own, length, main = scores[of], size[left], np.repeat(top[left], size[left])
                m, at = len(own), np.cumsum(size[left]) - size[left]
                total = np.zeros((m + 1, own.shape[1]))
                np.cumsum(own, axis=0, dtype=np.float64, out=total[1:])
                i, text_no = np.arange(m), np.repeat(np.arange(len(left)), length)
                low, high = np.maximum(i - 3, np.repeat(at, length)), np.minimum(i + 4, np.repeat(at + length, length))
                near = ((total[high] - total[low]) / (high - low)[:, None] + self.b).argmax(1)
                other = near != main
                run = other[2:] & other[1:-1] & other[:-2] & (text_no[2:] == text_no[:-2]) if m > 2 else np.zeros(0, dtype=bool)
                mixed = np.zeros(len(left), dtype=bool)
                mixed[text_no[2:][run]] = True
                mixed |= (sure[left] < CONFIDENCE) & (length >= FEWEST_WORDS)
                clear[left] = ~mixed
            for k, (row, c) in enumerate(cut):
                lang = LANGUAGES[top[k]]
                if clear[k] and lang not in ("zh", "ja"):
                    out[row] = (lang if c >= FEWEST_WORDS else None, float(sure[k]), [])
                else:
                    out[row] = self.text(texts[row], segments[row])
        return out

    @staticmethod
    def blocks(text: str, found: list[tuple[str, int]]) -> list[int]:
        """Words that are pieces of one long run without spaces."""
        return [k for k in range(len(found)) if k and found[k - 1][1] + len(found[k - 1][0]) == found[k][1] and len(found[k - 1][0]) == 6 and found[k][0].isalpha() and not re.match(rf"[{UNSPACED}]", found[k][0])]


def fit(rows: list[tuple[str, str]]) -> Model:
    """The model from (text, language) rows with wrong labels among them."""
    texts = [bare_words(t) for t, _ in rows]
    keep = [i for i, t in enumerate(texts) if len(t) >= 2]
    texts, labels = [texts[i] for i in keep], np.array([LANGUAGES.index(rows[i][1]) for i in keep], dtype=np.int64)
    # Each half is judged by a model of the other half, which cannot have learnt its wrong labels by heart; what it
    # contradicts is left out. The same scores, made of rows not trained on, fit the temperature.
    fold = np.arange(len(texts)) % 2 == 0
    mean = np.zeros((len(texts), len(LANGUAGES)))
    for half in (fold, ~fold):
        model = Model()
        model.train([t for t, h in zip(texts, half) if h], labels[half])
        for i in np.flatnonzero(~half):
            mean[i] = model.scored(texts[i]).mean(0) + model.b
    good = mean.argmax(1) == labels
    model = Model()
    model.train([t for t, g in zip(texts, good) if g], labels[good])
    z, y = mean, labels
    right = z.argmax(1) == y  # wrong labels would pass for errors: only rows the model agrees with or is unsure of calibrate
    gap = np.sort(z, axis=1)[:, -1] - np.sort(z, axis=1)[:, -2]
    use = right | (gap < 1)
    if use.any():
        heats = [0.5, 0.7, 1.0, 1.4, 2.0, 3.0]
        loss = [np.mean(np.log(np.exp((z[use] - z[use].max(1, keepdims=True)) / h).sum(1)) - ((z[use] - z[use].max(1, keepdims=True)) / h)[np.arange(use.sum()), y[use]]) for h in heats]
        model.heat = heats[int(np.argmin(loss))]
    return model


def labelled(spark: SparkSession, folder: str, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """About `per_language` rows a language and table, by hash; the first 400 characters of a text are its example."""
    notation = F.create_map(*[x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))])
    out = []
    parts = []
    for name, key in (("utterances", "utt_id"), ("switches", "switch_id"), ("documents", "doc_id")):
        df = table(spark, folder, name).where("text is not null and lang is not null")
        lang = notation[F.lower(F.element_at(F.split(F.trim("lang"), "[-_]"), 1))]
        parts.append(df.select(F.lit(name).alias("source"), F.substring("text", 1, 400).alias("text"), lang.alias("code"), F.xxhash64(key).alias("h")).where("code is not null"))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # The share that passes the filter follows from the counts, so no group is gathered or sorted whole.
    counts = both.groupBy("source", "code").count()
    share = counts.select("source", "code", (F.lit(float(per_language)) / F.col("count")).alias("share"))
    picked = both.join(F.broadcast(share), ["source", "code"]).where("(h % 1000000 + 1000000) % 1000000 < share * 1000000")
    return sorted((r["text"], r["code"]) for r in picked.select("text", "code").collect())


def languages(df: DataFrame, model: Model, key: str, text: str = "text", segments: bool = False) -> DataFrame:
    """`key`, lang, confidence, segments (array of lang, confidence, start_at, end_at) of each row. Narrow; the model is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in parts:
            out = []
            for k, (lang, sure, found) in zip(part["key"], own.batch(part["text"].tolist(), [segments] * len(part))):
                out.append((k, lang, sure, [dict(zip(("lang", "confidence", "start_at", "end_at"), f)) for f in found]))
            yield pd.DataFrame(out, columns=["key", "lang", "confidence", "segments"])

    done = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key bigint, lang string, confidence double, segments array<struct<lang string, confidence double, start_at bigint, end_at bigint>>")
    return done.withColumnRenamed("key", key)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """kind, row_id, lang: texts whose field is missing or wrong, with the right language; foreign stretches."""
    model = fit(labelled(spark, folder))
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in parts:
            out = []
            found_all = own.batch(part["text"].tolist(), [k == "utterance" for k in part["kind"]])
            for kind, k, field, (lang, sure, found) in zip(part["kind"], part["row_id"], part["lang"], found_all):
                if lang is not None and sure >= CONFIDENCE and code(field) != lang:
                    out.append((kind, k, lang))
                out += [("segment", k, x) for x in sorted({f[0] for f in found})]
            yield pd.DataFrame(out, columns=["kind", "row_id", "lang"])

    sources = [("utterances", "utterance", "utt_id"), ("switches", "switch", "switch_id"), ("documents", "document", "doc_id")]
    rows = [table(spark, folder, name).where("text is not null").select(F.lit(kind).alias("kind"), F.col(key).alias("row_id"), "text", "lang") for name, kind, key in sources]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).mapInPandas(run, "kind string, row_id bigint, lang string").distinct()
