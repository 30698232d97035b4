"""Subject areas of documents (problem 9).

Method: classifier chains over term, source and structure features. A linear softmax over terms gives each sentence its
subject; the shares of sentences by subject, with the document's source and structure, are the features of a chain of
logistic classifiers, one a subject, each of which also sees the decisions before it, so that subjects that go together
or shut each other out are modelled. The probabilities are calibrated on documents whose sentences the term model was
not trained on, and the best combination of labels is decoded by beam search.

Bounds: the models are fitted on at most MOST_LABELLED labelled documents, chosen by hash (some megabytes; the labels'
number is the readers' work and does not grow with the corpus); every document is classified, with all its sentences.
Defined results: null and blank texts and texts in other languages than en, de and fr get no subject; repeated rows and
labels count once; several readers' labels of one document are joined.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import language
from foliant.llm.language import LANGUAGES, Model, bare_words
from foliant.sources.tables import table

MOST_LABELLED = 8000
LANGUAGE_ROWS = 250  # labelled rows a language and table for the language model
SURE = 0.6  # probability from which a sentence deals with a subject
SOURCES = 16  # buckets of source names
BEAM = 4
AT_ONCE = 1500  # documents whose words lie in memory together
STEPS, RATE = 900, 2.0  # steps of 256 sentences, in 3 to 12 passes
READ = [LANGUAGES.index(x) for x in ("en", "de", "fr")]

# Abbreviations before which no sentence ends here.
SHORT = frozenset("Mr Mrs Ms Dr Prof St Ste Jr Sr No Nr Bd vol Vol cap lib fol ed Hg ca Cf Vgl vgl cf pp p S M Mme".split())
END = re.compile("[.!?…][”\"’»)\\]]*\\s+|\n")


class Terms:
    """A linear softmax over the words of a sentence; words are looked up as typed, lower-cased when first seen."""

    def __init__(self, subjects: list[str]):
        self.subjects, self.ids = subjects, {}
        self.w = np.zeros((1, len(subjects)), dtype=np.float32)  # row 0: words never seen in training

    def train(self, sentences: list[list[str]], y: np.ndarray, seed: int = 5) -> None:
        """Sentences with the subject of their document; stochastic gradient descent with a rate for each term."""
        rng = np.random.default_rng(seed)
        coded = []
        for s in sentences:
            coded.append(np.array(sorted({self.ids.setdefault(w.lower(), len(self.ids) + 1) for w in s}), dtype=np.int64))
        w = np.zeros((len(self.ids) + 1, len(self.subjects)), dtype=np.float32)
        seen = np.full(len(w), 1e-2, dtype=np.float32)
        keep = np.array([k for k, c in enumerate(coded) if len(c)], dtype=np.int64)
        for _ in range(int(np.clip(STEPS * 256 // max(len(keep), 1), 3, 12))):
            order = rng.permutation(keep)
            for at in range(0, len(order), 256):
                rows = order[at : at + 256]
                index = np.concatenate([coded[k] for k in rows])
                n = np.array([len(coded[k]) for k in rows])
                z = np.add.reduceat(w[index], np.cumsum(n) - n, axis=0)
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                g = np.repeat(p, n, axis=0)
                used, inverse = np.unique(index, return_inverse=True)
                step = np.zeros((len(used), w.shape[1]), dtype=np.float32)
                np.add.at(step, inverse, g)
                step /= len(rows)
                seen[used] += (step**2).mean(1)
                w[used] -= RATE * step / np.sqrt(seen[used])[:, None]
        self.w = w

    def rows(self, words: list[str]) -> np.ndarray:
        get, out = self.ids.get, None
        out = [get(x) for x in words]
        if None in out:
            for x in dict.fromkeys(words):
                if x not in self.ids:
                    if len(self.ids) > 1_000_000:  # words as typed are kept for speed only
                        self.ids = {k: v for k, v in self.ids.items() if k.islower() and v}
                        get = self.ids.get
                    self.ids[x] = self.ids.get(x.lower(), 0)
            out = [get(x, 0) for x in words]
        return np.array(out, dtype=np.int64)


def shares(terms: Terms, texts: list[list[list[str]]]) -> np.ndarray:
    """Of each document, by subject: the share of its sentences that deal with it, and the mean probability."""
    k = len(terms.subjects)
    out = np.zeros((len(texts), 2 * k), dtype=np.float64)
    flat = [s for t in texts for s in t]
    n_s = np.array([len(t) for t in texts])
    if not flat:
        return out
    index = terms.rows([w for s in flat for w in s])
    n = np.array([len(s) for s in flat])
    some = np.flatnonzero(n)
    p = np.full((len(flat), k), 1 / k)
    if len(some):
        z = np.add.reduceat(terms.w[index], (np.cumsum(n) - n)[some], axis=0)
        z = np.exp(z - z.max(1, keepdims=True))
        p[some] = z / z.sum(1, keepdims=True)
    docs = np.flatnonzero(n_s)
    start = (np.cumsum(n_s) - n_s)[docs]
    out[docs, :k] = np.add.reduceat((p >= SURE).astype(float), start, axis=0) / n_s[docs, None]
    out[docs, k:] = np.add.reduceat(p, start, axis=0) / n_s[docs, None]
    return out


def split(text: str | None) -> list[list[str]]:
    """The words of each sentence; none ends after an abbreviation, an initial or before a small letter."""
    out: list[list[str]] = []
    if not text:
        return out
    goes_on = False
    for piece in END.split(text):
        words = bare_words(piece)
        if not words:
            continue
        if goes_on or out and words[0][0].islower() and piece[0] == words[0][0]:
            out[-1] += words
        else:
            out.append(words)
        last = words[-1]
        goes_on = (last in SHORT or len(last) == 1 and last.isupper()) and piece.endswith(last)
    return out


def side_features(source: list[str | None], texts: list[list[list[str]]]) -> np.ndarray:
    """Source and structure of each document: the bucket of its source, the number and length of its sentences."""
    out = np.zeros((len(texts), SOURCES + 3))
    for i, (s, t) in enumerate(zip(source, texts)):
        out[i, zlib.crc32((s or "").encode()) % SOURCES] = 1
        out[i, SOURCES] = np.log1p(len(t))
        out[i, SOURCES + 1] = len(t) <= 2
        out[i, SOURCES + 2] = np.log1p(sum(map(len, t)) / max(1, len(t)))
    return out


class Chain:
    """Logistic classifiers in the order of their subjects' frequency, each with the decisions before it."""

    def __init__(self, order: list[int]):
        self.order, self.w = order, []

    def inputs(self, k: int, x: np.ndarray, side: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The subject's own share about the threshold, its mean probability, the shares of the others, source, structure."""
        n = x.shape[1] // 2
        own, mean = x[:, k], x[:, n + k]
        others = np.delete(x[:, :n], k, axis=1)
        near = np.stack([own, np.minimum(own, 0.2) * 5, np.clip((own - 0.1) * 10, 0, 1), np.clip((own - 0.17) * 20, 0, 1), np.clip((own - 0.3) * 5, 0, 1), mean, others.max(1), others.sum(1)], axis=1)
        return np.hstack([np.ones((len(x), 1)), near, 0.3 * side, before])

    def fit(self, x: np.ndarray, side: np.ndarray, y: np.ndarray) -> None:
        """Newton steps with a ridge; the labels before are the readers' own."""
        for j, k in enumerate(self.order):
            a = self.inputs(k, x, side, y[:, self.order[:j]].astype(float))
            w, t = np.zeros(a.shape[1]), y[:, k].astype(float)
            ridge = np.full(a.shape[1], 1.0)
            ridge[0] = 1e-3
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
                step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (t - p) - ridge * w)
                w += np.clip(step, -4, 4)
                if np.abs(step).max() < 1e-4:
                    break
            self.w.append(w)

    def decode(self, x: np.ndarray, side: np.ndarray) -> np.ndarray:
        """The most probable combination of labels of each document, by beam search."""
        n = len(x)
        paths = np.zeros((n, 1, len(self.order)))
        score = np.zeros((n, 1))
        for j, k in enumerate(self.order):
            width = paths.shape[1]
            base = self.inputs(k, x, side, np.zeros((n, 0))) @ self.w[j][: len(self.w[j]) - j]
            z = base[:, None] + paths[:, :, :j] @ self.w[j][len(self.w[j]) - j :]
            yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
            both = np.concatenate([score + no, score + yes], axis=1)
            grown = np.concatenate([paths, paths], axis=1)
            grown[:, width:, j] = 1
            best = np.argsort(-both, axis=1, kind="stable")[:, :BEAM]
            score = np.take_along_axis(both, best, axis=1)
            paths = np.take_along_axis(grown, best[:, :, None], axis=1)
        out = np.zeros((n, len(self.order)), dtype=bool)
        out[:, self.order] = paths[:, 0, :] > 0.5
        return out


class Classifier:
    def __init__(self, subjects: list[str]):
        self.subjects = subjects

    def fit(self, rows: list[tuple[str, str | None, list[str]]]) -> Classifier:
        """Rows (text, source, subjects)."""
        texts = [split(t) for t, _, _ in rows]
        y = np.array([[s in own for s in self.subjects] for _, _, own in rows])
        x = np.zeros((len(rows), 2 * len(self.subjects)))
        fold = np.arange(len(rows)) % 2 == 0
        for half in (fold, ~fold):
            terms = self._terms(texts, y, half, once=True)
            rest = np.flatnonzero(~half)
            x[rest] = shares(terms, [texts[i] for i in rest])
        self.terms = self._terms(texts, y, np.ones(len(rows), dtype=bool))
        self.chain = Chain(np.argsort(-y.sum(0), kind="stable").tolist())
        self.chain.fit(x, side_features([s for _, s, _ in rows], texts), y)
        return self

    def _terms(self, texts: list, y: np.ndarray, use: np.ndarray, once: bool = False) -> Terms:
        """Learnt from documents of one subject, then once more from all, each sentence under the likeliest of its document's subjects."""
        one = [i for i in np.flatnonzero(use) if y[i].sum() == 1]
        terms = Terms(self.subjects)
        terms.train([s for i in one for s in texts[i]], np.array([y[i].argmax() for i in one for _ in texts[i]], dtype=np.int64))
        many = [i for i in np.flatnonzero(use) if y[i].any()] if not once else []
        flat = [(s, i) for i in many for s in texts[i]]
        if not flat:
            return terms
        index = terms.rows([w for s, _ in flat for w in s])
        n = np.array([len(s) for s, _ in flat])
        z = np.add.reduceat(terms.w[index], np.cumsum(n) - n, axis=0)
        own = np.array([y[i] for _, i in flat])
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        label = np.where(own, p, -1).argmax(1)
        # A sentence that clearly deals with a subject its document was not given says nothing about the labels it has.
        keep = p.max(1) - p[np.arange(len(p)), label] < 0.5
        out = Terms(self.subjects)
        out.train([s for (s, _), k in zip(flat, keep) if k], label[keep])
        return out

    def __call__(self, texts: list[str | None], source: list[str | None]) -> tuple[np.ndarray, list]:
        cut = [split(t) for t in texts]
        return self.chain.decode(shares(self.terms, cut), side_features(source, cut)), cut


def readable(model: Model, cut: list[list[list[str]]]) -> np.ndarray:
    """Whether the main language of each document is en, de or fr."""
    flat = [w for t in cut for s in t for w in s]
    n = np.array([sum(map(len, t)) for t in cut])
    out = np.zeros(len(cut), dtype=bool)
    some = np.flatnonzero(n)
    if len(some):
        if len(model.known) > 400_000:
            model.known.clear()
        ids = model.ids(flat)
        z = np.add.reduceat(model.scores[ids], (np.cumsum(n) - n)[some], axis=0) / n[some, None] + model.b
        out[some] = np.isin(z.argmax(1), READ)
    return out


def labelled(spark: SparkSession, folder: str) -> tuple[list[str], list[tuple[str, str | None, list[str]]]]:
    labels = table(spark, folder, "subject_labels").where("subject is not null").select("doc_id", "subject").distinct()
    subjects = sorted(r[0] for r in table(spark, folder, "subject_areas").where("subject is not null").select("subject").distinct().collect())
    n = labels.select("doc_id").distinct().count()
    share = min(1.0, MOST_LABELLED / max(n, 1))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    documents = table(spark, folder, "documents").where("text is not null").select("doc_id", "text", "source")
    rows = documents.join(F.broadcast(chosen), "doc_id").collect()
    return subjects, [(r["text"], r["source"], r["subjects"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, subject of all documents in en, de or fr."""
    subjects, rows = labelled(spark, folder)
    pair = spark.sparkContext.broadcast((Classifier(subjects).fit(rows), language.fit(language.labelled(spark, folder, LANGUAGE_ROWS))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify, model = pair.value
        names = np.array(classify.subjects, dtype=object)
        for whole in parts:
            for start in range(0, len(whole), AT_ONCE):
                part = whole.iloc[start : start + AT_ONCE]
                found, cut = classify(part["text"].tolist(), part["source"].tolist())
                found &= readable(model, cut)[:, None]
                doc, subject = np.nonzero(found)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[doc], "subject": names[subject]})

    documents = table(spark, folder, "documents").where("trim(text) <> ''").select("doc_id", "text", "source")
    return documents.mapInPandas(run, "doc_id bigint, subject string").distinct()
