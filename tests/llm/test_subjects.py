from __future__ import annotations

import random

import numpy as np
import pytest

from foliant.llm.subjects import Chain, Classifier, split

TERMS = {"law": "court judge verdict contract appeal statute".split(), "music": "lute hymn organ chant melody tune".split(), "sport": "race goal athlete league score team".split()}


def document(rng, subjects, n=8):
    out = []
    for k in range(n):
        s = subjects[k % len(subjects)]
        out.append(f"The {rng.choice(['old', 'new', 'lost'])} {rng.choice(TERMS[s])} of the {rng.choice(['town', 'valley', 'house'])} met the {rng.choice(TERMS[s])}.")
    rng.shuffle(out)
    return " ".join(out)


@pytest.fixture(scope="module")
def classifier():
    rng = random.Random(1)
    rows = []
    for k in range(240):
        own = rng.sample(sorted(TERMS), 1 + (k % 3 == 0))
        rows.append((document(rng, own), "a" if k % 2 else None, own if k % 15 else [rng.choice(sorted(TERMS))]))
    return Classifier(sorted(TERMS)).fit(rows)


def test_held_out_accuracy(classifier):
    rng = random.Random(2)
    own = [rng.sample(sorted(TERMS), 1 + (k % 3 == 0)) for k in range(60)]
    got, _ = classifier([document(rng, s) for s in own], ["a"] * 60)
    want = np.array([[s in o for s in classifier.subjects] for o in own])
    assert (got == want).all(1).mean() > 0.9


def test_blank_texts_get_no_subject(classifier):
    got, cut = classifier([None, "", " \n"], [None] * 3)
    assert cut == [[], [], []] and got.shape == (3, 3)


def test_split_keeps_abbreviations():
    assert split("Dr. Nuzul met J. Laken. They left, e.g. by sea.\nNew line") == [["Dr", "Nuzul", "met", "J", "Laken"], ["They", "left", "e", "g", "by", "sea"], ["New", "line"]]
    assert split(None) == []


def test_beam_search_finds_the_best_combination():
    rng = np.random.default_rng(3)
    x, side = rng.random((200, 8)), np.zeros((200, 2))
    y = np.stack([x[:, 0] > 0.5, x[:, 1] > 0.6, (x[:, 0] > 0.5) & (x[:, 2] > 0.3), x[:, 3] > 0.8], axis=1)
    chain = Chain([0, 1, 2, 3])
    chain.fit(x, side, y)
    got = chain.decode(x, side)
    best = []
    for i in range(len(x)):
        def total(labels, i=i):
            p = 0.0
            for j, k in enumerate(chain.order):
                z = (chain.inputs(k, x[i : i + 1], side[i : i + 1], np.array([labels[:j]], dtype=float)) @ chain.w[j])[0]
                p += -np.logaddexp(0, -z if labels[j] else z)
            return p
        best.append(max((tuple(bool(n >> b & 1) for b in range(4)) for n in range(16)), key=total))
    assert (got == np.array(best)).all(1).mean() > 0.98
