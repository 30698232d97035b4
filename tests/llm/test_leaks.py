from __future__ import annotations

import random

import pytest

from foliant.llm.leaks import Index, leaks, remove_spans, words

RNG = random.Random(3)
VOCABULARY = [f"word{i}" for i in range(400)]
ITEM = [RNG.choice(VOCABULARY) for _ in range(60)]


def text(parts):
    return " ".join(parts)


def noise(n, seed):
    rng = random.Random(seed)
    return [rng.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="module")
def index():
    return Index([(1, text(ITEM)), (2, text(noise(50, 9)))])


def found(index, parts):
    return [x[0] for x in index.documents([text(parts)])[0]]


def test_whole_partial_and_changed_passages(index):
    assert found(index, noise(100, 1) + ITEM + noise(100, 2)) == [1]
    assert found(index, noise(100, 1) + ITEM[10:36] + noise(100, 2)) == [1]
    assert found(index, noise(100, 1) + ITEM[10:25] + noise(100, 2)) == []
    changed = [w if i % 9 else "other" for i, w in enumerate(ITEM)]
    assert found(index, noise(50, 1) + changed) == [1]


def test_three_stretches_in_order(index):
    a, b, c = ITEM[0:10], ITEM[20:30], ITEM[45:55]
    assert found(index, a + noise(30, 1) + b + noise(30, 2) + c) == [1]
    assert found(index, c + noise(30, 1) + b + noise(30, 2) + a) == []


def test_layout_and_characters(index):
    dressed = text(ITEM).upper().replace(" ", "\n").replace("WORD1", "ＷＯＲＤ1")
    assert [x[0] for x in index.documents([dressed])[0]] == [1]
    assert index.documents([None, "", " "]) == [[], [], []]
    assert words("Cross-shaped “Étude”​, l'an") == ["cross", "shaped", "etude", "lan"]


def test_rows_and_removal(spark):
    docs = spark.createDataFrame([(7, text(noise(40, 1) + ITEM), "x"), (8, None, "y"), (None, text(ITEM), "z"), (9, text(noise(80, 5)), "w")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, text(ITEM)), (1, text(ITEM)), (2, None)], "item_id bigint, text string")
    out = leaks(docs, items).collect()
    assert [(r.item_id, r.doc_id, r.share) for r in out] == [(1, 7, 1.0)]
    rest = remove_spans(text(noise(40, 1) + ITEM), [(out[0].first_word, out[0].last_word)])
    assert rest == text(noise(40, 1)) or set(rest.split()) >= set(noise(40, 1)[:-3])
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0
