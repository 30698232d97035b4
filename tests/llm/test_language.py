from __future__ import annotations

import pickle

import pytest

from foliant.llm import language as L

SAMPLES = {
    "en": "the old scribe keeps the letter in the house and they have read it with great care",
    "de": "der alte Schreiber bewahrt den verlorenen Brief unter dem Dach und die Kapelle ist sehr dunkel",
    "fr": "le vieux copiste conserve la lettre perdue dans une longue salle avec une certaine prudence",
    "la": "vetus ille scriba servat epistulam amissam sub tecto sacelli post magnam aquarum eluvionem",
    "ru": "старый писец хранит тёмную притчу после великого потопа в конце третьей книги",
    "zh": "年老的抄写人在大水之后断然否定了晦涩的寓言博学的编者",
}


@pytest.fixture(scope="module")
def model():
    rows = []
    for lang, text in SAMPLES.items():
        words = list(text) if lang == "zh" else text.split()
        for k in range(60):
            rows.append((("" if lang == "zh" else " ").join(words[(k * 3 + i) % len(words)] for i in range(9)), lang if k % 12 else "en"))
    return L.fit(rows)


def test_notations():
    assert [L.code(x) for x in ("EN", "en_US", "English", "ger", "zh-Hans", "iw", "xx", "", None, "und", "??")] == ["en", "en", "en", "de", "zh", "he", None, None, None, None, None]


def test_main_language_and_stretches(model):
    assert model.text(SAMPLES["de"], True)[0] == "de" and model.text(SAMPLES["zh"], True)[0] == "zh"
    mixed = "the old scribe keeps the letter “vetus ille scriba servat epistulam amissam sub tecto sacelli” in the house"
    lang, _, found = model.text(mixed, True)
    assert lang == "en" and [f[0] for f in found] == ["la"] and "scriba servat" in mixed[found[0][2] : found[0][3]]


def test_short_blank_and_null(model):
    assert model.text(None, True) == (None, 0.0, []) and model.text(" 12 !", True)[0] is None and model.text("ad loc", True)[0] is None


def test_batch_is_text_and_pickles(model):
    texts = [*SAMPLES.values(), None, "", "the old scribe", "12 34"]
    again = pickle.loads(pickle.dumps(model))
    assert [x[0] for x in again.batch(texts, [True] * len(texts))] == [model.text(t, True)[0] for t in texts]


def test_languages_rows(spark, model):
    df = spark.createDataFrame([(1, SAMPLES["fr"], "x"), (2, None, "y")], "id bigint, text string, lang string")
    assert [(r.id, r.lang) for r in L.languages(df, model, "id").orderBy("id").collect()] == [(1, "fr"), (2, None)]
