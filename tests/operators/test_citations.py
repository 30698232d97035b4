from __future__ import annotations

import pytest

from foliant.functions.vocabularies import vocabulary
from foliant.operators import citations as C


@pytest.fixture(scope="module")
def scanner():
    return C.Scanner(vocabulary())


@pytest.mark.parametrize(
    ("text", "spoken"),
    [
        ("1 Cor 2:10", "First Corinthians two, ten"),
        ("T. Levi 10:5; 14:1; 16:1", "Testament of Levi ten, five; fourteen, one; sixteen, one"),
        ("Cassius Dio, 57.25.8", "Cassius Dio, fifty-seven, twenty-five, eight"),
        ("Num. 8.10", "Numa eight, ten"),
        ("Prov 3:5", "Providence three, five"),
        ("3 Macc. 2:1", "3 Maccabees two, one"),
        ("3 Macc 2:1", "Third Maccabees two, one"),
        ("Mark 2:10ff", "Mark two:10ff"),
        ("Mark, 12 examples", "Mark twelve examples"),
        ("Resp. 364b-365a", "Republic three hundred sixty-four B to three hundred sixty-five A"),
        ("DK 31 B112", "Diels-Kranz thirty-one, B, one hundred twelve"),
        ("4Q246", "four Q, two-four-six"),
        ("11QPsa", "one-one Q, the Psalms Scroll A"),
        ("1QH 11:19-22", "one Q, the Thanksgiving Hymns, eleven, nineteen to twenty-two"),
        ("CD 12:23-13:1", "the Damascus Document twelve, twenty-three to thirteen, one"),
        ("Mark  2:10", "Mark  2:10"),
        ("Mark\n\n2:10", "Mark\n\n2:10"),
        ("Number 5", "Number 5"),
        ("DK47A1", "DK47A1"),
        ("", ""),
        (None, None),
    ],
)
def test_spoken(scanner, text, spoken):
    assert scanner.speak(text) == spoken


def test_near_misses(scanner):
    assert scanner.near("Fragment DK47A1 here") == [("diels_kranz", "DK", "Fragment DK47A1 here")]
    assert scanner.near("Mark, ever the pragmatist, counted 12") == []
    assert scanner.near("Mark 2:10") == []
    assert scanner.near(None) == []


def test_words_and_locators():
    assert C.in_words(0) == "zero" and C.in_words(21) == "twenty-one" and C.in_words(1100) == "one thousand one hundred" and C.in_words(2_000_115) == "two thousand thousand one hundred fifteen"
    assert C.number_locator("32.9.6-10") == "thirty-two, nine, six to ten"
    assert C.stephanus_locator("514a2") == "five hundred fourteen A, two"
    assert C.fragment_locator("31 B112") == "thirty-one, B, one hundred twelve"


def test_rows(spark):
    df = spark.createDataFrame([(1, "See 1 Cor 2:10 and DK47A1."), (2, None), (3, "")], "cite_id bigint, text string")
    assert [tuple(r) for r in C.citations(df, "cite_id").collect()] == [(1, 4, 14, "biblical", "1 Cor", "First Corinthians two, ten")]
    assert [tuple(r)[:3] for r in C.near_misses(df, "cite_id").collect()] == [(1, "diels_kranz", "DK")]
    assert [r[0] for r in df.select(C.spoken(df.text)).collect()] == ["See First Corinthians two, ten and DK47A1.", None, ""]
