"""Column functions over text. Null gives null throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits.
ANCHOR = r"\[\^([^\]]+)\]"
BIBLIOGRAPHY_HEADING = r"(?i)bibliography|works cited|\breferences\b"
APPARATUS = r"(?i)front matter|bibliograph|index|contents|acknowledg|abbreviation|list of (figures|tables|illustrations|maps)|copyright|^notes?$"
PAGE_NUMBER = r"(?i)^(?:[0-9]+|[ivxlcdm]+)$"
PARAGRAPH_END = r"[.!?…:][)\]\"'”’]*$"
HEADING_CHARS = 80
SLUG_CHARS = 48
SPACE = r"[ \t\n\x0b\f\r\u0085  -     　]"
INVISIBLE = r"[­​‌‍⁠﻿]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapsed(text: Column | str) -> Column:
    """PJ14: invisible characters dropped, white space runs made one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(text), INVISIBLE, ""), SPACE + "+", " "))


def flattened(text: Column | str) -> Column:
    """PJ4: one line of a block. Soft hyphens go with the white space after them, control characters but tab and line
    end go, a hyphen at a line end before a small letter joins the lines, white space runs become one space."""
    x = F.regexp_replace(col(text), r"­" + SPACE + "*", "")
    x = F.regexp_replace(x, r"[\x00-\x08\x0b-\x1f\x7f]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"-\n(?=[a-z])", ""), SPACE + "+", " "))


def repetition_key(text: Column | str) -> Column:
    """PJ5: the text without white space and digits, in small letters; page heads that differ in the number agree."""
    return F.lower(F.regexp_replace(col(text), SPACE + "+|[0-9]+", ""))


def anchors(text: Column | str) -> Column:
    """The refs of the note anchors in order, repeats kept."""
    return F.regexp_extract_all(col(text), F.lit(ANCHOR), F.lit(1))


def without_anchors(text: Column | str) -> Column:
    """PJ11: anchors and the white space before them dropped, the rest trimmed; may be empty."""
    return F.trim(F.regexp_replace(col(text), SPACE + "*" + ANCHOR, ""))


def slug(text: Column | str) -> Column:
    """PJ10: small letters and digits, everything else one underscore, none at the ends; `document` where none is left."""
    x = F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(x == "", F.lit("document")).otherwise(x)


def stem(number: Column | str, title: Column | str) -> Column:
    """PJ10: `NN_slug`, the number with two digits or more, the slug cut to 48 characters without a last underscore."""
    return F.concat(F.format_string("%02d_", col(number)), F.regexp_replace(F.substring(slug(title), 1, SLUG_CHARS), "_+$", ""))


def is_page_number(text: Column | str) -> Column:
    """F3."""
    return col(text).rlike(PAGE_NUMBER)


def is_bibliography_heading(text: Column | str) -> Column:
    """F1."""
    return col(text).rlike(BIBLIOGRAPHY_HEADING)


def is_apparatus(title: Column | str) -> Column:
    """titles of the apparatus that is not read out."""
    return col(title).rlike(APPARATUS)


def ends_paragraph(text: Column | str) -> Column:
    """Whether a text ends like a finished paragraph."""
    return col(text).rlike(PARAGRAPH_END)


def heading_like(text: Column | str) -> Column:
    """at most 80 characters and at least half the words with a capital; a text without words is like one."""
    words = F.regexp_extract_all(col(text), F.lit(r"(\p{L}+)"), F.lit(1))
    capital = F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))
    return (F.length(col(text)) <= HEADING_CHARS) & (2 * F.size(capital) >= F.size(words))


def first_letter(text: Column | str) -> Column:
    """The first letter of the text without its anchors; empty without letters."""
    return F.regexp_extract(F.regexp_replace(col(text), ANCHOR, ""), r"(\p{L})", 1)


def escaped_metadata(text: Column | str) -> Column:
    """SK13: backslash before `\\ = ; #` and line ends."""
    return F.regexp_replace(col(text), r"([\\=;#\n])", r"\\$1")


def playlist_title(text: Column | str) -> Column:
    """SK11: commas made low quotation marks, since a comma ends the duration."""
    return F.replace(col(text), F.lit(","), F.lit("‚"))


ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), n.cast("int") + 1)


def spelled(n: Column | str) -> Column:
    """A number from 0 to 999,999 in English words, no "and", tens and ones with a hyphen; null beyond."""
    n = col(n)

    def below_hundred(x: Column) -> Column:
        tens = _pick(TENS, F.floor(x / 10))
        return F.when(x < 20, _pick(ONES, F.least(x, F.lit(19)))).when(x % 10 == 0, tens).otherwise(F.concat(tens, F.lit("-"), _pick(ONES, x % 10)))

    def below_thousand(x: Column) -> Column:
        rest = x % 100
        hundreds = F.concat(_pick(ONES, F.floor(x / 100)), F.lit(" hundred"))
        return F.when(x < 100, below_hundred(x)).when(rest == 0, hundreds).otherwise(F.concat(hundreds, F.lit(" "), below_hundred(rest)))

    thousands = F.concat(below_thousand(F.floor(n / 1000) % 1000), F.lit(" thousand"))
    whole = F.when(n < 1000, below_thousand(n % 1000)).when(n % 1000 == 0, thousands).otherwise(F.concat(thousands, F.lit(" "), below_thousand(n % 1000)))
    return F.when((n >= 0) & (n < 1_000_000), whole)


def locator_words(text: Column | str) -> Column:
    """A locator spoken: numbers in words, points and colons as commas, dashes as "to"; other characters go."""
    parts = F.regexp_extract_all(col(text), F.lit(r"([0-9]+|[.:]|[-–−])"), F.lit(1))
    spoken = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), spelled(p.cast("bigint"))).when(p.isin(".", ":"), F.lit(", ")).otherwise(F.lit(" to ")))
    return F.array_join(spoken, "")


def spelled_digits(text: Column | str) -> Column:
    """Each digit in words, joined by hyphens."""
    return F.array_join(F.transform(F.regexp_extract_all(col(text), F.lit("([0-9])"), F.lit(1)), lambda d: _pick(ONES, d.cast("int"))), "-")
