"""Sentence units for texts in many languages and scripts, in SQL expressions only (problem 3).

Every step keeps the number of code points: a mark that does not end a sentence is replaced by one private-use
character, a boundary replaces one white-space character. Offsets in the masked text are therefore offsets in the
text, and cutting the text at them restores every masked character.

Defined results: a null or blank text gives no sentence; a text without end mark is one; a blank line always ends
one; a quotation or bracketed remark is never cut; a note anchor and closing marks stay with the sentence before.
Private-use characters E000-E023 that a text already holds are read as ordinary letters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import table

# The marks.
STOPS = ".．!?…‥。！？｡؟۔।॥։።፧⸮‼⁇⁈⁉"
CLOSERS = "”\"’»)\\]」』】〉》›“'"
MASK = ""
QUOTE_MASK = ""
GERSHAYIM = ""
CUT = ""
CJK_CUT = ""
WS = r"[\s\u0085   -     　]"

# Abbreviations that stand before a name or a number and so never end a sentence.
TITLES = "Dr|Drs|Prof|Mr|Mrs|Ms|Messrs|St|Ste|Rev|Fr|Sr|Sra|Srta|Dra|Mme|Mmes|Mlle|MM|Mgr|sig|Sig|sigg|dott|Dott|prof|Hr|Hrn|Frl|dhr|mevr|mw|ds|ir|Gen|Col|Capt|Lt|Hon|Ven"
BEFORE_NAME = "ed|eds|trans|tr|Hg|Hrsg|hrsg|ca|approx|cf|Cf|vgl|Vgl|cfr|Cfr|viz|vs|c|Véase|bes|bzw|resp|ibid"
BEFORE_NUMBER = (
    "p|pp|P|fol|foll|Fol|ff|f|fo|vol|vols|Vol|Vols|no|nos|No|Nos|nr|Nr|Nrn|núm|num|n|nn|N|º|Bd|Bde|Bdn|S|Sp|Jh|Jhd|Abs|Abb|Kap|ch|chap|Ch|cap|Cap|capp|lib|Lib|"
    "art|Art|Artt|sect|sec|Sec|par|para|fig|figs|Fig|Figs|t|tt|T|tom|tome|pág|págs|pag|pagg|blz|bl|dl|hfdst|Rz|Anm|Abt|Taf|pl|Pl|col|cols|ll|l|v|vv|q|qu|r|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec|Okt|Dez|Mrz|janv|févr|avr|juil|déc|"
    "с|стр|т|тт|гл|ст|рис|см|ср|г|гг|σ|σελ|κεφ|τ|τόμ|στ"
)
TWO_PART = r"z\.{W}?B|d\.{W}?h|u\.{W}?a|u\.{W}?ä|s\.{W}?o|s\.{W}?u|i\.{W}?d|v\.{W}?a|z\.{W}?T|o\.{W}?ä|i\.{W}?e|e\.{W}?g|p\.{W}?ej|p\.{W}?ex|ad{W}es|per{W}es|o\.{W}?a|т\.{W}?е|и\.{W}?о|т\.{W}?д".replace("{W}", WS)
#: The halves of those whose first half has a point of its own.
INNER = [(p[0], p[1]) for p in (x.split(rf"\.{WS}?") for x in TWO_PART.split("|")) if len(p) == 2]
ERAS = r"(?:B\.C|A\.D|C\.E|B\.C\.E|U\.S|U\.K|a\.m|p\.m|Ph\.D)"
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
ORDINAL_NOUNS = f"{MONTHS}|Jahrhundert|Jahrhunderts|Jh|Jhs|Jahrtausend|Kapitel|Kapitels|Buch|Buches|Auflage|Band|Bandes|Tag|Jahrestag|Abschnitt"
PARTICLES = "de|du|des|von|van|vom|zu|zum|zur|ter|ten|den|der|della|delle|dei|degli|del|di|da|dal|dos|das|do|ibn|bin|ben|af|av"

# Marks that open and close a quotation or remark; a German closing mark is an English opening mark, so order counts.
PAIRS = [("„", "“”", "„"), ("“", "”", "“”"), ("«", "»", "«»"), ("»", "«", "«»"), ("「", "」", "「」"), ("『", "』", "『』"), ("‚", "‘", "‚‘"), ("‘", "’", "‘"), ("(", ")", "()"), ("[", "]", "[]"), ("（", "）", "（）")]
_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _PLAIN)
_OPEN, _CLOSE = "", ""
_IN_OPEN, _IN_CLOSE = "\ue022", "\ue023"
_HELD = "".join(map(chr, range(0xE000, 0xE024)))  # all placeholders


def _esc(chars: str) -> str:
    return "".join("\\" + c if c in "[]()\\^-" else c for c in chars)


def _inside(piece: Column) -> Column:
    """Masks every end mark of a quotation but those right before its closing mark."""
    tail = F.regexp_extract(piece, f"[{_esc(STOPS)};]*.$", 0)
    head = F.substring(piece, F.lit(1), F.length(piece) - F.length(tail))
    return F.concat(F.translate(head, STOPS + ";", QUOTE_MASK * (len(STOPS) + 1)), tail)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once: without it an expression named n times is copied n times, and the
    copies of nested steps multiply."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def _mask_pair(text: Column, open_: str, close: str, not_in: str) -> Column:
    apostrophe = open_ in "‘‚"
    close_pattern = f"[{_esc(close)}]" + (r"(?![\p{L}])" if apostrophe else "")
    inner = f"[^{_esc(not_in)}{_esc(close) if not apostrophe else ''}{CUT}]*" if not apostrophe else f"[^‘‚{CUT}]*?"
    pattern = f"{_esc(open_)}({inner}){close_pattern}"

    def once(x: Column, opened: str, closed: str) -> Column:
        pieces = F.split(F.regexp_replace(x, pattern, f"{_OPEN}$1{_CLOSE}"), f"(?={_OPEN})|(?<={_CLOSE})", -1)
        masked = F.array_join(F.transform(pieces, lambda y: F.when(y.startswith(_OPEN), _inside(y)).otherwise(y)), "")
        return F.translate(masked, _OPEN + _CLOSE, opened + closed)

    # The anchor [^ref] keeps its own marks; elsewhere any closing mark will do for the rules below.
    shut = "]" if open_ == "[" else ")" if open_ in "(（" else "”"
    opened = {"[": "[", "(": "("}.get(open_, "“")
    if apostrophe:
        return F.when(text.contains(open_), once(text, opened, shut)).otherwise(text)
    # Nested pairs are masked from the innermost outwards, as often as there are opening marks: no pair lies deeper.
    turns = F.sequence(F.lit(1), F.length(text) - F.length(F.translate(text, open_, "")))
    nested = F.translate(F.aggregate(turns, text, lambda x, _: once(x, _IN_OPEN, _IN_CLOSE)), _IN_OPEN + _IN_CLOSE, opened + shut)
    deep = text.rlike(f"{_esc(open_)}[^{_esc(close)}{CUT}]*{_esc(open_)}")
    return F.when(~text.contains(open_), text).when(deep, nested).otherwise(once(text, opened, shut))


def _mask_pairs(text: Column) -> Column:
    for pair in PAIRS:
        text = _let(text, partial(lambda p, x: _mask_pair(x, *p), pair))
    return text


def _mask_straight(text: Column) -> Column:
    """Straight quotation marks come in turns within a paragraph; a last one without partner is left alone."""
    paragraphs = F.split(text, f"(?<={CUT})", -1)

    def one(p: Column) -> Column:
        parts = F.split(p, '"', -1)
        last = F.size(parts) - 1
        turned = F.transform(
            parts,
            lambda x, i: F.when((i % 2 == 1) & (i < last), _inside(F.concat(x, F.lit('"')))).when(i < last, F.concat(x, F.lit('"'))).otherwise(x),
        )
        return F.array_join(turned, "")

    return F.when(text.contains('"'), F.array_join(F.transform(paragraphs, one), "")).otherwise(text)


def masked(text: Column) -> Column:
    """The text with harmless marks masked and one character at each boundary replaced; same length as the text."""
    dot = MASK
    # Placeholders the text already holds are read as a letter, full-width letters and digits as plain ones; between CJK letters the full-width full stop is a CJK stop.
    text = F.translate(text, _HELD + _WIDE, "ǀ" * len(_HELD) + _PLAIN)
    rules = [
        (r"(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}])．", "。"),
        (r"\n(?=[^\S\n]*\n)", CUT),  # blank line
        (r'(?<=\p{IsHebrew})"(?=\p{IsHebrew})', GERSHAYIM),
        (r"(?<=\p{N})[.．](?=\p{N})", dot),  # decimals, locators
        (r"(?<=[\p{L}\p{N}/])[.．](?=[\p{L}\p{N}/])", dot),  # host names, i.e., a.m.
        (r"(?<=[\p{L}\p{N}/=&])[?!](?=[\p{L}\p{N}/=&_])", dot),  # addresses
    ]
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    text = _let(_mask_pairs(text), _mask_straight)
    w = WS
    more = [
        (rf"(?<![\p{{L}}\p{{M}}])((?:{TITLES}|{BEFORE_NAME}))[.．](?={w}*[“‘„«(\[]?[\p{{L}}\p{{N}}])", rf"$1{dot}"),
        (rf"(?<![\p{{L}}\p{{M}}{MASK}])((?:{BEFORE_NUMBER}))[.．](?={w}*\p{{N}})", rf"$1{dot}"),
        (rf"(?<![\p{{L}}\p{{M}}])((?:{'|'.join(rf'{a}(?=[.．]{w}*+{b}[.．])' for a, b in INNER)}))[.．]", rf"$1{dot}"),
        (rf"(?<![\p{{L}}\p{{M}}])((?:{TWO_PART.replace('[.．]', MASK).replace(chr(92) + '.', '[.．' + MASK + ']')}))[.．](?={w})", rf"$1{dot}"),
        (rf"(?<![\p{{L}}\p{{M}}.．{MASK}])(\p{{Lu}})[.．](?={w}*\p{{Lu}})", rf"$1{dot}"),  # initials
        (rf"(?<=[\p{{Lu}}]{dot}{w}\p{{Lu}})[.．](?={w}\p{{Lu}})", dot),
        (rf"(?<![\p{{L}}\p{{M}}])(\p{{Lu}}\p{{L}}{{0,5}})[.．](?={w}\p{{N}}+[{MASK}:]\p{{N}})", rf"$1{dot}"),  # siglum and locator
        (rf"(?<![\p{{L}}\p{{M}}])([\p{{IsArabic}}\p{{IsHebrew}}\p{{IsDevanagari}}\p{{IsEthiopic}}\p{{IsArmenian}}][\p{{M}}]*)[.．](?={w})", rf"$1{dot}"),
        (rf"(?<=[\p{{IsDevanagari}}])[.．](?={w}*[\p{{IsDevanagari}}\p{{N}}])", dot),
        (rf"(?<![\p{{L}}\p{{N}}])(\p{{Nd}}{{1,2}})[.．](?={w}(?:{ORDINAL_NOUNS})(?![\p{{L}}]))", rf"$1{dot}"),
        (rf"(?<![\p{{L}}])((?:[Aa]m|[Ii]m|[Dd]er|[Dd]em|[Dd]es|[Dd]en|[Vv]om|[Zz]um|[Dd]as|[Dd]ie){w}\p{{Nd}}{{1,2}})[.．](?={w}\p{{L}})", rf"$1{dot}"),
    ]
    for pattern, to in more:
        text = F.regexp_replace(text, pattern, to)
    tail = rf"(?:[{CLOSERS}]|\p{{Cf}}|{w}[”»](?!{w}?\p{{L}}{{0}}$)|\[\^[^\]\s]{{1,60}}\])*"
    tail = rf"(?:[{CLOSERS}]|\p{{Cf}}| »| »|\[\^[^\]\s]{{1,60}}\])*"
    begin = rf"(?=[\s\p{{Z}}\p{{Cf}}]*(?:[“‘„«»(\[\"'¿¡「『（—–-]|{w})*(?:(?![\p{{Ll}}—–,;:]).|[\p{{IsGreek}}\p{{IsArmenian}}]|(?:{PARTICLES}){w}\p{{Lu}}|[dl]['’]\p{{Lu}}|al-\p{{Lu}}))"
    text = F.regexp_replace(text, rf"((?:[{_esc(STOPS)}]|(?<=\p{{IsGreek}})[;;])[{_esc(STOPS)}]*{tail}){w}{begin}", rf"$1{CUT}")
    # A CJK stop ends a sentence without white space too, after its tail of stops, invisible characters and anchors; a
    # closing mark right after it leaves the sentence open (他说：“走。”然后). The mark takes the next sentence's first place.
    cjk_tail = rf"[{_esc(STOPS)}]*+(?:\p{{Cf}}|\[\^[^\]\s]{{1,60}}\])*+"
    return F.regexp_replace(text, rf"([。！？｡]{cjk_tail}(?![{_esc('”’」』】〉》）)]')}]){w}*+)[^{CUT}]", rf"$1{CJK_CUT}")


def spans(text: Column) -> Column:
    """array<struct<start_at, end_at>> of the sentences; null for a null text."""
    pieces = F.split(masked(text), f"(?<={CUT})|(?={CJK_CUT})", -1)
    blank = rf"[\s\x1c-\x1f\u0085   -     　{CUT}]"
    measured = F.transform(
        pieces,
        lambda p: F.struct(
            F.length(p).cast("bigint").alias("n"),
            (F.length(p) - F.length(F.regexp_replace(p, f"^{blank}+", ""))).cast("bigint").alias("lead"),
            F.length(F.regexp_replace(p, f"{blank}+$", "")).cast("bigint").alias("kept"),
        ),
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start_at:bigint,end_at:bigint>>").alias("out"))
    folded = F.aggregate(
        measured,
        zero,
        lambda acc, m: F.struct(
            (acc["at"] + m["n"]).alias("at"),
            F.when(m["lead"] < m["kept"], F.concat(acc["out"], F.array(F.struct((acc["at"] + m["lead"]).alias("start_at"), (acc["at"] + m["kept"]).alias("end_at"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return folded


def sentences(df: DataFrame, text: str = "text", restore: bool = True) -> DataFrame:
    """One row per sentence: the columns of `df` without `text`, then sentence_no, start_at, end_at and, with
    `restore`, the sentence itself, cut from the text as it was. Nulls and blank texts give no row; columns of `df`
    with these names are replaced. Narrow: no shuffle."""
    keep = [F.col(c) for c in df.columns if c not in (text, "sentence_no", "start_at", "end_at", "sentence", "__spans")]
    with_spans = df.select(*keep, F.col(text), spans(F.col(text)).alias("__spans"))
    # The outer form, since the plain one makes the optimizer filter on the spans too and so compute them three times.
    rows = with_spans.select(*keep, F.col(text), F.posexplode_outer("__spans").alias("sentence_no", "__s")).where("__s is not null")
    cut = [F.expr(f"substring(`{text}`, int(__s.start_at) + 1, int(__s.end_at - __s.start_at))").alias("sentence")] if restore else []
    return rows.select(*keep, "sentence_no", F.col("__s.start_at").alias("start_at"), F.col("__s.end_at").alias("end_at"), *cut)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """kind, row_id, text of problem 3: every utterance, and the sections of `.epub` books."""
    books = table(spark, folder, "doc_meta").where("suffix = '.epub'").select("doc_id").distinct()
    sections = table(spark, folder, "sections").select("section_id", "doc_id", "text").join(books, "doc_id", "left_semi")
    return table(spark, folder, "utterances").select(F.lit("utterance").alias("kind"), F.col("utt_id").alias("row_id"), "text").unionByName(
        sections.select(F.lit("section").alias("kind"), F.col("section_id").alias("row_id"), "text")
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """kind, row_id, start_at, end_at: one row per sentence. Repeated rows are alike, so their spans are made in place
    and counted once: the spans are shuffled, not the texts."""
    return sentences(texts(spark, folder), restore=False).select("kind", "row_id", "start_at", "end_at").distinct()
