"""One consistent form for texts that look the same (problem 2).

Method: a trie over the corpus vocabulary is traversed by a weighted edit automaton in which look-alike characters and
ignorable characters cost nothing and any other edit costs 1; the best spelling reached within the budget is the
canonical one, and a token that reaches none is normalised by table. With the budget 0 of `canonical` zero-cost
reachability is an equivalence relation (same sequence of look-alike classes), so all members of a class get the same
spelling whether or not the vocabulary holds it: the bound on the vocabulary never decides what compares equal.

Kept apart, being visible: case, accents, raised digits, dash length, quotation marks, punctuation.
Defined results: null stays null, an empty or invisible text becomes the empty text, runs of white space within a line
become one space, line ends stay (a blank line stays one), texts of any length are processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import table

# Letters of other scripts and phonetic letters that print like the Latin letter below them.
LOOK_ALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХҮԌԚԜаеорсухіјѕԁһԛԝѵӏк" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνυικγηχτϲϳ" "օսհցզոՕՍ" "ɑɡʋⅼ",
    "ABESIJKMHOPCTYXYGQWaeopcyxijsdhqwvlk" "ABEZHIKMNOPTYXaopvuikynxtcj" "ouhgqnOU" "agvl",
))
# Hyphens of one width, apostrophes of one form, Hebrew and Greek signs that print alike.
LOOK_ALIKES |= {"‐": "-", "‑": "-", "­": "", "·": "·", ";": ";", "−": "–", "⸱": "·", "ʼ": "’"}
#: Compatibility forms that differ in width, break behaviour or joining only; raised, lowered and circled ones are visible.
SAME_FORMS = ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Words the canonical spelling may be chosen from: the most frequent ones; every other token is spelled by table.
VOCABULARY = 50_000


def ignorable(c: str) -> bool:
    return unicodedata.category(c) in ("Cf", "Cc", "Cn") and not c.isspace() or "︀" <= c <= "️" or c == "͏"


def symbols(c: str) -> str:
    """The look-alike class of a character: none for ignorables, several for ligatures and accented letters."""
    if c.isspace():
        return " "
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if ignorable(c):
        return ""
    form = unicodedata.decomposition(c)
    ligature = "LIGATURE" in unicodedata.name(c, "") and form.startswith("<compat>")
    if form.startswith(SAME_FORMS) or ligature:
        return "".join(symbols(chr(int(x, 16))) for x in form.split()[1:])
    return "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFD", c))


class Classes(dict):
    """Symbols by character, worked out once per character."""

    def __missing__(self, c: str) -> str:
        self[c] = out = symbols(c)
        return out


CLASSES = Classes()


def by_table(token: str) -> str:
    """The canonical spelling of a token the vocabulary does not hold."""
    return unicodedata.normalize("NFC", "".join([CLASSES[c] for c in token]))


class Trie:
    """Spellings by character; each node is [children, best spelling, its count]."""

    def __init__(self, words: list[tuple[str, int]]):
        self.root: list = [{}, None, 0]
        for word, n in words:
            node = self.root
            for c in unicodedata.normalize("NFD", word):
                node = node[0].setdefault(c, [{}, None, 0])
            if node[1] is None or (-n, word) < (-node[2], node[1]):
                node[1], node[2] = word, n
        self.alike: dict[str, set[str]] = {}
        for c in {c for w, _ in words for c in unicodedata.normalize("NFD", w)}:
            if len(CLASSES[c]) == 1:
                self.alike.setdefault(CLASSES[c], set()).add(c)

    def best(self, token: str, budget: int = 0) -> str | None:
        """The cheapest spelling, then the most frequent, then the first by code point; None beyond the budget."""
        states = self._inserted({id(self.root): (self.root, 0)}, budget)
        marks = unicodedata.normalize("NFD", "".join([CLASSES[c] for c in token]))  # ignorables are gone at no cost
        for s in marks:
            after: dict[int, tuple[list, int]] = {}

            def reach(node: list, cost: int) -> None:
                if cost <= budget and cost < after.get(id(node), (None, budget + 1))[1]:
                    after[id(node)] = (node, cost)

            for node, cost in states.values():
                for c in self.alike.get(s, ()):
                    if c in node[0]:
                        reach(node[0][c], cost)
                if cost < budget:
                    reach(node, cost + 1)
                    for child in node[0].values():
                        reach(child, cost + 1)
            states = self._inserted(after, budget)
            if not states:
                return None
        ends = [(cost, -node[2], node[1]) for node, cost in states.values() if node[1] is not None]
        return min(ends)[2] if ends else None

    @staticmethod
    def _inserted(states: dict, budget: int) -> dict:
        queue = list(states.values())
        while queue:
            node, cost = queue.pop()
            for child in node[0].values() if cost < budget else ():
                if cost + 1 < states.get(id(child), (None, budget + 1))[1]:
                    states[id(child)] = (child, cost + 1)
                    queue.append((child, cost + 1))
        return states


LINE_END = re.compile(r"\r\n|[\n\r  \x85]")
#: White space, as `str.split` has it, without the line ends.
GAPS = re.compile(r"[^\S\n]+")


def canonical_text(text: str, spell) -> str:
    lines = []
    for line in LINE_END.sub("\n", text).split("\n"):
        lines.append(" ".join([w for w in map(spell, line.split()) if w]))
    out = "\n".join(lines).strip("\n")
    return re.sub(r"\n{3,}", "\n\n", out)


def vocabulary(texts: list[Column], df: DataFrame, most: int = VOCABULARY) -> list[tuple[str, int]]:
    """The most frequent clean tokens (one script each, composed, nothing ignorable) with their counts."""
    token = F.explode(F.split(F.concat_ws(" ", *texts), r"\s+")).alias("token")
    clean = r"^[\p{IsLatin}\p{Nd}\p{P}&&[^＀-￯ﬀ-ﬆɑɡʋ‐‑ʼ]]+$|^[\p{IsGreek}\p{P}]*\p{IsGreek}{2,}[\p{IsGreek}\p{P}]*$|^[\p{IsCyrillic}\p{P}]*\p{IsCyrillic}{2,}[\p{IsCyrillic}\p{P}]*$"
    counted = df.select(token).where(F.col("token").rlike(clean)).groupBy("token").count()
    return [(r[0], r[1]) for r in counted.orderBy(F.desc("count"), "token").limit(most).collect()]


def canonical(df: DataFrame, text: str = "text", out: str = "canonical", words: list[tuple[str, int]] | None = None) -> DataFrame:
    """`df` with the canonical text in `out` (replaced where it exists). Narrow; the vocabulary (at most VOCABULARY
    words, some megabytes) is taken from `df` where none is given and broadcast once."""
    spark = df.sparkSession
    words = vocabulary([F.col(text)], df) if words is None else words
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("string")
    def spell_all(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie, seen = Trie(shared.value), {}

        def spell(token: str) -> str:
            found = seen.get(token)
            if found is None:
                if len(seen) > 500_000:
                    seen.clear()
                found = seen[token] = trie.best(token) or by_table(token)
            return found

        for part in parts:
            yield part.map(lambda t: None if t is None else canonical_text(t, spell))

    return df.withColumn(out, spell_all(F.col(text)))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """kind, key, text of all entries and sections with text; repeated rows are alike and meet again as one string."""
    entries, sections = table(spark, folder, "bibliography"), table(spark, folder, "sections")
    both = entries.select(F.lit("entry").alias("kind"), F.col("entry_id").alias("key"), "text")
    return both.unionByName(sections.select(F.lit("section").alias("kind"), F.col("section_id").alias("key"), "text")).where("text is not null and key is not null")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """kind, key_a, key_b: rows whose canonical texts are equal and whose texts are not. Blank texts are no case.

    Only digests are shuffled. Spellings are counted once a class and paired by an equi-join on the canonical digest; rows
    then meet the pairs of their own spellings. So copies of one string, however many, are never compared with each
    other, no group is gathered, and a hot spelling is split by the join on its rows."""
    from foliant.session import checkpoint_dir

    checkpoint_dir(spark)
    both = texts(spark, folder)
    rows = canonical(both, words=vocabulary([F.col("text")], both)).where("canonical <> ''")
    rows = rows.select("kind", "key", F.sha2("canonical", 256).alias("look"), F.sha2("text", 256).alias("spelling")).distinct().checkpoint()
    spellings = rows.select("kind", "look", "spelling").distinct()
    other = spellings.withColumnRenamed("spelling", "spelling_b")
    pairs = spellings.withColumnRenamed("spelling", "spelling_a").join(other, ["kind", "look"]).where("spelling_a < spelling_b").drop("look")
    left = rows.select("kind", F.col("key").alias("a"), F.col("spelling").alias("spelling_a"))
    right = rows.select("kind", F.col("key").alias("b"), F.col("spelling").alias("spelling_b"))
    met = pairs.join(left, ["kind", "spelling_a"]).join(right, ["kind", "spelling_b"]).where("a <> b")
    return met.select("kind", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
