"""Repair of text from scanned pages (problem 4).

Method: an averaged-perceptron character editor. For each word it weighs its proposals - keep, or replacements, deletions
and insertions of characters, a deleted space, a line join without or with its hyphen - and takes the best. It is trained
on noise made from clean text: lines wrapped to a page's width, words broken, characters misread by a table of print
confusions. Running headers and page numbers are found by their place and form on the page: lines that hold a number
only, or the title of the book or section with or without one, within the letters a scan gets wrong, and lines next to
these that come back in several books.

Bounds: the lexicon holds the MOST_WORDS most frequent words of clean sections, the training text TRAINING_SECTIONS of
them chosen by hash; both are broadcast. All lines of all texts are edited. Stamps are not bounded: each text is joined
with those among its own lines.
Defined results: null and empty texts have no lines to report; blank lines are never reported; line numbers count all
lines; letters of other scripts and words the lexicon cannot explain are kept.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import checkpoint_dir
from foliant.sources.tables import table

MOST_WORDS = 200_000
TRAINING_SECTIONS = 250
PASSES = 3

# What a scan reads -> what was printed.
CONFUSIONS = [
    ("1", "i"), ("1", "l"), ("0", "o"), ("5", "s"), ("9", "g"), ("8", "b"), ("6", "b"), ("3", "e"), ("†", "t"), ("ɑ", "a"), ("c", "e"), ("e", "c"), ("n", "u"), ("u", "n"), ("b", "h"), ("h", "b"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("U", "ll"), ("li", "h"), ("h", "li"), ("ii", "u"), ("ri", "n"), ("in", "m"), ("nn", "m"), ("I", "l"), ("l", "i"), ("i", "l"), ("t", "f"), ("f", "t"), ("o", "a"), ("a", "o"), ("y", "v"), ("v", "y"),
    ("l", "1"), ("I", "1"), ("O", "0"), ("o", "0"), ("S", "5"), ("Z", "2"), ("B", "8"), ("q", "g"), ("j", "i"), ("£", "f"), ("€", "e"), ("|", "l"), ("ﬁ", "fi"), ("0", "O"), ("1", "I"), ("5", "S"), ("6", "G"), ("8", "B"),
    ("s", "f"), ("f", "s"), ("lc", "k"), ("k", "lc"), ("tl", "d"), ("c", "o"), ("o", "c"), ("o", "e"), ("e", "o"), ("D", "O"), ("z", "x"), ("r", "t"), ("t", "r"), ("l", "t"), ("t", "l"), ("ı", "i"), ("í", "i"), ("@", "a"), ("$", "s"), ("ll", "U"), ("nn", "rm"), ("iu", "in"),
]
BY_FIRST: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _seen, _meant in CONFUSIONS:
    BY_FIRST[_seen[0]].append((_seen, _meant))

HYPHENS = "-‐‑¬­"
EDGES = ".,;:!?()[]{}“”\"'‘’‚„«»‹›…—–-/*·" + HYPHENS
ANCHOR = re.compile(r"\[\^[^\]]*\]")
BROKEN = re.compile(rf"([^\s—–{re.escape(HYPHENS)}][^\s—–]*)[{re.escape(HYPHENS)}]\s*$")
ODD = re.compile(r"[0-9†ɑ|€£@$ﬁı]")
LATIN = re.compile(r"^[A-Za-zÀ-ɏ0-9†ɑﬁ|€£@$'’-]+$")
DIGITS_LIKE = re.compile(r"^[0-9lIOoSZB]+$")
NUMBER_LINE = re.compile(r"^[\s\-–—\[\](){}|.·*~]*(?:[0-9lIOoSZB]{1,4}|[ivxlcdm1]{1,8}|[IVXLCDM1]{1,8})[\s\-–—\[\](){}|.·*~]*$")
SUSPENDED = frozenset("and or und oder et ou e o y u en of bzw nor to".split())  # fixed values: words after a hyphen that stands for a part left out

FOLD = str.maketrans({"1": "i", "l": "i", "I": "i", "|": "i", "0": "o", "O": "o", "5": "s", "S": "s", "9": "g", "q": "g", "c": "e", "u": "n", "h": "b", "8": "b", "6": "b", "†": "t", "f": "t", "ɑ": "a", "3": "e"})


def fold(word: str) -> str:
    """The word with characters that scans mix up brought together."""
    w = word.replace("U", "ll") if not word.isupper() else word
    w = w.lower() if not ODD.search(w) else "".join(c if c in "†ɑ|" or c.isdigit() else c.lower() for c in w)
    return w.replace("rn", "m").replace("cl", "d").replace("vv", "w").translate(FOLD)


class Lexicon:
    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.folded = {fold(w) for w in counts}

    def n(self, word: str) -> int:
        w = word.lower().replace("’", "'")
        n = self.counts.get(w, 0)
        if not n and w.endswith("'s"):
            n = self.counts.get(w[:-2], 0)
        if not n and "-" in w:
            n = min((self.counts.get(p, 0) for p in w.split("-") if p), default=0)
        return n

    def known(self, word: str) -> bool:
        if word.isdigit() or not word:
            return True
        return self.n(word) > 0 or not LATIN.match(word)

    def near(self, word: str) -> bool:
        return fold(word) in self.folded


def size(n: int) -> str:
    return "0" if n == 0 else "1" if n < 5 else "2" if n < 30 else "3" if n < 200 else "4"


class Editor:
    """Averaged perceptron over the operations of a proposal."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.w: dict[str, float] = {}
        self.total: dict[str, float] = defaultdict(float)
        self.stamp: dict[str, int] = defaultdict(int)
        self.t = 0

    def __getstate__(self):
        return {"lexicon": self.lexicon.counts, "w": {k: v for k, v in self.w.items() if v}}

    def __setstate__(self, state):
        self.__init__(Lexicon(state["lexicon"]))
        self.w = state["w"]

    # A proposal: (place, operations, the word after it, features).

    def proposals(self, word: str, held_out: bool = False) -> list[tuple[int, str, str, list[str]]]:
        before = not held_out and self.lexicon.known(word)
        odd = "odd" if ODD.search(word) and not word.isdigit() else "plain"
        number = "num" if DIGITS_LIKE.match(word) and any(c.isdigit() for c in word) else "word"
        case = "Cap" if word[:1].isupper() else "low"
        out = [(-1, "K", word, [f"K|{before}", f"K|{before}|{odd}|{case}|{number}", f"K|{number}"])]
        for i, c in enumerate(word):
            for seen, meant in BY_FIRST.get(c, ()):
                if not word.startswith(seen, i):
                    continue
                after = word[:i] + meant + word[i + len(seen) :]
                if meant.isdigit() and number == "word":
                    continue
                n = self.lexicon.n(after) if not after.isdigit() else 20
                if not n and not (odd == "odd" and not seen.isalpha() or seen == "ɑ"):
                    continue  # neither the lexicon nor the form of the word speaks for it
                ops = f"R:{seen}>{meant}" if len(seen) == len(meant) else f"RD:{seen}>{meant}" if len(seen) > len(meant) else f"RI:{seen}>{meant}"
                kind = ops.split(":")[0]
                edge = "^" if i == 0 else "$" if i + len(seen) == len(word) else "."
                out.append((i, ops, after, [ops, f"{ops}|{size(n)}", f"{kind}|{before}|{size(n)}|{odd}", f"{kind}|{case}|{size(n)}", f"{kind}|{case}|{size(n)}|{odd}", f"{ops}|{word[i - 1 : i]}|{word[i + len(seen) : i + len(seen) + 1]}", f"{ops}|{number}", f"{kind}|{edge}|{case}", f"left|{bool(ODD.search(after))}|{number}", f"len|{min(len(word), 6)}|{before}|{size(n)}"]))
        return out

    def split_proposals(self, left: str, right: str) -> list[tuple[int, str, str, list[str]]]:
        """Two words: leave them, or delete the space."""
        whole = left + right
        a, b, n = self.lexicon.known(left), self.lexicon.known(right), self.lexicon.n(whole)
        short = min(len(left), len(right))
        form = f"{a}{b}|{size(n)}"
        return [(-1, "K", left, [f"KS|{form}", f"KS|{form}|{min(short, 4)}"]), (0, "D: ", whole, [f"DS|{form}", f"DS|{form}|{min(short, 4)}", f"DS|{right[:1].isupper()}"])]

    def join_proposals(self, left: str, right: str, hyphen: str) -> list[tuple[int, str, str, list[str]]]:
        """A line end with a hyphen: keep both, join to one word, join with the hyphen."""
        whole, compound = left + right, f"{left}-{right}"
        n, m = self.lexicon.n(whole), self.lexicon.counts.get(compound.lower(), 0)
        # The last part of a compound with several hyphens decides, and so does a compound a misread letter hides.
        if not m and "-" in left:
            m = self.lexicon.counts.get(f"{left.rsplit('-', 1)[1]}-{right}".lower(), 0)
        near_n, near_m = self.lexicon.near(whole), self.lexicon.near(compound)
        more = "more" if m > n else "less" if m < n else "same"
        form = f"{size(n)}|{size(m)}|{more}|{near_n}|{near_m}"
        rest = [hyphen, "small" if right[:1].islower() else "Cap", "susp" if right.lower() in SUSPENDED else "free", f"{self.lexicon.known(left)}|{self.lexicon.known(right)}"]
        return [(k, op, after, [f"{op}|{form}", *[f"{op}|{r}" for r in rest], f"{op}|{rest[2]}|{size(m)}|{near_n}", f"{op}|{rest[3]}|{form}"]) for k, op, after in ((-1, "K-", left), (0, "J", whole), (1, "J-", compound))]

    def best(self, options: list) -> int:
        get = self.w.get
        scores = [sum([get(f, 0.0) for f in o[3]]) for o in options]
        return max(range(len(options)), key=scores.__getitem__)

    def learn(self, options: list, gold: int) -> None:
        self.t += 1
        guess = self.best(options)
        if guess != gold:
            for k, by in ((gold, 1.0), (guess, -1.0)):
                for f in options[k][3]:
                    self.total[f] += (self.t - self.stamp[f]) * self.w.get(f, 0.0)
                    self.stamp[f] = self.t
                    self.w[f] = self.w.get(f, 0.0) + by

    def finish(self) -> None:
        for f in self.w:
            self.total[f] += (self.t - self.stamp[f]) * self.w[f]
            self.w[f] = self.total[f] / max(1, self.t)

    def word(self, word: str) -> tuple[str, list[int]]:
        """The edited word and the places of its edits."""
        places: list[int] = []
        for _ in range(4):
            if self.lexicon.known(word) and not places:
                return word, places
            options = self.proposals(word)
            k = self.best(options)
            if k == 0 or self.lexicon.known(word):
                break
            places.append(options[k][0])
            word = options[k][2]
        return word, places


def core(token: str) -> str:
    """A token without the marks around it."""
    return token.strip(EDGES)


def title_key(text: str | None) -> str:
    return "".join(c for c in fold((text or "").lower()) if c.isalpha())


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`."""
    if abs(len(a) - len(b)) > most:
        return False
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        if min(now) > most:
            return False
        last = now
    return last[-1] <= most


def stampable(line: str) -> bool:
    """A line short enough, not ending like a sentence and not beginning inside one: it may be a library's stamp."""
    s = line.strip()
    return 8 < len(s) <= 80 and s[-1].isalnum() and not s[0].islower()


def furniture(lines: list[str], titles: list[str], stamps: frozenset[str] = frozenset(), untitled: bool = True) -> set[int]:
    """Lines that belong to the page: a number alone, a title with or without a number, short and standing alone in
    form; a stamp that stands next to such a line."""
    keys = [k for k in map(title_key, titles) if k]
    out = set()
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or len(s) > 100:
            continue
        if stamps and stampable(s) and title_key(s) in stamps:
            out.add(i)
            continue
        if NUMBER_LINE.match(s) and not (s.endswith((".", ")")) and not s.startswith(("[", "(", "-", "—", "–"))):
            # A page number opens or closes a page; a number that a sentence runs into is text.
            if re.search(r"[0-9]", s) or len(s) < 9 and (not s.strip().isalpha() or s.islower() or s.isupper()) and s.lower() not in ("did", "dim", "mild", "mix", "mil", "mid", "lid", "vivid", "civil", "livid", "i"):
                out.add(i)
            elif s.lower() == "i" and (i == 0 or not lines[i - 1].strip() or i + 1 == len(lines) or not lines[i + 1].strip()):
                out.add(i)
            continue
        bare = re.sub(r"^\W*(?:[0-9lIOoSZB]{1,4}|[ivxlcdm]{1,8})\s{2,}|\s*[|·•]\s*[0-9lIOoSZBivxlcdm]{1,8}\W*$|\s{2,}(?:[0-9lIOoSZB]{1,4}|[ivxlcdm]{1,8})\W*$|^\W*[0-9lIOoSZBivxlcdm]{1,8}\s*[|·•]\s*", "", s)
        key = title_key(bare)
        if any(within(key, k, 2 if len(k) >= 12 else 1 if len(k) >= 6 else 0) for k in keys):
            out.add(i)
    if untitled and len(keys) < 2:  # a title is not known: a line in title form right beside a page number is its running header
        numbers = {i for i in out if NUMBER_LINE.match(lines[i].strip())}
        for i, line in enumerate(lines):
            words = [w for w in re.findall(r"[^\W\d_]+", line) if len(w) > 3]
            if i not in out and (i - 1 in numbers or i + 1 in numbers) and stampable(line) and words and all(w[0].isupper() for w in words):
                out.add(i)
    return out


def stamp_candidates(lines: list[str], titles: list[str]) -> list[tuple[str, bool]]:
    """(key, whether it stands next to page furniture) of the lines that may be stamps."""
    page = furniture(lines, titles, untitled=False)
    return [(title_key(x), i - 1 in page or i + 1 in page) for i, x in enumerate(lines) if i not in page and stampable(x)]


def read(text: str | None, titles: list[str], editor: Editor, stamps: frozenset[str] = frozenset()) -> tuple[list[tuple[int, str]], list[str]]:
    """((line_no, kind) of every finding, the repaired lines; a line joined to the one before is empty)."""
    if not text:
        return [], []
    lines = text.split("\n")
    page = furniture(lines, titles, stamps)
    found = [(i, "furniture") for i in sorted(page)]
    body = [i for i, x in enumerate(lines) if i not in page and x.strip()]
    fixed = ["" if i in page else x for i, x in enumerate(lines)]
    misread: set[int] = set()
    lexicon = editor.lexicon
    taken: dict[int, int] = {}  # tokens at the start of a line that belong to the word broken before
    for at, i in enumerate(body):
        line = ANCHOR.sub(" ", lines[i])
        tokens = line.split()
        broken = BROKEN.search(line)
        last_joined = False
        if broken and at + 1 < len(body) and tokens:
            nxt = body[at + 1]
            after = ANCHOR.sub(" ", lines[nxt]).split()
            left, right = tokens[-1].lstrip(EDGES).rstrip(HYPHENS), core(after[0]) if after else ""
            if left and right and LATIN.match(right):
                options = editor.join_proposals(left, right, line.rstrip()[-1])
                op = options[editor.best(options)][1]
                if op != "K-":
                    found.append((i, "broken_word" if op == "J" else "broken_compound"))
                    last_joined = True
                    taken[nxt] = 1
                    whole = left + right if op == "J" else f"{left}-{right}"
                    if not (lexicon.known(whole) or op == "J-" and lexicon.known(left) and lexicon.known(right)):
                        new, places = editor.word(whole)
                        for p in places:
                            misread.add(i if p < len(left) else nxt)
                        whole = new
                    fixed[i] = re.sub(r"\S+\s*$", lambda m: m.group().rstrip()[: len(m.group().rstrip()) - len(m.group().rstrip().lstrip(EDGES))] + whole, fixed[i].rstrip()) if fixed[i].rstrip().endswith(tuple(HYPHENS)) else fixed[i]
                    rest = lines[nxt].lstrip()
                    fixed[i] += rest[len(right) :].split(" ", 1)[0] if rest.startswith(right) else ""
                    fixed[nxt] = rest.split(" ", 1)[1] if " " in rest else ""
        words = tokens[taken.get(i, 0) : len(tokens) - last_joined]
        cores = [core(w) for w in words]
        k = 0
        while k < len(words):
            w = cores[k]
            if len(w) > 1 and w.endswith(("'s", "’s")):
                w = w[:-2]
            if k + 1 < len(words) and cores[k + 1] and words[k][-1:] == cores[k][-1:] and words[k + 1][:1] == cores[k + 1][:1] and not (lexicon.known(w) and lexicon.known(cores[k + 1])) and lexicon.n(cores[k] + cores[k + 1]) and cores[k].isalpha():
                options = editor.split_proposals(cores[k], cores[k + 1])
                if editor.best(options) == 1:
                    misread.add(i)
                    fixed[i] = fixed[i].replace(f"{words[k]} {words[k + 1]}", words[k] + words[k + 1], 1)
                    k += 2
                    continue
            if w and not lexicon.known(w):
                new, places = editor.word(w)
                if places:
                    misread.add(i)
                    fixed[i] = fixed[i].replace(w, new, 1)
            k += 1
    found += [(i, "misread") for i in sorted(misread)]
    return found, fixed


def paragraphs(text: str | None, titles: list[str], editor: Editor, stamps: frozenset[str] = frozenset()) -> str | None:
    """Continuous paragraphs: furniture gone, lines joined, words edited; a blank line next to furniture is the page's
    unless the line before it ends a sentence."""
    if text is None:
        return None
    found, fixed = read(text, titles, editor, stamps)
    page = {i for i, kind in found if kind == "furniture"}
    lines = text.split("\n")
    out: list[list[str]] = [[]]
    for i, line in enumerate(fixed):
        if lines[i].strip():
            if line.strip():
                out[-1].append(line.strip())
        else:
            by_page = any(j in page for j in (i - 1, i + 1))
            done = bool(out[-1]) and re.search(r"[.!?…][”\"’»)\]]*(?:\[\^[^\]]*\])*$", out[-1][-1])
            if out[-1] and (not by_page or done):
                out.append([])
    return "\n\n".join(" ".join(p) for p in out if p)


# Training.


def spoiled(word: str, rng: random.Random) -> tuple[str, list[tuple[int, str]]]:
    """The word as a scan might read it, with the edits that mend it."""
    options = [(i, seen, meant) for i in range(len(word)) for seen, meant in CONFUSIONS if word.startswith(meant, i) and not meant.isdigit()]
    common = [o for o in options if (o[1], o[2]) in CONFUSIONS[:26]]
    if not options:
        return word, []
    i, seen, meant = rng.choice(common if common and rng.random() < 0.9 else options)
    return word[:i] + seen + word[i + len(meant) :], [(i, f"{seen}>{meant}")]


def train(lexicon: Lexicon, texts: list[str], seed: int = 3) -> Editor:
    """Three passes over the words of clean texts, spoiled anew each time."""
    editor, rng = Editor(lexicon), random.Random(seed)
    for _ in range(PASSES):
        for text in texts:
            words = [core(w) for w in ANCHOR.sub(" ", text).split()]
            for k, w in enumerate(words):
                if len(w) < 2 or not LATIN.match(w) or w.isdigit():
                    continue
                chance = rng.random()
                if chance < 0.25:
                    bad, edits = spoiled(w, rng)
                    if edits and bad != w and not lexicon.known(bad):
                        options = editor.proposals(bad)
                        gold = [j for j, o in enumerate(options) if o[0] == edits[0][0] and o[2] == w]
                        if gold:
                            editor.learn(options, gold[0])
                elif chance < 0.6 and lexicon.n(w) < (60 if w[0].isupper() else 5):  # a rare word or a name: as if the lexicon did not hold it
                    editor.learn(editor.proposals(w, held_out=True), 0)
                elif chance < 0.7 and len(w) > 3 and w.isalpha():
                    at = rng.randint(1, len(w) - 1)
                    editor.learn(editor.split_proposals(w[:at], w[at:]), 1)
                elif chance < 0.82 and k + 1 < len(words) and words[k + 1].isalpha() and w.isalpha():
                    if lexicon.n(w + words[k + 1]):
                        editor.learn(editor.split_proposals(w, words[k + 1]), 0)
                elif chance < 0.95 and len(w) > 4 and w.isalpha():
                    at = rng.randint(2, len(w) - 2)
                    left, right = w[:at], w[at:]
                    if rng.random() < 0.15:
                        right = spoiled(right, rng)[0]
                    editor.learn(editor.join_proposals(left, right, rng.choice(HYPHENS)), 1)
                if "-" in w.strip("-"):
                    left, right = w.split("-", 1) if rng.random() < 0.5 else w.rsplit("-", 1)
                    if left and right:
                        if rng.random() < 0.15:
                            right = spoiled(right, rng)[0]
                        editor.learn(editor.join_proposals(left, right, rng.choice(HYPHENS)), 2)
            for m in re.finditer(r"(\w+)[-‐] (\w+)", text):
                editor.learn(editor.join_proposals(m.group(1), m.group(2), "-"), 0)
    editor.finish()
    return editor


def lexicon_counts(clean: DataFrame, most: int = MOST_WORDS) -> dict[str, int]:
    """The most frequent words of the clean texts `text`, lower-cased, compounds whole and in parts; at least twice."""
    plain = F.regexp_replace(F.regexp_replace("text", r"\[\^[^\]]*\]", " "), "[‐‑]", "-")
    tokens = clean.select(F.explode(F.split(plain, r"\s+")).alias("token"))
    word = F.lower(F.regexp_replace("token", r"^[^\p{L}]+|[^\p{L}]+$|['’]s[^\p{L}]*$", "")).alias("word")
    words = tokens.select(word).where(F.col("word").rlike(r"^[\p{IsLatin}'’-]{1,40}$") & ~F.col("word").contains("ɑ"))
    parts = words.select(F.explode(F.array_distinct(F.concat(F.array("word"), F.split("word", "-")))).alias("word")).where("word <> ''")
    return {r[0]: r[1] for r in parts.groupBy("word").count().where("count >= 2").orderBy(F.desc("count"), "word").limit(most).collect()}


def editor_of(clean: DataFrame) -> Editor:
    """The editor trained on clean sections (section_id, text)."""
    n = clean.count()
    some = clean.where(F.pmod(F.xxhash64("section_id"), F.lit(1_000_000)) < int(min(1.0, TRAINING_SECTIONS / max(n, 1)) * 1_000_000))
    texts = [r[0] for r in some.orderBy("section_id").select("text").collect()]
    return train(Lexicon(lexicon_counts(clean)), texts)


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Clean sections, and the texts of scanned books: section_id, ref, text, titles."""
    books = table(spark, folder, "doc_meta").select("doc_id", "suffix", F.col("title").alias("book")).dropDuplicates(["doc_id"])
    sections = table(spark, folder, "sections").select("section_id", "doc_id", "title", "text", "footnotes")
    both = sections.join(books, "doc_id")
    clean = both.where("suffix = '.epub' and text is not null").select("section_id", "text").distinct()
    scanned = both.where("suffix = '.pdf'")
    titles = F.array("book", "title").alias("titles")
    notes = scanned.select("section_id", "doc_id", F.explode("footnotes").alias("n"), titles).select("section_id", "doc_id", F.coalesce("n.ref", F.lit("")).alias("ref"), "n.text", "titles")
    return clean, scanned.select("section_id", "doc_id", F.lit("").alias("ref"), "text", titles).unionByName(notes).where("text is not null")


def stamp_lines(scanned: DataFrame) -> DataFrame:
    """section_id, ref, doc_id, key, n, near: the lines of each text that may be stamps, how often each stands there and how
    often next to page furniture."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for s, ref, d, text, titles in part[["section_id", "ref", "doc_id", "text", "titles"]].itertuples(index=False):
                found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
                for key, near in stamp_candidates(text.split("\n"), [t for t in titles if t]):
                    found[key][0] += 1
                    found[key][1] += near
                out += [(s, ref, d, key, n, near) for key, (n, near) in found.items()]
            yield pd.DataFrame(out, columns=["section_id", "ref", "doc_id", "key", "n", "near"])

    return scanned.mapInPandas(run, "section_id bigint, ref string, doc_id bigint, key string, n bigint, near bigint")


def stamps_of(lines: DataFrame, books: int = 3) -> DataFrame:
    """key: lines of section texts that come back in at least so many books, next to page furniture at least half the time."""
    by_book = lines.where("ref = ''").groupBy("key", "doc_id").agg(F.sum("n").alias("n"), F.sum("near").alias("near"))
    return by_book.groupBy("key").agg(F.count("*").alias("books"), F.sum("n").alias("n"), F.sum("near").alias("near")).where(f"books >= {books} and 2 * near >= n").select("key")


def with_stamps(scanned: DataFrame) -> DataFrame:
    """`scanned` with `stamps`, the stamps among a text's own lines (null if none); the set of all stamps need fit nowhere.
    Sections of one book lie together in the files; the merge join deals the pages out evenly."""
    checkpoint_dir(scanned.sparkSession)
    lines = stamp_lines(scanned).checkpoint()  # read twice below
    own = lines.join(stamps_of(lines), "key", "left_semi").groupBy(F.col("section_id").alias("__section"), F.col("ref").alias("__ref")).agg(F.collect_set("key").alias("stamps"))
    same = F.col("section_id").eqNullSafe(F.col("__section")) & (F.col("ref") == F.col("__ref"))
    return scanned.join(own.hint("merge"), same, "left").select(*scanned.columns, "stamps")


def _read_all(spark: SparkSession, folder: str, make, schema: str) -> DataFrame:
    clean, scanned = _inputs(spark, folder)
    shared = spark.sparkContext.broadcast(editor_of(clean))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        editor = shared.value
        for part in parts:
            texts = part[["section_id", "ref", "text", "titles", "stamps"]].itertuples(index=False)
            out = [row for s, ref, text, titles, stamps in texts for row in make(s, ref, text, [t for t in titles if t], editor, frozenset(() if stamps is None else stamps))]
            yield pd.DataFrame(out, columns=names)

    return with_stamps(scanned).mapInPandas(run, schema).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """section_id, ref, line_no, kind of all sections and footnotes of `.pdf` books."""
    return _read_all(spark, folder, lambda s, ref, text, titles, e, stamps: [(s, ref, n, kind) for n, kind in read(text, titles, e, stamps)[0]], "section_id bigint, ref string, line_no bigint, kind string")


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """section_id, ref, text: the readable paragraphs of all sections and footnotes of `.pdf` books."""
    return _read_all(spark, folder, lambda s, ref, text, titles, e, stamps: [(s, ref, paragraphs(text, titles, e, stamps))], "section_id bigint, ref string, text string")
