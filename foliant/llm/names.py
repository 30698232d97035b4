"""Variant spellings of the names of people and institutions (problem 1).

Method: pigeonhole segment join. Every head word of a name (a family name, the place of an institution) is cut into k+1
segments; position-shifted substrings of the other head words are looked up in the inverted index of segments by an
equi-join, and the candidates are verified with a banded edit distance (insertion, deletion, change, swap of neighbours).
Two changes within k leave at least one segment whole, so no pair within the distance is missed. Names whose head words
meet are then compared by their given names (full, initials, nicknames, one typing error) or, for institutions, by
their words (whole, abbreviated, acronym).

Who is linked: names that agree in full given names form a person; a name that says less (initials, fewer given names,
none) joins the one person it fits and stays alone where it fits several, since namesakes are different people.
Defined results: null and blank names are dropped; repeated names count once; names without letters are never linked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.leaks import FOLDED
from foliant.sources.tables import table

# Short forms of given names, each with the names it stands for.
NICKNAMES = {
    "alex": "alexander", "sasha": "alexander", "sascha": "alexander", "sandy": "alexander", "alec": "alexander", "xander": "alexander",
    "tony": "anthony", "toni": "anthony", "thea": "dorothea theodora", "dora": "dorothea theodora", "dolly": "dorothea", "dot": "dorothea", "theo": "theodora theodor",
    "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "edward theodor", "teddy": "edward theodor",
    "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "betsy": "elizabeth", "libby": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth", "elsie": "elizabeth", "bess": "elizabeth",
    "paco": "francisco", "pancho": "francisco", "kiko": "francisco", "frank": "francisco", "curro": "francisco", "fred": "frederick", "freddie": "frederick", "freddy": "frederick", "fritz": "frederick", "rick": "frederick richard",
    "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe", "peppino": "giuseppe", "hattie": "henrietta harriet", "etta": "henrietta", "hetty": "henrietta", "hettie": "henrietta",
    "inge": "ingrid", "inga": "ingrid", "hans": "johannes", "hannes": "johannes", "jan": "johannes", "jo": "johannes", "johan": "johannes", "jannes": "johannes",
    "kathi": "katharina", "kati": "katharina", "katja": "katharina", "kathe": "katharina", "katrin": "katharina", "kate": "katharina", "trina": "katharina", "rina": "katharina", "katie": "katharina", "kat": "katharina",
    "lew": "llewelyn", "llew": "llewelyn", "lyn": "llewelyn", "lou": "llewelyn", "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "madge": "margaret", "margie": "margaret", "greta": "margaret", "daisy": "margaret", "rita": "margaret", "maisie": "margaret",
    "matt": "matthias", "mats": "matthias", "hias": "matthias", "matze": "matthias", "kolya": "nikolai", "nick": "nikolai", "nico": "nikolai", "niko": "nikolai", "klaus": "nikolai",
    "piet": "pieter", "pete": "pieter", "peter": "pieter", "dick": "richard", "rich": "richard", "richie": "richard", "ricky": "richard", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bert": "robert", "rupert": "robert",
    "sue": "susanna", "susi": "susanna", "susie": "susanna", "suzy": "susanna", "sanna": "susanna", "susan": "susanna", "uli": "ulrich", "ulli": "ulrich", "utz": "ulrich", "bill": "william", "billy": "william", "will": "william", "willy": "william", "liam": "william",
    "zoli": "zoltan", "yusi": "yusuf", "joe": "joseph", "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john", "kit": "christopher", "chris": "christopher", "tom": "thomas", "tommy": "thomas", "sam": "samuel", "dan": "daniel", "mike": "michael", "misha": "mikhail", "vanya": "ivan", "pepe": "jose", "gigi": "luigi", "nanni": "giovanni", "gianni": "giovanni",
}
#: First letters of the short forms of each full name.
SHORT_LETTERS: dict[str, set[str]] = {}
for _short, _full in NICKNAMES.items():
    for _name in _full.split():
        SHORT_LETTERS.setdefault(_name, set()).add(_short[0])
# Particles of family names.
PARTICLES = set("de du des von van vom zu zum zur ter ten den der della delle dei degli del di da dal dos das do ibn bin ben af av la le les al el the und".split())
# Kinds of institutions, whole and short.
BODIES = set("academy acad institute inst centre center ctr society soc commission comm committee university univ museum mus library libr college coll association assoc council foundation found department dept school bureau office".split())
# Words that an acronym and a comparison of institutions pass over; short forms that are no beginning of the word.
SMALL = set("for of and the on in".split())
SHORT = {"ctr": "centre", "center": "centre", "ms": "manuscript", "mss": "manuscripts", "dept": "department", "natl": "national", "intl": "international"}
LETTERS = {ord("ø"): "o", ord("Ø"): "O", ord("ß"): "ss", ord("æ"): "ae", ord("Æ"): "AE", ord("œ"): "oe", ord("ł"): "l", ord("đ"): "d", ord("ð"): "d", ord("þ"): "th", ord("&"): " and "}
#: Given names kept to tell the order of names without a comma: the ones most used; beyond them both orders are tried.
MOST_GIVEN = 20_000


def tokens(name: str) -> list[str]:
    return name.translate(LETTERS).translate(FOLDED).split()


def changes(word: str) -> int:
    """k: the typing errors allowed in a head word."""
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


def distance(a: str, b: str, most: int) -> int:
    """Banded edit distance with swaps of neighbours; most + 1 when it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before, last = None, {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                now[j] = i
                continue
            d = min(last.get(j, far) + 1, now.get(j - 1, far) + 1, last.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if before is not None and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before.get(j - 2, far) + 1)
            now[j] = min(d, far)
        if min(now.values()) > most:
            return far
        before, last = last, now
    return last.get(len(b), far)


KEYS = {c: (row, x + row / 2) for row, keys in enumerate(("qwertyuiop", "asdfghjkl", "zxcvbnm")) for x, c in enumerate(keys)}


def beside(a: str, b: str) -> bool:
    """Whether two letters lie side by side on the keyboard."""
    return a in KEYS and b in KEYS and abs(KEYS[a][0] - KEYS[b][0]) <= 1 and abs(KEYS[a][1] - KEYS[b][1]) <= 1


def same_head(a: str, b: str) -> bool:
    """Within k errors; two replaced letters are errors of typing only if each lies beside the right one."""
    most = min(changes(a), changes(b))
    d = distance(a, b, most)
    if d > most:
        return False
    if d == 2 and len(a) == len(b):
        wrong = [(x, y) for x, y in zip(a, b) if x != y]
        return len(wrong) != 2 or all(beside(x, y) for x, y in wrong)
    return True


def segments(word: str) -> list[tuple[int, str]]:
    """The k+1 segments of a word with their places, even in length."""
    parts = changes(word) + 1
    base, extra = divmod(len(word), parts)
    out, at = [], 0
    for p in range(parts):
        n = base + (p >= parts - extra)
        out.append((at, word[at : at + n]))
        at += n
    return out


def index_keys(word: str) -> list[str]:
    return [f"{len(word)}:{p}:{s}" for p, (_, s) in enumerate(segments(word))]


def probe_keys(word: str) -> set[str]:
    """The keys of every word within k of this one: its substrings at the places the segments may have shifted to."""
    out = set()
    for length in range(len(word) - 2, len(word) + 3):
        like = "x" * length
        k = changes(like)
        if abs(length - len(word)) > k or length < 1:
            continue
        for p, (at, s) in enumerate(segments(like)):
            for shift in range(-k, k + 1):
                if at + shift >= 0 and at + shift + len(s) <= len(word):
                    out.add(f"{length}:{p}:{word[at + shift:at + shift + len(s)]}")
    return out


def parsed(name: str, given: set[str]) -> tuple[str, list[str], list[str]]:
    """(kind, head words, other words) of a name; an initial is a word of one letter."""
    words = tokens(name)
    acronym = re.search(r"\b[A-Z]f[A-Z]{2,}\b|\b[A-Z]{3,}\b", name) if sum(c.islower() for c in name) else None
    if any(w in BODIES for w in words) and not ("," in name and len(words) == 2) or acronym and acronym.group()[1] == "f":
        head, rest = [], []
        apart = re.search(r"\(([^()]+)\)\s*$|,\s*([^,]+)$", name)
        if apart:
            head = [w for w in tokens(apart.group(1) or apart.group(2)) if w not in SMALL]
            rest = tokens(name[: apart.start()])
        else:
            at = next((i for i, w in enumerate(words) if w in BODIES), None)
            if at is None:
                rest = [acronym.group()]
                head = tokens(name.replace(acronym.group(), " "))
            else:
                head, rest = words[:at], words[at:]
        return "body", [w for w in head if w not in SMALL] or rest[:1], [w for w in rest if w.lower() not in SMALL]
    if "," in name:
        head, _, rest = name.partition(",")
        heads = [w for w in tokens(head) if w not in PARTICLES and len(w) > 1]
        others = [w for w in tokens(rest) if w not in PARTICLES]
        if heads and not all(w in given for w in heads):
            return "person", heads, others
    whole = [w for w in words if w not in PARTICLES]
    heads = [w for w in whole if len(w) > 1 and w not in given]
    if not heads:
        heads = [w for w in whole if len(w) > 1][-1:]
    elif len(heads) > 1:  # a given name nobody else has, or a typing error in one: the family name is at one end
        near = [w for w in heads if len(w) < 5 or any(abs(len(w) - len(g)) < 2 and w[0] == g[0] and distance(w, g, 1) <= 1 for g in given)]
        heads = [w for w in heads if w not in near] or heads
    return "person", heads, [w for w in whole if w not in heads]


def same_given(a: str, b: str, loose: bool = False) -> bool:
    """Whether two given names or initials may be one; `loose`: an initial may be that of a short form (P. for Margaret)."""
    if a == b:
        return True
    if loose and (len(a) == 1) != (len(b) == 1):
        one, full = sorted((a, b), key=len)
        if any(one in SHORT_LETTERS.get(f, ()) for f in NICKNAMES.get(full, full).split()):
            return True
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0] or any(f[0] == s for x, s in ((a, b), (b, a)) if len(s) == 1 for f in NICKNAMES.get(x, "").split())
    full_a, full_b = set(NICKNAMES.get(a, a).split()), set(NICKNAMES.get(b, b).split())
    if full_a & full_b:
        return True
    return min(len(a), len(b)) >= 4 and distance(a, b, 1) <= 1


def level(others: list[str]) -> int:
    """How much a person's given names say: none, with an initial, full."""
    return 0 if not others else 1 if any(len(w) == 1 for w in others) else 2


def same_person(a: list[str], b: list[str], loose: bool = False) -> bool:
    """Given names agree one by one, in order; the shorter list may leave out later ones or single ones of a double name."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return True
    if not same_given(a[0], b[0], loose):
        return False
    i = 1
    for w in b[1:]:
        if i < len(a) and same_given(a[i], w, loose):
            i += 1
    return i == len(a)


def same_word(a: str, b: str) -> bool:
    a, b = SHORT.get(a, a), SHORT.get(b, b)
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and long.startswith(short):
        return True
    return len(short) >= 5 and distance(a, b, 1) <= 1


def same_body(a: list[str], b: list[str]) -> bool:
    for x, y in ((a, b), (b, a)):
        if len(x) == 1 and len(x[0]) > 2 and x[0] not in BODIES:
            return len(y) > 1 and x[0].replace("f", "").lower() == "".join(SHORT.get(w, w)[0] for w in y) or x == y
    return len(a) == len(b) and all(same_word(x, y) for x, y in zip(a, b))


def full_first(others: list[str]) -> str:
    """First letters of the full and short forms of the first given name."""
    if not others:
        return ""
    full = NICKNAMES.get(others[0], others[0]).split()
    return "".join(sorted({f[0] for f in full} | {others[0][0]} | {c for f in full for c in SHORT_LETTERS.get(f, ())}))


def nodes(names: DataFrame) -> DataFrame:
    """`node` (the normalised name), kind, heads, others, level of distinct names `name`."""
    spark = names.sparkSession
    # Given names: words that follow the comma after several family names, and do so more often than they stand before it.
    sides = names.where(F.col("name").contains(",")).select(F.split("name", ",", 2).alias("s"))
    folded = F.pandas_udf(lambda s: s.map(lambda t: [w for w in tokens(t) if len(w) > 1]), "array<string>")
    after = sides.select(F.explode(folded(F.col("s")[1])).alias("w"), F.lit(1).alias("n"))
    before = sides.select(F.explode(folded(F.col("s")[0])).alias("w"), F.lit(-1).alias("n"))
    most = after.unionByName(before).groupBy("w").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "w").limit(MOST_GIVEN).collect()
    given = spark.sparkContext.broadcast({r[0] for r in most} | set(NICKNAMES) - BODIES)

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name in part["name"]:
                kind, heads, others = parsed(name, given.value)
                heads = sorted(set(heads))
                if heads:
                    out.append((name, f"{kind}|{' '.join(heads)}|{' '.join(others)}", kind, heads, others, level(others) if kind == "person" else 2))
            yield pd.DataFrame(out, columns=["name", "node", "kind", "heads", "others", "level"])

    return names.mapInPandas(parse, "name string, node string, kind string, heads array<string>, others array<string>, level int")


def near_heads(heads: DataFrame) -> DataFrame:
    """head_a, head_b of the distinct `head` words within k errors of each other, both ways and each with itself."""
    keys = F.pandas_udf(lambda s: s.map(index_keys), "array<string>")
    probes = F.pandas_udf(lambda s: s.map(lambda w: sorted(probe_keys(w))), "array<string>")
    index = heads.select(F.col("head").alias("head_a"), F.explode(keys("head")).alias("key"))
    probe = heads.select(F.col("head").alias("head_b"), F.explode(probes("head")).alias("key"))
    # A swap counts as two plain edits, so nothing within k errors is farther apart than 2k of these; the rest goes before it is shuffled.
    plain = F.when(F.least(F.length("head_a"), F.length("head_b")) < 9, F.levenshtein("head_a", "head_b", 2)).otherwise(F.levenshtein("head_a", "head_b", 4))
    found = index.join(probe, "key").where(plain >= 0).select("head_a", "head_b").distinct()

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[[same_head(a, b) for a, b in zip(part["head_a"], part["head_b"])]]

    one = found.mapInPandas(verify, "head_a string, head_b string")
    return one.unionByName(one.select(F.col("head_b").alias("head_a"), F.col("head_a").alias("head_b"))).distinct()


def _kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the cluster's shared folder."""
    from foliant.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """node, component (its least node): least labels travel along the edges `a`, `b` (both ways) and labels of labels
    are followed, until nothing changes; the number of rounds grows with the logarithm of the longest path."""
    labels = all_nodes.select("node", F.col("node").alias("component"))
    while True:
        told = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(told, labels["node"] == told["a"], "left").select("node", F.least("component", F.coalesce("least", "component")).alias("next"), F.col("component").alias("old"))
        far = step.select(F.col("node").alias("next"), F.col("next").alias("further"))
        step = _kept(step.join(far, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("component"), "old"))
        changed = step.where("component <> old").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels


def linked(names: DataFrame) -> DataFrame:
    """`name`, `entity` of the distinct strings `name`: one row per spelling with its class."""
    raw = _kept(nodes(names))
    own = raw.select("node", "kind", "heads", "others", "level").distinct()
    by_head = own.select("node", "kind", "others", "level", F.explode("heads").alias("head"))
    pairs_of_heads = _kept(near_heads(by_head.select("head").distinct()))
    left = by_head.select(F.col("node").alias("a"), F.col("kind").alias("kind"), F.col("others").alias("others_a"), F.col("level").alias("level_a"), F.col("head").alias("head_a"))
    right = by_head.select(F.col("node").alias("b"), F.col("kind").alias("kind"), F.col("others").alias("others_b"), F.col("level").alias("level_b"), F.col("head").alias("head_b"))
    # People of one family name meet only where the first given names can begin with the same letter.
    letters = F.pandas_udf(lambda s: s.map(lambda o: list(full_first(list(o)))), "array<string>")
    first = lambda kind, others: F.when((F.col(kind) == "body") | (F.size(others) == 0), F.array(F.lit(""))).otherwise(letters(others))
    left = left.withColumn("first", F.explode(first("kind", "others_a")))
    right_named = right.withColumn("first", F.explode(first("kind", "others_b")))

    def agree(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            given = list(zip(part["kind"], part["others_a"], part["others_b"]))
            strict = [(same_body if k == "body" else same_person)(list(x), list(y)) for k, x, y in given]
            loose = [ok or k == "person" and same_person(list(x), list(y), loose=True) for ok, (k, x, y) in zip(strict, given)]
            yield part.assign(strict=strict)[loose][["a", "b", "kind", "level_a", "level_b", "more", "exact", "strict"]]

    size = F.size("others_b") - F.size("others_a")
    met = left.join(pairs_of_heads, "head_a").join(right_named, ["kind", "head_b", "first"]).where("a <> b")
    met = met.select("a", "b", "kind", "others_a", "others_b", "level_a", "level_b", size.alias("more"), (F.col("head_a") == F.col("head_b")).alias("exact"))
    met = met.groupBy("a", "b", "kind", "others_a", "others_b", "level_a", "level_b", "more").agg(F.max("exact").alias("exact"))
    edges = _kept(met.mapInPandas(agree, "a string, b string, kind string, level_a int, level_b int, more int, exact boolean, strict boolean"))
    strong = edges.where("level_a = 2 and level_b = 2 and strict and (more = 0 or kind = 'body')").select("a", "b")
    labels = components(strong, own).withColumn("done", F.lit(False))

    def attach(labels: DataFrame, weak: DataFrame) -> DataFrame:
        """Components not attached yet, of which a name `a` fits exactly one component of names `b` that say more, join it."""
        of_b = weak.join(labels.select(F.col("node").alias("b"), F.col("component").alias("to")), "b")
        of_both = of_b.join(labels.where("not done").select(F.col("node").alias("a"), "component"), "a").where("to <> component")
        one = of_both.groupBy("component").agg(F.min("to").alias("to"), F.max("to").alias("other")).where("to = other").select("component", "to")
        return _kept(labels.join(one, "component", "left").select("node", F.coalesce("to", "component").alias("component"), (F.col("done") | F.col("to").isNotNull()).alias("done")))

    labels = attach(labels, edges.where("level_a = 2 and level_b = 2 and more > 0 and strict").select("a", "b"))
    # Initials: those of the names themselves before those of short forms, the same head before a mistyped one.
    for fit in ("exact and strict", "strict", "exact", "true"):
        labels = attach(labels, edges.where(f"level_a = 1 and level_b = 2 and more >= 0 and {fit}").select("a", "b"))
    labels = attach(labels, edges.where("level_a = 1 and level_b = 1 and more > 0 and strict").select("a", "b"))
    bare = left.where("level_a = 0 and kind = 'person'").join(pairs_of_heads, "head_a").join(right.where("level_b > 0 and kind = 'person'").drop("kind"), "head_b")
    bare = _kept(bare.groupBy("a", "b").agg(F.max(F.col("head_a") == F.col("head_b")).alias("exact")))
    for fit in ("exact", "true"):
        labels = attach(labels, bare.where(fit).select("a", "b"))
    return raw.select("name", "node").join(labels, "node").select("name", F.col("component").alias("entity"))


def author_names(spark: SparkSession, folder: str) -> DataFrame:
    cited = table(spark, folder, "bibliography").select(F.explode("authors").alias("name"))
    paired = table(spark, folder, "pairings").select(F.col("author").alias("name"))
    return cited.unionByName(paired).where("trim(name) <> ''").distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """name_a, name_b: the pairs of spellings of one person or institution. A class holds the spellings of one entity,
    not its rows, so its pairs are few however often the entity is named."""
    found = linked(author_names(spark, folder))
    other = found.select(F.col("name").alias("name_b"), "entity")
    return found.select(F.col("name").alias("name_a"), "entity").join(other, "entity").where("name_a < name_b").select("name_a", "name_b")
