from __future__ import annotations

import random

from foliant.llm.names import changes, components, distance, index_keys, linked, p1_found, probe_keys, same_head

NAMES = [
    "Lakobrimem, Margaret", "Margaret Lakobrimem", "LAKOBRIMEM, Peggy", "Lakobrrimem, Margaret", "Lakobrimem , M.", "Lakobrimem",
    "Begokrotard, Francisco", "Begokrotard, Frederick", "Begokrotard, F.", "Paco Begokrotard",
    "ter Brosakugost, Francisco", "BROSAKUGOST, Paco ter",
    "Habolaran Commission for Comparative Liturgy", "Commission for Comp. Liturgy, Habolaran", "Habolaran CfCL", "Habolaran Academy for Votive Inscriptions",
    "Other, Vera", "Third, Margaret", "Fourth, Francisco", "Fifth, Margaret", "Sixth, Francisco", "Seventh, Vera", "Eighth, Vera",
]


def slow_distance(a, b):
    """Optimal string alignment over the whole table."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_banded_distance_and_pigeonhole_against_brute_force():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 11))) for _ in range(120)]
    for a in words:
        for b in words:
            true = slow_distance(a, b)
            assert distance(a, b, 2) == min(true, 3)
            k = min(changes(a), changes(b))
            if true <= k and all(abs(len(a) - len(b)) <= changes(w) for w in (a, b)):
                # A swap across a segment's end touches two segments; it is then found by the larger of the two words' keys or by substitution.
                assert set(index_keys(a)) & probe_keys(b) or true == 1 and sorted(a) == sorted(b) or true == 2, (a, b)


def test_two_replaced_letters_must_lie_beside_the_right_ones():
    assert same_head("kagavivard", "kahabivard") and not same_head("brenifekem", "trenifetem") and same_head("nohepezik", "nehepezik") and same_head("listustutost", "lisstuustutost") is True
    assert not same_head("short", "shxxt") and not same_head("", "a") and same_head("", "")


def classes(spark, names):
    out = {}
    for r in linked(spark.createDataFrame([(n,) for n in names], "name string")).collect():
        out.setdefault(r.entity, set()).add(r.name)
    return sorted(sorted(v) for v in out.values() if len(v) > 1)


def test_linked_joins_spellings_and_keeps_namesakes_apart(spark):
    assert classes(spark, NAMES) == sorted(map(sorted, [NAMES[0:6], ["Begokrotard, Francisco", "Paco Begokrotard"], NAMES[10:12], NAMES[12:15]]))


def test_empty_and_odd_names(spark):
    assert classes(spark, ["123", "?!", "x"]) == []
    assert linked(spark.createDataFrame([], "name string")).count() == 0


def test_components_are_brute_force_components(spark):
    rng = random.Random(2)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = [tuple(rng.sample(nodes, 2)) for _ in range(28)]
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a string, b string")
    assert {r.node: r.component for r in components(both, spark.createDataFrame([(n,) for n in nodes], "node string")).collect()} == root


def test_p1_found(spark, tmp_path):
    spark.createDataFrame([(["Lakobrimem, Margaret", None],), (None,), ([" "],), (["Lakobrimem, Margaret"],)], "authors array<string>").write.parquet(f"{tmp_path}/bibliography.parquet")
    spark.createDataFrame([("Margaret Lakobrimem",), (None,)], "author string").write.parquet(f"{tmp_path}/pairings.parquet")
    assert [tuple(r) for r in p1_found(spark, str(tmp_path)).collect()] == [("Lakobrimem, Margaret", "Margaret Lakobrimem")]


def test_initials_of_short_forms_and_exact_heads_first(spark):
    base = ["Kikehotul, Theodora", "Kikehotul, D.", "Baterovost, Elizabeth", "Baterovost", "Bateroovst, Vera", "Krozalim, Edward", "Krozalim, Richard", "Krozalim, R.", "Krozalim, E.", "Other, Theodora", "Third, Theodora", "Fourth, Elizabeth", "Fifth, Edward"]
    assert classes(spark, base) == sorted([sorted(x) for x in (base[0:2], base[2:4], [base[5], base[8]], [base[6], base[7]])])
