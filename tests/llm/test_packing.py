from __future__ import annotations

import random
from collections import defaultdict

from foliant.llm.packing import SumOfSquares, packed, token_counts


def test_each_placement_has_the_smallest_sum():
    rng = random.Random(4)
    bins, gaps = SumOfSquares(20), {}
    for _ in range(300):
        s = rng.randint(1, 20)
        options = []
        for b, g in [*gaps.items(), (None, 20)]:
            if g >= s:
                count = defaultdict(int)
                for c, h in gaps.items():
                    if c != b and h:
                        count[h] += 1
                if g - s:
                    count[g - s] += 1
                options.append(sum(n * n for n in count.values()))
        b, at = bins.place(s)
        assert at == 20 - gaps.get(b, 20)
        gaps[b] = gaps.get(b, 20) - s
        count = defaultdict(int)
        for h in gaps.values():
            if h:
                count[h] += 1
        assert sum(n * n for n in count.values()) == min(options)


def test_packed_conserves_everything(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([1, 5, 70, 99, 100, 101, 250, 1000])) for i in range(400)]
    df = spark.createDataFrame([*sizes, sizes[0], (900, 0), (901, None)], "doc_id bigint, n_tokens bigint")
    out = packed(df, capacity=100, shard_items=100).collect()
    own, fill = defaultdict(int), defaultdict(list)
    for r in out:
        own[r.doc_id] += r.n_tokens
        fill[r.shard, r.container_no].append((r.at_token, r.n_tokens))
    assert dict(own) == dict(sizes)
    for parts in fill.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(n for _, n in parts) <= 100
    assert all(r.n_tokens == 100 or sizes[r.doc_id][1] <= 100 or r.piece_no == sizes[r.doc_id][1] // 100 for r in out)
    assert len({r.shard for r in out}) == 4
    assert packed(df.limit(0)).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "x" * 5000)], "doc_id bigint, text string")
    n = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert n[1] == 2 and n[3] == 0 and 2 not in n and n[4] > 100
