"""Filling containers of fixed capacity with documents (problem 7).

Method: sum-of-squares packing. With N(g) open containers of residual gap g, an item is placed where the sum of N(g)^2
over all gaps becomes smallest: into a gap g, which changes the sum by 2(N(g - s) - N(g)) + 2 (1 - 2N(g)
when that fills it), or into a new container, by 2N(capacity - s) + 1. Items are never split unless longer than the capacity; those give full
containers of their own and one rest, which is an item.

Packing is sequential, so the items are dealt to shards by hash; their number follows from the counted tokens, so that a
shard holds about SHARD_ITEMS items whatever the size of the corpus. What is lost against one shard is a few open
containers a shard. Only keys and sizes are shuffled, never texts.
Defined results: null texts have no size and are not packed; texts without tokens likewise; repeated rows count once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import table

CAPACITY = 2048
SHARD_ITEMS = 20_000
#: The folder of the public tokenizers' files; the vocabulary is byte-level BPE of 50,256 ranks.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts a text before this vocabulary's merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def tokenizer(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """`key`, n_tokens of every row whose text is not null. Narrow."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path).encode_ordinary
        for part in parts:
            yield pd.DataFrame({"key": part["key"], "n_tokens": [len(encode(t)) for t in part["text"]]})

    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(count, f"key {df.schema[key].dataType.simpleString()}, n_tokens bigint").withColumnRenamed("key", key)


class SumOfSquares:
    """Containers of `capacity`; `place` puts one item and returns its container and its offset there."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # N(g); N(0) and N(capacity) stay 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        n = self.count
        # What each gap of size..capacity-1 changes the sum by; no gap without a container.
        change = 2 * (n[: self.capacity - size] - n[size : self.capacity]) + 2
        if len(change):
            change[0] -= 1
            change = np.where(n[size : self.capacity] > 0, change, 1 << 40)
            at = int(change.argmin())
            fresh = 2 * int(n[self.capacity - size]) + 1 if size < self.capacity else 0
            if change[at] <= fresh:
                gap = size + at
                container = self.open[gap].pop()
                n[gap] -= 1
                self._keep(container, at)
                return container, self.capacity - gap
        container = self.made
        self.made += 1
        self._keep(container, self.capacity - size)
        return container, 0

    def _keep(self, container: int, gap: int) -> None:
        if gap:
            self.open[gap].append(container)
            self.count[gap] += 1


def packed(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """`key`, piece_no, shard, container_no, at_token, n_tokens: the place of every piece; (shard, container_no) names a container."""
    kind = sizes.schema[key].dataType.simpleString()
    items = sizes.where(F.col(size) > 0).select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size")).distinct()
    n = items.count()
    shards = max(1, -(-n // shard_items))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        bins, out = SumOfSquares(capacity), []
        shard = int(part["shard"].iloc[0])
        for k, s in part.sort_values(["order", "key"])[["key", "size"]].itertuples(index=False):
            whole, rest = divmod(s, capacity)
            for p in range(whole):
                out.append((k, p, shard, bins.made, 0, capacity))
                bins.made += 1
            if rest:
                container, at = bins.place(rest)
                out.append((k, whole, shard, container, at, rest))
        return pd.DataFrame(out, columns=["key", "piece_no", "shard", "container_no", "at_token", "n_tokens"])

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).withColumn("order", F.xxhash64("key", F.lit(1)))
    done = dealt.groupBy("shard").applyInPandas(pack, f"key {kind}, piece_no bigint, shard bigint, container_no bigint, at_token bigint, n_tokens bigint")
    return done.withColumnRenamed("key", key)


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The token counts of all documents, written once to the shared folder: the count and the packing read them."""
    from foliant.session import checkpoint_dir

    checkpoint_dir(spark)
    return token_counts(table(spark, folder, "documents")).checkpoint()


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, piece_no, shard, container_no, at_token, n_tokens of all documents."""
    return packed(_sizes(spark, folder))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """shard, containers, n_tokens, fill: the share of the capacity used, by shard."""
    containers = p7_packed(spark, folder).groupBy("shard").agg(F.countDistinct("container_no").alias("containers"), F.sum("n_tokens").alias("n_tokens"))
    return containers.select("shard", "containers", "n_tokens", (F.col("n_tokens") / (F.col("containers") * CAPACITY)).alias("fill"))
