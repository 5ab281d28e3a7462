"""Sum-of-squares packing of token-counted texts into containers of fixed capacity."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch

CAPACITY = 2048
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
SHARD_ITEMS = 65536  # items that are packed together; the number of shards grows with the input
_ENCODERS: dict[str, object] = {}


def encoder(path: str | None):
    """The tokenizer of a rank file, loaded once per Python worker; the default is the public multilingual one."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(TOKENIZER), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens`` of every row; null and empty texts have 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"item": batch["item"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    rows = df.select(F.col(key).alias("item"), F.col(text).alias("text"))
    return rows.mapInPandas(count, f"item {dict(df.dtypes)[key]}, n_tokens long").withColumnRenamed("item", key)


class SquarePacker:
    """Online packing: an item goes where the sum over gaps of (open containers with that gap) squared ends smallest.

    Ties go to the tightest gap.  ``waiting[g]`` lists open containers with g tokens free.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, dtype=np.int64)
        self.waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        """Container number for an item of 1 to capacity tokens."""
        counts, cap = self.open, self.capacity
        # moving a container from gap g to g - size changes the sum by 2 (open[g - size] - open[g]) + 2
        change = 2 * (counts[: cap - size] - counts[size:cap]) + 2  # index: the gap that remains
        if size < cap:
            change[0] = 1 - 2 * counts[size]  # a full container leaves the sum
        change[counts[size:cap] == 0] = np.iinfo(np.int64).max
        fresh = 2 * counts[cap - size] + 1 if size < cap else 0
        left = int(change.argmin()) if size < cap else cap
        if size == cap or change[left] > fresh:
            number, left = self.made, cap - size
            self.made += 1
        else:
            number = self.waiting[left + size].pop()
            counts[left + size] -= 1
        if left:
            counts[left] += 1
            self.waiting[left].append(number)
        return number


def pack_shard(sizes: list[int], capacity: int) -> list[int]:
    """Container numbers from 0 on for items of one shard.

    After the last item the containers that are still open are emptied and their items packed again,
    largest first, each into the tightest gap; the better of the two packings of them is kept.
    """
    packer = SquarePacker(capacity)
    where = [packer.place(s) for s in sizes]
    still = {number for gap in range(1, capacity) for number in packer.waiting[gap]}
    again = sorted((i for i, number in enumerate(where) if number in still), key=lambda i: -sizes[i])
    bins, tight = best_fit([sizes[i] for i in again], capacity)
    if len(bins) < len(still):
        numbers = sorted(still)
        for i, k in zip(again, tight):
            where[i] = numbers[k]
    return where


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(free space of each container, container of each item), each item put into the tightest gap."""
    free: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, dtype=bool)
    where = []
    for size in sizes:
        fitting = filled[size:]
        k = int(fitting.argmax()) if fitting.any() else -1
        if k < 0:
            number, gap = len(free), capacity
            free.append(capacity)
        else:
            gap = size + k
            number = stacks[gap].pop()
            filled[gap] = bool(stacks[gap])
        free[number] = gap - size
        if free[number]:
            stacks[free[number]].append(number)
            filled[free[number]] = True
        where.append(number)
    return free, where


def pack(counts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``key, piece, token_start, n_tokens, container`` for every row of ``key, n_tokens``.

    Only a text longer than the capacity is split: into full containers and one rest, which is an
    item like any other.  A text without tokens takes no space: piece 0 with container null.  Items
    are dealt to shards by a hash of key and piece, so each shard sees them in random order, equal texts
    spread, and no shard depends on the number of rows of any group; a shard's work is bounded by its
    number of items.  Every shard leaves at most a few containers unfilled.
    """
    scratch = Scratch(counts.sparkSession)
    counts = scratch.save(counts, "counts")
    full = F.expr(f"cast(n_tokens div {capacity} as int)")
    rest = F.expr(f"n_tokens % {capacity}")
    last = F.when((rest > 0) | (F.col("n_tokens") == 0), full).otherwise(full - 1)
    pieces = counts.select(key, "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.select(key, "piece", start.alias("token_start"), F.least(F.col("n_tokens") - start, F.lit(capacity).cast("long")).alias("n_tokens"))
    n_items = counts.agg(F.coalesce(F.sum(last + 1), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-n_items // shard_items))
    order = F.xxhash64(key, "piece")
    items = pieces.where("n_tokens > 0").withColumn("__order", order).withColumn("__shard", F.pmod(F.xxhash64(F.lit(17), F.col(key), F.col("piece")), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__order", "__key", "piece"], kind="stable")
        where = pack_shard(pdf["n_tokens"].tolist(), capacity)
        pdf["container"] = pdf["__shard"].to_numpy() * (1 << 32) + np.asarray(where, dtype=np.int64)
        return pdf[["__key", "piece", "token_start", "n_tokens", "container"]]

    kind = dict(counts.dtypes)[key]
    packed = items.withColumnRenamed(key, "__key").groupBy("__shard").applyInPandas(run, f"__key {kind}, piece int, token_start long, n_tokens long, container long").withColumnRenamed("__key", key)
    return packed.unionByName(pieces.where("n_tokens = 0").withColumn("container", F.lit(None).cast("long")))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, containers, tokens, the least possible number of containers and the share of space used."""
    used = packed.where("container is not null").agg(F.count(F.lit(1)).alias("pieces"), F.count_distinct("container").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return used.withColumn("least_containers", F.ceil(F.col("tokens") / capacity)).withColumn("used_share", F.coalesce(F.try_divide(F.col("tokens"), F.col("containers") * capacity), F.lit(1.0)))
