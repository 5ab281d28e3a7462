"""Exact distinct counts from compressed bitmaps that merge by OR and AND; the error is zero."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import Scratch

WORD_BITS = 64
BUCKETS = 1024  # members are spread over so many buckets; a bucket's rows are handled by one task


def encode_members(rows: DataFrame, scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """Dictionary ``member``, ``code`` of dense integers from 0 on.

    ``rows`` has ``member`` and ``home``.  Members are range-partitioned by (home, member), so those
    of one home get neighbouring codes and their bitmaps few words; a range is cut inside a home of
    any size.  Only the number of members per partition goes to the driver.  With ``known``, an
    earlier dictionary, codes stay as they are and new members get the following ones.
    """
    members = rows.where(F.col("member").isNotNull()).groupBy("member").agg(F.min("home").alias("home"))
    start = 0
    if known is not None:
        members = members.join(known, "member", "left_anti")
        last = known.agg(F.max("code")).first()[0]
        start = 0 if last is None else last + 1
    placed = members.repartitionByRange("home", "member").select("member", "home", F.spark_partition_id().alias("part"))
    placed = scratch.save(placed, "members")
    first = {}
    for part, n in sorted(placed.groupBy("part").count().collect()):
        first[part] = start
        start += n
    offsets = rows.sparkSession.createDataFrame(list(first.items()), "part int, first long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("home", "member")) - 1
    fresh = placed.withColumn("rank", rank).join(F.broadcast(offsets), "part").select("member", (F.col("first") + F.col("rank")).alias("code"))
    return scratch.save(fresh if known is None else known.select("member", "code").unionByName(fresh), "dictionary")


def bucketed(rows: DataFrame, groups: Sequence[str], kinds: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Distinct (groups, member) with ``kinds`` as bits, ``bucket`` and the dense ``code`` inside the bucket.

    A member's bucket is a hash, its code the rank by activity among the members there, so busy
    members share words and codes need neither a driver nor a global sort.  Repeats vanish map-side.
    The result is partitioned by bucket: bitmaps of any level can be built from it in place.
    """
    mask = F.lit(0)
    for k, kind in enumerate(kinds):
        mask = F.when(F.col("kind") == kind, F.lit(1 << k)).otherwise(mask)
    keyed = rows.where(F.col("member").isNotNull()).select(F.pmod(F.xxhash64("member"), F.lit(buckets)).cast("int").alias("bucket"), "member", *groups, mask.alias("kinds"))
    once = keyed.groupBy("bucket", "member", *groups).agg(F.bit_or("kinds").alias("kinds"))
    size = F.count(F.lit(1)).over(Window.partitionBy("bucket", "member"))
    placed = once.repartition("bucket").withColumn("size", size)
    code = F.dense_rank().over(Window.partitionBy("bucket").orderBy(F.desc("size"), "member")) - 1
    return placed.select("bucket", *groups, "kinds", code.alias("code"))


def bucket_bitmaps(coded: DataFrame, groups: Sequence[str], kinds: Sequence[str], levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Bitmaps of every level: ``level``, the groups, ``bucket``, ``word`` and a long per kind.

    All rows of a bucket lie in one partition, so each bitmap is finished where its members are and
    only its count has to travel; a row joins a level when all columns of that level are known.
    """
    bits = F.expr(f"shiftleft(1L, cast(code % {WORD_BITS} as int))")
    words = coded.select("bucket", *groups, F.expr(f"code div {WORD_BITS}").alias("word"), *[F.when(F.col("kinds").bitwiseAND(1 << k) != 0, bits).otherwise(F.lit(0).cast("long")).alias(kind) for k, kind in enumerate(kinds)])
    finest = merge_bitmaps(words, ["bucket", *groups], kinds)
    return roll_up(finest, levels, ["bucket", *groups], kinds)


def partial_bitmaps(rows: DataFrame, dictionary: DataFrame, groups: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """One row per group and non-empty 64-bit word of the bitmap: the groups, ``word`` and a long per kind.

    ``rows`` has the groups, ``member`` and ``kind``.  Repeats vanish map-side before the join with
    the dictionary.  Words without a bit are not stored, which is the compression; a bit is set by
    ``bit_or`` in a hash aggregation.  These rows are the mergeable partial result.
    """
    once = rows.where(F.col("member").isNotNull()).select(*groups, "kind", "member").distinct()
    coded = once.join(dictionary, "member").select(*groups, "kind", F.expr(f"code div {WORD_BITS}").alias("word"), F.expr(f"shiftleft(1L, cast(code % {WORD_BITS} as int))").alias("bit"))
    bits = [F.bit_or(F.when(F.col("kind") == kind, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(kind) for kind in kinds]
    return coded.groupBy(*groups, "word").agg(*bits)


def merge_bitmaps(parts: DataFrame, groups: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """OR of partial bitmaps, for days or batches that were built apart with one dictionary."""
    return parts.groupBy(*groups, "word").agg(*[F.bit_or(kind).alias(kind) for kind in kinds])


def roll_up(parts: DataFrame, levels: Mapping[str, Sequence[str]], groups: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Bitmaps of every level; a row joins a level when all columns of that level are known."""
    names = list(levels)
    known = [F.when(F.reduce(F.array(F.lit(True), *[F.col(c).isNotNull() for c in columns]), F.lit(True), lambda a, b: a & b), F.lit(k).cast("byte")) for k, columns in enumerate(levels.values())]
    spread = parts.withColumn("level", F.explode(F.filter(F.array(*known), lambda x: x.isNotNull())))
    named = {c for columns in levels.values() for c in columns}  # any other group, such as the bucket, is kept at every level
    kept = {c: F.col("level").isin(*[k for k, name in enumerate(names) if c in levels[name]]) for c in groups if c in named}
    spread = spread.select("level", *[F.when(kept[c], F.col(c)).alias(c) if c in named else F.col(c) for c in groups], "word", *kinds)
    return merge_bitmaps(spread, ["level", *groups], kinds)


def count_bits(bitmaps: DataFrame, keys: Sequence[str], counts: Mapping[str, Column]) -> DataFrame:
    """Set bits per key of each expression over the bitmap columns (``a``, ``a & b`` and so on)."""
    return bitmaps.groupBy(*keys).agg(*[F.sum(F.bit_count(bits).cast("long")).alias(name) for name, bits in counts.items()])


def level_names(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    pairs = [F.lit(x) for k, name in enumerate(levels) for x in (k, name)]
    return df.withColumn("level", F.try_element_at(F.create_map(*pairs), F.col("level").cast("int")))
