"""Per-key results when a few keys hold most of the records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import Scratch

HEAVY_SHARE = 0.005  # keys above this share of rows are salted; there can be at most 200 of them
SALTS = 64


def heavy_keys(rows: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """Keys (``key``) with at least ``share`` of all rows: at most 1 / share of them, however large the input."""
    counts = Scratch(rows.sparkSession).save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes")  # one row per key, read twice
    whole = counts.agg(F.sum("n").alias("n"))
    return counts.where(F.col("key").isNotNull() & (F.col("n") >= share * whole.scalar())).select("key")


def salted(rows: DataFrame, member: str, share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """Adds ``salt``: spread over the salts for heavy keys, 0 for the rest.

    The salt is a hash of the member and not a random number: members then never straddle salts, so
    distinct members and top members merge exactly, and a task that is run again after an executor
    was lost sends its rows to the same place.  The heavy keys are broadcast: their number is
    bounded by 1 / share.
    """
    heavy = F.broadcast(heavy_keys(rows, share).select("key", F.lit(True).alias("heavy")))
    spread = F.pmod(F.xxhash64(F.col(member)), F.lit(salts)).cast("int")
    return rows.join(heavy, "key", "left").withColumn("salt", F.when(F.col("heavy"), spread).otherwise(F.lit(0))).drop("heavy")


def keyed_rows(df: DataFrame, key: Column, member: Column, value: Column) -> DataFrame:
    return df.select(key.alias("key"), member.alias("member"), F.coalesce(value, F.lit(0)).cast("long").alias("value"))


def key_sums(df: DataFrame, key: Column, member: Column, value: Column, share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """Per key: ``n_rows`` and ``value_total`` only, by the same two stages; null values are zero, a null key is a group.

    The table is read once for the sizes of keys and once for the sums.
    """
    partial = salted(keyed_rows(df, key, member, value), "member", share, salts).groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("value_total"))
    return partial.groupBy("key").agg(F.sum("n_rows").alias("n_rows"), F.sum("value_total").alias("value_total"))


def key_totals(df: DataFrame, key: Column, member: Column, value: Column, tops: Sequence[int] = (1, 5), share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """Per key: ``n_rows``, ``value_total``, ``n_members``, ``member_total`` and ``top{k}_share``.

    Null values are zero.  Null members count in ``n_rows`` and ``value_total`` only; the shares are
    those of the k largest members (ties by name) in ``member_total``, 0.0 where that is 0.  Rows
    with a null key form a group of their own.  An empty table gives no rows.

    Stage one works per (key, salt): members are summed, counted and ranked inside their salt, and
    the leaders of a salt are kept with its partial row.  Stage two merges at most ``salts`` such
    rows per key.  The table is read once for the sizes of keys and once for all results.
    """
    most = max(tops)
    per_member = salted(keyed_rows(df, key, member, value), "member", share, salts).groupBy("key", "salt", "member").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    named = F.col("member").isNotNull()
    by_size = Window.partitionBy("key", "salt").orderBy(named.desc(), F.col("total").desc(), F.col("member").asc())
    ranked = per_member.withColumn("rank", F.row_number().over(by_size))
    leader = F.when(named & (F.col("rank") <= most), F.struct((-F.col("total")).alias("less"), "member"))
    partial = ranked.groupBy("key", "salt").agg(
        F.sum("n").alias("n_rows"), F.sum("total").alias("value_total"), F.sum(named.cast("long")).alias("n_members"), F.sum(F.when(named, F.col("total"))).alias("member_total"),
        F.collect_list(leader).alias("leaders"),
    )
    totals = partial.groupBy("key").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("value_total").alias("value_total"), F.sum("n_members").alias("n_members"), F.coalesce(F.sum("member_total"), F.lit(0)).alias("member_total"),
        F.array_sort(F.flatten(F.collect_list("leaders"))).alias("leaders"),
    )
    held = lambda k: F.aggregate(F.slice("leaders", 1, k), F.lit(0).cast("long"), lambda x, leader: x - leader["less"])
    shares = [F.coalesce(F.try_divide(held(k).cast("double"), F.col("member_total").cast("double")), F.lit(0.0)).alias(f"top{k}_share") for k in tops]
    return totals.select("key", "n_rows", "value_total", "n_members", "member_total", *shares)


def dominant_keys(totals: DataFrame, percent: int = 5) -> DataFrame:
    """Keys whose rows or values are at least ``percent`` percent of all, the null key counting in the whole only.

    The totals are one row per key and written once, because the whole is taken from them too.
    """
    totals = Scratch(totals.sparkSession).save(totals.select("key", "n_rows", "value_total"), "totals")
    whole = totals.agg(F.sum("n_rows").alias("n_rows"), F.sum("value_total").alias("value_total"))
    enough = [F.col(c) * 100 >= whole.select(c).scalar() * percent for c in ("n_rows", "value_total")]
    return totals.where(F.col("key").isNotNull() & (enough[0] | enough[1]))
