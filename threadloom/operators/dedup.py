"""Exactly one copy of every message that was delivered at least once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delivery_order(time: Column, tie: Column) -> Column:
    """Earliest delivery first, unknown times last, then the lowest tie-break (null last)."""
    return F.struct(time.isNull(), time, tie.isNull(), tie)


def first_rows(df: DataFrame, key: Column, time: str, tie: str, carry: list[str]) -> DataFrame:
    """``__key`` and ``__row`` with the carried columns of each key's first delivery.

    ``min_by`` over a struct of delivery time and tie-break is merged map-side, so a key with a
    third of all rows sends one partial row per task.  Rows with a null key are left out.
    """
    keyed = df.select(key.alias("__key"), F.struct(*[F.col(c) for c in carry]).alias("__row"), delivery_order(F.col(time), F.col(tie)).alias("__order"))
    return keyed.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.min_by("__row", "__order").alias("__row"))


def first_delivery(df: DataFrame, key: Column, time: str, tie: str, carry: list[str]) -> DataFrame:
    """``__key`` and the carried columns of each key's first delivery."""
    return first_rows(df, key, time, tie, carry).select("__key", "__row.*")


def surplus_deliveries(df: DataFrame, key: Column, time: str, tie: str) -> DataFrame:
    """``tie`` of every delivery that is not the first of its key; ``tie`` must be unique among its keys' known ones.

    The keepers are anti-joined on key and ``tie``, so a hot key is spread over its ties and cannot
    fill one task.  A null tie comes last in its key and is compared like a value: of several
    deliveries that lack it, all are alike and none is surplus if their key has no other.  Rows with
    a null key are never surplus; an empty table gives an empty result.
    """
    keepers = first_delivery(df, key, time, tie, [tie]).select(F.col("__key").alias("__kept"), F.col(tie).alias("__tie"))
    rows = df.where(key.isNotNull()).select(key.alias("__key"), F.col(tie))
    same = (F.col("__key") == F.col("__kept")) & F.col(tie).eqNullSafe(F.col("__tie"))
    return rows.join(keepers, same, "left_anti").select(tie)


def keep_first(df: DataFrame, key: Column, time: str, tie: str) -> DataFrame:
    """Every column of exactly one row per key; rows with a null key all remain.

    Repeated rows that agree even in the tie-break collapse to one.
    """
    columns = df.columns
    kept = first_rows(df, key, time, tie, columns).select("__row.*")
    return kept.unionByName(df.where(key.isNull()))
