"""Totals and averages over trailing periods for every entity and calendar day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_totals(df: DataFrame, entity: Column, day: Column, value: Column) -> DataFrame:
    """Columns ``entity``, ``day``, ``total``: one row per active day; null values count as zero.

    Rows without entity or day do not count.  The sum is merged map-side before its shuffle.
    """
    rows = df.select(entity.alias("entity"), day.alias("day"), F.coalesce(value, F.lit(0)).alias("value"))
    return rows.where(F.col("entity").isNotNull() & F.col("day").isNotNull()).groupBy("entity", "day").agg(F.sum("value").alias("total"))


def densify(daily: DataFrame) -> DataFrame:
    """A row for each day from an entity's first to its last active day, zero where it was idle.

    This is the product of entities and calendar cut to each entity's own span.  It is made by
    letting every active day also emit the idle days up to the next one, so there is neither a
    Cartesian join nor a join back, and the rows stay in the partition of their entity.
    """
    order = Window.partitionBy("entity").orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(order), 1), F.col("day"))
    spans = daily.select("entity", "day", "total", until.alias("until"))
    days = spans.select("entity", F.col("day").alias("active"), "total", F.explode(F.sequence("day", "until")).alias("day"))
    return days.select("entity", "day", F.when(F.col("day") == F.col("active"), F.col("total")).otherwise(F.lit(0)).alias("total"))


def rolling_totals(df: DataFrame, entity: Column, day: Column, value: Column, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Columns ``entity``, ``day``, ``total`` and, for each period n, ``total_n`` and ``mean_n``.

    Sums run over a fixed number of preceding rows of the dense table; days before the first active
    day count as days without activity, so a mean always divides by n.  After the daily
    aggregation an entity has at most one row per calendar day, whatever its share of the input.
    """
    dense = densify(daily_totals(df, entity, day, value))
    order = Window.partitionBy("entity").orderBy("day")
    out = dense.select("*", *[F.sum("total").over(order.rowsBetween(1 - n, 0)).alias(f"total_{n}") for n in periods])
    return out.select("*", *[(F.col(f"total_{n}") / F.lit(float(n))).alias(f"mean_{n}") for n in periods])
