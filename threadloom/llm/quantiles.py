"""Percentiles from counts in signed logarithmic buckets, with a guaranteed relative error."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.01


def gamma(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def offset(alpha: float) -> int:
    """More than the largest bucket number a double can have."""
    return math.ceil(750 / math.log(gamma(alpha))) + 1


def bucket(value: Column, alpha: float = ALPHA) -> Column:
    """Ordered bucket number: negative values below 0, zero at 0, positive above; null for null, NaN and infinity."""
    x = value.cast("double")
    number = F.ceil(F.log(F.abs(x)) / F.lit(math.log(gamma(alpha)))) + F.lit(offset(alpha))
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite & (x > 0), number).when(finite & (x < 0), -number).when(finite, F.lit(0)).cast("long")


def bucket_value(number: Column, alpha: float = ALPHA) -> Column:
    """The value of a bucket from which all its members differ by at most ``alpha`` of themselves."""
    g = gamma(alpha)
    size = F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.abs(number) - F.lit(offset(alpha)))
    return F.when(number > 0, size).when(number < 0, -size).otherwise(F.lit(0.0))


def bucket_counts(df: DataFrame, keys: Sequence[str], value: Column, alpha: float = ALPHA) -> DataFrame:
    """The mergeable partial result: keys, ``bucket``, ``n``.

    Counted map-side in a hash aggregation; the number of buckets of a key has a fixed bound
    whatever the number of its values.
    """
    return df.select(*keys, bucket(value, alpha).alias("bucket")).where(F.col("bucket").isNotNull()).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds matching buckets of partial results from other partitions or days."""
    return parts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, keys: Sequence[str], wanted: Mapping[str, float], alpha: float = ALPHA) -> DataFrame:
    """Keys, ``n`` and a column for each wanted fraction, interpolated between neighbouring ranks.

    Each of the two ranks is within ``alpha`` of the true value of that rank; where both have one
    sign, so is the result of the interpolated percentile.  A result between a negative and a
    positive value is within ``alpha`` times the larger of the two.  Keys without values have no row.
    """
    order = Window.partitionBy(*keys).orderBy("bucket")
    rows = counts.select(*keys, "bucket", "n", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))
    rows = rows.withColumn("value", bucket_value(F.col("bucket"), alpha))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("value")))

    parts = [F.max("total").alias("n")]
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("total") - 1)
        parts += [at(F.floor(place)).alias(f"{name}__lo"), at(F.ceil(place)).alias(f"{name}__hi"), F.max(place - F.floor(place)).alias(f"{name}__w")]
    merged = rows.groupBy(*keys).agg(*parts)
    between = [(F.col(f"{c}__lo") + F.col(f"{c}__w") * (F.col(f"{c}__hi") - F.col(f"{c}__lo"))).alias(c) for c in wanted]
    return merged.select(*keys, "n", *between)
