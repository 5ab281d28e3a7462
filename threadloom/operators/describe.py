"""Counts and scan statistics of a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.columns import month_index


def in_window(df: DataFrame, start: int, end: int, time: str = "created_utc") -> DataFrame:
    """Rows with start <= time < end; rows without time are out."""
    return df.where((F.col(time) >= start) & (F.col(time) < end))


def in_communities(df: DataFrame, names: DataFrame, column: str = "subreddit") -> DataFrame:
    """Rows whose community is listed in ``names.name``; a semi-join that the planner may broadcast by size."""
    return df.join(names.select(F.col("name").alias(column)), column, "left_semi")


def describe_counts(df: DataFrame) -> DataFrame:
    """``level, subreddit, month, n, first_utc, last_utc`` for the whole, community, month and community-month.

    One pass by grouping sets.  Rows without time have month ``unknown`` in community-month and are
    in no month; the whole and the communities count them.
    """
    rows = df.select("subreddit", F.coalesce("month", F.lit("unknown")).alias("month"), "created_utc")
    sets = rows.groupingSets([[], ["subreddit"], ["month"], ["subreddit", "month"]], "subreddit", "month").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.min("created_utc").alias("first_utc"), F.max("created_utc").alias("last_utc")
    )
    level = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "community").when(F.col("gid") == 2, "month").otherwise("community_month")
    out = sets.select(level.alias("level"), "subreddit", "month", "n", "first_utc", "last_utc")
    return out.where((F.col("level") != "month") | (F.col("month") != "unknown"))


def month_pivot(df: DataFrame, months: Sequence[str]) -> DataFrame:
    """A row per community with a column per month and ``total`` over those months, and a row ``ALL``."""
    rows = df.where(F.col("month").isNotNull())
    wide = rows.groupBy("subreddit").pivot("month", list(months)).agg(F.count(F.lit(1)))
    filled = wide.select("subreddit", *[F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(m) for m in months])
    whole = filled.agg(*[F.coalesce(F.sum(F.col(f"`{m}`")), F.lit(0)).alias(m) for m in months]).select(F.lit("ALL").alias("subreddit"), *[F.col(f"`{m}`") for m in months])
    total = sum((F.col(f"`{m}`") for m in months), F.lit(0).cast("long"))
    return filled.unionByName(whole).withColumn("total", total)


def counts_by_type(df: DataFrame, kind: Column) -> DataFrame:
    """Rows and distinct communities per community type and month."""
    rows = df.where(F.col("month").isNotNull()).groupBy("subreddit", "month").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(kind.alias("community_type"), "month").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("communities"))


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values with their counts; ties by name.  A top-k report: the limit is its purpose."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(k)


def rows_of_top(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """All rows of the k most frequent values; the k names are few, so the semi-join needs no shuffle."""
    return df.join(top_values(df, column, k).select(column), column, "left_semi")


def folded_order(df: DataFrame, column: str) -> DataFrame:
    """Each distinct name with its ``place`` in an order without case, then by itself; one row per name of a dimension."""
    names = df.select(column).where(F.col(column).isNotNull()).distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(F.lower(column), column)))


def scan_stats(df: DataFrame, start: int, end: int) -> DataFrame:
    """One row: rows, rows in the window, missing times, time range, distinct names and score statistics."""
    inside = (F.col("created_utc") >= start) & (F.col("created_utc") < end)
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"), F.coalesce(F.sum(inside.cast("long")), F.lit(0)).alias("rows_in_window"), F.coalesce(F.sum(F.col("created_utc").isNull().cast("long")), F.lit(0)).alias("missing_time"),
        F.min("created_utc").alias("first_utc"), F.max("created_utc").alias("last_utc"), F.count_distinct("subreddit").alias("communities"), F.count_distinct("author").alias("authors"),
        F.count("score").alias("scores"), F.sum("score").alias("score_sum"), F.avg("score").alias("score_mean"), F.min("score").alias("score_min"), F.max("score").alias("score_max"),
    )


def dense_grid(*cells: DataFrame, entity: str = "subreddit") -> DataFrame:
    """Every community in every month from the first to the last month seen in any of the tables.

    The calendar is made on the fly from two scalars: each community emits its own months.
    """
    seen = cells[0].select(entity, "month")
    for part in cells[1:]:
        seen = seen.unionByName(part.select(entity, "month"))
    seen = seen.where(F.col("month").isNotNull()).distinct()
    ends = seen.agg(F.min(month_index(F.col("month"))).alias("a"), F.max(month_index(F.col("month"))).alias("b"))
    months = F.sequence(ends.select("a").scalar(), ends.select("b").scalar())
    grid = seen.select(entity).distinct().select(entity, F.explode(months).alias("idx"))
    year, number = F.floor(F.col("idx") / 12).cast("int"), (F.col("idx") % 12 + 1).cast("int")
    return grid.select(entity, F.format_string("%04d-%02d", year, number).alias("month"))


def on_grid(grid: DataFrame, cells: DataFrame, entity: str = "subreddit") -> DataFrame:
    """The cells on the grid; numbers missing there are 0."""
    out = grid.join(cells, [entity, "month"], "left")
    return out.fillna(0)
