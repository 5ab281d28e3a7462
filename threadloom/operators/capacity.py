"""Support capacity: rolling helpers, their overlap over time, retention and replies to newcomers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.columns import index_month, month_index, share

CELL = ["subreddit", "month"]


def activity_grid(activity: DataFrame) -> DataFrame:
    """``subreddit, idx``: every month from a community's first to its last active one."""
    ends = activity.groupBy("subreddit").agg(F.min(month_index(F.col("month"))).alias("a"), F.max(month_index(F.col("month"))).alias("b"))
    return ends.select("subreddit", F.explode(F.sequence("a", "b")).alias("idx"))


def contributors(activity: DataFrame, horizons: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """Per community and month: contributors, new ones, and the shares of either seen again 1, 3 and 6 months later.

    Near the end of the data nobody can be seen again: the shares are 0 there, not null.  One pass of
    range windows per author replaces the self-joins.
    """
    rows = activity.select("subreddit", "author", month_index(F.col("month")).alias("idx")).distinct()
    order = Window.partitionBy("subreddit", "author").orderBy("idx")
    rows = rows.withColumn("new", F.row_number().over(order) == 1)
    rows = rows.withColumns({f"back_{h}": F.coalesce(F.count(F.lit(1)).over(order.rangeBetween(h, h)) > 0, F.lit(False)) for h in horizons})
    sums = rows.groupBy("subreddit", "idx").agg(
        F.count(F.lit(1)).alias("active_contributors"), F.sum(F.col("new").cast("long")).alias("new_contributors"), *[F.avg(F.col(f"back_{h}").cast("int")).alias(f"contributor_return_{h}m") for h in horizons],
        *[F.coalesce(F.avg(F.when(F.col("new"), F.col(f"back_{h}").cast("int"))), F.lit(0.0)).alias(f"newcomer_return_{h}m") for h in horizons],
    )
    return sums.withColumn("newcomer_share", share(F.col("new_contributors"), F.col("active_contributors")))


def newcomer_posts(activity: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts written in their author's first month in the community, and the share that got a reply."""
    first = activity.groupBy("subreddit", "author").agg(F.min(month_index(F.col("month"))).alias("idx"))
    mine = posts.select("subreddit", "author", month_index(F.col("month")).alias("idx"), F.coalesce("num_comments_observed", F.lit(0)).alias("n"))
    joined = mine.join(first, ["subreddit", "author", "idx"])
    return joined.groupBy("subreddit", "idx").agg(F.count(F.lit(1)).alias("newcomer_posts"), F.avg((F.col("n") > 0).cast("int")).alias("newcomer_reply_rate"))


def helper_months(helpers: DataFrame, posts: DataFrame) -> DataFrame:
    """``subreddit, idx, helper, n``: comments by helpers other than the author, in the month of the post."""
    mine = posts.where(F.col("month").isNotNull()).select("submission_id", "subreddit", month_index(F.col("month")).alias("idx"))
    rows = helpers.where(F.col("is_non_op") == 1).join(mine, "submission_id")
    return rows.groupBy("subreddit", "idx", F.col("commenter").alias("helper")).agg(F.sum(F.coalesce("comment_count", F.lit(0))).alias("n"))


def rolling_helpers(months: DataFrame, grid: DataFrame, window: int = 12, top: int = 5) -> DataFrame:
    """Per grid month over the window ending there: helpers, effective helpers, top share, and Jaccard overlap with the window before.

    Every helper month is emitted once per window it lies in, so distinct helpers need no frame of
    sets; the months were aggregated before, so the factor applies to few rows.  Helpers are summed
    per window in a hash aggregation before any ranking.
    """
    current = months.select("subreddit", "helper", "n", F.explode(F.sequence("idx", F.col("idx") + window - 1)).alias("at"), F.lit(True).alias("now"))
    earlier = months.select("subreddit", "helper", "n", F.explode(F.sequence(F.col("idx") + window, F.col("idx") + 2 * window - 1)).alias("at"), F.lit(False).alias("now"))
    both = current.unionByName(earlier).groupBy("subreddit", "at", "helper").agg(
        F.sum(F.when(F.col("now"), F.col("n"))).alias("n"), F.max(F.col("now").cast("int")).alias("is_now"), F.max((~F.col("now")).cast("int")).alias("was")
    )
    placed = both.withColumn("rank", F.row_number().over(Window.partitionBy("subreddit", "at", (F.xxhash64("helper") % 16)).orderBy(F.col("n").desc_nulls_last(), "helper")))
    leaders = placed.where((F.col("rank") <= top) & F.col("n").isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy("subreddit", "at").orderBy(F.desc("n"), "helper")))
    tops = leaders.where(F.col("rank") <= top).groupBy("subreddit", "at").agg(F.sum("n").alias("top_n"))
    x = F.col("n").cast("double")
    sums = both.groupBy("subreddit", "at").agg(
        F.sum("is_now").alias("rolling_helpers"), F.sum("was").alias("earlier"), F.sum(F.col("is_now") * F.col("was")).alias("common"), F.sum("n").alias("total"), F.sum(x * x).alias("sq")
    )
    rows = grid.select("subreddit", F.col("idx").alias("at")).join(sums, ["subreddit", "at"], "left").join(tops, ["subreddit", "at"], "left")
    total = F.col("total").cast("double")
    return rows.select(
        "subreddit", F.col("at").alias("idx"), F.coalesce("rolling_helpers", F.lit(0)).alias("rolling_helpers"), share(total * total, F.col("sq")).alias("effective_helpers"),
        share(F.col("top_n"), total).alias("top5_helper_share"), share(F.col("common"), F.col("rolling_helpers") + F.col("earlier") - F.col("common")).alias("helper_jaccard"),
    )


def helper_retention(months: DataFrame, horizons: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """Share of a month's helpers who help again 1, 3 and 6 months later; 0 near the end of the data."""
    order = Window.partitionBy("subreddit", "helper").orderBy("idx")
    rows = months.select("subreddit", "idx", "helper").withColumns({f"back_{h}": F.coalesce(F.count(F.lit(1)).over(order.rangeBetween(h, h)) > 0, F.lit(False)) for h in horizons})
    return rows.groupBy("subreddit", "idx").agg(F.count(F.lit(1)).alias("monthly_helpers"), *[F.avg(F.col(f"back_{h}").cast("int")).alias(f"helper_return_{h}m") for h in horizons])


def support_capacity(activity: DataFrame, posts: DataFrame, helpers: DataFrame, window: int = 12) -> DataFrame:
    """All monthly measures on each community's own span of months; missing ones are 0."""
    grid = activity_grid(activity)
    months = helper_months(helpers, posts)
    out = grid
    for part in (contributors(activity), newcomer_posts(activity, posts), rolling_helpers(months, grid, window), helper_retention(months)):
        out = out.join(part, ["subreddit", "idx"], "left")
    return out.fillna(0).withColumn("month", index_month(F.col("idx"))).drop("idx")


# The measures of the summary.
SUMMARISED = [
    "active_contributors", "newcomer_share", "newcomer_reply_rate", "rolling_helpers", "effective_helpers", "top5_helper_share", "helper_jaccard",
    *[f"{who}_return_{h}m" for who in ("newcomer", "contributor", "helper") for h in (1, 3, 6)],
]


def capacity_summary(monthly: DataFrame, kind: Column, cutoff: str = "2022-12", transition: str = "2022-11") -> DataFrame:
    """Means per community type and period, the transition month left out."""
    rows = monthly.where(F.col("month") != transition)
    period = F.when(F.col("month") < cutoff, "pre").otherwise("post")
    columns = SUMMARISED
    return rows.groupBy(kind.alias("community_type"), period.alias("period")).agg(F.count(F.lit(1)).alias("cells"), *[F.avg(c).alias(f"mean_{c}") for c in columns])
