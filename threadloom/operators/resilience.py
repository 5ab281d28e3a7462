"""Change of communities around a cutoff: resilience profiles, growth groups, rank and regression statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import stats
from threadloom.functions.columns import share
from threadloom.operators.panel import exact_quantiles


def resilience_profiles(buckets: DataFrame, months: DataFrame, cutoff: str = "2022-11", least_pre: int = 3, least_post: int = 3, least_comments: float = 10.0) -> DataFrame:
    """Per community: zero-filled mean comments before and after, relative change, threading and depth weighted by comments.

    ``buckets`` are depth buckets of communities, ``months`` the calendar (``month``).  Kept are
    communities with enough active months on either side and enough comments before.
    """
    cal = months.agg(F.sum((F.col("month") < cutoff).cast("long")).alias("pre"), F.sum((F.col("month") >= cutoff).cast("long")).alias("post"))
    pre, post = F.col("month") < cutoff, F.col("month") >= cutoff
    on = lambda rule, c: F.sum(F.when(rule, F.col(c)).otherwise(0))
    sums = buckets.where((F.col("month") != "unknown") & (F.col("subreddit") != "ALL")).groupBy("subreddit").agg(
        on(pre, "n").alias("pre_n"), on(post, "n").alias("post_n"), F.sum((pre & (F.col("n") > 0)).cast("long")).alias("pre_months"), F.sum((post & (F.col("n") > 0)).cast("long")).alias("post_months"),
        F.sum(F.when(pre, F.col("depth_2") + F.col("depth_3plus")).otherwise(0)).alias("threaded"), on(pre, "depth_sum").alias("deep"),
    )
    out = sums.withColumns({"pre_mean": share(F.col("pre_n"), cal.select("pre").scalar()), "post_mean": share(F.col("post_n"), cal.select("post").scalar())})
    out = out.where((F.col("pre_months") >= least_pre) & (F.col("post_months") >= least_post) & (F.col("pre_mean") >= least_comments) & (F.col("pre_mean") > 0))
    return out.select(
        "subreddit", "pre_mean", "post_mean", ((F.col("post_mean") - F.col("pre_mean")) / F.col("pre_mean") * 100).alias("pct_change"),
        share(F.col("threaded"), F.col("pre_n")).alias("threading_ratio"), share(F.col("deep"), F.col("pre_n")).alias("mean_depth"), "pre_months", "post_months",
    )


def median_split(df: DataFrame, column: str, name: str = "group") -> DataFrame:
    """Adds ``high`` for values at or above the median, ``low`` below; all alike are split at the middle by rank."""
    middle = exact_quantiles(df.select(F.lit(0).alias("one"), F.col(column).alias("value")), ["one"], {"m": 0.5})
    stats = df.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(column, "subreddit")  # one row per community
    by_rank = F.row_number().over(order) > F.floor(stats.select("n").scalar() / 2)
    flat = stats.select("a").scalar() == stats.select("b").scalar()
    return df.withColumn(name, F.when(F.when(flat, by_rank).otherwise(F.col(column) >= middle.select("m").scalar()), "high").otherwise("low"))


def indexed_trend(profiles: DataFrame, buckets: DataFrame, column: str = "threading_ratio") -> DataFrame:
    """Mean over communities of comments indexed to their pre-period mean = 100, by median split and month."""
    groups = median_split(profiles, column).select("subreddit", "group", "pre_mean")
    rows = groups.join(buckets.where(F.col("month") != "unknown").select("subreddit", "month", "n"), "subreddit")
    return rows.groupBy("group", "month").agg(F.avg(F.col("n") / F.col("pre_mean") * 100).alias("index"), F.count(F.lit(1)).alias("communities"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ranks from 1 on, ties sharing their mean; the input has one row per community."""
    order = Window.orderBy(column)
    first, ties = F.rank().over(order), F.count(F.lit(1)).over(Window.partitionBy(column))
    return df.withColumn(name, first + (ties - 1) / 2.0)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and the rank correlation (null without variation)."""
    ranked = average_ranks(average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "__x"), y, "__y")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("__x", "__y").alias("rho"))


def simple_ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, slope, intercept and r2."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return df.agg(F.regr_count(a, b).alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"))


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: sizes and U of the group ``high``."""
    ranked = average_ranks(df, value, "__r")
    sums = ranked.agg(F.sum(F.when(F.col(group) == "high", F.col("__r"))).alias("r"), F.count(F.when(F.col(group) == "high", 1)).alias("n_high"), F.count(F.when(F.col(group) == "low", 1)).alias("n_low"))
    return sums.select("n_high", "n_low", (F.col("r") - F.col("n_high") * (F.col("n_high") + 1) / 2.0).alias("u"))


def growth_profiles(panel: DataFrame, kind: Column, cutoff: str = "2022-12", structure: tuple[str, ...] = ()) -> DataFrame:
    """Health communities: means before and after, growth over at least 1, and the tercile of comment growth (ties by name).

    ``pre_c`` is the mean before the cutoff of every column c of ``structure``.
    """
    pre, post = F.col("month") < cutoff, F.col("month") >= cutoff
    mean = lambda rule, c: F.avg(F.when(rule, F.col(c)))
    rows = panel.where(kind == "health").groupBy("subreddit").agg(
        *[mean(rule, c).alias(f"{p}_mean_{c}") for p, rule in (("pre", pre), ("post", post)) for c in ("comments", "submissions")], *[mean(pre, c).alias(f"pre_{c}") for c in structure]
    )
    change = lambda c: (F.col(f"post_mean_{c}") - F.col(f"pre_mean_{c}")) / F.greatest(F.col(f"pre_mean_{c}"), F.lit(1.0))
    rows = rows.withColumns({"comment_growth": change("comments"), "submission_growth": change("submissions")})
    place = F.row_number().over(Window.orderBy("comment_growth", "subreddit")) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("growth_group", F.when(place <= 1 / 3, "declining").when(place <= 2 / 3, "stable").otherwise("growing"))


def growth_summary(profiles: DataFrame) -> DataFrame:
    """Per growth group: communities and means of growth and of the structure before the cutoff."""
    means = ["comment_growth", "pre_threading_ratio", "pre_gini", "pre_top5_share"]
    return profiles.groupBy("growth_group").agg(F.count(F.lit(1)).alias("communities"), *[F.avg(c).alias(f"mean_{c}") for c in means])


def weighted_change(panel: DataFrame, kind: Column, value: str, weight: str, cutoff: str = "2022-12") -> DataFrame:
    """Per community type: weighted means before and after and their difference."""
    pre = F.col("month") < cutoff
    mean = lambda rule: F.try_divide(F.sum(F.when(rule, F.col(value) * F.col(weight))), F.sum(F.when(rule, F.col(weight))))
    out = panel.groupBy(kind.alias("community_type")).agg(mean(pre).alias("pre_mean"), mean(~pre).alias("post_mean"))
    return out.withColumn("change", F.col("post_mean") - F.col("pre_mean"))


def statistics(profiles: DataFrame, x: str, y: str) -> DataFrame:
    """``test, n, statistic, p_value`` of rank correlation, regression slope and the test between halves of x.

    The statistics are aggregates; only their few scalars reach the driver.
    """
    rho = spearman(profiles, x, y).first()
    line = simple_ols(profiles, x, y).first()
    split = median_split(profiles, x)
    u = mann_whitney(split, "group", y).first()
    size = F.col("count").cast("double")
    tied = split.groupBy(y).count().agg(F.coalesce(F.sum(size * size * size - size), F.lit(0.0)).alias("t")).first().t
    rows = [("spearman", rho.n, rho.rho, stats.spearman_p(math.nan if rho.rho is None else rho.rho, rho.n))]
    fits = line.n > 2 and line.slope is not None and line.r2 is not None
    t = math.copysign(math.sqrt(line.r2 * (line.n - 2) / max(1e-300, 1 - line.r2)), line.slope) if fits else math.nan
    rows.append(("ols_slope", line.n, line.slope, stats.t_two_sided(t, line.n - 2) if fits else math.nan))
    both = u.n_high and u.n_low
    rows.append(("mann_whitney_u", u.n_high + u.n_low, u.u, stats.mann_whitney_p(u.u, u.n_high, u.n_low, [], tied) if both else math.nan))
    return profiles.sparkSession.createDataFrame(rows, "test string, n long, statistic double, p_value double")
