"""The community-month panel: activity, lengths, removals, scores and concentration of authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.columns import author_as_written, is_placeholder, share
from threadloom.operators.communities import community_type
from threadloom.operators.describe import dense_grid, on_grid

CELL = ["subreddit", "month"]


def submission_cells(submissions: DataFrame) -> DataFrame:
    """Per cell: submissions, distinct authors, mean text lengths, removed share and mean score.

    A submission is removed when it has no author or its title or text is a placeholder; its lengths
    do not count then, its score does.
    """
    removed = F.col("author").isNull() | is_placeholder(F.col("title")) | is_placeholder(F.col("selftext"))
    rows = submissions.where(F.col("month").isNotNull())
    length = lambda c: F.when(~removed, F.length(F.coalesce(c, F.lit(""))))
    return rows.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("submissions"), F.count_distinct(author_as_written(F.col("author"))).alias("unique_submission_authors"),
        F.coalesce(F.avg(length("title")), F.lit(0.0)).alias("mean_title_length"), F.coalesce(F.avg(length("selftext")), F.lit(0.0)).alias("mean_selftext_length"),
        F.avg(removed.cast("int")).alias("removed_submission_share"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_submission_score"),
    )


def comment_cells(comments: DataFrame) -> DataFrame:
    """Per cell: comments, distinct authors, mean and exact median length, removed share and mean score."""
    removed = is_placeholder(F.col("body"))
    length = F.when(~removed, F.length(F.coalesce("body", F.lit(""))))
    return comments.where(F.col("month").isNotNull()).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("comments"), F.count_distinct(author_as_written(F.col("author"))).alias("unique_comment_authors"),
        F.coalesce(F.avg(length), F.lit(0.0)).alias("mean_comment_length"), F.avg(removed.cast("int")).alias("removed_comment_share"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_comment_score"),
    ).join(exact_medians(comments.where(F.col("month").isNotNull()).select(*CELL, length.alias("value")), CELL).withColumnRenamed("median", "median_comment_length"), CELL, "left").fillna({"median_comment_length": 0.0})


def exact_medians(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact ``median`` of ``value`` per key from counts of each distinct value; keys without values are absent.

    A cell of any size sends at most one row per distinct value and task.
    """
    counts = df.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("value")
    rows = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("value")))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return rows.groupBy(*keys).agg(((at(low) + at(high)) / 2.0).alias("median"))


def exact_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per key, from counts of each distinct value like ``exact_medians``.

    Distinct values are counted map-side and sorted on disk if need be; no group is held in a buffer.
    """
    counts = df.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("value")
    rows = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("value").cast("double")))
    parts = []
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("total") - 1)
        parts += [at(F.floor(place)).alias(f"{name}__a"), at(F.ceil(place)).alias(f"{name}__b"), F.max(place - F.floor(place)).alias(f"{name}__w")]
    return rows.groupBy(*keys).agg(*parts).select(*keys, *[(F.col(f"{c}__a") + F.col(f"{c}__w") * (F.col(f"{c}__b") - F.col(f"{c}__a"))).alias(c) for c in wanted])


def panel(submissions: DataFrame, comments: DataFrame, buckets: DataFrame | None = None, kind: F.Column | None = None, cutoff: str = "2022-11") -> DataFrame:
    """Both sides on the dense grid with depth, concentration, community type, ``comments_per_submission`` and ``months_since`` the cutoff.

    ``buckets`` are the depth buckets of the comments, resolved here unless given; ``kind`` is the
    community type, by default that of the two study groups.  Concentration counts the comments'
    valid authors.
    """
    if buckets is None:
        from threadloom.operators.threads import comment_depths, depth_buckets

        buckets = depth_buckets(comments, comment_depths(comments))
    kind = community_type(F.col("subreddit")) if kind is None else kind
    s, c = submission_cells(submissions), comment_cells(comments)
    deep = buckets.where((F.col("subreddit") != "ALL") & (F.col("month") != "unknown")).select(*CELL, "mean_depth", "threading_ratio", "max_depth")
    names = {"top_1pct_share": "pct1_share", "next_9pct_share": "pct9_share", "last_90pct_share": "pct90_share"}
    shares = concentration(author_month_counts(comments)).drop("total_comments", "unique_authors").withColumnsRenamed(names)
    rows = dense_grid(s, c)
    for cells in (s, c, deep, shares):
        rows = on_grid(rows, cells)
    year, month = int(cutoff[:4]), int(cutoff[5:])
    since = (F.substring("month", 1, 4).cast("int") - year) * 12 + F.substring("month", 6, 2).cast("int") - month
    return rows.withColumns({"community_type": kind, "comments_per_submission": share(F.col("comments"), F.col("submissions")), "months_since": since, "post": (F.col("month") >= cutoff).cast("int")})


def author_month_counts(comments: DataFrame) -> DataFrame:
    """Comments per community, month and valid author."""
    author = author_as_written(F.col("author"))
    rows = comments.where(F.col("month").isNotNull()).select(*CELL, author.alias("author")).where(F.col("author").isNotNull())
    return rows.groupBy(*CELL, "author").agg(F.count(F.lit(1)).alias("n"))


def concentration(counts: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Per cell: total, authors, top shares, HHI, Gini and the shares of the 1, next 9 and last 90 percent.

    Equal counts are interchangeable in all of these, so authors are first merged into one row per
    distinct count: a cell with any number of authors then has few rows, and ranks are ranges.
    """
    sizes = counts.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("k"))
    down = Window.partitionBy(*keys).orderBy(F.desc("n"))
    every = Window.partitionBy(*keys)
    rows = sizes.select(
        *keys, "n", "k", F.sum("k").over(down).alias("upto"), F.sum("k").over(every).alias("authors"), F.sum(F.col("n") * F.col("k")).over(every).alias("total")
    ).withColumn("above", F.col("upto") - F.col("k"))
    one = F.greatest(F.lit(1), F.ceil(F.col("authors") * 0.01))
    ten = F.greatest(one + 1, F.ceil(F.col("authors") * 0.1))

    def held(rank) -> F.Column:
        """Comments of the authors up to a rank."""
        inside = F.greatest(F.lit(0), F.least(F.col("k"), rank - F.col("above")))
        return F.sum(F.col("n") * inside)

    # ascending ranks of this row run from authors - upto + 1 to authors - above
    weights = F.col("k") * (F.col("authors") - F.col("upto") + 1 + F.col("authors") - F.col("above")) - F.col("k") * (F.col("authors") + 1)
    sums = rows.groupBy(*keys).agg(
        F.max("total").alias("total_comments"), F.max("authors").alias("unique_authors"), held(F.lit(1)).alias("t1"), held(F.lit(5)).alias("t5"),
        held(one).alias("h1"), held(ten).alias("h10"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("k")).alias("sq"), F.sum(F.col("n").cast("double") * weights).alias("g"),
    )
    total = F.col("total_comments").cast("double")
    return sums.select(
        *keys, "total_comments", "unique_authors", share(F.col("t1"), total).alias("top1_share"), share(F.col("t5"), total).alias("top5_share"), share(F.col("sq"), total * total).alias("hhi"),
        share(F.col("g"), F.col("unique_authors") * total).alias("gini"), share(F.col("h1"), total).alias("top_1pct_share"),
        share(F.col("h10") - F.col("h1"), total).alias("next_9pct_share"), share(F.col("total_comments") - F.col("h10"), total).alias("last_90pct_share"),
    )


def type_summary(cells: DataFrame, kind: F.Column) -> DataFrame:
    """Unweighted means over cells per community type."""
    means = ["top1_share", "top5_share", "hhi", "gini"]
    return cells.groupBy(kind.alias("community_type")).agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("subreddit").alias("communities"), *[F.avg(c).alias(f"mean_{c}") for c in means])


def half_change(cells: DataFrame) -> DataFrame:
    """Per community: comments in the first and second half of its months, relative change and mean shares.

    The halves split the community's own months at the rounded-down middle; communities with one
    month or nothing in the first half are left out.
    """
    order, every = Window.partitionBy("subreddit").orderBy("month"), Window.partitionBy("subreddit")
    rows = cells.withColumn("rank", F.row_number().over(order)).withColumn("half", F.floor(F.count(F.lit(1)).over(every) / 2))
    first = F.col("rank") <= F.col("half")
    out = rows.groupBy("subreddit").agg(
        F.sum(F.when(first, F.col("total_comments")).otherwise(0)).alias("first_half"), F.sum(F.when(~first, F.col("total_comments")).otherwise(0)).alias("second_half"),
        F.avg("gini").alias("mean_gini"), F.avg("top5_share").alias("mean_top5_share"),
    )
    return out.where("first_half > 0").withColumn("change", (F.col("second_half") - F.col("first_half")) / F.col("first_half"))
