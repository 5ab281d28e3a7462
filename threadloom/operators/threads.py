"""Depth of comments, posts' responsiveness and the thread structure behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.columns import share, strip, valid_author
from threadloom.operators import trees
from threadloom.operators.panel import exact_quantiles

CELL = ["subreddit", "month"]


def comment_depths(comments: DataFrame) -> DataFrame:
    """``comment_id, depth`` of every distinct comment below a post, known or not; others have no row."""
    nodes = trees.read_nodes(comments, "comment_id", "parent_id")
    every = trees.hierarchy(trees.resolve_forest(nodes), paths=False)
    return every.where(F.col("depth").isNotNull()).select(F.col("id").alias("comment_id"), "depth")


def depth_buckets(comments: DataFrame, depths: DataFrame) -> DataFrame:
    """Per community and month over resolved records, and over all communities as ``ALL``: counts by depth, mean, maximum, threading ratio.

    Repeated records each count.  Records without time have month ``unknown``.
    """
    rows = comments.select("comment_id", "subreddit", F.coalesce("month", F.lit("unknown")).alias("month")).join(depths, "comment_id")
    sums = rows.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.sum("depth").alias("depth_sum"), F.max("depth").alias("max_depth"),
        F.sum((F.col("depth") == 1).cast("long")).alias("depth_1"), F.sum((F.col("depth") == 2).cast("long")).alias("depth_2"), F.sum((F.col("depth") >= 3).cast("long")).alias("depth_3plus"),
    )
    adds = ["n", "depth_sum", "depth_1", "depth_2", "depth_3plus"]
    whole = sums.groupBy("month").agg(*[F.sum(c).alias(c) for c in adds], F.max("max_depth").alias("max_depth")).withColumn("subreddit", F.lit("ALL"))
    return sums.unionByName(whole).withColumns({"mean_depth": share(F.col("depth_sum"), F.col("n")), "threading_ratio": share(F.col("depth_2") + F.col("depth_3plus"), F.col("n"))})


def first_posts(submissions: DataFrame) -> DataFrame:
    """One row per post id; of copies the earliest time counts, then the smallest author and community."""
    order = F.struct(F.col("created_utc").isNull(), "created_utc", "author", "subreddit")
    row = F.struct("subreddit", "author", "created_utc", "month")
    return submissions.where(F.col("submission_id").isNotNull()).groupBy("submission_id").agg(F.min_by(row, order).alias("p")).select("submission_id", "p.*")


def post_metrics(submissions: DataFrame, comments: DataFrame, depths: DataFrame) -> DataFrame:
    """Per post: comments, first latency, author's follow-ups, replies by depth, commenters and the busiest helper.

    Latency counts any comment, never below 0.  The author's follow-ups are those with the same name
    as written.  Commenters are valid authors.  Comments are counted per (post, commenter, depth
    class) first, so one huge thread is spread over its commenters.
    """
    posts = first_posts(submissions)
    meta = posts.select("submission_id", F.col("author").alias("op"), F.col("created_utc").alias("posted"))
    rows = comments.where(F.col("link").isNotNull() & F.col("created_utc").isNotNull()).join(depths, "comment_id", "left")
    per_author = rows.groupBy(F.col("link").alias("submission_id"), "author").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_utc").alias("first"), F.sum((F.col("depth") == 1).cast("long")).alias("direct"),
        F.sum((F.col("depth") >= 2).cast("long")).alias("deep"), F.max("depth").alias("deepest"),
    )
    named = valid_author(F.col("author"))
    joined = per_author.join(meta, "submission_id")
    helper = named.isNotNull() & ~F.coalesce(F.col("author") == F.col("op"), F.lit(False))
    sums = joined.groupBy("submission_id").agg(
        F.sum("n").alias("num_comments_observed"), F.min("first").alias("first"), F.sum(F.when(F.col("author") == F.col("op"), F.col("n")).otherwise(0)).alias("op_followup_comments"),
        F.coalesce(F.sum("direct"), F.lit(0)).alias("direct_reply_count"), F.coalesce(F.sum("deep"), F.lit(0)).alias("deep_reply_count"), F.coalesce(F.max("deepest"), F.lit(0)).alias("max_depth"),
        F.count(F.when(named.isNotNull(), 1)).alias("unique_commenters"), F.count(F.when(helper, 1)).alias("unique_non_op_commenters"), F.coalesce(F.max(F.when(helper, F.col("n"))), F.lit(0)).alias("top_helper_comments"),
        F.coalesce(F.sum(F.when(helper, F.col("n"))), F.lit(0)).alias("helper_comments"),
    )
    out = posts.join(sums, "submission_id", "left")
    counts = [c for c in sums.columns if c not in ("submission_id", "first")]
    minutes = F.greatest(F.lit(0.0), (F.col("first") - F.col("created_utc")) / 60.0)
    return out.withColumn("first_reply_latency_minutes", F.when(F.col("first").isNotNull(), minutes)).drop("first").fillna(0, counts)


def monthly_responsiveness(posts: DataFrame) -> DataFrame:
    """Per community and month of the post: reply and follow-up rates, latency quartiles over replied posts, means and medians."""
    replied = F.col("num_comments_observed") > 0
    rows = posts.where(F.col("month").isNotNull())
    out = rows.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("posts"), F.avg(replied.cast("int")).alias("reply_rate"), F.avg((F.col("op_followup_comments") > 0).cast("int")).alias("op_followup_rate"),
        F.avg("num_comments_observed").alias("mean_comments"), F.avg("unique_commenters").alias("mean_commenters"),
        F.avg("direct_reply_count").alias("mean_direct_replies"), F.avg("deep_reply_count").alias("mean_deep_replies"), F.avg("max_depth").alias("mean_max_depth"),
    )
    hours = exact_quantiles(rows.where(replied).select(*CELL, (F.col("first_reply_latency_minutes") / 60.0).alias("value")), CELL, {"median_latency_hours": 0.5, "p25_latency_hours": 0.25, "p75_latency_hours": 0.75})
    counts = exact_quantiles(rows.select(*CELL, F.col("num_comments_observed").alias("value")), CELL, {"median_comments": 0.5})
    return out.join(hours, CELL, "left").join(counts, CELL, "left").withColumn("unanswered_rate", 1 - F.col("reply_rate")).fillna(0.0)


def thread_structure(posts: DataFrame) -> DataFrame:
    """Shares of posts whose author came back, that stayed flat, had several actors, were focused on one helper or distributed."""
    top = share(F.col("top_helper_comments"), F.col("helper_comments"))
    answered = F.col("num_comments_observed") > 0
    flags = {
        "op_return_share": F.col("op_followup_comments") > 0,
        "single_commenter_thread_share": answered & (F.col("max_depth") <= 1),
        "multi_actor_share": F.col("unique_non_op_commenters") >= 3,
        "focused_share": (F.col("helper_comments") > 0) & (top > 0.5),
        "distributed_share": (F.col("unique_non_op_commenters") >= 5) & (top <= 0.3),
    }
    return posts.where(F.col("month").isNotNull()).groupBy(*CELL).agg(F.count(F.lit(1)).alias("posts"), *[F.avg(f.cast("int")).alias(name) for name, f in flags.items()])


def helper_counts(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """``submission_id, commenter, is_non_op, comment_count`` over valid commenters of known posts."""
    posts = first_posts(submissions).select("submission_id", F.col("author").alias("op"))
    rows = comments.select(F.col("link").alias("submission_id"), valid_author(F.col("author")).alias("commenter")).where(F.col("commenter").isNotNull() & F.col("submission_id").isNotNull())
    counts = rows.groupBy("submission_id", "commenter").agg(F.count(F.lit(1)).alias("comment_count"))
    other = F.when(F.col("commenter") == strip(F.col("op")), 0).otherwise(1)
    return counts.join(posts, "submission_id").select("submission_id", "commenter", other.alias("is_non_op"), "comment_count")


def reply_edges(submissions: DataFrame, comments: DataFrame, depths: DataFrame) -> DataFrame:
    """``subreddit, month, source, target, edge_count``: who replied to whom, without replies to oneself.

    Only resolved comments of known posts make edges; a comment of depth 1 replies to the post's
    author, a deeper one to its parent's.
    """
    posts = first_posts(submissions).select(F.col("submission_id").alias("link"), valid_author(F.col("author")).alias("op"))
    parent, _ = trees.read_parent(F.col("parent_id"))
    rows = comments.where(F.col("month").isNotNull()).select("comment_id", "link", *CELL, valid_author(F.col("author")).alias("source"), parent.alias("ptr"))
    authors = comments.groupBy("comment_id").agg(F.min(valid_author(F.col("author"))).alias("parent_author")).withColumnRenamed("comment_id", "ptr")
    rows = rows.join(posts, "link").join(depths, "comment_id").join(authors, "ptr", "left")
    target = F.when(F.col("ptr").isNotNull(), F.col("parent_author")).otherwise(F.col("op"))
    edges = rows.select(*CELL, "source", target.alias("target")).where("source is not null and target is not null and source <> target")
    return edges.groupBy(*CELL, "source", "target").agg(F.count(F.lit(1)).alias("edge_count"))


def dyads(edges: DataFrame) -> DataFrame:
    """Per cell: pairs, share of pairs with replies in both directions, share of replies inside pairs with at least two."""
    pairs = edges.groupBy(*CELL, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).alias("directions"), F.sum("edge_count").alias("replies"))
    out = pairs.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("dyads"), F.sum("replies").alias("replies"), F.avg((F.col("directions") == 2).cast("int")).alias("reciprocal_dyad_share"),
        F.sum(F.when(F.col("replies") >= 2, F.col("replies")).otherwise(0)).alias("repeated"),
    )
    return out.withColumn("repeat_dyad_share", share(F.col("repeated"), F.col("replies"))).drop("repeated")


def author_activity(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """``subreddit, month, author, activity_count`` over posts and comments of valid authors."""
    rows = submissions.select(*CELL, valid_author(F.col("author")).alias("author")).unionByName(comments.select(*CELL, valid_author(F.col("author")).alias("author")))
    return rows.where("month is not null and author is not null").groupBy(*CELL, "author").agg(F.count(F.lit(1)).alias("activity_count"))


def author_history(activity: DataFrame, month_number) -> DataFrame:
    """Per cell: authors and the shares that are new, back after a pause, or active the month before.

    One window per (community, author) replaces the joins on first and previous months.
    """
    order = Window.partitionBy("subreddit", "author").orderBy("idx")
    rows = activity.select(*CELL, "author", month_number.alias("idx")).withColumns({"before": F.lag("idx").over(order)})
    new, repeat = F.col("before").isNull(), F.col("before") == F.col("idx") - 1
    flag = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("unique_authors"), flag(new).alias("new_author_share"), flag(~new & ~repeat).alias("returning_author_share"), flag(repeat).alias("repeat_author_share"))


# The signs with which z-scores enter the two indices.
BOND = {"op_return_share": 1, "reciprocal_dyad_share": 1, "repeat_dyad_share": 1, "repeat_author_share": 1}
IDENTITY = {"unique_authors": 1, "new_author_share": 1, "distributed_share": 1, "focused_share": -1}


def zscores(df: DataFrame, columns: list[str], active, reference, fallback) -> DataFrame:
    """Adds ``z_c`` per column: distance from the reference rows' mean in population deviations.

    0.0 for inactive rows and where the reference is constant or empty.  The fallback rows serve as
    reference when the reference is empty.  The statistics are one row of scalars.
    """
    stats = []
    for name, rule in (("r", reference), ("f", fallback)):
        stats += [F.count(F.when(rule, 1)).alias(f"{name}_n")]
        for c in columns:
            v = F.when(rule, F.col(c))
            stats += [F.avg(v).alias(f"{name}_{c}_m"), F.when(F.min(v) < F.max(v), F.stddev_pop(v)).alias(f"{name}_{c}_s")]
    row = df.agg(*stats)
    pick = lambda c, part: F.when(row.select("r_n").scalar() > 0, row.select(f"r_{c}_{part}").scalar()).otherwise(row.select(f"f_{c}_{part}").scalar())
    return df.withColumns({f"z_{c}": F.when(active, F.coalesce((F.col(c) - pick(c, "m")) / pick(c, "s"), F.lit(0.0))).otherwise(F.lit(0.0)) for c in columns})


def interaction_indices(monthly: DataFrame, warm_up: int, cutoff: str) -> DataFrame:
    """Adds ``author_history_observed`` and ``bond_index`` and ``identity_index``: signed sums of z-scores against the pre-period.

    ``monthly`` is a dense grid.  History is observed from ``warm_up`` months after the first on.  The reference are active rows before the cutoff with at least ``warm_up`` earlier months in the
    panel; without any, all active rows before it.
    """
    columns = list(dict.fromkeys([*BOND, *IDENTITY]))
    order = Window.partitionBy("subreddit").orderBy("month")
    rows = monthly.withColumn("author_history_observed", (F.row_number().over(order) > warm_up).cast("int"))
    active = F.col("unique_authors") > 0
    early = active & (F.col("month") < cutoff)
    scored = zscores(rows, columns, active, early & (F.col("author_history_observed") == 1), early)
    total = lambda signs: sum((F.col(f"z_{c}") * s for c, s in signs.items()), F.lit(0.0))
    return scored.withColumns({"bond_index": total(BOND), "identity_index": total(IDENTITY)}).drop(*[f"z_{c}" for c in columns])
