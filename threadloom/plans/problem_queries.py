"""Queries of the general data problems: rolling totals, hierarchies, skew, drift and redelivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.columns import compare_name, epoch_day, epoch_month, is_placeholder, post_key, strip, valid_author
from threadloom.operators import dedup, drift, rolling, skew, trees
from threadloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Community days whose last seven days had no submission."""
    days = community_days(spark, d)
    return days.where(F.col("total_7") == 0).select(F.col("entity").alias("subreddit"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def community_days(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_totals(table(spark, d, "submissions"), compare_name(F.col("subreddit")), epoch_day(F.col("created_utc")), F.lit(1))


def dated(days: DataFrame, entity: str) -> DataFrame:
    return days.select(F.col("entity").alias(entity), F.date_format("day", "yyyy-MM-dd").alias("day"), *[c for c in days.columns if c not in ("entity", "day")])


def p1_community_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Submissions per community and day with 7- and 30-day totals and means; every delivery counts."""
    return dated(community_days(spark, d), "subreddit")


def p1_commenter_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Comments per commenter and day; the day is that of the submission's first delivery with a time."""
    posts = table(spark, d, "submissions").where(F.col("created_utc").isNotNull())
    days = dedup.first_delivery(posts, post_key(F.col("submission_id")), "received_at", "delivery_id", ["created_utc"])
    helpers = table(spark, d, "helper_counts").withColumn("__key", post_key(F.col("submission_id"))).join(days, "__key")
    name = strip(F.col("commenter"))
    out = dated(rolling.rolling_totals(helpers, F.when(name != "", name), epoch_day(F.col("created_utc")), F.col("comment_count")), "commenter")
    return out.withColumn("is_placeholder", is_placeholder(F.col("commenter")).cast("int"))


def comment_forest(spark: SparkSession, d: str) -> trees.Forest:
    return trees.resolve_forest(trees.read_nodes(table(spark, d, "comments"), "comment_id", "parent_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Comments on a circle of parents."""
    return comment_forest(spark, d).cycles.select("cycle_id", F.col("id").alias("comment_id"))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root, state and number of descendants of every comment; only comments on a circle have no number."""
    forest = comment_forest(spark, d)
    nodes = trees.with_descendant_counts(trees.hierarchy(forest))
    below = trees.with_descendant_counts(trees.below_cycles(forest)).select("id", F.col("n_descendants").alias("n_below"))
    n = F.coalesce("n_descendants", "n_below").alias("n_descendants")
    return nodes.join(below, "id", "left").select(F.col("id").alias("comment_id"), "state", "root", "level", "depth", F.array_join("path", "/").alias("path"), "cycle_id", n)


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of comment and descendant with their distance; comments on a circle are in no pair."""
    forest = comment_forest(spark, d)
    return trees.descendants(trees.hierarchy(forest)).unionByName(trees.descendants(trees.below_cycles(forest)))


def p2_max_depth(spark: SparkSession, d: str) -> DataFrame:
    """Deepest level per community and month over resolved comments."""
    depths = trees.hierarchy(comment_forest(spark, d), paths=False).where(F.col("depth").isNotNull()).select(F.col("id").alias("comment_id"), "depth")
    rows = table(spark, d, "comments").select("comment_id", compare_name(F.col("subreddit")).alias("subreddit"), epoch_month(F.col("created_utc")).alias("month"))
    return rows.where("subreddit is not null and month is not null").join(depths, "comment_id").groupBy("subreddit", "month").agg(F.max("depth").alias("max_depth"))


def counted_authors(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "author_counts"), compare_name(F.col("subreddit")), valid_author(F.col("author")), F.col("comment_count")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Communities with at least 5 percent of the rows or of the counts."""
    return skew.dominant_keys(skew.key_sums(*counted_authors(spark, d))).select(F.col("key").alias("subreddit"))


def p3_community_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, counts, number of authors and top authors' shares per community."""
    names = {"key": "subreddit", "value_total": "comment_total", "n_members": "n_authors", "member_total": "author_total"}
    totals = skew.key_totals(*counted_authors(spark, d))
    return totals.select(*[F.col(c).alias(names.get(c, c)) for c in totals.columns])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Layout changes between neighbouring files of a feed."""
    return drift.layout_changes(table(spark, d, "raw_submissions")).select("feed", "file_no", "field", "change")


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    """The same with old name and both types."""
    return drift.layout_changes(table(spark, d, "raw_submissions"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """Every raw line in one typed table with rescued fields, approved fields promoted."""
    return drift.replay(drift.rescue_ingest(table(spark, d, "raw_submissions")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Surplus deliveries of a post."""
    return dedup.surplus_deliveries(table(spark, d, "submissions"), post_key(F.col("submission_id")), "received_at", "delivery_id")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Exactly one row of each post, with all its columns."""
    return dedup.keep_first(table(spark, d, "submissions"), post_key(F.col("submission_id")), "received_at", "delivery_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_community_rolling, p1_commenter_rolling, p2_found, p2_hierarchy, p2_descendants, p2_max_depth, p3_found, p3_community_totals, p4_found, p4_changes, p4_table, p7_found, p7_kept)}
