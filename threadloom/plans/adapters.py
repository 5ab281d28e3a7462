"""The supplied tables as inputs of the discussion operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.columns import author_as_written, compare_name, epoch_month, post_key, share, valid_author
from threadloom.operators import communities, threads
from threadloom.session import Scratch
from threadloom.sources.canonical import load
from threadloom.sources.tables import file_marks, table

FIRST_MONTH, LAST_MONTH = "2022-01", "2023-12"
WINDOW = (1648771200, 1680307200)  # April 2022 to March 2023
# Community groups of the supplied tables.
GENERAL = """everydayqueries smalltalkroom askthebench oldradios bikecommutebits fishtanknotes paperbacks cheapmeals kitchenfails boardgamebarn
gardenshedtalk catnaps moviebench pennywise_ideas chessporch languageswap knittingpile mapnerds cyclecafe""".split()
HEALTH = """pulsecorner sleepledger kneeclub mindthegut nightshiftnotes saltandsugar migrainelog backpainbarn allergyatlas thyroidtalk footcare_forum lungloft
skinstories fastingfolk eyestrainers jointventures coldsnaps gentlestretch earringing celiaccircle quietgrief ibs_lounge insulinkitchen anxietyattic""".split()
LISTED = ["pulsecorner", "kneeclub", "oldradios"]
# Patterns that occur in the supplied texts.
PATTERNS = {"question": r"\?|\b(how|what|why|should i|anyone)\b", "experience": r"\b(my (dad|cousin|manager)|i lost)\b", "support": r"\b(thanks|thank you)\b", "medical": r"\b(dr|physio|pharmacist|nurse)\b"}
MENTIONS = r"\b(?:app|version|tablets?)\b"
MODERATORS = """top5_share top1_share gini hhi pct1_share threading_ratio mean_depth
reply_rate unanswered_rate op_followup_rate median_latency_hours""".split()

community_type = partial(communities.community_type, general=GENERAL, health=HEALTH)


def stored_panel(spark: SparkSession, d: str) -> DataFrame:
    """monthly_panel with missing counts as 0, compared names, community types and comments per submission."""
    t = table(spark, d, "monthly_panel")
    numbers = [c for c in t.columns if c not in ("subreddit", "month")]
    rows = t.select(compare_name(F.col("subreddit")).alias("subreddit"), "month", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers]).where("subreddit is not null and month is not null")
    return rows.withColumns({"community_type": community_type(F.col("subreddit")), "comments_per_submission": share(F.col("comments"), F.col("submissions"))})


def helper_posts(spark: SparkSession, d: str) -> DataFrame:
    """post_metrics as ``submission_id, subreddit, month, author, num_comments_observed``."""
    t = table(spark, d, "post_metrics")
    return t.select(post_key(F.col("submission_id")).alias("submission_id"), compare_name(F.col("subreddit")).alias("subreddit"), "month", valid_author(F.col("author")).alias("author"), "num_comments_observed")


def valid_helpers(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "helper_counts")
    rows = t.select(post_key(F.col("submission_id")).alias("submission_id"), valid_author(F.col("commenter")).alias("commenter"), "is_non_op", "comment_count")
    return rows.where("submission_id is not null and commenter is not null")


def activity(spark: SparkSession, d: str) -> DataFrame:
    return threads.author_activity(*load(spark, d))


def month_counts(spark: SparkSession, d: str) -> DataFrame:
    """author_counts merged over shards: ``subreddit, month, author, n`` of valid authors."""
    t = table(spark, d, "author_counts").select(compare_name(F.col("subreddit")).alias("subreddit"), "month", author_as_written(F.col("author")).alias("author"), F.coalesce("comment_count", F.lit(0)).alias("n"))
    rows = t.where("subreddit is not null and month is not null and author is not null")
    return rows.groupBy("subreddit", "month", "author").agg(F.sum("n").alias("n")).where("n > 0")


def calendar(cells: DataFrame) -> DataFrame:
    return cells.select("month").where(F.col("month") != "unknown").distinct()


_DEPTHS: dict[tuple, DataFrame] = {}


def depths(spark: SparkSession, d: str) -> DataFrame:
    """Depth of every comment below a post, resolved once per session for all queries that need it; anew when the files changed."""
    path = f"{d}/comments.parquet"
    key = (spark.sparkContext.applicationId, path, *file_marks(spark, path))
    if key not in _DEPTHS:
        _DEPTHS[key] = Scratch(spark).save(threads.comment_depths(load(spark, d)[1]), "depths")
    return _DEPTHS[key]


def texts(spark: SparkSession, d: str) -> DataFrame:
    """documents with compared name, month and the kind of record."""

    t = table(spark, d, "documents")
    return t.select("doc_id", "text", "record_kind", "lang", "source", "author", "created_utc", F.coalesce(compare_name(F.col("subreddit")), F.lit("unknown")).alias("subreddit"), epoch_month(F.col("created_utc")).alias("month"))


