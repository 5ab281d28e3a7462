"""Canonical submissions and comments, the input of all discussion operators.

submission: submission_id, subreddit, author, title, selftext, score, created_utc, month
comment: comment_id, link, parent_id, subreddit, author, body, score, created_utc, month

``subreddit`` is the name for comparison, ``unknown`` where it is missing.  ``created_utc`` is whole
seconds, ``month`` is UTC and null without a time.  Every record stays a row of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.columns import compare_name, epoch_month, epoch_seconds, post_key
from threadloom.sources.tables import table

SUBMISSION = {"selftext": "string", "title": "string", "author": "string", "score": "double"}
COMMENT = {"body": "string", "author": "string", "score": "double", "parent_id": "string"}


def _filled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(kind) if c in df.columns else F.lit(None).cast(kind) for c, kind in columns.items()})


def _common(df: DataFrame) -> DataFrame:
    df = df.withColumn("created_utc", epoch_seconds(F.col("created_utc")))
    name = F.coalesce(compare_name(F.col("subreddit")), F.lit("unknown"))
    return df.withColumns({"subreddit": name, "month": epoch_month(F.col("created_utc"))})


def canonical_submissions(df: DataFrame, key: str = "submission_id") -> DataFrame:
    out = _common(_filled(df, SUBMISSION)).withColumn("submission_id", post_key(F.col(key).cast("string")))
    return out.select("submission_id", "subreddit", "author", "title", "selftext", "score", "created_utc", "month")


def canonical_comments(df: DataFrame, key: str = "comment_id", link: str = "submission_id") -> DataFrame:
    out = _common(_filled(df, COMMENT)).withColumns({"comment_id": F.col(key).cast("string"), "link": post_key(F.col(link).cast("string"))})
    return out.select("comment_id", "link", "parent_id", "subreddit", "author", "body", "score", "created_utc", "month")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(submissions, comments) of a folder of Parquet tables."""
    return canonical_submissions(table(spark, folder, "submissions")), canonical_comments(table(spark, folder, "comments"))
