"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.columns import compare_name, epoch_day, epoch_month, is_placeholder, valid_author
from threadloom.llm import distinct, leakage, packing, quantiles, sentences
from threadloom.sources.tables import table

GROUPS = ["day", "month", "subreddit"]
KINDS = ["comment", "submission", "counted"]
LEVELS = {
    "all": [], "day": ["day"], "month": ["month"], "community": ["subreddit"],
    "community_day": ["day", "subreddit"], "community_month": ["month", "subreddit"],
}


def author_rows(spark: SparkSession, d: str) -> DataFrame:
    """``day, month, subreddit, kind, member`` of all three tables; author_counts knows no day."""
    parts = []
    for name, kind in (("comments", "comment"), ("submissions", "submission")):
        t = table(spark, d, name)
        parts.append(t.select(epoch_day(F.col("created_utc")).alias("day"), epoch_month(F.col("created_utc")).alias("month"), compare_name(F.col("subreddit")).alias("subreddit"), F.lit(kind).alias("kind"), valid_author(F.col("author")).alias("member")))
    t = table(spark, d, "author_counts")
    parts.append(t.select(F.lit(None).cast("date").alias("day"), F.col("month"), compare_name(F.col("subreddit")).alias("subreddit"), F.lit("counted").alias("kind"), valid_author(F.col("author")).alias("member")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("member").isNotNull())


def p5_distinct_authors(spark: SparkSession, d: str) -> DataFrame:
    """Distinct authors per day, month, community and their combinations; exact.

    ``authors_in_both`` are those of an AND of the comment and submission bitmaps.  Null, blank and
    placeholder authors are none; rows lacking a column of a level do not count in that level.
    """
    coded = distinct.bucketed(author_rows(spark, d), GROUPS, KINDS)
    rolled = distinct.bucket_bitmaps(coded, GROUPS, KINDS, LEVELS)
    bits = {"unique_comment_authors": F.col("comment"), "unique_submission_authors": F.col("submission"), "unique_counted_authors": F.col("counted")}
    both = {"authors_in_both": F.col("comment").bitwiseAND(F.col("submission")), "authors_in_any": F.col("comment").bitwiseOR(F.col("submission")).bitwiseOR(F.col("counted"))}
    out = distinct.level_names(distinct.count_bits(rolled, ["level", *GROUPS], bits | both), LEVELS)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def measures(spark: SparkSession, d: str) -> DataFrame:
    """``measure, subreddit, month, value``: comment lengths in code points and reply latencies in hours."""
    comments, posts = table(spark, d, "comments"), table(spark, d, "post_metrics")
    body = F.when(~is_placeholder(F.col("body")), F.length("body"))
    month = F.coalesce("month", epoch_month(F.col("created_utc")))
    lengths = comments.select(F.lit("length").alias("measure"), compare_name(F.col("subreddit")).alias("subreddit"), epoch_month(F.col("created_utc")).alias("month"), body.cast("double").alias("value"))
    hours = posts.select(F.lit("latency").alias("measure"), compare_name(F.col("subreddit")).alias("subreddit"), month.alias("month"), (F.col("first_reply_latency_minutes") / 60.0).alias("value"))
    return lengths.unionByName(hours).where("subreddit is not null and month is not null")


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per community and month with a relative error of at most 1 percent.

    Null and placeholder bodies have no length; unanswered posts have no latency, negative ones count.
    """
    keys = ["measure", "subreddit", "month"]
    counts = quantiles.bucket_counts(measures(spark, d), keys, F.col("value"))
    wanted = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
    long = quantiles.percentiles(counts, keys, wanted)

    def of(measure: str, column: str) -> F.Column:
        found = F.max(F.when(F.col("measure") == measure, F.col(column)))
        return found if column == "n" else F.round(found, 6)

    out = [of("length", "n").alias("n_comments")] + [of("length", c).alias(f"{c}_comment_length") for c in wanted]
    out += [of("latency", "n").alias("n_replied")] + [of("latency", c).alias(f"{c}_first_reply_latency_hours") for c in wanted]
    return long.groupBy("subreddit", "month").agg(*out)


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """Container of every document or piece of one, capacity 2,048 tokens."""
    return packing.pack(packing.token_counts(table(spark, d, "documents")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How much of the containers is used."""
    return packing.fill_report(p8_packing(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the test items they leak."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Ends of all sentences of all documents."""
    return sentences.sentence_ends(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p5_distinct_authors, p6_percentiles, p8_packing, p8_fill, p9_found, p10_found)}
