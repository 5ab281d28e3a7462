"""Structured Streaming over folders of new files: filtering and exactly-once delivery of posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from threadloom.functions.columns import post_key
from threadloom.sources.jsonl import filter_lines


def filter_new_files(spark: SparkSession, folder: str, out: str, checkpoint: str, names: Sequence[str], start: int | None = None, end: int | None = None) -> StreamingQuery:
    """Filters every file of JSON lines that is new since the last run, then stops; the checkpoint remembers which.

    Takes the place of a progress file: a run that dies in the middle neither loses nor doubles a file.
    """
    lines = spark.readStream.format("text").option("pathGlobFilter", "*.jsonl*").load(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.lit(None).cast("long").alias("line_no"), "value")
    kept = filter_lines(lines, names, start, end)
    return kept.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def first_deliveries(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, within: str = "60 days") -> StreamingQuery:
    """Keeps the first row seen of each post id while deliveries lie at most ``within`` apart.

    State is bounded by the watermark.  Rows without id all pass.  Repeats that come later than
    that are left to the batch operator, which knows no such bound.
    """
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("received_at", F.col("received_at").cast("timestamp"))
    own = F.coalesce(post_key(F.col("submission_id")), F.concat(F.lit("\x1f"), F.col("delivery_id").cast("string")))
    kept = rows.withColumn("__key", own).withWatermark("received_at", within).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
    return kept.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def daily_activity(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Streaming counts per community and UTC day, final once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "subreddit").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "subreddit", "n")
