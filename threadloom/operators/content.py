"""Text proxies: flags by pattern, counts of marks and words, keyword mentions and coded samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.columns import BLANKS, is_placeholder, share, strip
from threadloom.operators.panel import exact_medians

CELL = ["subreddit", "month"]
# The default patterns of the text flags and of mentions of language models.
PATTERNS = {
    "question": r"\?|\b(how|what|why|should i|anyone|experience)\b",
    "experience": r"\b(i have|my doctor|my symptoms|diagnosed|anyone else|experience)\b",
    "support": r"\b(sorry|hope|hug|support|feel|you are not alone|take care)\b",
    "medical": r"\b(doctor|physician|er|urgent care|not medical advice|ask your doctor)\b",
}
MENTIONS = r"\b(?:chatgpt|gpt(?:-3|-4)?|openai|llm|large language model|generative ai|ai generated|artificial intelligence|bard|gemini|claude|copilot)\b"


def flag(text: Column, pattern: str) -> Column:
    """1 where the pattern occurs in any case, 0 elsewhere and for null."""
    return F.coalesce(text.rlike("(?i)" + pattern), F.lit(False)).cast("int")


def submission_text(title: Column, selftext: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(selftext, F.lit(""))))


def punctuation(text: Column) -> Column:
    """Number of the 32 ASCII punctuation characters."""
    return F.length(F.regexp_replace(text, r"[^\p{Punct}]", ""))


def plain_sentences(text: Column) -> Column:
    """Parts between runs of . ! and ? that are not blank."""
    return F.filter(F.split(text, "[.!?]+"), lambda s: strip(s) != "")


def words(text: Column) -> Column:
    """Words between blanks, summed over the sentences."""
    sizes = F.transform(plain_sentences(text), lambda s: F.size(F.split(strip(s), f"[{BLANKS}]+")))
    return F.aggregate(sizes, F.lit(0), lambda total, n: total + n)


def text_flags(df: DataFrame, text: Column, patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """Adds a 0/1 column for each pattern."""
    return df.select("*", *[flag(text, p).alias(name) for name, p in patterns.items()])


def text_metrics(df: DataFrame, keys: list[str], text: Column, patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """Per key over texts that are neither blank nor placeholders: flag shares, lengths, marks, sentences and words.

    Keys whose texts are all invalid have no row.  The whole text counts.
    """
    body = F.coalesce(text, F.lit(""))
    rows = df.select(*keys, body.alias("t")).where((strip(F.col("t")) != "") & ~is_placeholder(F.col("t")))
    t = F.col("t")
    rows = rows.select(
        *keys, F.length(t).alias("chars"), *[flag(t, p).alias(name) for name, p in patterns.items()], t.contains("?").cast("int").alias("asks"), punctuation(t).alias("marks"),
        F.size(plain_sentences(t)).alias("parts"), words(t).alias("words"),
    )
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("texts"), F.avg("chars").alias("mean_length"), *[F.avg(name).alias(f"{name}_share") for name in patterns], F.avg("asks").alias("question_mark_share"),
        F.avg((F.col("chars") < 20).cast("int")).alias("very_short_share"), F.avg((F.col("chars") > 500).cast("int")).alias("long_share"),
        share(F.sum("marks"), F.sum("chars")).alias("punctuation_per_char"), share(F.sum("words"), F.sum("parts")).alias("words_per_sentence"),
    )
    medians = exact_medians(rows.select(*keys, F.col("chars").alias("value")), keys).withColumnRenamed("median", "median_length")
    return sums.join(medians, keys, "left")


def keyword_mentions(df: DataFrame, keys: list[str], text: Column, pattern: str = MENTIONS) -> DataFrame:
    """Texts per key that mention the pattern, and their share of all texts, placeholders included."""
    rows = df.select(*keys, flag(text, pattern).alias("hit"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("texts"), F.sum("hit").alias("mentions"), F.avg("hit").alias("mention_share"))


def validation_report(coded: DataFrame, proxies: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Per proxy against manual codes: coverage, confusion counts, precision and recall (null where undefined).

    ``proxies`` maps a name to (proxy is on, manual code or null).
    """
    parts = []
    for name, (proxy, manual) in proxies.items():
        known = manual.isNotNull()
        count = lambda rule: F.coalesce(F.sum(rule.cast("long")), F.lit(0))
        part = coded.agg(
            F.count(F.lit(1)).alias("sampled"), count(known).alias("coded"), count(known & proxy & (manual == 1)).alias("true_positive"), count(known & proxy & (manual == 0)).alias("false_positive"),
            count(known & ~proxy & (manual == 1)).alias("false_negative"), count(known & ~proxy & (manual == 0)).alias("true_negative"),
        ).withColumn("proxy", F.lit(name))
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    return out.withColumns({"coverage": share(F.col("coded"), F.col("sampled")), "precision": ratio("true_positive", "false_positive"), "recall": ratio("true_positive", "false_negative")})


def order_free_sample(df: DataFrame, n: int, key: Column, seed: int = 42) -> DataFrame:
    """n rows by the smallest seeded hash of their key: independent of order and partitions.  Sampling is its purpose."""
    return df.withColumn("__h", F.xxhash64(F.lit(seed), key)).orderBy("__h", key).limit(n).drop("__h")


def stratified_sample(df: DataFrame, strata: list[str], per_stratum: int, key: Column, seed: int = 42) -> DataFrame:
    """The rows with the smallest seeded hash in each stratum; the group limit is applied before the shuffle."""
    order = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_stratum).drop("rank")


MANUAL = ("manual_question", "manual_experience", "manual_support", "manual_medical")


def coding_rows(sample: DataFrame, keep: list[str], text: Column, manual: tuple[str, ...] = MANUAL, patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """A sample laid out for hand coding: the kept columns, whole text, proxies, and empty columns to fill in.

    Placeholders and blank texts are left out, as the proxies don't judge them.
    """
    rows = sample.select(*keep, F.coalesce(text, F.lit("")).alias("text")).where((strip(F.col("text")) != "") & ~is_placeholder(F.col("text")))
    return text_flags(rows, F.col("text"), patterns).select("*", *[F.lit(None).cast("int").alias(m) for m in manual])
