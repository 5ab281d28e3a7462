"""Queries of the discussion operators on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.columns import month_index, shard_of, strip
from threadloom.operators import capacity, content, describe, models, panel, resilience, threads
from threadloom.plans import adapters as a
from threadloom.session import Scratch
from threadloom.sources.canonical import load
from threadloom.sources.jsonl import months_between, scan_report
from threadloom.sources.tables import table

WARM_UP = 6  # months in which nearly all authors look new
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so that the order of summation doesn't show.

    The steps lie a little beside the short decimals that shares of small counts often hit.
    """
    scale = float(10**digits)
    return df.withColumns({c: F.floor(F.col(f"`{c}`") * scale + 0.5001) / scale for c, kind in df.dtypes if kind == "double"})


@query
def panel_base(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: comments and submissions, authors, lengths, removals, scores, depth and concentration per community and month on the dense grid."""
    s, c = load(spark, d)
    return rounded(panel.panel(s, c, threads.depth_buckets(c, a.depths(spark, d)), a.community_type(F.col("subreddit"))))


@query
def describe_counts(spark: SparkSession, d: str) -> DataFrame:
    """Submissions per community, month and both, with the time range."""
    return describe.describe_counts(load(spark, d)[0])


@query
def describe_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Submissions per community with a column per month, a total and an ALL row."""
    return describe.month_pivot(load(spark, d)[0], months_between(a.FIRST_MONTH, a.LAST_MONTH))


@query
def describe_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Comments and communities per community type and month."""
    return describe.counts_by_type(load(spark, d)[1], a.community_type(F.col("subreddit")))


@query
def top_communities(spark: SparkSession, d: str) -> DataFrame:
    """The 20 communities with most comments."""
    return describe.top_values(load(spark, d)[1], "subreddit", 20)


@query
def top_authors(spark: SparkSession, d: str) -> DataFrame:
    """The 20 authors with most comments as written."""
    return describe.top_values(load(spark, d)[1], "author", 20)


@query
def top_trend(spark: SparkSession, d: str) -> DataFrame:
    """Comments per month of the 15 communities with most of them."""
    return describe.rows_of_top(load(spark, d)[1].where("month is not null"), "subreddit").groupBy("subreddit", "month").agg(F.count(F.lit(1)).alias("n"))


@query
def top_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The ten communities with most mentions of the pattern."""
    t = a.texts(spark, d)
    return describe.top_values(t.where(content.flag(F.col("text"), a.MENTIONS) == 1), "subreddit", 10)


@query
def community_order(spark: SparkSession, d: str) -> DataFrame:
    """Community names as written, in an order without case."""
    return describe.folded_order(table(spark, d, "submissions").select(strip(F.col("subreddit")).alias("subreddit")), "subreddit")


@query
def raw_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines, blank lines, parse errors and missing fields per feed of the raw lines."""
    return scan_report(table(spark, d, "raw_submissions").select("feed", "payload"), ["feed"], "payload")


@query
def scan_stats(spark: SparkSession, d: str) -> DataFrame:
    """Scan statistics of the comments."""
    return rounded(describe.scan_stats(load(spark, d)[1], *a.WINDOW), 2)


@query
def window_filter(spark: SparkSession, d: str) -> DataFrame:
    """Comments in a half-open time window."""
    return describe.in_window(load(spark, d)[1], *a.WINDOW).select("comment_id", "created_utc", "subreddit")


@query
def community_semi(spark: SparkSession, d: str) -> DataFrame:
    """Submissions of listed communities."""
    names = spark.createDataFrame([(n,) for n in a.LISTED], "name string")
    return describe.in_communities(load(spark, d)[0], names).select("submission_id", "subreddit", "created_utc")


@query
def median_length(spark: SparkSession, d: str) -> DataFrame:
    """Exact median length of comments per community and month."""
    return panel.comment_cells(load(spark, d)[1]).select("subreddit", "month", "median_comment_length")


@query
def author_month_counts(spark: SparkSession, d: str) -> DataFrame:
    """Comments per community, month and author."""
    return panel.author_month_counts(load(spark, d)[1])


@query
def concentration(spark: SparkSession, d: str) -> DataFrame:
    """Top shares, HHI, Gini and tiers of authors per community and month."""
    return rounded(panel.concentration(a.month_counts(spark, d)))


@query
def type_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean concentration per community type."""
    return rounded(panel.type_summary(panel.concentration(a.month_counts(spark, d)), a.community_type(F.col("subreddit"))))


@query
def half_change(spark: SparkSession, d: str) -> DataFrame:
    """Change of activity between the halves of a community's months, with its concentration."""
    return rounded(panel.half_change(panel.concentration(a.month_counts(spark, d))))


@query
def comment_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth of every comment below a post, resolved on every call."""
    return threads.comment_depths(load(spark, d)[1])


@query
def depth_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Depth statistics per community and month, and over all communities."""
    c = load(spark, d)[1]
    return rounded(threads.depth_buckets(c, a.depths(spark, d)))


def posts(spark: SparkSession, d: str) -> DataFrame:
    s, c = load(spark, d)
    return threads.post_metrics(s, c, a.depths(spark, d))


@query
def post_activity(spark: SparkSession, d: str) -> DataFrame:
    """Responsiveness and thread structure per post."""
    return rounded(posts(spark, d))


@query
def responsiveness_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Responsiveness per community and month of the post."""
    return rounded(threads.monthly_responsiveness(posts(spark, d)))


@query
def responsiveness_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Reply rate and median latency over delayed replies per community type and month."""
    hours = F.col("first_reply_latency_minutes") / 60.0
    keys = ["community_type", "month"]
    rows = posts(spark, d).where(F.col("month").isNotNull()).select(a.community_type(F.col("subreddit")).alias("community_type"), "month", (F.col("num_comments_observed") > 0).cast("int").alias("replied"), hours.alias("value"))
    medians = panel.exact_quantiles(rows.where("value > 0"), keys, {"median_latency_hours": 0.5})
    return rounded(rows.groupBy(*keys).agg(F.avg("replied").alias("reply_rate")).join(medians, keys, "left"))


@query
def thread_structure(spark: SparkSession, d: str) -> DataFrame:
    """Shares of thread shapes per community and month."""
    return rounded(threads.thread_structure(posts(spark, d)))


@query
def commenter_counts(spark: SparkSession, d: str) -> DataFrame:
    """Comments per post and commenter."""
    return threads.helper_counts(*load(spark, d))


def edges(spark: SparkSession, d: str) -> DataFrame:
    s, c = load(spark, d)
    return threads.reply_edges(s, c, a.depths(spark, d))


@query
def reply_edges(spark: SparkSession, d: str) -> DataFrame:
    """Weighted directed author edges per community and month."""
    return edges(spark, d)


@query
def dyads(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocity and repetition of reply pairs per community and month."""
    return rounded(threads.dyads(edges(spark, d)))


@query
def author_activity(spark: SparkSession, d: str) -> DataFrame:
    """Posts and comments per community, month and author."""
    return a.activity(spark, d)


@query
def author_history(spark: SparkSession, d: str) -> DataFrame:
    """Shares of new, returning and repeating authors."""
    return rounded(threads.author_history(a.activity(spark, d), month_index(F.col("month"))))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    s, c = load(spark, d)
    depths = a.depths(spark, d)
    history = threads.author_history(threads.author_activity(s, c), month_index(F.col("month")))
    shapes = threads.thread_structure(threads.post_metrics(s, c, depths))
    pairs = threads.dyads(threads.reply_edges(s, c, depths))
    grid = describe.dense_grid(history, shapes, pairs)
    rows = describe.on_grid(describe.on_grid(describe.on_grid(grid, history), shapes), pairs)
    rows = scratch.save(rows, "interactions")  # read once per scalar of the reference
    return scratch.save(threads.interaction_indices(rows, WARM_UP, "2022-11"), "indices")


@query
def interactions_monthly(spark: SparkSession, d: str) -> DataFrame:
    """All interaction measures on the dense grid with the bond and identity indices."""
    return rounded(interactions(spark, d))


def helper_months(spark: SparkSession, d: str) -> DataFrame:
    return capacity.helper_months(a.valid_helpers(spark, d), a.helper_posts(spark, d))


def with_month(df: DataFrame) -> DataFrame:
    from threadloom.functions.columns import index_month

    return df.withColumn("month", index_month(F.col("idx"))).drop("idx")


@query
def rolling_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Helpers over trailing twelve months and their overlap with the twelve before."""
    grid = capacity.activity_grid(a.activity(spark, d))
    return rounded(with_month(capacity.rolling_helpers(helper_months(spark, d), grid)))


@query
def contributor_retention(spark: SparkSession, d: str) -> DataFrame:
    """Contributors, newcomers and their return after 1, 3 and 6 months."""
    return rounded(with_month(capacity.contributors(a.activity(spark, d))))


@query
def helper_retention(spark: SparkSession, d: str) -> DataFrame:
    """Helpers of a month who help again after 1, 3 and 6 months."""
    return rounded(with_month(capacity.helper_retention(helper_months(spark, d))))


@query
def newcomer_reply(spark: SparkSession, d: str) -> DataFrame:
    """Posts of newcomers and how many were answered."""
    return rounded(with_month(capacity.newcomer_posts(a.activity(spark, d), a.helper_posts(spark, d))))


def support(spark: SparkSession, d: str) -> DataFrame:
    return capacity.support_capacity(a.activity(spark, d), a.helper_posts(spark, d), a.valid_helpers(spark, d))


@query
def support_capacity(spark: SparkSession, d: str) -> DataFrame:
    """All support-capacity measures per community and month."""
    return rounded(support(spark, d))


@query
def capacity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Support capacity per community type and period."""
    return rounded(capacity.capacity_summary(support(spark, d), a.community_type(F.col("subreddit"))))


@query
def text_flags(spark: SparkSession, d: str) -> DataFrame:
    """Pattern flags of every document."""
    t = a.texts(spark, d)
    return content.text_flags(t.select("doc_id", "text"), F.col("text"), a.PATTERNS).drop("text")


@query
def text_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Text measures per kind of record, community and month."""
    t = a.texts(spark, d).where("month is not null and record_kind is not null")
    return rounded(content.text_metrics(t, ["record_kind", "subreddit", "month"], F.col("text"), a.PATTERNS))


@query
def keyword_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of a pattern per community and month."""
    return rounded(content.keyword_mentions(a.texts(spark, d).where("month is not null"), ["subreddit", "month"], F.col("text"), a.MENTIONS))


@query
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of text proxies against codes; a stand-in for manual codes is read off the language column."""
    t = a.texts(spark, d).where("text is not null")
    coded = F.when(F.col("lang").isNotNull(), (F.lower("lang") == "en").cast("int"))
    flags = {name: (content.flag(F.col("text"), p) == 1, coded) for name, p in a.PATTERNS.items()}
    return rounded(content.validation_report(t, flags))


@query
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five documents per kind, community type and period."""
    t = a.texts(spark, d).where("month is not null and record_kind is not null")
    period = F.when(F.col("month") < "2022-12", "pre").otherwise("post")
    rows = t.select("doc_id", "record_kind", a.community_type(F.col("subreddit")).alias("community_type"), period.alias("period"))
    return content.stratified_sample(rows, ["record_kind", "community_type", "period"], 5, F.col("doc_id"))


@query
def sample_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Size of every stratum and how many of it are sampled."""
    t = a.texts(spark, d).where("month is not null and record_kind is not null")
    period = F.when(F.col("month") < "2022-12", "pre").otherwise("post")
    rows = t.groupBy("record_kind", a.community_type(F.col("subreddit")).alias("community_type"), period.alias("period")).agg(F.count(F.lit(1)).alias("available"))
    return rows.withColumn("sampled", F.least("available", F.lit(5)))


@query
def order_free_sample(spark: SparkSession, d: str) -> DataFrame:
    """500 comments by seeded hash."""
    return content.order_free_sample(load(spark, d)[1].select("comment_id").distinct(), 500, F.col("comment_id"))


def buckets(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d)[1]
    return threads.depth_buckets(c, a.depths(spark, d))


def profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cells = Scratch(spark).save(buckets(spark, d), "buckets")
    return Scratch(spark).save(resilience.resilience_profiles(cells, a.calendar(cells), least_comments=1.0), "profiles"), cells


@query
def resilience_profile(spark: SparkSession, d: str) -> DataFrame:
    """Change of comments around the cutoff and the depth before it."""
    return rounded(profiles(spark, d)[0])


@query
def indexed_trend(spark: SparkSession, d: str) -> DataFrame:
    """Indexed monthly comments of communities with much and little threading."""
    return rounded(resilience.indexed_trend(*profiles(spark, d)))


@query
def spearman_rho(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of threading and change."""
    return rounded(resilience.spearman(profiles(spark, d)[0], "threading_ratio", "pct_change"))


@query
def simple_ols(spark: SparkSession, d: str) -> DataFrame:
    """Regression of change on threading."""
    return rounded(resilience.simple_ols(profiles(spark, d)[0], "threading_ratio", "pct_change"), 4)


@query
def mann_whitney_u(spark: SparkSession, d: str) -> DataFrame:
    """U of the change in communities with much threading."""
    return rounded(resilience.mann_whitney(resilience.median_split(profiles(spark, d)[0], "threading_ratio"), "group", "pct_change"))


@query
def resilience_tests(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation, slope and rank-sum test of threading and change with their p-values."""
    return rounded(resilience.statistics(profiles(spark, d)[0], "threading_ratio", "pct_change"))


@query
def smallest_p_values(spark: SparkSession, d: str) -> DataFrame:
    """The five smallest p-values of the effect models."""
    fits = models.twfe_did(a.stored_panel(spark, d))
    return rounded(fits.where(F.col("p_value").isNotNull()).orderBy("p_value", "outcome_name", "model").limit(5))


def growth(spark: SparkSession, d: str) -> DataFrame:
    columns = ("threading_ratio", "gini", "top5_share")
    cells = structure(spark, d, a.depths(spark, d)).select("subreddit", "month", *columns)
    rows = a.stored_panel(spark, d).join(cells, ["subreddit", "month"], "left")
    early = interactions(spark, d).where((F.col("author_history_observed") == 1) & (F.col("month") < models.CUTOFF))
    means = early.groupBy("subreddit").agg(*[F.avg(c).alias(f"pre_{c}") for c in ("bond_index", "identity_index", "reciprocal_dyad_share")])
    return resilience.growth_profiles(rows, a.community_type(F.col("subreddit")), structure=columns).join(means, "subreddit", "left")


@query
def growth_terciles(spark: SparkSession, d: str) -> DataFrame:
    """Growth of health communities, its tercile, and their structure and interactions before the cutoff."""
    return rounded(growth(spark, d))


@query
def growth_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means of growth and earlier structure per tercile."""
    return rounded(resilience.growth_summary(growth(spark, d)))


@query
def panel_context(spark: SparkSession, d: str) -> DataFrame:
    """The stored panel with mentions, text measures of comments and responsiveness; what a cell lacks is 0."""
    t = a.texts(spark, d).where("month is not null")
    mentions = content.keyword_mentions(t, ["subreddit", "month"], F.col("text"), a.MENTIONS)
    words = content.text_metrics(t.where("record_kind = 'comment'"), ["subreddit", "month"], F.col("text"), a.PATTERNS).select("subreddit", "month", "mean_length", "question_share", "punctuation_per_char")
    answers = threads.monthly_responsiveness(posts(spark, d)).select("subreddit", "month", "reply_rate", "median_latency_hours")
    rows = a.stored_panel(spark, d).select("subreddit", "month", "comments", "submissions")
    for cells in (mentions, words, answers):
        rows = describe.on_grid(rows, cells)
    return rounded(rows)


@query
def balanced_panel(spark: SparkSession, d: str) -> DataFrame:
    """Communities that have comments in every month of the stored panel."""
    return models.balanced(a.stored_panel(spark, d).where("comments > 0")).select("subreddit", "month", "comments")


@query
def exclude_top2(spark: SparkSession, d: str) -> DataFrame:
    """The stored panel without the two largest general communities."""
    return models.without_top_general(a.stored_panel(spark, d)).select("subreddit", "month", "comments")


@query
def winsorized(spark: SparkSession, d: str) -> DataFrame:
    """Comments of the stored panel between their 1st and 99th percentile."""
    p = a.stored_panel(spark, d).withColumn("comments", F.col("comments").cast("double"))
    return rounded(p.select("subreddit", "month", models.winsorized(p, "comments").alias("comments")))


@query
def did_frame(spark: SparkSession, d: str) -> DataFrame:
    """The regression frame of the weighted specification."""
    return rounded(models.analysis_frame(a.stored_panel(spark, d), "comments", models.Spec("weighted", weighted=True)))


@query
def event_bins(spark: SparkSession, d: str) -> DataFrame:
    """Rows per event bin."""
    frame = models.analysis_frame(a.stored_panel(spark, d), "comments")
    return frame.groupBy(models.event_bin(F.col("time_index")).alias("event_bin"), "health").agg(F.count(F.lit(1)).alias("n"))


@query
def did_2x2(spark: SparkSession, d: str) -> DataFrame:
    """Four means and their double difference."""
    return rounded(models.did_2x2(models.analysis_frame(a.stored_panel(spark, d), "comments")))


@query
def nearest_match(spark: SparkSession, d: str) -> DataFrame:
    """Nearest general community of each health community."""
    rows = a.stored_panel(spark, d)
    frame = models.analysis_frame(rows, "comments").join(rows.select("subreddit", "month", "comments_per_submission"), ["subreddit", "month"])
    return rounded(models.nearest_matches(models.pre_features(frame, models.CUTOFF)))


@query
def smd_balance(spark: SparkSession, d: str) -> DataFrame:
    """Standardised mean differences before and after matching."""
    return rounded(models.balance(a.stored_panel(spark, d), "comments"))


@query
def weighted_change(spark: SparkSession, d: str) -> DataFrame:
    """Weighted change per community type."""
    return rounded(resilience.weighted_change(a.stored_panel(spark, d), a.community_type(F.col("subreddit")), "comments_per_submission", "submissions"))


@query
def twfe_did(spark: SparkSession, d: str) -> DataFrame:
    """Two-way fixed-effects estimates of all outcomes and specifications."""
    return rounded(models.twfe_did(a.stored_panel(spark, d)))


@query
def event_study(spark: SparkSession, d: str) -> DataFrame:
    """Event-study estimates per outcome."""
    return rounded(models.event_study(a.stored_panel(spark, d)))


@query
def pretrend(spark: SparkSession, d: str) -> DataFrame:
    """Joint test of leads per outcome."""
    return rounded(models.pretrend_test(a.stored_panel(spark, d)))


@query
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """Baseline estimate without each community in turn."""
    return rounded(models.leave_one_out(a.stored_panel(spark, d)))


def structure(spark: SparkSession, d: str, depths: DataFrame) -> DataFrame:
    """Concentration and depth on the cells of the stored panel; what a cell lacks is 0."""
    shares = panel.concentration(a.month_counts(spark, d)).select("subreddit", "month", "top5_share", "top1_share", "gini", "hhi", F.col("top_1pct_share").alias("pct1_share"))
    deep = threads.depth_buckets(load(spark, d)[1], depths).where(F.col("subreddit") != "ALL").select("subreddit", "month", "threading_ratio", "mean_depth")
    return describe.on_grid(describe.on_grid(a.stored_panel(spark, d).select("subreddit", "month"), shares), deep)


def moderators(spark: SparkSession, d: str) -> DataFrame:
    """Concentration, depth and responsiveness on the cells of the stored panel; what a cell lacks is 0."""
    s, c = load(spark, d)
    depths = a.depths(spark, d)
    monthly = threads.monthly_responsiveness(threads.post_metrics(s, c, depths))
    return describe.on_grid(structure(spark, d, depths), monthly).select("subreddit", "month", *a.MODERATORS)


@query
def moderation(spark: SparkSession, d: str) -> DataFrame:
    """Moderation of the effect by concentration, depth and responsiveness before the cutoff."""
    return rounded(models.moderation(a.stored_panel(spark, d), moderators(spark, d), a.MODERATORS))


INTERACTION_OUTCOMES = """new_author_share returning_author_share repeat_author_share op_return_share reciprocal_dyad_share
repeat_dyad_share multi_actor_share focused_share bond_index identity_index""".split()


def observed_interactions(spark: SparkSession, d: str) -> DataFrame:
    """Interaction measures after the warm-up with type and activity of the stored panel."""
    rows = interactions(spark, d).where("author_history_observed = 1").join(a.stored_panel(spark, d).select("subreddit", "month", "community_type", "comments", "submissions"), ["subreddit", "month"])
    return Scratch(spark).save(rows, "outcomes")  # read once per model


@query
def interaction_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Effect estimates on all interaction outcomes after the warm-up, with q-values over the outcomes of a model."""
    specs = (models.Spec("unweighted"), models.Spec("community_specific_trends", trends=True))
    fits = models.twfe_did(observed_interactions(spark, d), INTERACTION_OUTCOMES, specs, log=False)
    return models.bh_fdr(Scratch(spark).save(rounded(fits), "fits"), "p_value", ["model"])


@query
def interaction_events(spark: SparkSession, d: str) -> DataFrame:
    """Event studies of all interaction outcomes."""
    return rounded(models.event_study(observed_interactions(spark, d), INTERACTION_OUTCOMES, log=False))


@query
def interaction_pretrend(spark: SparkSession, d: str) -> DataFrame:
    """Joint tests of leads and event studies of all interaction outcomes; ``kind`` is pretrend or event_study, a test has no event_bin."""
    rows = observed_interactions(spark, d)
    tests = models.pretrend_test(rows, INTERACTION_OUTCOMES, log=False).withColumn("kind", F.lit("pretrend"))
    studies = models.event_study(rows, INTERACTION_OUTCOMES, log=False).withColumn("kind", F.lit("event_study"))
    return rounded(tests.unionByName(studies, allowMissingColumns=True))


@query
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    """Benjamini-Hochberg q-values of made-up p-values: shares of the stored panel's cells per community."""
    p = a.stored_panel(spark, d).groupBy("community_type", "subreddit").agg(F.round(F.avg((F.col("comments") > 500).cast("int")), 6).alias("p_value"))
    return rounded(models.bh_fdr(p.withColumn("p_value", F.col("p_value") / 20 + F.length("subreddit") / 1000.0), "p_value", ["community_type"]))


@query
def key_results(spark: SparkSession, d: str) -> DataFrame:
    """Headline figures in long form: section, community type, period, measure, value.

    Means are given for either period and for all months; counts, totals and estimates for all.
    """
    period = F.explode(F.array(F.when(F.col("month") < models.CUTOFF, "pre").otherwise("post"), F.lit("all")))
    kind = a.community_type(F.col("subreddit")).alias("community_type")
    stored, whole = a.stored_panel(spark, d), F.lit("all")
    texts = a.texts(spark, d).where("month is not null")
    by_kind = content.keyword_mentions(texts.where("record_kind is not null"), ["record_kind", "subreddit", "month"], F.col("text"), a.MENTIONS)
    by_kind = by_kind.select("subreddit", "month", *[F.when(F.col("record_kind") == k, F.col("mention_share")).alias(f"{k}_mention_share") for k in ("comment", "submission")])
    parts = []
    for section, cells, columns in (
        ("panel", stored.drop("community_type"), ["comments", "submissions", "comments_per_submission"]),
        ("responsiveness", threads.monthly_responsiveness(posts(spark, d)), ["reply_rate", "unanswered_rate", "op_followup_rate", "median_latency_hours"]),
        ("mentions", content.keyword_mentions(texts, ["subreddit", "month"], F.col("text"), a.MENTIONS), ["mention_share"]),
        ("mentions", by_kind, ["comment_mention_share", "submission_mention_share"]),
        ("concentration", panel.concentration(a.month_counts(spark, d)), ["gini", "top5_share"]),
        ("interactions", interactions(spark, d), ["bond_index", "identity_index"]),
    ):
        means = cells.select(kind, period.alias("period"), *columns).groupBy("community_type", "period").agg(*[F.avg(c).alias(c) for c in columns])
        parts.append(means.unpivot(["community_type", "period"], columns, "measure", "value").withColumn("section", F.lit(section)))
    size = stored.agg(F.count_distinct("subreddit").cast("double").alias("n_communities"), F.count_distinct("month").cast("double").alias("n_months"))
    totals = stored.groupBy("community_type").agg(*[F.sum(c).cast("double").alias(f"total_{c}") for c in ("comments", "submissions")])
    for cells, columns in ((size.withColumn("community_type", whole), ["n_communities", "n_months"]), (totals, ["total_comments", "total_submissions"])):
        parts.append(cells.withColumn("period", whole).unpivot(["community_type", "period"], columns, "measure", "value").withColumn("section", F.lit("panel")))
    fits = models.twfe_did(stored, specs=(models.Spec("unweighted"),))
    parts.append(fits.select(whole.alias("community_type"), whole.alias("period"), F.concat("outcome_name", F.lit("_estimate")).alias("measure"), F.col("estimate").alias("value"), F.lit("did").alias("section")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out)


@query
def thread_shards(spark: SparkSession, d: str) -> DataFrame:
    """Comments per shard of their thread."""
    rows = load(spark, d)[1].where(F.col("link").isNotNull())
    return rows.groupBy(shard_of(F.col("link"), 16).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("link").alias("threads"))


@query
def event_activity(spark: SparkSession, d: str) -> DataFrame:
    """Events, users and values per type and day of the event stream."""
    rows = table(spark, d, "events")
    out = rows.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.avg("value").alias("mean_value"))
    return rounded(out)


@query
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Squared distance of every embedding to the mean of its label; the labels' means are a small aggregate joined by key."""
    long = table(spark, d, "embeddings").where("label is not null").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return rounded(long.join(means, ["label", "i"]).groupBy("vec_id", "label").agg(F.sum(F.pow(F.col("x").cast("double") - F.col("m"), F.lit(2.0))).alias("distance")), 4)
