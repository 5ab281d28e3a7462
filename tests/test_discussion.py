"""Discussion operators on small hand-made threads with known cells."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions.columns import month_index
from threadloom.operators import capacity, content, describe, models, panel, resilience, threads
from threadloom.operators.communities import GENERAL, HEALTH, community_type
from threadloom.sources.canonical import canonical_comments, canonical_submissions

JUN, JUL, AUG = 1654100000, 1657000000, 1660000000


def subs(spark, rows):
    df = spark.createDataFrame([dict(zip(("submission_id", "subreddit", "author", "title", "selftext", "score", "created_utc"), r)) for r in rows], "submission_id string, subreddit string, author string, title string, selftext string, score double, created_utc long")
    return canonical_submissions(df)


def coms(spark, rows):
    df = spark.createDataFrame([dict(zip(("comment_id", "submission_id", "parent_id", "subreddit", "author", "body", "score", "created_utc"), r)) for r in rows], "comment_id string, submission_id string, parent_id string, subreddit string, author string, body string, score double, created_utc long")
    return canonical_comments(df)


@pytest.fixture(scope="module")
def thread(spark):
    s = subs(spark, [
        ("s1", "r/Ask", "op", "title", "text", 3.0, JUN), ("s2", "ask", "[deleted]", "[removed]", None, None, JUN + 5), ("s3", "Other", "x", "tt", "", 1.0, AUG), (None, None, None, None, None, None, None),
    ])
    c = coms(spark, [
        ("c1", "s1", "t3_s1", "ask", "anna", "hello", 1.0, JUN + 600), ("c2", "s1", "t1_c1", "ask", "op", "hi 😀", 2.0, JUN + 700), ("c3", "s1", "t1_c2", "ask", "anna", "[removed]", None, JUN + 800),
        ("c4", "s1", "t3_s1", "ask", "[deleted]", "", 0.0, JUN + 60), ("c5", "s1", "t1_c4", "ask", "ben", None, 0.0, JUN + 900), ("c5", "s1", "t1_c4", "ask", "ben", None, 0.0, JUN + 900),
        ("c6", "gone", "t1_nowhere", "other", "ben", "abc", 5.0, AUG), ("c7", "s3", "t3_s3", "other", "x", "x", 5.0, AUG - 100), ("c8", "s3", "t3_s3", "other", None, "y", 5.0, None),
    ])
    return s, c


def test_panel(spark, thread):
    cells = {(r.subreddit, r.month): r for r in panel.panel(*thread).collect()}
    assert set(cells) == {(n, m) for n in ("ask", "other") for m in ("2022-06", "2022-07", "2022-08")}
    r = cells["ask", "2022-06"]
    assert (r.submissions, r.comments, r.unique_submission_authors, r.unique_comment_authors) == (2, 6, 1, 3)
    assert (r.removed_submission_share, r.mean_title_length, r.mean_selftext_length) == (0.5, 5.0, 4.0)
    assert r.removed_comment_share == pytest.approx(1 / 6) and r.mean_comment_length == pytest.approx((5 + 4) / 5) and r.median_comment_length == 0.0
    assert (r.comments_per_submission, r.months_since, r.post) == (3.0, -5, 0)
    assert cells["ask", "2022-07"].comments == 0


def test_exact_median(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 10.0), ("b", 3.0), ("c", None)], "k string, value double")
    assert {r.k: r.median for r in panel.exact_medians(df, ["k"]).collect()} == {"a": 3.0, "b": 3.0}


def test_concentration(spark):
    df = spark.createDataFrame([("x", "m", a, n) for a, n in (("a", 90), ("b", 5), ("c", 3), ("d", 2))] + [("y", "m", a, 4) for a in "abcde"], "subreddit string, month string, author string, n long")
    got = {r.subreddit: r for r in panel.concentration(df).collect()}
    assert got["x"].gini == pytest.approx(0.665) and got["x"].top1_share == 0.9 and got["x"].hhi == pytest.approx(0.8138)
    assert got["y"].gini == pytest.approx(0.0) and got["y"].hhi == pytest.approx(0.2)
    r = got["x"]
    assert r.top_1pct_share + r.next_9pct_share + r.last_90pct_share == pytest.approx(1.0) and (r.top_1pct_share, r.next_9pct_share) == (0.9, 0.05)


def test_depth_and_posts(spark, thread, rows):
    s, c = thread
    depths = threads.comment_depths(c)
    assert rows(depths) == [("c1", 1), ("c2", 2), ("c3", 3), ("c4", 1), ("c5", 2), ("c7", 1), ("c8", 1)]
    b = {(r.subreddit, r.month): r for r in threads.depth_buckets(c, depths).collect()}
    r = b["ask", "2022-06"]
    assert (r.n, r.max_depth, r.depth_1, r.depth_2, r.depth_3plus, r.mean_depth) == (6, 3, 2, 3, 1, pytest.approx(11 / 6)) and r.threading_ratio == pytest.approx(4 / 6)
    assert ("other", "unknown") in b and b["ALL", "2022-06"].n == 6
    p = {r.submission_id: r for r in threads.post_metrics(s, c, depths).collect()}
    assert set(p) == {"s1", "s2", "s3"}
    r = p["s1"]
    assert (r.num_comments_observed, r.op_followup_comments, r.direct_reply_count, r.deep_reply_count, r.max_depth) == (6, 1, 2, 4, 3)
    assert (r.unique_commenters, r.unique_non_op_commenters, r.top_helper_comments, r.helper_comments, r.first_reply_latency_minutes) == (3, 2, 2, 4, 1.0)
    assert p["s2"].first_reply_latency_minutes is None and p["s2"].num_comments_observed == 0
    assert p["s3"].first_reply_latency_minutes == 0.0
    m = {(r.subreddit, r.month): r for r in threads.monthly_responsiveness(threads.post_metrics(s, c, depths)).collect()}
    assert m["ask", "2022-06"].reply_rate == 0.5 and m["ask", "2022-06"].median_latency_hours == pytest.approx(1 / 60)


def test_edges_and_dyads(spark, thread, rows):
    s, c = thread
    edges = threads.reply_edges(s, c, threads.comment_depths(c))
    assert rows(edges, "subreddit", "source", "target", "edge_count") == [("ask", "anna", "op", 2), ("ask", "op", "anna", 1)]
    r = threads.dyads(edges).first()
    assert (r.dyads, r.replies, r.reciprocal_dyad_share, r.repeat_dyad_share) == (1, 3, 1.0, 1.0)


def test_author_history(spark):
    data = [("a", "2022-01", "x"), ("a", "2022-02", "x"), ("a", "2022-04", "x"), ("a", "2022-04", "y")]
    df = spark.createDataFrame(data, "subreddit string, month string, author string")
    got = {r.month: (r.new_author_share, r.returning_author_share, r.repeat_author_share) for r in threads.author_history(df, month_index(F.col("month"))).collect()}
    assert got == {"2022-01": (1.0, 0.0, 0.0), "2022-02": (0.0, 0.0, 1.0), "2022-04": (0.5, 0.5, 0.0)}


def test_zscores(spark):
    df = spark.createDataFrame([(1, 1.0, 0.1), (1, 3.0, 0.1), (0, 9.0, 0.1)], "ref int, v double, flat double")
    got = [(r.z_v, r.z_flat) for r in threads.zscores(df, ["v", "flat"], F.lit(True), F.col("ref") == 1, F.lit(True)).orderBy("v").collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0), (7.0, 0.0)]


def test_rolling_helpers_against_sets(spark):
    import random

    rng = random.Random(3)
    data = {(h, i) for i in range(24270, 24290) for h in "abcdefghij" if rng.random() < 0.3}
    months = spark.createDataFrame([("s", i, h, 1 + (ord(h) + i) % 3) for h, i in data], "subreddit string, idx int, helper string, n long")
    grid = spark.createDataFrame([("s", i) for i in range(24270, 24290)] + [("none", 24270)], "subreddit string, idx int")
    for r in capacity.rolling_helpers(months, grid, window=4).collect():
        now = {h for h, i in data if r.idx - 3 <= i <= r.idx} if r.subreddit == "s" else set()
        was = {h for h, i in data if r.idx - 7 <= i <= r.idx - 4} if r.subreddit == "s" else set()
        sums = sorted((sum(1 + (ord(h) + i) % 3 for x, i in data if x == h and r.idx - 3 <= i <= r.idx) for h in now), reverse=True)
        assert r.rolling_helpers == len(now) and r.helper_jaccard == pytest.approx(len(now & was) / len(now | was) if now | was else 0)
        assert r.effective_helpers == pytest.approx(sum(sums) ** 2 / sum(x * x for x in sums) if sums else 0) and r.top5_helper_share == pytest.approx(sum(sums[:5]) / sum(sums) if sums else 0)


def test_retention_is_zero_at_the_end(spark):
    df = spark.createDataFrame([("s", "2022-01", "a"), ("s", "2022-02", "a"), ("s", "2022-02", "b")], "subreddit string, month string, author string")
    got = {r.idx % 12 + 1: r for r in capacity.contributors(df).collect()}
    assert (got[1].contributor_return_1m, got[2].contributor_return_1m, got[2].new_contributors, got[2].newcomer_share) == (1.0, 0.0, 1, 0.5)


def test_describe(spark, thread):
    s, c = thread
    got = {(r.level, r.subreddit, r.month): r.n for r in describe.describe_counts(s).collect()}
    assert got["all", None, None] == 4 and got["community", "ask", None] == 2 and got["community_month", "unknown", "unknown"] == 1 and ("month", None, "unknown") not in got
    wide = {r.subreddit: r for r in describe.month_pivot(s, ["2022-06", "2022-07", "2022-08"]).collect()}
    assert wide["ALL"].total == 3 and wide["ask"]["2022-06"] == 2 and wide["other"]["2022-07"] == 0
    stats = describe.scan_stats(c, JUN, AUG).first()
    assert (stats.rows_read, stats.missing_time, stats.rows_in_window) == (9, 1, 7)
    assert [(r.subreddit, r.n) for r in describe.top_values(c, "subreddit", 1).collect()] == [("ask", 6)]
    assert describe.describe_counts(s.limit(0)).where("level <> 'all'").count() == 0


def test_community_types(spark):
    df = spark.createDataFrame([("ADHD",), ("askreddit",), ("paleo",), (None,)], "n string").select(community_type(F.col("n")).alias("t"))
    assert [r.t for r in df.collect()] == ["health", "general", "other", "other"]
    assert (len(GENERAL), len(HEALTH)) == (12, 62)


def test_text_metrics(spark):
    data = [("a", "How are you? Fine. Thanks!!"), ("a", None), ("a", " [deleted] "), ("a", ""), ("b", "x" * 50000), ("b", "no end")]
    df = spark.createDataFrame(data, "k string, text string")
    got = {r.k: r for r in content.text_metrics(df, ["k"], F.col("text")).collect()}
    r = got["a"]
    assert (r.texts, r.question_share, r.question_mark_share, r.mean_length, r.median_length, r.words_per_sentence) == (1, 1.0, 1.0, 27.0, 27.0, pytest.approx(5 / 3)) and r.punctuation_per_char == pytest.approx(4 / 27)
    assert got["b"].texts == 2 and got["b"].mean_length == 25003.0
    hits = {r.k: r.mentions for r in content.keyword_mentions(spark.createDataFrame([("a", "I asked ChatGPT."), ("a", None), ("b", "gptx")], "k string, text string"), ["k"], F.col("text")).collect()}
    assert hits == {"a": 1, "b": 0}


def test_samples(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    first = sorted(r.id for r in content.stratified_sample(df.repartition(1), ["g"], 4, F.col("id")).collect())
    assert len(first) == 12 and first == sorted(r.id for r in content.stratified_sample(df.orderBy(F.desc("id")).repartition(5), ["g"], 4, F.col("id")).collect())
    assert content.order_free_sample(df, 500, F.col("id")).count() == 100


def test_coding_rows(spark):
    df = spark.createDataFrame([(1, "how are you"), (2, None), (3, "[removed]")], "id long, body string").withColumn("text", F.lit("clash"))
    got = content.coding_rows(df, ["id"], F.col("body")).collect()
    assert [(r.id, r.text, r.question, r.manual_question) for r in got] == [(1, "how are you", 1, None)]


def test_validation_report(spark):
    df = spark.createDataFrame([(True, 1), (True, 0), (False, 1), (True, None)], "p boolean, m int")
    r = content.validation_report(df, {"x": (F.col("p"), F.col("m"))}).first()
    assert (r.coverage, r.precision, r.recall, r.true_negative) == (0.75, 0.5, 0.5, 0)
    assert content.validation_report(df.limit(0), {"x": (F.col("p"), F.col("m"))}).first().precision is None


def test_rank_statistics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 1.0), ("c", 3.0, 5.0), ("d", 3.0, 4.0)], "subreddit string, x double, y double")
    assert resilience.spearman(df, "x", "y").first().rho == pytest.approx(0.7378647873726218)
    r = resilience.simple_ols(df, "x", "y").first()
    assert r.slope == pytest.approx(16 / 11) and r.n == 4
    split = resilience.median_split(df, "x")
    assert sorted((r.subreddit, r.group) for r in split.collect()) == [("a", "low"), ("b", "low"), ("c", "high"), ("d", "high")]
    assert resilience.mann_whitney(split, "group", "y").first().u == 4.0
    p = {r.test: r for r in resilience.statistics(df, "x", "y").collect()}
    assert p["mann_whitney_u"].p_value == pytest.approx(1 / 3) and 0 < p["spearman"].p_value < 1 and 0 < p["ols_slope"].p_value < 1
    assert [r.n for r in resilience.statistics(df.limit(0), "x", "y").collect()] == [0, 0, 0]
    flat = resilience.median_split(df.withColumn("x", F.lit(1.0)), "x")
    assert sorted(r.group for r in flat.collect()) == ["high", "high", "low", "low"]


def made_panel(spark, missing=()):
    data = []
    for k in range(8):
        kind = "health" if k < 4 else "general"
        for m in range(9):
            month = f"2022-{m + 7:02d}" if m < 6 else f"2023-{m - 5:02d}"
            if (k, m) in missing:
                continue
            level = (20 + 3 * k + 2 * m) * (1.4 if kind == "health" and month >= "2022-12" else 1.0)
            data.append((f"c{k}", month, kind, int(level), 10, level / 10))
    return spark.createDataFrame(data, "subreddit string, month string, community_type string, comments long, submissions long, comments_per_submission double")


def test_did_equals_double_difference_on_balanced_panel(spark):
    p = made_panel(spark)
    fits = {r.model: r for r in models.twfe_did(p, ["comments"], models.SPECS[:7]).collect()}
    two = models.did_2x2(models.analysis_frame(p, "comments")).first()
    assert fits["unweighted"].estimate == pytest.approx(two.did, abs=1e-9) and 0.2 < two.did < 0.5
    assert fits["unweighted"].std_error > 0 and fits["unweighted"].n_obs == 64 and "2022-11" not in {r.month for r in models.analysis_frame(p, "comments").collect()}
    assert fits["balanced_panel"].estimate == pytest.approx(fits["unweighted"].estimate)
    assert fits["exclude_top2_general"].n_communities == 6


def test_unbalanced_community_is_dropped(spark):
    p = made_panel(spark, missing={(0, 3)})
    names = {r.subreddit for r in models.analysis_frame(p, "comments", models.Spec("b", balanced=True)).select("subreddit").distinct().collect()}
    assert names == {f"c{k}" for k in range(1, 8)}


def test_event_study_and_pretrend(spark):
    p = made_panel(spark)
    study = {r.event_bin: r for r in models.event_study(p, ["comments"]).collect()}
    assert study[-2].estimate == 0.0 and study[0].estimate > 0 and study[0].ci_low < study[0].estimate < study[0].ci_high
    tests = models.pretrend_test(p, ["comments"]).first()
    assert tests.n_leads == 4 and 0 <= tests.p_value <= 1
    assert models.pretrend_test(p, ["comments"], reference=-2).first().n_leads == 3
    assert models.leave_one_out(p).count() == 8


def test_moderation_and_matching(spark):
    p = made_panel(spark)
    monthly = p.select("subreddit", "month", (F.length("subreddit") + F.col("comments") % 7).cast("double").alias("m"))
    out = models.moderation(p, monthly, ["m"], ["comments"]).collect()
    assert {r.model for r in out} == {"triple_interaction", "within_health"}
    frame = models.analysis_frame(p, "comments")
    matched = models.nearest_matches(models.pre_features(frame, models.CUTOFF)).collect()
    assert len(matched) == 4 and all(r.matched in {"c4", "c5", "c6", "c7"} for r in matched)


def test_bh_fdr(spark):
    df = spark.createDataFrame([("m", 0.01), ("m", 0.04), ("m", 0.03), ("m", None), ("n", 0.5)], "model string, p double")
    got = {(r.model, r.p): r.q_value for r in models.bh_fdr(df, "p", ["model"]).collect()}
    assert got["m", 0.01] == pytest.approx(0.03) and got["m", 0.03] == pytest.approx(0.04) and got["m", 0.04] == pytest.approx(0.04) and got["m", None] is None and got["n", 0.5] == 0.5
