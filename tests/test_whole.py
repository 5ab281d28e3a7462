"""Whole results of queries on small tables made for what they once left out."""

import os

import pytest
from pyspark.sql import functions as F

from threadloom.functions import stats
from threadloom.operators import capacity, content, models, resilience, threads
from threadloom.plans import core_queries, problem_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def comments(spark, tmp_path):
    """A circle a-b; c hangs off a with child d and grandchildren e, f; g hangs off b; x-y is an ordinary tree."""
    data = [("a", "t1_b"), ("b", "t1_a"), ("c", "t1_a"), ("d", "t1_c"), ("e", "t1_d"), ("f", "t1_d"), ("g", "t1_b"), ("x", "t3_p"), ("y", "t1_x")]
    spark.createDataFrame(data, "comment_id string, parent_id string").write.parquet(str(tmp_path / "comments.parquet"))
    return str(tmp_path)


def test_descendants_below_a_circle(spark, comments, rows):
    want = [("c", "d", 1), ("c", "e", 2), ("c", "f", 2), ("d", "e", 1), ("d", "f", 1), ("x", "y", 1)]
    assert rows(problem_queries.p2_descendants(spark, comments), "ancestor", "descendant", "distance") == want
    got = {r.comment_id: r.n_descendants for r in problem_queries.p2_hierarchy(spark, comments).collect()}
    assert got == {"a": None, "b": None, "c": 3, "d": 2, "e": 0, "f": 0, "g": 0, "x": 1, "y": 0}


def test_author_history_warm_up(spark):
    columns = list(dict.fromkeys([*threads.BOND, *threads.IDENTITY]))
    values = {f"2022-{m:02d}": 100.0 if m <= 6 else float(m) for m in range(1, 13)}  # the first six months would spoil the reference
    df = spark.createDataFrame([("s", m, *[v] * len(columns)) for m, v in values.items()], ", ".join(["subreddit string", "month string", *[f"{c} double" for c in columns]]))
    got = {r.month: r for r in threads.interaction_indices(df, core_queries.WARM_UP, "2022-11").collect()}
    assert [got[m].author_history_observed for m in sorted(got)] == [0] * 6 + [1] * 6
    assert got["2022-12"].bond_index == pytest.approx(4 * (12 - 8.5) / 1.25**0.5)


@pytest.fixture
def made_interactions(spark, monkeypatch):
    """Sixteen months of eight communities whose measures are partly negative; the first two are warm-up."""
    months = [f"2022-{m:02d}" for m in range(5, 13)] + [f"2023-{m:02d}" for m in range(1, 9)]
    names = core_queries.INTERACTION_OUTCOMES
    value = lambda k, m, j: float((7 * k + 5 * m * (j + 1) + k * m * m) % 11 - 5 + (3 if k < 4 and m >= 7 else 0))
    data = [(f"c{k}", t, int(m >= 2), *[value(k, m, j) for j in range(len(names))]) for k in range(8) for m, t in enumerate(months)]
    cells = spark.createDataFrame(data, ", ".join(["subreddit string", "month string", "author_history_observed int", *[f"{n} double" for n in names]]))
    stored = spark.createDataFrame([(r[0], r[1], "health" if r[0] < "c4" else "general", 10, 2) for r in data], "subreddit string, month string, community_type string, comments long, submissions long")
    monkeypatch.setattr(core_queries, "interactions", lambda *_: cells)
    monkeypatch.setattr(core_queries.a, "stored_panel", lambda *_: stored)
    return cells.join(stored, ["subreddit", "month"]).where("author_history_observed = 1")


def test_interaction_pretrend(spark, made_interactions):
    got = core_queries.interaction_pretrend(spark, "").collect()
    tests = {r.outcome_name: r for r in got if r.kind == "pretrend"}
    studies = {(r.outcome_name, r.event_bin): r for r in got if r.kind == "event_study"}
    bins = {-5, -4, -3, -2, 0, 1, 2, 3, 4, 5, 6, 7, 8}
    assert set(tests) == set(core_queries.INTERACTION_OUTCOMES) and {r.n_leads for r in tests.values()} == {4}
    assert set(studies) == {(o, b) for o in core_queries.INTERACTION_OUTCOMES for b in bins}
    # without log an estimate is the difference of the groups' changes since bin -2 in the values as they are, negative ones too
    mean = {(r.health, r.time_index): r.m for r in models.analysis_frame(made_interactions, "bond_index", log=False).groupBy("health", "time_index").agg({"raw_outcome": "avg"}).withColumnRenamed("avg(raw_outcome)", "m").collect()}
    for b in bins:
        want = mean[1, b] - mean[0, b] - mean[1, -2] + mean[0, -2]
        assert studies["bond_index", b].estimate == pytest.approx(want, abs=1e-5)


def test_interaction_outcomes(spark, made_interactions):
    got = core_queries.interaction_outcomes(spark, "").collect()
    specs = {"unweighted", "community_specific_trends"}
    assert {(r.outcome_name, r.model) for r in got} == {(o, m) for o in core_queries.INTERACTION_OUTCOMES for m in specs} and len(got) == 20
    assert {(r.n_obs, r.n_months) for r in got} == {(8 * 13, 13)}  # without the warm-up and the transition month
    for model in specs:
        fits = sorted((r for r in got if r.model == model), key=lambda r: r.p_value)
        assert fits[0].q_value == pytest.approx(min(1.0, min(r.p_value * 10 / (k + 1) for k, r in enumerate(fits))))


REFERENCE_MODERATORS = """top5_share top1_share gini hhi pct1_share threading_ratio mean_depth
reply_rate unanswered_rate op_followup_rate median_latency_hours""".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_moderators(spark):
    assert core_queries.a.MODERATORS == REFERENCE_MODERATORS
    cells = core_queries.moderators(spark, DATA).cache()
    assert cells.count() == core_queries.a.stored_panel(spark, DATA).count()
    assert all(v for v in cells.agg(*[F.max(c) for c in REFERENCE_MODERATORS]).first())
    fits = models.moderation(core_queries.a.stored_panel(spark, DATA), cells, core_queries.a.MODERATORS).collect()
    assert len({(r.outcome_name, r.moderator, r.model) for r in fits}) == 66


def test_newcomer_return_and_summary(spark):
    data = [("s", "2022-01", "a"), ("s", "2022-01", "b"), ("s", "2022-02", "a"), ("s", "2022-02", "c"), ("s", "2022-03", "a"), ("s", "2022-04", "b")]
    got = {r.idx % 12 + 1: r for r in capacity.contributors(spark.createDataFrame(data, "subreddit string, month string, author string")).collect()}
    assert [(got[1][f"newcomer_return_{h}m"], got[2][f"newcomer_return_{h}m"]) for h in (1, 3, 6)] == [(0.5, 0.0), (0.5, 0.0), (0.0, 0.0)]
    assert (got[2].contributor_return_1m, got[3].newcomer_return_1m) == (0.5, 0.0)  # nobody is new in March
    columns = capacity.SUMMARISED
    monthly = spark.createDataFrame([("s", m, *[float(k + j) for j in range(len(columns))]) for k, m in enumerate(("2022-09", "2022-10", "2022-11"))], ", ".join(["subreddit string", "month string", *[f"{c} double" for c in columns]]))
    r = capacity.capacity_summary(monthly, F.lit("health")).first()
    assert len(columns) == 16 and [r[f"mean_{c}"] for c in columns] == [j + 0.5 for j in range(16)]


def test_text_length_shares(spark):
    df = spark.createDataFrame([("a", "x" * n) for n in (19, 20, 500, 501)], "k string, text string")
    r = content.text_metrics(df, ["k"], F.col("text")).first()
    assert (r.very_short_share, r.long_share) == (0.25, 0.25)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_growth_and_key_results(spark, monkeypatch):
    cells = core_queries.interactions(spark, DATA).cache()
    monkeypatch.setattr(core_queries, "interactions", lambda *_: cells)
    profiles = core_queries.growth_terciles(spark, DATA).cache()
    wanted = {"submission_growth", "pre_threading_ratio", "pre_gini", "pre_top5_share", "pre_bond_index", "pre_identity_index", "pre_reciprocal_dyad_share"}
    assert wanted <= set(profiles.columns) and profiles.where("pre_gini > 0").count() > 0
    monkeypatch.setattr(core_queries, "growth", lambda *_: profiles)
    summary = core_queries.growth_summary(spark, DATA).collect()
    assert {r.growth_group for r in summary} == {"declining", "stable", "growing"} and sum(r.communities for r in summary) == profiles.count()
    got = {(r.section, r.measure) for r in core_queries.key_results(spark, DATA).where("period = 'all'").collect()}
    assert {("panel", m) for m in ("n_communities", "n_months", "total_comments", "total_submissions")} | {("interactions", m) for m in ("bond_index", "identity_index")} <= got
    assert {("did", f"{o}_estimate") for o in models.OUTCOMES} | {("responsiveness", "unanswered_rate"), ("mentions", "comment_mention_share"), ("mentions", "submission_mention_share")} <= got


def test_every_tie_counts(spark, monkeypatch):
    monkeypatch.setattr(resilience, "COMMUNITY_ROWS", 1, raising=False)
    df = spark.createDataFrame([(f"c{k:02d}", float(k), float(k * 7 % 20 // 4)) for k in range(20)], "subreddit string, x double, y double")
    u = resilience.mann_whitney(resilience.median_split(df, "x"), "group", "y").first()
    got = {r.test: r.p_value for r in resilience.statistics(df, "x", "y").collect()}
    assert got["mann_whitney_u"] == pytest.approx(stats.mann_whitney_p(u.u, 10, 10, [4] * 5), rel=1e-12)
