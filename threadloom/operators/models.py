"""Difference-in-differences on the community-month panel.

The panel is read once; one plan makes the rows of all outcomes and specifications, and
``effects`` fits them from cross products per community.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.columns import month_index
from threadloom.functions.stats import chi2_sf, normal_two_sided
from threadloom.operators.panel import exact_quantiles
from threadloom.operators.effects import Fit, fit_models, omitting_each
from threadloom.session import Scratch

TRANSITION = "2022-11"
CUTOFF = "2022-12"
MATCHED_COMMUNITIES = 100_000  # general communities whose four features are held at once when matching; more take more passes


@dataclass(frozen=True)
class Spec:
    """One specification of the panel model."""

    name: str
    cutoff: str = CUTOFF
    balanced: bool = False
    without_top_general: int = 0
    winsorized: bool = False
    matched: bool = False
    weighted: bool = False
    trends: bool = False
    omit: str | None = None


# The specifications every outcome is estimated with.
SPECS = (
    Spec("unweighted"), Spec("weighted_pre_activity", weighted=True), Spec("balanced_panel", balanced=True), Spec("exclude_top2_general", without_top_general=2),
    Spec("winsorized_1_99", winsorized=True), Spec("community_specific_trends", trends=True), Spec("matched_pre_period", matched=True), Spec("cutoff_2023_01", cutoff="2023-01"),
    Spec("cutoff_2023_03", cutoff="2023-03"), Spec("cutoff_2023_07", cutoff="2023-07"), Spec("placebo_2022_05", cutoff="2022-05"), Spec("placebo_2022_08", cutoff="2022-08"),
)
OUTCOMES = ("comments", "submissions", "comments_per_submission")


def number(month: str) -> int:
    return int(month[:4]) * 12 + int(month[5:]) - 1


def balanced(panel: DataFrame) -> DataFrame:
    """Communities present in every month of the panel."""
    months = panel.select("month").distinct().agg(F.count(F.lit(1)).alias("n"))
    full = panel.groupBy("subreddit").agg(F.count_distinct("month").alias("n")).where(F.col("n") == months.scalar())
    return panel.join(full.select("subreddit"), "subreddit", "left_semi")


def without_top_general(panel: DataFrame, cutoff: str = CUTOFF, k: int = 2) -> DataFrame:
    """Without the k general communities with most comments before the cutoff; ties by name."""
    rows = panel.where((F.col("community_type") == "general") & (F.col("month") < cutoff))
    top = rows.groupBy("subreddit").agg(F.sum("comments").alias("n")).orderBy(F.desc("n"), "subreddit").limit(k)
    return panel.join(top.select("subreddit"), "subreddit", "left_anti")


def winsorized(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> Column:
    """The column held between two interpolated percentiles of itself."""
    ends = exact_quantiles(df.select(F.lit(0).alias("one"), F.col(column).alias("value")), ["one"], {"a": low, "b": high})
    return F.greatest(ends.select("a").scalar(), F.least(ends.select("b").scalar(), F.col(column)))


def analysis_frame(panel: DataFrame, outcome: str, spec: Spec = Spec("unweighted"), log: bool = True) -> DataFrame:
    """Rows of general and health communities, ready for a model of one outcome.

    ``panel`` has subreddit, month, community_type, comments, submissions and the outcome.  Adds
    health, post, health_post, time_index, raw_outcome, outcome and weight (1 unless the spec weights).
    """
    rows = panel.where(F.col("community_type").isin("general", "health") & (F.col("month") != TRANSITION))
    if spec.balanced:
        rows = balanced(rows)
    if spec.without_top_general:
        rows = without_top_general(rows, spec.cutoff, spec.without_top_general)
    if spec.omit is not None:
        rows = rows.where(F.col("subreddit") != spec.omit)
    rows = rows.withColumn("raw_outcome", F.coalesce(F.col(outcome).cast("double"), F.lit(0.0)))
    if spec.winsorized:
        rows = rows.withColumn("raw_outcome", winsorized(rows, "raw_outcome"))
    health, post = (F.col("community_type") == "health").cast("int"), (F.col("month") >= spec.cutoff).cast("int")
    rows = rows.withColumns({
        "health": health, "post": post, "health_post": health * post, "time_index": month_index(F.col("month")) - number(spec.cutoff),
        "outcome": F.log1p(F.greatest(F.col("raw_outcome"), F.lit(0.0))) if log else F.col("raw_outcome"),
    })
    weight = F.lit(1.0)
    if spec.weighted:
        before = F.when(F.col("month") < spec.cutoff, F.coalesce("comments", F.lit(0)) + F.coalesce("submissions", F.lit(0)))
        weight = F.greatest(F.lit(1.0), F.coalesce(F.sum(before).over(Window.partitionBy("subreddit")), F.lit(0)).cast("double"))
    rows = rows.withColumn("weight", weight)
    if spec.matched:
        counts = nearest_matches(pre_features(rows, spec.cutoff)).groupBy(F.col("matched").alias("subreddit")).agg(F.count(F.lit(1)).cast("double").alias("times"))
        rows = rows.join(counts, "subreddit", "left").withColumn("weight", F.when(F.col("health") == 1, 1.0).otherwise(F.coalesce("times", F.lit(0.0)))).drop("times").where("weight > 0")
    return rows.select("subreddit", "month", "health", "post", "health_post", "time_index", "raw_outcome", "outcome", "weight")


FEATURES = ["outcome_mean", "outcome_slope", "outcome_std", "engagement_mean"]


def pre_features(rows: DataFrame, cutoff: str, by: Sequence[str] = ()) -> DataFrame:
    """Per community before the cutoff: mean, slope and spread of the outcome, mean engagement, all standardised over communities."""
    engagement = F.col("comments_per_submission") if "comments_per_submission" in rows.columns else F.lit(0.0)
    y, x = F.col("raw_outcome"), F.col("time_index").cast("double")
    per = rows.where(F.col("month") < cutoff).groupBy(*by, "subreddit", "health").agg(
        F.avg(y).alias("outcome_mean"), F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("outcome_slope"), F.stddev_pop(y).alias("outcome_std"), F.avg(engagement).alias("engagement_mean")
    )
    per = Scratch(rows.sparkSession).save(per, "communities")  # one row per community
    stats = per.groupBy(*by).agg(*[s for c in FEATURES for s in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    joined = per.join(stats, list(by)) if by else per.crossJoin(F.broadcast(stats))  # one row of statistics
    scaled = [((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)).alias(c) for c in FEATURES]
    return joined.select(*by, "subreddit", "health", *scaled)


def nearest_matches(features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, subreddit, matched, distance``: for each health community the nearest general one of its group, ties by name.

    The general communities' features, four numbers each, are broadcast in passes of a fixed number;
    health communities are compared with them in blocks, and the nearest of all passes counts.
    """
    spark, by = features.sparkSession, list(by)
    features = Scratch(spark).save(features.select(*by, "subreddit", "health", *FEATURES), "features")
    kinds = ", ".join(f"{c} {dict(features.dtypes)[c]}" for c in by)
    schema = f"{kinds + ', ' if kinds else ''}subreddit string, square double, matched string"

    def compare(block: list) -> DataFrame:
        groups: dict[tuple, list] = {}
        for r in block:
            groups.setdefault(tuple(r[c] for c in by), []).append(r)
        shared = spark.sparkContext.broadcast({k: ([r.subreddit for r in rows], np.array([[r[c] for c in FEATURES] for r in rows], dtype=float)) for k, rows in groups.items()})

        def run(batches):
            for batch in batches:
                out = []
                for row in batch.itertuples(index=False):
                    key = tuple(getattr(row, c) for c in by)
                    if key in shared.value:
                        names, known = shared.value[key]
                        gaps = sum((known[:, k] - getattr(row, c)) ** 2 for k, c in enumerate(FEATURES))
                        best = int(np.round(gaps, 12).argmin())
                        out.append((*key, row.subreddit, float(gaps[best]), names[best]))
                yield pd.DataFrame(out, columns=[*by, "subreddit", "square", "matched"])

        return features.where("health = 1").mapInPandas(run, schema)

    parts, block = [], []
    for row in features.where("health = 0").orderBy(*by, "subreddit").toLocalIterator():
        block.append(row)
        if len(block) == MATCHED_COMMUNITIES:
            parts.append(Scratch(spark).save(compare(block), "nearest"))
            block = []
    if block or not parts:
        parts.append(compare(block))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    best = whole.groupBy(*by, "subreddit").agg(F.min(F.struct(F.round("square", 12).alias("place"), "matched", "square")).alias("m"))
    return best.select(*by, "subreddit", "m.matched", F.sqrt("m.square").alias("distance"))


def balance(panel: DataFrame, outcome: str, cutoff: str = CUTOFF) -> DataFrame:
    """Standardised mean differences of the pre-period between health and general rows, unmatched and matched."""
    parts = []
    for name, spec in (("unmatched", Spec("u", cutoff)), ("matched", Spec("m", cutoff, matched=True))):
        rows = analysis_frame(panel, outcome, spec).where(F.col("month") < cutoff)
        mean = lambda h: F.try_divide(F.sum(F.when(F.col("health") == h, F.col("raw_outcome") * F.col("weight"))), F.sum(F.when(F.col("health") == h, F.col("weight"))))
        stats = rows.agg(mean(1).alias("health_mean"), mean(0).alias("general_mean"), F.stddev_pop("raw_outcome").alias("spread"))
        parts.append(stats.select(F.lit(name).alias("sample"), "health_mean", "general_mean", F.coalesce(F.try_divide(F.col("health_mean") - F.col("general_mean"), F.col("spread")), F.lit(0.0)).alias("smd")))
    return parts[0].unionByName(parts[1])


def did_2x2(frame: DataFrame) -> DataFrame:
    """The four cell means and their double difference."""
    mean = lambda h, p: F.avg(F.when((F.col("health") == h) & (F.col("post") == p), F.col("outcome")))
    out = frame.agg(mean(1, 1).alias("health_post"), mean(1, 0).alias("health_pre"), mean(0, 1).alias("general_post"), mean(0, 0).alias("general_pre"), F.count(F.lit(1)).alias("n_obs"))
    return out.withColumn("did", F.col("health_post") - F.col("health_pre") - F.col("general_post") + F.col("general_pre"))


def event_bin(time_index: Column) -> Column:
    return F.greatest(F.lit(-6), F.least(F.lit(24), time_index)).cast("int")


def summary_row(estimate: float, variance: float) -> tuple[float, float, float | None]:
    """(estimate, standard error, p-value); there is no p-value without an error."""
    error = math.sqrt(max(variance, 0.0))
    return float(estimate), error, normal_two_sided(estimate / error) if error > 0 else None


def model_rows(panel: DataFrame, outcomes: Sequence[str], specs: Sequence[Spec], log: bool) -> DataFrame:
    """The rows of every outcome and specification in one table: ``outcome_name, model`` and those of ``analysis_frame``.

    The panel is written once; what a specification needs to know of communities is one row each.
    """
    scratch = Scratch(panel.sparkSession)
    extra = [c for c in ("comments", "submissions", "comments_per_submission") if c in panel.columns]
    kept = panel.where(F.col("community_type").isin("general", "health") & (F.col("month") != TRANSITION))
    base = scratch.save(kept.select("subreddit", "month", "community_type", *dict.fromkeys([*extra, *outcomes])), "panel")
    health = (F.col("community_type") == "health").cast("int")

    def before(cutoff: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("month") < cutoff, value)), F.lit(0))

    weighted, topped = {s.cutoff for s in specs if s.weighted}, {s for s in specs if s.without_top_general}
    activity = F.coalesce("comments", F.lit(0)) + F.coalesce("submissions", F.lit(0)) if weighted else None
    facts = base.groupBy("subreddit", "community_type").agg(
        F.count_distinct("month").alias("n_months"), *[F.greatest(F.lit(1.0), before(c, activity).cast("double")).alias(f"activity_{c}") for c in sorted(weighted)],
        *[before(c, F.col("comments")).alias(f"volume_{c}") for c in sorted({s.cutoff for s in topped})],
    )
    facts = scratch.save(facts, "facts")
    for s in topped:
        top = facts.where(F.col("community_type") == "general").orderBy(F.desc(f"volume_{s.cutoff}"), "subreddit").limit(s.without_top_general)
        facts = facts.join(top.select("subreddit", F.lit(True).alias(f"top_{s.name}")), "subreddit", "left")
    n_months = base.agg(F.count_distinct("month").alias("n")).first().n

    values = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome_name"), F.coalesce(F.col(o).cast("double"), F.lit(0.0)).alias("raw_outcome")) for o in outcomes]))
    per_outcome = base.join(facts.drop("community_type"), "subreddit").select("*", values.alias("v")).select("*", "v.*").drop("v", *[o for o in outcomes if o not in extra])
    if any(s.winsorized for s in specs):
        bounds = exact_quantiles(per_outcome.select("outcome_name", F.col("raw_outcome").alias("value")), ["outcome_name"], {"low": 0.01, "high": 0.99})
        per_outcome = per_outcome.join(F.broadcast(bounds), "outcome_name")  # one row per outcome
    for s in specs:
        if s.matched:
            rows = per_outcome.withColumns({"health": health, "time_index": month_index(F.col("month")) - number(s.cutoff)})
            matches = nearest_matches(pre_features(rows, s.cutoff, ["outcome_name"]), ["outcome_name"])
            times = matches.groupBy("outcome_name", F.col("matched").alias("subreddit")).agg(F.count(F.lit(1)).cast("double").alias(f"times_{s.name}"))
            per_outcome = per_outcome.join(times, ["outcome_name", "subreddit"], "left")

    def frame(s: Spec) -> Column:
        keep, weight, raw = F.lit(True), F.lit(1.0), F.col("raw_outcome")
        if s.balanced:
            keep = keep & (F.col("n_months") == n_months)
        if s.without_top_general:
            keep = keep & F.col(f"top_{s.name}").isNull()
        if s.omit is not None:
            keep = keep & (F.col("subreddit") != s.omit)
        if s.winsorized:
            raw = F.greatest("low", F.least("high", raw))
        if s.weighted:
            weight = F.col(f"activity_{s.cutoff}")
        if s.matched:
            weight = F.when(health == 1, 1.0).otherwise(F.col(f"times_{s.name}"))
            keep = keep & weight.isNotNull()
        return F.when(keep, F.struct(F.lit(s.name).alias("model"), F.lit(s.trends).alias("trends"), (F.col("month") >= s.cutoff).cast("int").alias("post"), (month_index(F.col("month")) - number(s.cutoff)).alias("time_index"), raw.alias("raw"), weight.alias("weight")))

    rows = per_outcome.select("outcome_name", "subreddit", "month", health.alias("health"), F.explode(F.array(*[frame(s) for s in specs])).alias("s")).where("s is not null")
    outcome = F.log1p(F.greatest(F.col("s.raw"), F.lit(0.0))) if log else F.col("s.raw")
    return rows.select("outcome_name", "s.model", "subreddit", "month", "health", "s.post", "s.time_index", "s.weight", "s.trends", outcome.alias("outcome"))


def long_rows(rows: DataFrame, treatments: Column) -> DataFrame:
    """Rows as ``effects`` takes them."""
    numbers = [F.col("time_index").cast("double").alias("time"), F.col("outcome").alias("y"), F.col("weight").alias("w"), treatments.alias("x")]
    keys = [c for c in ("outcome_name", "model", "moderator", "trends") if c in rows.columns]
    return rows.select(*keys, "subreddit", month_index(F.col("month")).alias("at"), *numbers)


RESULT = "outcome_name string, model string, estimate double, std_error double, p_value double, n_obs long, n_communities long, n_months long"


def twfe_did(panel: DataFrame, outcomes: Sequence[str] = OUTCOMES, specs: Sequence[Spec] = SPECS, log: bool = True) -> DataFrame:
    """Two-way fixed-effects estimate of health x post for every outcome and specification, clustered by community."""
    rows = long_rows(model_rows(panel, outcomes, specs, log), F.array((F.col("health") * F.col("post")).cast("double")))

    def report(key: tuple, fit: Fit) -> list[tuple]:
        beta, cov = fit.effects([0])
        return [(*key, *summary_row(beta[0], cov[0, 0]), fit.n, fit.units, fit.n_months)]

    return fit_models(rows, ["outcome_name", "model"], 1, report, RESULT, F.col("trends"))


def leave_one_out(panel: DataFrame, outcome: str = "comments") -> DataFrame:
    """The baseline estimate without each community in turn; a row per omitted community."""
    rows = long_rows(model_rows(panel, [outcome], (Spec("unweighted"),), True), F.array((F.col("health") * F.col("post")).cast("double")))
    return omitting_each(rows, lambda name, estimate, variance: (name, *summary_row(estimate, variance)), "omitted string, estimate double, std_error double, p_value double")


FIRST_BIN, LAST_BIN = -6, 24
BINS = LAST_BIN - FIRST_BIN + 1


def event_rows(panel: DataFrame, outcomes: Sequence[str], spec: Spec, reference: int | None, log: bool) -> DataFrame:
    """Rows with a treatment per event bin but the reference, which stays an empty column; a second set counts the rows of each bin."""
    rows = model_rows(panel, outcomes, (spec,), log).withColumn("bin", event_bin(F.col("time_index")))
    bins = [k for k in range(FIRST_BIN, LAST_BIN + 1)]
    treatments = F.array(*[((F.col("bin") == k) & (F.lit(k) != F.lit(reference if reference is not None else FIRST_BIN - 1))).cast("double") * F.col("health") for k in bins])
    return long_rows(rows, treatments)


def bins_of(fit: Fit, cutoff: str, reference: int | None, first: int) -> list[int]:
    """Event bins with rows, without the reference."""
    seen = {max(FIRST_BIN, min(LAST_BIN, first + int(m) - number(cutoff))) for m in np.flatnonzero(fit.rows)}
    return sorted(b for b in seen if b != reference)


def event_study(panel: DataFrame, outcomes: Sequence[str] = OUTCOMES, cutoff: str = CUTOFF, weighted: bool = False, log: bool = True) -> DataFrame:
    """Estimates per event bin with 95 percent intervals; the reference is -2 at the default cutoff, whose -1 is left out, else -1."""
    reference = -2 if cutoff == CUTOFF else -1
    rows = event_rows(panel, outcomes, Spec("event_study", cutoff, weighted=weighted), reference, log)

    def report(key: tuple, fit: Fit) -> list[tuple]:
        bins = bins_of(fit, cutoff, reference, fit.month0)
        beta, cov = fit.effects([b - FIRST_BIN for b in bins])
        out = [(key[0], b, *summary_row(beta[k], cov[k, k])) for k, b in enumerate(bins)] + [(key[0], reference, 0.0, 0.0, None)]
        return [(*r, r[2] - 1.96 * r[3], r[2] + 1.96 * r[3]) for r in out]

    schema = "outcome_name string, event_bin int, estimate double, std_error double, p_value double, ci_low double, ci_high double"
    return fit_models(rows, ["outcome_name", "model"], BINS, report, schema)


def pretrend_test(panel: DataFrame, outcomes: Sequence[str] = OUTCOMES, cutoff: str = CUTOFF, reference: int | None = -1, log: bool = True) -> DataFrame:
    """Joint Wald test that the leads before -1 are zero.

    With the default reference -1, which is the excluded month at the default cutoff, the design has
    no reference bin, and the test is that of its least-norm solution; reference -2 gives the version
    with one.
    """
    rows = event_rows(panel, outcomes, Spec("pretrend", cutoff), reference, log)

    def report(key: tuple, fit: Fit) -> list[tuple]:
        present = bins_of(fit, cutoff, None, fit.month0)
        bins = [b for b in present if b != reference]
        leads = [k for k, b in enumerate(bins) if b < -1]
        statistic = p = None
        if leads:
            beta, cov = fit.effects([b - FIRST_BIN for b in bins], whole_bins=len(bins) == len(present))
            part = beta[leads]
            statistic = float(part @ np.linalg.pinv(cov[np.ix_(leads, leads)]) @ part)
            p = chi2_sf(statistic, len(leads))
        return [(key[0], len(leads), statistic, p)]

    schema = "outcome_name string, n_leads int, statistic double, p_value double"
    return fit_models(rows, ["outcome_name", "model"], BINS, report, schema, healthy=lambda row: any(row.x))


def moderation(panel: DataFrame, monthly: DataFrame, moderators: Sequence[str], outcomes: Sequence[str] = OUTCOMES, cutoff: str = CUTOFF) -> DataFrame:
    """Triple interaction and within-health models for every moderator.

    A moderator is a community's mean of a monthly measure before the cutoff; communities without it
    have 0.  The transition month stays in and belongs to the time before.
    """
    means = monthly.where(F.col("month") < cutoff).groupBy("subreddit").agg(*[F.avg(F.col(m).cast("double")).alias(f"m_{m}") for m in moderators])
    rows = panel.where(F.col("community_type").isin("general", "health")).join(means, "subreddit", "left")
    health, post = (F.col("community_type") == "health").cast("double"), (F.col("month") >= cutoff).cast("double")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("moderator"), F.coalesce(F.col(f"m_{m}"), F.lit(0.0)).alias("value")) for m in moderators]))
    values = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome_name"), F.log1p(F.greatest(F.coalesce(F.col(o).cast("double"), F.lit(0.0)), F.lit(0.0))).alias("outcome")) for o in outcomes]))
    rows = rows.select("subreddit", "month", health.alias("h"), post.alias("p"), pairs.alias("m"), *outcomes).select("*", values.alias("o"))
    h, p, m = F.col("h"), F.col("p"), F.col("m.value")
    model = F.explode(F.array(F.lit("triple_interaction"), F.when(h == 1, "within_health")))
    rows = rows.select("subreddit", "month", "h", "p", "m", "o.*", "m.moderator", model.alias("model")).where("model is not null")
    nothing = F.lit(0.0)
    within = F.col("model") == "within_health"
    treatments = F.array(F.when(within, p * m).otherwise(h * p * m), F.when(within, nothing).otherwise(h * p), F.when(within, nothing).otherwise(p * m))
    long = long_rows(rows.withColumns({"time_index": F.lit(0), "weight": F.lit(1.0)}), treatments)

    def report(key: tuple, fit: Fit) -> list[tuple]:
        beta, cov = fit.effects([0] if key[2] == "within_health" else [0, 1, 2])
        return [(*key, *summary_row(beta[0], cov[0, 0]), fit.n, fit.units)]

    schema = "outcome_name string, moderator string, model string, estimate double, std_error double, p_value double, n_obs long, n_communities long"
    return fit_models(long, ["outcome_name", "moderator", "model"], 3, report, schema)


def bh_fdr(df: DataFrame, p: str, within: Sequence[str] = (), name: str = "q_value") -> DataFrame:
    """Adds Benjamini-Hochberg q-values within groups; null p-values keep a null and do not count."""
    group = Window.partitionBy(*within, F.col(p).isNull() | F.isnan(p))
    rank = F.row_number().over(group.orderBy(p))
    raw = F.col(p) * F.count(F.lit(1)).over(group) / rank
    rows = df.withColumn("__raw", raw).withColumn("__rank", rank)
    least = F.min("__raw").over(group.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.when(F.col(p).isNotNull() & ~F.isnan(p), F.least(F.lit(1.0), least))).drop("__raw", "__rank")
