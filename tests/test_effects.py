"""Fits from cross products against a dense design with a pseudo-inverse."""

import random

import numpy as np
import pandas as pd
import pytest

from threadloom.functions.stats import chi2_sf
from threadloom.operators import effects, models


def dense(y, treatments, units, months, weights=None, time=None):
    """(coefficients, covariance clustered by unit): [treatments, 1, unit and month dummies without the first, unit trends]."""
    dummies = lambda v: np.eye(len(set(v)))[pd.factorize(pd.Series(list(v)), sort=True)[0]]
    unit = dummies(units)
    parts = [treatments, np.ones((len(y), 1)), unit[:, 1:], dummies(months)[:, 1:]]
    if time is not None:
        parts.append(unit * np.asarray(time, float)[:, None])
    x = np.hstack(parts)
    root = np.sqrt(np.ones(len(y)) if weights is None else weights)
    xw, yw = x * root[:, None], y * root
    bread = np.linalg.pinv(xw.T @ xw, rcond=1e-12)
    beta = bread @ xw.T @ yw
    scores = unit.T @ (xw * (yw - xw @ beta)[:, None])
    n, k, g = len(y), x.shape[1], unit.shape[1]
    t = treatments.shape[1]
    return beta[:t], (bread @ scores.T @ scores @ bread * (g / max(1, g - 1) * (n - 1) / max(1, n - k)))[:t, :t]


@pytest.fixture(params=["a_general", "z_general"])
def panel(request, spark):
    """An unbalanced panel; the first community in order is general in one case and health in the other."""
    rng = random.Random(3)
    months = [f"2022-{m:02d}" for m in range(4, 13)] + [f"2023-{m:02d}" for m in range(1, 7)]
    kinds = {f"{'a' if (k < 5) == (request.param == 'a_general') else 'z'}{k}": "general" if k < 5 else "health" for k in range(11)}
    rows = [(s, m, kind, rng.randrange(5, 400), rng.randrange(0, 40)) for s, kind in kinds.items() for m in months if s[1] in '1267' or rng.random() < 0.85]
    rows += [("other", m, "other", 5, 1) for m in months]
    return spark.createDataFrame(rows, "subreddit string, month string, community_type string, comments long, submissions long")


def frame(panel, spec, outcome="comments"):
    return models.analysis_frame(panel, outcome, spec).toPandas()


@pytest.mark.parametrize("spec", [models.SPECS[k] for k in (0, 1, 2, 3, 4, 5, 6, 7, 10)], ids=lambda s: s.name)
def test_twfe_agrees_with_dense_design(panel, spec):
    got = models.twfe_did(panel, ["comments"], [spec]).first()
    pdf = frame(panel, spec)
    beta, cov = dense(pdf["outcome"].to_numpy(), pdf[["health_post"]].to_numpy(float), pdf["subreddit"], pdf["month"], pdf["weight"].to_numpy(float), pdf["time_index"] if spec.trends else None)
    assert (got.n_obs, got.n_communities, got.n_months) == (len(pdf), pdf["subreddit"].nunique(), pdf["month"].nunique())
    assert got.estimate == pytest.approx(beta[0], rel=1e-6, abs=1e-9) and got.std_error == pytest.approx(cov[0, 0] ** 0.5, rel=1e-6)


def bins_of(pdf, reference):
    event = pdf["time_index"].clip(-6, 24)
    bins = sorted(b for b in set(event) if b != reference)
    return bins, np.stack([(event == b) * pdf["health"] for b in bins], axis=1).astype(float)


def test_event_study_and_pretrend_agree_with_dense_design(panel):
    pdf = frame(panel, models.Spec("e"))
    bins, x = bins_of(pdf, -2)
    beta, cov = dense(pdf["outcome"].to_numpy(), x, pdf["subreddit"], pdf["month"])
    got = {r.event_bin: r for r in models.event_study(panel, ["comments"]).collect()}
    assert set(got) == {*bins, -2} and got[-2].estimate == 0.0
    for k, b in enumerate(bins):
        assert got[b].estimate == pytest.approx(beta[k], rel=1e-6, abs=1e-9) and got[b].std_error == pytest.approx(cov[k, k] ** 0.5, rel=1e-6)
    for reference in (-1, -2):
        bins, x = bins_of(pdf, reference)
        leads = [k for k, b in enumerate(bins) if b < -1]
        beta, cov = dense(pdf["outcome"].to_numpy(), x, pdf["subreddit"], pdf["month"])
        want = beta[leads] @ np.linalg.pinv(cov[np.ix_(leads, leads)]) @ beta[leads]
        test = models.pretrend_test(panel, ["comments"], reference=reference).first()
        assert test.n_leads == len(leads) and test.statistic == pytest.approx(want, rel=1e-5)
        assert test.p_value == pytest.approx(chi2_sf(want, len(leads)), rel=1e-4, abs=1e-12)


def test_leave_one_out_agrees_with_dense_design(panel, monkeypatch):
    pdf = frame(panel, models.Spec("u"))
    for a_pass in (effects.OMITTED_A_PASS, 4):
        monkeypatch.setattr(effects, "OMITTED_A_PASS", a_pass)
        got = {r.omitted: r for r in models.leave_one_out(panel).collect()}
        assert set(got) == set(pdf["subreddit"])
        for name, r in got.items():
            part = pdf[pdf["subreddit"] != name]
            beta, cov = dense(part["outcome"].to_numpy(), part[["health_post"]].to_numpy(float), part["subreddit"], part["month"])
            assert r.estimate == pytest.approx(beta[0], rel=1e-6) and r.std_error == pytest.approx(cov[0, 0] ** 0.5, rel=1e-6)


def test_moderation_agrees_with_dense_design(spark, panel):
    names = [r.subreddit for r in panel.select("subreddit").distinct().collect()]
    monthly = spark.createDataFrame([(s, "2022-05", float((7 * k) % 5 + 1)) for k, s in enumerate(sorted(names)) if k != 2], "subreddit string, month string, m double")
    value = {r.subreddit: r.m for r in monthly.collect()}
    pdf = panel.where("community_type <> 'other'").toPandas()
    h, p, m = (pdf["community_type"] == "health").astype(float), (pdf["month"] >= models.CUTOFF).astype(float), pdf["subreddit"].map(value).fillna(0.0)
    y = np.log1p(pdf["comments"].to_numpy(float))
    got = {r.model: r for r in models.moderation(panel, monthly, ["m"], ["comments"]).collect()}
    beta, cov = dense(y, np.stack([h * p * m, h * p, p * m], axis=1), pdf["subreddit"], pdf["month"])
    assert got["triple_interaction"].estimate == pytest.approx(beta[0], rel=1e-6) and got["triple_interaction"].std_error == pytest.approx(cov[0, 0] ** 0.5, rel=1e-6)
    part = (h == 1).to_numpy()
    beta, cov = dense(y[part], (p * m).to_numpy()[part, None], pdf["subreddit"][part], pdf["month"][part])
    assert got["within_health"].estimate == pytest.approx(beta[0], rel=1e-6) and got["within_health"].std_error == pytest.approx(cov[0, 0] ** 0.5, rel=1e-6)


def test_matching_in_passes(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(f"c{k:02d}", int(k < 8), *[rng.choice([0.0, 1.0, 2.0]) for _ in models.FEATURES]) for k in range(40)]
    df = spark.createDataFrame(rows, "subreddit string, health int, " + ", ".join(f"{c} double" for c in models.FEATURES))
    want = {r[0]: min((round(sum((a - b) ** 2 for a, b in zip(r[2:], g[2:])), 12), g[0]) for g in rows if not g[1])[1] for r in rows if r[1]}
    for a_pass in (models.MATCHED_COMMUNITIES, 5):
        monkeypatch.setattr(models, "MATCHED_COMMUNITIES", a_pass)
        assert {r.subreddit: r.matched for r in models.nearest_matches(df).collect()} == want


def test_empty_panel(spark, panel):
    none = panel.limit(0)
    assert models.twfe_did(none, ["comments"]).count() == 0 and models.leave_one_out(none).count() == 0 and models.event_study(none, ["comments"]).count() == 0
