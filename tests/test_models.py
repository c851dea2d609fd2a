from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwork.models import linear as L
from strandwork.models import stats as S


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    ids, times = np.repeat(np.arange(40), 12), np.tile(np.arange(12), 40)
    x = rng.normal(size=480) + ids / 20
    d = ((ids % 2) * (times >= 6)).astype(float)
    y = 1.5 * x - 0.7 * d + ids * 0.1 + times * 0.3 + rng.normal(size=480)
    frame = pd.DataFrame({"g": ids, "t": times, "x": x, "d": d, "y": y, "n": rng.poisson(np.exp(0.2 + 0.3 * d)), "b": (rng.random(480) < 1 / (1 + np.exp(-(0.3 * x - 0.2)))).astype(int)})
    return frame, spark.createDataFrame(frame)


def test_least_squares_with_robust_and_clustered_errors(panel):
    frame, df = panel
    x = np.column_stack([np.ones(len(frame)), frame.x, frame.d])
    y = frame.y.to_numpy()
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    e = y - x @ beta
    n, k = x.shape
    hc1 = bread @ (x * e[:, None] ** 2).T @ x @ bread * n / (n - k)
    fit = L.ols(df, "y", ["x", "d"])
    assert np.allclose(fit.beta, beta) and np.allclose(fit.cov, hc1)
    s = np.array([(x[frame.g == g] * e[frame.g == g][:, None]).sum(0) for g in range(40)])
    assert np.allclose(L.ols(df, "y", ["x", "d"], cluster="g").cov, bread @ s.T @ s @ bread * 40 / 39 * (n - 1) / (n - k))
    assert math.isclose(fit.extra["r2"], 1 - e @ e / ((y - y.mean()) ** 2).sum())


def test_fixed_effects_as_dummies(panel):
    frame, df = panel
    fit = L.fixed_effects(df, "y", ["x", "d"], ["g", "t"], "g")
    dummies = np.column_stack([frame.x, frame.d, pd.get_dummies(frame.g).to_numpy(float), pd.get_dummies(frame.t).to_numpy(float)[:, 1:]])
    beta = np.linalg.lstsq(dummies, frame.y.to_numpy(), rcond=None)[0]
    assert np.allclose(fit.beta, beta[:2], atol=1e-6) and fit.extra["clusters"] == 40


def test_fixed_effects_by_sweeps_and_other_clusters(panel):
    frame, df = panel
    odd = df.filter("(g + t) % 5 != 0")  # unbalanced
    for cluster in ("g", "t", "b"):
        exact = L.fixed_effects(odd, "y", ["x", "d"], ["g", "t"], cluster)
        swept = L.fixed_effects(odd, "y", ["x", "d"], ["g", "t"], cluster, max_levels=1)
        assert np.allclose(exact.beta, swept.beta, atol=1e-8) and np.allclose(exact.cov, swept.cov, rtol=1e-5)
    three = odd.selectExpr("*", "g % 7 * t % 3 as h")
    f = three.toPandas()
    dummies = np.column_stack([f.x, f.d, *[pd.get_dummies(f[e]).to_numpy(float) for e in ("g", "t", "h")]])
    beta = np.linalg.lstsq(dummies, f.y.to_numpy(), rcond=None)[0]
    assert np.allclose(L.fixed_effects(three, "y", ["x", "d"], ["g", "t", "h"], "g").beta, beta[:2], atol=1e-8)
    with pytest.raises(RuntimeError):
        L.within(odd, ["y"], ["g", "t"], sweeps=1)


def test_newton_on_the_cluster_as_on_the_driver(panel, monkeypatch):
    frame, df = panel
    for family, y in (("poisson", "n"), ("logit", "b")):
        here = L.newton(df, y, ["x", "d"], family)
        monkeypatch.setattr(L, "LOCAL_DESIGNS", 0)
        there = L.newton(df, y, ["x", "d"], family)
        monkeypatch.undo()
        assert np.allclose(here.beta, there.beta, atol=1e-9) and np.allclose(here.cov, there.cov, rtol=1e-7)
        assert math.isclose(here.extra.get("dispersion", 1), there.extra.get("dispersion", 1), rel_tol=1e-7)
        with pytest.raises(RuntimeError):
            L.newton(df, y, ["x", "d"], family, rounds=1)


def test_newton_models(panel):
    frame, df = panel
    for family, y, xs in (("poisson", "n", ["d"]), ("logit", "b", ["x"])):
        fit = L.newton(df, y, xs, family)
        x = np.column_stack([np.ones(len(frame)), frame[xs[0]]])
        beta = np.zeros(2)
        for _ in range(60):
            mu = np.exp(x @ beta) if family == "poisson" else 1 / (1 + np.exp(-x @ beta))
            w = mu if family == "poisson" else mu * (1 - mu)
            beta += np.linalg.solve((x * w[:, None]).T @ x, x.T @ (frame[y].to_numpy() - mu))
        assert np.allclose(fit.beta, beta, atol=1e-7)
    with pytest.raises(ValueError):
        L.newton(df.filter("n = 0"), "n", ["x"], "poisson")


def test_lagged_errors_and_contrasts():
    rng = np.random.default_rng(1)
    x, names = L.its_design(60, 30)
    y = x @ np.array([2.0, 0.1, 3.0, -0.2]) + rng.normal(size=60)
    fit = L.ols_hac(x, y, names, 3)
    e = y - x @ fit.beta
    s = x * e[:, None]
    meat = sum((1 - abs(a - b) / 4) * np.outer(s[a], s[b]) for a in range(60) for b in range(60) if abs(a - b) <= 3)
    bread = np.linalg.inv(x.T @ x)
    assert np.allclose(fit.cov, bread @ meat @ bread)
    assert np.allclose(L.ols_hac(x, y, names, 12).beta, fit.beta)
    estimate, se = fit.combine({"post": 1, "time_after": 6})
    assert math.isclose(estimate, fit.beta[2] + 6 * fit.beta[3]) and se > 0
    w, df, p = fit.wald(["post"])
    assert df == 1 and math.isclose(w, (fit.beta[2] / fit.se[2]) ** 2) and math.isclose(p, S.normal_p(fit.beta[2], fit.se[2]), abs_tol=1e-12)
    assert abs(L.prais_winsten(x, y, names).extra["rho"]) <= 0.95
    with pytest.raises(np.linalg.LinAlgError):
        L.ols_hac(np.ones((10, 2)), np.ones(10), ["a", "b"])


def test_probabilities():
    assert math.isclose(S.chi2_tail(16.166159, 7), 0.023641, abs_tol=2e-6)
    assert math.isclose(S.chi2_tail(19.7805, 2), math.exp(-19.7805 / 2), rel_tol=1e-12)
    assert abs(S.chi2_tail(20, 10) - S.chi2_tail_cube_root(20, 10)) < 1e-3
    assert math.isclose(S.fisher_two_sided(3, 1, 1, 3), 0.4857142857, abs_tol=1e-9)
    assert math.isnan(S.normal_p(1, 0))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 30), st.integers(0, 30), st.integers(0, 30), st.integers(0, 30))
def test_fisher_against_all_tables(a, b, c, d):
    n, r, k = a + b + c + d, a + b, a + c
    if not n:
        return
    p = {x: math.comb(r, x) * math.comb(n - r, k - x) / math.comb(n, k) for x in range(max(0, k - (n - r)), min(r, k) + 1)}
    assert math.isclose(S.fisher_two_sided(a, b, c, d), min(1, sum(v for v in p.values() if v <= p[a] + 1e-12)), abs_tol=1e-9)


def test_bootstrap_covers_and_repeats(spark):
    from pyspark.sql import functions as F

    df = spark.range(400).select(F.col("id").alias("g"), (F.col("id") % 10).cast("double").alias("v"))
    run = lambda d: sorted(tuple(r) for r in L.cluster_bootstrap(d, "g", lambda x: [(F.sum(x.w * x.v) / F.sum("w")).alias("m")], 40).collect())
    first = run(df)
    assert [(r, round(m, 9)) for r, m in first] == [(r, round(m, 9)) for r, m in run(df.repartition(7))]
    means = [m for _, m in first]
    assert 3.9 < min(means) < 4.5 < max(means) < 5.1
