import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.stats import association as AS
from tidewell.stats import decision as D
from tidewell.stats import families as FA
from tidewell.stats import formula
from tidewell.stats import hypothesis as H
from tidewell.stats import linear as L
from tidewell.stats import meta as M
from tidewell.stats import models as MO
from tidewell.stats import special as sp
from tidewell.stats import survival as S
from tidewell.stats import timeseries as TS
from tidewell.stats.core import exact_median

near = lambda a, b, t=1e-8: np.allclose(a, b, rtol=t, atol=t)


@pytest.fixture(scope="module")
def xy(spark):
    g = np.random.default_rng(3)
    n = 400
    p = pd.DataFrame({"i": np.arange(n), "x1": g.normal(size=n), "x2": g.normal(2, 3, n), "g": np.array(list("abc"))[np.arange(n) % 3], "e": np.arange(n) % 20})
    p["y"] = 1 + 2 * p.x1 - 0.5 * p.x2 + g.normal(size=n)
    p["b"] = (g.random(n) < 1 / (1 + np.exp(-(0.3 + p.x1)))).astype(int)
    p["c"] = g.poisson(np.exp(0.2 + 0.4 * p.x1))
    p["t"] = g.exponential(np.exp(0.5 * p.x1)) + 0.01
    return p, spark.createDataFrame(p)


def test_distribution_functions():
    assert near(sp.t_two_sided(2.0, 10), 0.07338803477074, 1e-12) and near(sp.chi2_sf(3.84145882069412, 1), 0.05, 1e-10) and near(sp.f_sf(3.0, 2, 10), 1.6**-5, 1e-12)
    assert near(sp.t_quantile(0.975, 10), 2.22813885198627, 1e-9) and near(sp.chi2_quantile(0.95, 5), 11.0704976935164, 1e-9) and near(sp.f_quantile(0.95, 3, 20), 3.09839121214, 1e-7)
    assert near(sp.studentized_range_sf(3.877676, 3, 10), 0.05, 1e-4) and near(sp.beta_inc(2, 3, 0.4), 0.5248, 1e-12) and near(sp.noncentral_t_cdf(1.0, 10, 0.0), 1 - sp.t_sf(1.0, 10), 1e-6)
    assert near(FA.power_of("mean_difference", 64, effect_size=0.5), 0.8014596, 1e-4) and FA.sample_size("mean_difference", 0.8, effect_size=0.5) == 64
    for test, e in (("anova", {"groups": 3, "effect_size": 0.25}), ("regression", {"predictors": 2, "effect_size": 0.15}), ("chi_square", {"df": 2, "effect_size": 0.3}), ("logrank", {"hazard_ratio": 0.6, "event_fraction": 0.7})):
        n = FA.sample_size(test, 0.8, **e)
        assert FA.power_of(test, n, **e) >= 0.8 > FA.power_of(test, n - 1, **e)


def test_classical_tests_against_arrays(xy):
    p, df = xy
    a, b = p.y[p.g == "a"], p.y[p.g == "b"]
    r = H.t_independent(df, "y", "g", "a", "b")
    assert near(r["statistic"], (a.mean() - b.mean()) / math.sqrt(a.var() / len(a) + b.var() / len(b)))
    both = pd.concat([a, b]).rank()
    assert near(H.mann_whitney(df, "y", "g", "a", "b")["statistic"], both[a.index].sum() - len(a) * (len(a) + 1) / 2)
    ranks = p.y.rank()
    n = len(p)
    h = 12 / (n * (n + 1)) * sum(ranks[p.g == k].sum() ** 2 / (p.g == k).sum() for k in "abc") - 3 * (n + 1)
    assert near(H.kruskal_wallis(df, "y", "g")["statistic"], h)
    assert near(H.friedman(df, ["x1", "x2", "y"])["statistic"], 12 * (p[["x1", "x2", "y"]].rank(axis=1).sum() ** 2).sum() / (n * 12) - 3 * n * 4)
    assert near(H.binomial(df, "b", 0.5)["p_value"], min(1, sum(sp.binomial_pmf(k, n, 0.5) for k in range(n + 1) if sp.binomial_pmf(k, n, 0.5) <= sp.binomial_pmf(int(p.b.sum()), n, 0.5) * (1 + 1e-7))), 1e-6)
    s = sum(np.sign(p.y[j] - p.y[i]) for i in range(n) for j in range(i + 1, n))
    assert near(H.mann_kendall(df, "y", "i")["s"], s)
    assert near(H.fisher_exact([[3, 1], [1, 3]])["p_value"], 0.4857142857, 1e-8)
    few = df.where("i < 9").selectExpr("y - 0.5 as d")
    d = p.y[:9] - 0.5
    r = d.abs().rank()
    w = r[d > 0].sum()
    sums = [sum(v for v, bit in zip(r, f"{m:09b}") if bit == "1") for m in range(512)]
    assert near(H.wilcoxon(few, "d")["p_value"], np.mean([abs(s - r.sum() / 2) >= abs(w - r.sum() / 2) - 1e-9 for s in sums]))
    k, m = int(p.c.sum()), 1.2 * n
    pm = np.array([math.exp(j * math.log(m) - m - math.lgamma(j + 1)) for j in range(1500)])
    assert near(H.poisson_rate(df, "c", 1.2)["p_value"], pm[pm <= pm[k] * (1 + 1e-7)].sum(), 1e-6)
    with pytest.raises(Exception):  # noqa: B017
        H.t_one_sample(df.selectExpr("case when i = 3 then null else y end as y"), "y")


def test_association_against_arrays(xy):
    p, df = xy
    assert near(AS.pearson(df, "x1", "y")["coefficient"], p.x1.corr(p.y)) and near(AS.spearman(df, "x1", "y")["coefficient"], p.x1.rank().corr(p.y.rank()))
    c, n = p.c.to_numpy(), len(p)
    s = sum(np.sign(p.x1[j] - p.x1[i]) * np.sign(c[j] - c[i]) for i in range(n) for j in range(i + 1, n))
    t = np.unique(c, return_counts=True)[1]
    assert near(AS.kendall(df, "x1", "c")["coefficient"], s / math.sqrt(n * (n - 1) / 2 * (n * (n - 1) / 2 - (t * (t - 1) / 2).sum())))
    r = [p[v] - np.poly1d(np.polyfit(p.x2, p[v], 1))(p.x2) for v in ("x1", "y")]
    assert near(AS.partial(df, "x1", "y", ["x2"])["coefficient"], np.corrcoef(*r)[0, 1])


def ols(p, x, y="y"):
    X = np.column_stack([np.ones(len(p)), p[x]])
    b = np.linalg.lstsq(X, p[y], rcond=None)[0]
    return X, b, (p[y] - X @ b).to_numpy()


def test_least_squares_and_covariances(xy):
    p, df = xy
    X, b, e = ols(p, ["x1", "x2"])
    inv, n, k = np.linalg.inv(X.T @ X), *X.shape
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    want = {"nonrobust": inv * (e @ e / (n - k)), "hc0": inv @ (X.T * e**2) @ X @ inv, "hc3": inv @ (X.T * (e / (1 - h)) ** 2) @ X @ inv}
    u = np.array([X[p.e == g].T @ e[p.e == g] for g in range(20)])
    want["cluster"] = inv @ u.T @ u @ inv * 20 / 19 * (n - 1) / (n - k)
    for kind, cov in want.items():
        m = L.fit(df, "y", ["x1", "x2"], covariance=kind, clusters="e")
        assert near(m.beta, b) and near(m.covariance, cov), kind
    m = L.fit(df, "y", ["x1", "x2"])
    s = X * e[:, None]
    hac = s.T @ s + sum((1 - q / 5) * (s[q:].T @ s[:-q] + s[:-q].T @ s[q:]) for q in range(1, 5))
    assert near(L.fit(df, "y", ["x1", "x2"], covariance="hac", order="i").covariance, inv @ hac @ inv)
    i = L.influence(df, m).orderBy("i").toPandas()
    assert near(i["leverage"], h) and near(i["cooks_distance"], e**2 * h / (k * (e @ e / (n - k)) * (1 - h) ** 2))
    assert near(L.durbin_watson(df, L.residuals(df, m), ["i"])["statistic"], (np.diff(e) ** 2).sum() / (e @ e))
    w = L.solve_ls(df, "y", ["x1"], "t")["beta"]
    assert near(w, np.linalg.lstsq(np.column_stack([np.ones(n), p.x1]) * np.sqrt(p.t.to_numpy())[:, None], p.y * np.sqrt(p.t), rcond=None)[0])


def test_panels_anova_and_penalties(xy):
    p, df = xy
    d = p[["y", "x1", "e"]].copy()
    w = d[["y", "x1"]] - d.groupby("e")[["y", "x1"]].transform("mean")
    fe = L.panel(df, "y", ["x1"], "e")
    assert near(fe.beta, (w.x1 @ w.y) / (w.x1 @ w.x1))
    assert L.panel(df, "y", ["x1"], "e", method="re").extra["sigma_u2"] >= 0
    two = p.assign(t=p.i // 20)
    D2 = np.column_stack([two.x1, pd.get_dummies(two.e).to_numpy(float), pd.get_dummies(two.t).to_numpy(float)[:, 1:]])
    assert near(L.panel(df.withColumn("tt", (df.i / 20).cast("int")), "y", ["x1"], "e", "tt", "two_way").beta[0], np.linalg.lstsq(D2, two.y, rcond=None)[0][0], 1e-7)
    t = {r["term"]: r for r in L.anova(df, "y", ["g"])}
    assert near(t["g"]["f"], H.one_way(df, "y", "g")["statistic"])
    assert near(L.ridge(df, "y", ["x1", "x2"], 0.0), ols(p, ["x1", "x2"])[1]) and near(L.lasso(df, "y", ["x1", "x2"], 0.0), ols(p, ["x1", "x2"])[1], 1e-6) and near(L.pls(df, "y", ["x1", "x2"], 2), ols(p, ["x1", "x2"])[1])
    assert near(L.lasso(df, "y", ["x1", "x2"], 1e3)[1:], 0)
    assert near(L.iv(df, "y", ["x1"], ["x2"], ["x1"])["coefficients"], ols(p, ["x1", "x2"])[1][[1, 2, 0]]) and L.iv(df, "y", ["x1"], [], ["c", "t"], "liml")["kappa"] >= 1


def score(p, x, b, mu, y):
    return np.column_stack([np.ones(len(p)), p[x]]).T @ (p[y] - mu)


def test_likelihood_models_reach_a_stationary_point(xy):
    p, df = xy
    eta = lambda r: r["parameters"][0] + p.x1 * r["parameters"][1]
    r = MO.logit(df, "b", ["x1"])
    assert near(score(p, ["x1"], None, 1 / (1 + np.exp(-eta(r))), "b"), 0, 1e-3) and r["converged"]
    r = MO.poisson(df, "c", ["x1"])
    assert near(score(p, ["x1"], None, np.exp(eta(r)), "c"), 0, 1e-3)
    r = MO.glm(df, "y", ["x1", "x2"], "gaussian")
    assert near(r["parameters"][:3], ols(p, ["x1", "x2"])[1], 1e-5)
    r = MO.gamma(df, "t", ["x1"])
    assert abs(r["parameters"][1] - 0.5) < 0.25
    q = MO.quantile(df, "y", ["x1"])
    e = p.y - q["parameters"][0] - q["parameters"][1] * p.x1
    assert abs((e > 0).mean() - 0.5) < 0.02
    assert near(MO.firth_logit(df, "b", ["x1"])["parameters"], MO.logit(df, "b", ["x1"])["parameters"], 5e-2)
    assert abs(MO.random_intercept(df, "y", ["x1", "x2"], "e")["parameters"][1] - 2) < 0.2
    assert near(MO.gee(df, "y", ["x1"], "e", correlation="independence")["parameters"], ols(p, ["x1"])[1], 1e-6)
    z = [-9.0, -3.0, -0.5, 0.0, 1.7, 8.0]
    got = [x[0] for x in df.sparkSession.createDataFrame([(v,) for v in z], "z double").select(MO.normal_cdf_column(df.sparkSession.range(1).id * 0 if False else __import__("pyspark").sql.functions.col("z"))).collect()]
    assert near(got, [sp.normal_cdf(v) for v in z], 1e-12)


def test_treatment_effects(xy):
    p, df = xy
    X1 = ols(p[p.b == 1], ["x1"])[1]
    X0 = ols(p[p.b == 0], ["x1"])[1]
    want = ((X1 - X0) @ np.vstack([np.ones(len(p)), p.x1])).mean()
    assert near(MO.regression_adjustment(df, "y", "b", ["x1"])["ate"], want)
    ps = 1 / (1 + np.exp(-(lambda r: r[0] + r[1] * p.x1)(MO.logit(df, "b", ["x1"])["parameters"])))
    near_other = [p.y[p.b != p.b[i]][np.abs(ps[p.b != p.b[i]] - ps[i]).idxmin()] for i in range(len(p))]
    effect = np.where(p.b == 1, p.y - near_other, near_other - p.y)
    m = MO.matching(df, "y", "b", ["x1"], blocks=7)
    assert near(m["ate"], effect.mean(), 1e-6) and near(m["att"], effect[p.b == 1].mean(), 1e-6)


def test_survival(xy):
    p, df = xy
    t, e = p.t.to_numpy(), p.b.to_numpy()
    km = S.kaplan_meier(df, "t", "b").orderBy("time").toPandas()
    s, want = 1.0, []
    for v in np.unique(t[e == 1]):
        s *= 1 - ((t == v) & (e == 1)).sum() / (t >= v).sum()
        want.append(s)
    assert near(km["survival"], want)
    c = S.cox(df, "t", "b", ["x1"])
    b = c["coefficients"][0]
    u = sum(p.x1[i] - (np.exp(b * p.x1[t >= t[i]]) @ p.x1[t >= t[i]]) / np.exp(b * p.x1[t >= t[i]]).sum() for i in range(len(p)) if e[i])
    assert abs(u) < 1e-5
    w = S.parametric(df, "t", "b", ["x1"], "exponential")
    eta = w["parameters"][0] + w["parameters"][1] * p.x1
    assert abs((e - t * np.exp(-eta)).sum()) < 1e-3
    assert S.logrank(df, "t", "b", "g")["df"] == 2


def test_series():
    y = np.cumsum(np.random.default_rng(5).normal(size=120)) + 50
    r = TS.arima(y, 1, 0, 0)
    X = np.column_stack([np.ones(119), y[:-1]])
    b = np.linalg.lstsq(X, y[1:], rcond=None)[0]
    assert near(r["parameters"][0], b[1], 1e-3) and len(r["forecast"]) == 10 and (np.diff(r["upper"] - r["lower"]) > 0).all()
    assert near(TS.arima(y, 0, 1, 0, constant=False, horizon=3)["forecast"], y[-1])
    season = np.tile([1.0, 2.0, 3.0, 4.0], 10)
    assert near(TS.ets(season, seasonal="additive", period=4, horizon=4)["forecast"], [1, 2, 3, 4], 1e-3)
    assert near(TS.grey(100 * 1.1 ** np.arange(8), 1)["forecast"][0], 100 * 1.1**8, 2e-2)
    assert near(TS.pacf_from([0.5, 0.25, 0.125]), [0.5, 0.0, 0.0]) and TS.garch(np.random.default_rng(1).normal(size=200))["loglik"] < 0
    assert TS.kpss(y)["statistic"] > TS.kpss(np.random.default_rng(2).normal(size=120))["statistic"]


def test_vector_models(spark):
    g = np.random.default_rng(7)
    a = np.zeros((300, 2))
    for t in range(1, 300):
        a[t] = np.array([[0.5, 0.2], [0.0, 0.3]]) @ a[t - 1] + g.normal(size=2)
    df = spark.createDataFrame(pd.DataFrame({"t": range(300), "u": a[:, 0], "v": a[:, 1]}))
    m = TS.var(df, ["u", "v"], "t", 1)
    want = np.linalg.lstsq(np.column_stack([np.ones(299), a[:-1]]), a[1:], rcond=None)[0]
    assert near(m["coefficients"], want)
    cause = {(r["effect"], r["cause"]): r["p_value"] for r in TS.granger(m)}
    assert cause["u", "v"] < 0.01 < cause["v", "u"] and near(TS.fevd(m, 5).sum(2), 1)
    assert TS.irf(m, 3).shape == (4, 2, 2) and TS.johansen(df, ["u", "v"], "t")[0]["trace"] > 30


def test_meta_decision_and_others(spark, xy):
    p, df = xy
    s = spark.createDataFrame([(i, e, v) for i, (e, v) in enumerate([(0.1, 0.04), (0.5, 0.02), (0.9, 0.09), (-0.2, 0.05)])], "study int, effect double, variance double")
    e, v = np.array([0.1, 0.5, 0.9, -0.2]), np.array([0.04, 0.02, 0.09, 0.05])
    f = M.pool(s)
    assert near(f["effect"], (e / v).sum() / (1 / v).sum())
    pm = M.pool(s, "pm")
    w = 1 / (v + pm["tau_squared"])
    assert near((w * (e - (w * e).sum() / w.sum()) ** 2).sum(), 3, 1e-6)
    l = {r["study"]: r["effect"] for r in M.leave_one_out(s, "study", "dl").collect()}
    assert near(l[0], M.pool(s.where("study <> 0"), "dl")["effect"])
    assert near(D.ahp([[1, 3], [1 / 3, 1]])["weights"], [0.75, 0.25]) and D.ism([[0, 1], [0, 0]])["levels"] == [[1], [0]]
    assert D.turf(spark.createDataFrame([(1, 0, 0), (0, 1, 0), (0, 1, 1)], "a int, b int, c int"), ["a", "b", "c"], 2)["reach"] == 3
    x = np.sort(p.t)
    n = len(x)
    assert near(FA.gini(df, "t")["gini"], np.abs(x[:, None] - x).sum() / (2 * n * n * x.mean()))
    dg = FA.dagum_gini(df, "t", "g")
    assert near(dg["gini"], FA.gini(df, "t")["gini"])
    c = p[["x1", "x2", "y"]].cov().to_numpy()
    assert near(FA.reliability(df, ["x1", "x2", "y"])["alpha"], 1.5 * (1 - np.trace(c) / c.sum()))
    assert near(FA.pca(df, ["x1", "x2", "y"])["eigenvalues"], np.sort(np.linalg.eigvalsh(p[["x1", "x2", "y"]].corr()))[::-1])
    assert FA.orthogonal_design(3, 4).shape == (9, 4) and FA.full_factorial(2, 3).shape == (8, 3)
    for a in range(4):
        for b in range(a):
            d = FA.orthogonal_design(3, 4)
            assert len({tuple(r) for r in d[:, [a, b]]}) == 9
    pts = spark.createDataFrame([(i, float(i % 5), float(i // 5), float(i % 5)) for i in range(25)], "k int, x double, y double, v double")
    pairs = FA.neighbour_pairs(pts, "k", "x", "y", 1.0)
    assert pairs.count() == 80 and FA.morans_i(pts, "k", "v", FA.row_standardised(pairs))["i"] > 0.3
    sm = FA.survey_mean(df.selectExpr("y", "1.0 as w"), "y", "w")
    assert near(sm["mean"], p.y.mean()) and near(sm["standard_error"], p.y.std() / math.sqrt(n))


def test_formula():
    f = formula.parse("2*exp(-x)^2 + min(b1, 3)/4 - -1")
    assert near(f({"x": 0.5, "b1": 8.0}), 2 * math.exp(-1) + 0.75 + 1)
    for bad in ("x +", "import(1)", "x.y", "(x", "x x"):
        with pytest.raises(ValueError):
            formula.parse(bad)


def test_more_diagnostics(xy):
    from tidewell.stats import diagnostics as DI

    p, df = xy
    n = len(p)
    e = p.y - p.y.mean()
    s, k = (e**3).mean() / (e**2).mean() ** 1.5, (e**4).mean() / (e**2).mean() ** 2
    assert near(DI.normality(df, "y")["jarque_bera"], n / 6 * (s * s + (k - 3) ** 2 / 4)) and 0 < DI.normality(df, "y")["omnibus_p"] < 1
    val = np.sort(np.linalg.eigvalsh(p[["x1", "x2", "y"]].corr()))
    assert near(DI.harman(df, ["x1", "x2", "y"])["first_component_ratio"], val[-1] / 3)
    small, large = L.fit(df, "y", ["x1"]), L.fit(df, "y", ["x1", "x2"])
    c = DI.nested_comparison(small, large)
    assert near(c["f"], (large.beta[2] / math.sqrt(large.covariance[2, 2])) ** 2)
    assert DI.information_matrix(df, large)["df"] == 5 + 3 + 1
    h = DI.treatment_heterogeneity(df, "y", "b", "g")
    want = [p.y[(p.g == g) & (p.b == 1)].mean() - p.y[(p.g == g) & (p.b == 0)].mean() for g in "abc"]
    assert near(list(h["effects"].values()), want)
    m = MO.logit(df, "b", ["x1"])
    a = DI.adjusted_prediction(df, ["x1"], m, "logit")
    assert near(a["prediction"], p.b.mean(), 1e-4) and a["lower"] < a["prediction"] < a["upper"]
    assert near(DI.adjusted_prediction(df, ["x1", "x2"], large, at={"x1": 1.0})["prediction"], large.beta[0] + large.beta[1] + large.beta[2] * p.x2.mean())
    sv = DI.survey_glm(df.selectExpr("*", "1.0 as w"), "b", ["x1"], "w")
    assert near(sv["parameters"], m["parameters"], 1e-5) and (sv["se"] > 0).all()
    r = DI.reclassification(df.selectExpr("b", "0.5 as r", "1 / (1 + exp(-x1)) as q"), "b", "r", "q")
    q = 1 / (1 + np.exp(-p.x1))
    assert near(r["idi"], q[p.b == 1].mean() - q[p.b == 0].mean()) and near(r["nri_events"], np.sign(q[p.b == 1] - 0.5).mean())
    assert DI.subgroup_cox(df, "t", "b", "x1", "g")["df"] == 2 and DI.odds_ratios(m)[1]["odds_ratio"] > 1


def test_quantile_regression_is_exact_over_all_rows(spark, xy, monkeypatch):
    p, df = xy

    def slack(y, x, b, q):
        """How far the subgradient condition of the least check loss is missed; none of it at the solution."""
        x = np.column_stack([np.ones(len(y)), x])
        e = y - x @ b
        on = np.abs(e) < 1e-9 * np.abs(y).max()
        pull = np.abs(x[~on].T @ np.where(e[~on] > 0, q, q - 1))
        return np.max(pull - max(q, 1 - q) * np.abs(x[on]).sum(0))

    for rows in (10**6, 60):  # all rows at once, and bands of 60 of the 400
        monkeypatch.setattr(MO, "BAND_ROWS", rows)
        for q in (0.5, 0.8):
            assert slack(p.y.to_numpy(), p[["x1", "x2"]].to_numpy(), MO.quantile(df, "y", ["x1", "x2"], q)["parameters"], q) <= 1e-9
    with pytest.raises(ArithmeticError):
        MO.quantile(df, "y", ["x1"], iterations=0)
    from __spark_entry__ import queries
    from tidewell.runtime import table

    line = table(spark, "/root/testdata/sf0.001", "lineitem").select("l_quantity", "l_extendedprice").toPandas().astype(float)
    got = {r["term"]: r["coefficient"] for r in queries()["model_quantile"](spark, "/root/testdata/sf0.001").collect()}
    assert slack(line.l_extendedprice.to_numpy(), line[["l_quantity"]].to_numpy(), np.array([got["Intercept"], got["l_quantity"]]), 0.5) <= 1e-6


def test_threshold_query_tries_the_default_number_of_splits(spark, monkeypatch):
    from __spark_entry__ import queries

    asked = {}
    monkeypatch.setattr(L, "threshold", lambda *args, **more: asked.update(more) or {"threshold": 0.0, "rss": 0.0})
    queries()["regression_threshold"](spark, "/root/testdata/sf0.001")
    assert not asked


def test_power_of_two_groups_and_discrepancy_by_hand():
    from tidewell.stats import special as sp

    def two_sided(shift):
        z = sp.normal_quantile(0.975)
        return sp.normal_sf(z - shift) + sp.normal_cdf(-z - shift)

    p1 = 0.25 * 2 / (1 + 0.25 * 2)
    shift = np.log(2) * np.sqrt(100 / (1 / 0.16 + 1 / (p1 * (1 - p1))))
    assert FA.power_of("logistic", 100, probability=0.2, odds_ratio=2.0) == pytest.approx(two_sided(shift), abs=1e-6)
    assert FA.power_of("poisson", 50, rate=0.5, rate_ratio=1.5, exposure=2.0) == pytest.approx(two_sided(np.log(1.5) / np.sqrt(1 / 50 + 1 / 75)), abs=1e-6)
    assert FA.power_of("cox", 200, hazard_ratio=1.5, event_fraction=0.6, predictor_variance=0.25) == pytest.approx(two_sided(np.log(1.5) * np.sqrt(30)), abs=1e-6)
    assert FA.centered_discrepancy(np.array([[0.5]])) == pytest.approx(13 / 12 - 2 + 1)  # one point in the middle of a line


def test_robust_regression_finds_the_median_in_bins(spark, xy, monkeypatch):
    p, df = xy

    def held(*_):
        raise AssertionError("holds every distinct value in one task")

    for module in (MO, H):
        monkeypatch.setattr(module.F, "median", held)
    for loss, c in (("huber", 1.345), ("tukey", 4.685)):
        q = p.assign(y=p.y + np.where(p.i < 20, 1e6, 0.0))
        X, b, e = ols(q, ["x1", "x2"])
        for _ in range(60):
            u = np.abs(e) / (c * np.median(np.abs(e)) / 0.67448975)
            w = np.where(u <= 1, 1.0, 1 / np.maximum(u, 1)) if loss == "huber" else np.where(u < 1, (1 - u * u) ** 2, 0.0)
            b = np.linalg.solve((X.T * w) @ X, (X.T * w) @ q.y)
            e = (q.y - X @ b).to_numpy()
        r = MO.robust(df.withColumn("y", F.col("y") + F.when(F.col("i") < 20, 1e6).otherwise(0.0)), "y", ["x1", "x2"], loss)
        assert near(r["parameters"], b, 1e-5), loss
    for values in ([3.0], [1.0, 2.0], [0.0] * 5, [5.0, 5.0, 7.0, 7.0], [1e-300, 1e300, 2.0, 1e-9], [*range(100_001)], [-1.0, -1.0 + 1e-15, -1.0 + 3e-15]):
        d = spark.createDataFrame([(float(v),) for v in values], "v double")
        for low, high in ((0.0, 1.0), (7.0, 7.0)):
            assert exact_median(d, F.col("v"), low, high) == np.median(values), values


def test_stepwise_may_select_nothing(spark, tmp_path):
    """The price is the same for all values of every predictor: the constant alone is best."""
    from tidewell.plans.statistics import QUERIES

    cells = itertools.product((1, 2), (1.0, 2.0), (0.03, 0.04), (0.05, 0.06), (100.0, 200.0))
    rows = [(o, 1, q, p, d, t, "N", "O") for o, q, d, t, p in cells]
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["regression_stepwise"](spark, str(tmp_path))
    assert got.dtypes == [("term", "string")] and got.collect() == []


def test_cmh_of_large_strata(spark):
    """Strata of 4,000,000 rows and more: products of their counts are beyond 64 bits."""
    from fractions import Fraction

    tables = {"F": (1_300_000, 900_000, 700_000, 1_100_000), "O": (900_000, 1_000_000, 1_100_000, 1_200_001), "one": (1, 0, 0, 0)}
    cells = [(s, x, y, k) for s, t in tables.items() for (x, y), k in zip(((1, 1), (1, 0), (0, 1), (0, 0)), t)]
    rows = spark.createDataFrame(cells, "s string, x int, y int, k int").select("s", "x", "y", F.explode(F.array_repeat(F.lit(True), F.col("k"))).alias("_"))
    e = v = p = q = Fraction(0)
    for a, b, c, d in tables.values():
        n, r, m = a + b + c + d, a + b, a + c
        e, p, q = e + a - Fraction(r * m, n), p + Fraction(a * d, n), q + Fraction(b * c, n)
        v += Fraction(r * (n - r) * m * (n - m), n * n * (n - 1)) if n > 1 else 0
    got = H.cmh(rows, "x", "y", "s")
    assert near(got["statistic"], float(e * e / v), 1e-12) and near(got["common_odds_ratio"], float(p / q), 1e-12)
