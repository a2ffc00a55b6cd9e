"""Linear models: least squares with its covariances, ANOVA, instruments, panels and diagnostics.

Everything rests on cross products and on sums over residual expressions; a fit is two or three passes, whatever
the number of rows.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.guards import operand
from tidewell.stats import special as sp
from tidewell.stats.core import cross, fitted, gram, moments, solve_ls


@dataclass
class LinearFit:
    """A fitted linear model; summaries and predictions need only this."""

    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    n: float
    rss: float
    tss: float
    constant: bool
    x: list
    y: object
    kind: str = "nonrobust"
    extra: dict = field(default_factory=dict)

    @property
    def df(self) -> float:
        return self.n - len(self.beta)

    @property
    def loglik(self) -> float:
        return -self.n / 2 * (math.log(2 * math.pi) + math.log(self.rss / self.n) + 1)

    def rows(self, confidence: float = 0.95) -> list[dict]:
        out = []
        for n, b, v in zip(self.names, self.beta, np.diag(self.covariance)):
            se = math.sqrt(max(v, 0))
            t = b / se if se else math.inf
            half = sp.t_quantile(0.5 + confidence / 2, self.df) * se
            out.append({"term": n, "coefficient": float(b), "standard_error": se, "statistic": t, "p_value": sp.t_two_sided(t, self.df), "lower": b - half, "upper": b + half})
        return out

    def summary(self) -> dict:
        k = len(self.beta)
        r2 = 1 - self.rss / self.tss if self.tss else float("nan")
        d1 = k - int(self.constant)
        f = (r2 / d1) / ((1 - r2) / self.df) if d1 and r2 < 1 else float("nan")
        return {"n": self.n, "df": self.df, "r_squared": r2, "adjusted_r_squared": 1 - (1 - r2) * (self.n - int(self.constant)) / self.df, "f": f, "f_p_value": sp.f_sf(f, d1, self.df) if d1 else float("nan"), "rmse": math.sqrt(self.rss / self.df), "loglik": self.loglik, "aic": 2 * k - 2 * self.loglik, "bic": k * math.log(self.n) - 2 * self.loglik}

    def linear(self, x: list | None = None) -> Column:
        return fitted(x or self.x, self.beta, self.constant)


def _names(x: list, constant: bool) -> list[str]:
    return (["Intercept"] if constant else []) + [c if isinstance(c, str) else f"x{i}" for i, c in enumerate(x)]


def _design(x: list, constant: bool) -> list[Column]:
    return ([F.lit(1.0)] if constant else []) + [operand(c) for c in x]


def _meat(df: DataFrame, design: list[Column], scale: Column) -> np.ndarray:
    """sum of scale * d d'."""
    k = len(design)
    r = df.agg(*[F.sum(design[i] * design[j] * scale).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
    return m


def fit(df: DataFrame, y: str, x: list, weight: str | None = None, constant: bool = True, covariance: str = "nonrobust", clusters: str | None = None, order: str | None = None, lags: int = 4) -> LinearFit:
    """OLS or WLS with nonrobust, HC0-HC3, cluster (CR1) or hac (Bartlett) covariance."""
    r = solve_ls(df, y, x, weight, constant)
    n = float(df.count()) if weight else r["n"]
    sigma2 = r["rss"] / (n - r["k"])
    cov = r["inv"] * sigma2
    design = _design(x, constant)
    e = operand(y) - fitted(x, r["beta"], constant)
    w = operand(weight) if weight else F.lit(1.0)
    inv, k = r["inv"], r["k"]
    if covariance in ("hc0", "hc1", "hc2", "hc3"):
        lever = F.lit(0.0)
        for i in range(k):
            for j in range(k):
                lever = lever + F.lit(float(inv[i, j])) * design[i] * design[j]
        lever = lever * w
        s = {"hc0": F.lit(1.0), "hc1": F.lit(n / (n - k)), "hc2": 1 / (1 - lever), "hc3": 1 / ((1 - lever) * (1 - lever))}[covariance]
        cov = inv @ _meat(df, design, e * e * w * w * s) @ inv
    elif covariance == "cluster":
        g = df.groupBy(clusters).agg(*[F.sum(d * e * w).alias(f"s{i}") for i, d in enumerate(design)])
        m = _meat(g, [F.col(f"s{i}") for i in range(k)], F.lit(1.0))
        groups = g.count()
        cov = inv @ m @ inv * (groups / (groups - 1)) * ((n - 1) / (n - k))
    elif covariance == "hac":
        over = Window.orderBy(order)
        d = df.select(F.col(order).alias("__o"), *[(c * e * w).alias(f"s{i}") for i, c in enumerate(design)])
        m = _meat(d, [F.col(f"s{i}") for i in range(k)], F.lit(1.0))
        over = Window.orderBy("__o")
        lagged = d.select("*", *[F.lag(f"s{i}", q).over(over).alias(f"l{i}_{q}") for i in range(k) for q in range(1, lags + 1)])
        got = lagged.agg(*[F.coalesce(F.sum(F.col(f"s{i}") * F.col(f"l{j}_{q}")), F.lit(0.0)).alias(f"g{i}_{j}_{q}") for i in range(k) for j in range(k) for q in range(1, lags + 1)]).first()
        for q in range(1, lags + 1):
            g = np.array([[got[f"g{i}_{j}_{q}"] for j in range(k)] for i in range(k)])
            m = m + (1 - q / (lags + 1)) * (g + g.T)
        cov = inv @ m @ inv
    elif covariance != "nonrobust":
        raise ValueError(f"unknown covariance {covariance}")
    return LinearFit(_names(x, constant), r["beta"], cov, n, r["rss"], r["tss"], constant, list(x), y, covariance, {"inv": inv})


def predict(df: DataFrame, model: LinearFit, x: list | None = None, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, model.linear(x))


def prais(df: DataFrame, y: str, x: list[str], order: str, iterations: int = 100, tolerance: float = 1e-6) -> tuple[LinearFit, float]:
    """Prais-Winsten regression for AR(1) errors; rho from the residuals' first autocorrelation."""
    model, rho = fit(df, y, x), 0.0
    w = Window.orderBy(order)
    for _ in range(iterations):
        e = df.select(F.col(order), (operand(y) - model.linear()).alias("e")).select("e", F.lag("e").over(w).alias("l"))
        r = e.agg(F.sum(F.col("e") * F.col("l")).alias("a"), F.sum(F.col("l") * F.col("l")).alias("b")).first()
        new = r["a"] / r["b"]
        root = math.sqrt(1 - new * new)
        cols = {"__y": operand(y), "__c": F.lit(1.0), **{f"__x{i}": operand(c) for i, c in enumerate(x)}}
        lagged = df.select(F.col(order), *[c.alias(n) for n, c in cols.items()]).select(*[F.coalesce(F.col(n) - F.lit(new) * F.lag(n).over(w), F.col(n) * F.lit(root)).alias(n) for n in cols])
        m = fit(lagged, "__y", ["__c", *[f"__x{i}" for i in range(len(x))]], constant=False)
        done = abs(new - rho) < tolerance
        rho = new
        model = LinearFit(_names(x, True), m.beta, m.covariance, m.n, m.rss, m.tss, True, list(x), y)
        if done:
            return model, rho
    raise RuntimeError("rho did not settle")


# -- analysis of variance ------------------------------------------------------------------------------------------


def _coded(df: DataFrame, factors: list[str]) -> tuple[DataFrame, dict[str, list[Column]]]:
    """Sum-to-zero columns for each factor's levels (a row per level comes to the driver)."""
    coded = {}
    for f in factors:
        levels = sorted(r[0] for r in df.select(f).distinct().collect())
        last = F.when(F.col(f) == F.lit(levels[-1]), -1.0)
        coded[f] = [last.when(F.col(f) == F.lit(lv), 1.0).otherwise(0.0) for lv in levels[:-1]]
    return df, coded


def anova(df: DataFrame, y: str, factors: list[str], covariates: list[str] = (), interactions: bool = True, ss: str = "type_iii") -> list[dict]:
    """Factorial ANOVA or ANCOVA of any number of factors, types I, II and III, from one Gram matrix."""
    df, coded = _coded(df, factors)
    terms: list[tuple[str, list[Column]]] = [(c, [operand(c)]) for c in covariates]
    for r in range(1, (len(factors) if interactions else 1) + 1):
        for combo in itertools.combinations(factors, r):
            cols = coded[combo[0]]
            for f in combo[1:]:
                cols = [a * b for a in cols for b in coded[f]]
            terms.append((":".join(combo), cols))
    flat = [c for _, cols in terms for c in cols]
    g, n = gram(df, [y, *flat])
    order = [0, *range(2, len(g)), 1]  # constant, predictors, response
    g = g[np.ix_(order, order)]
    at, spans = 1, []
    for name, cols in terms:
        spans.append((name, list(range(at, at + len(cols)))))
        at += len(cols)
    p = len(g) - 1

    def rss(use: list[int]) -> float:
        a = g[np.ix_(use, use)]
        return float(g[p, p] - g[p, use] @ np.linalg.solve(a, g[use, p]))

    every = [0, *range(1, p)]
    full = rss(every)
    df_error = n - len(every)
    out = []
    for i, (name, own) in enumerate(spans):
        if ss == "type_i":
            before = [0, *[k for _, s in spans[:i] for k in s]]
            s = rss(before) - rss(before + own)
        elif ss == "type_ii":
            parts = set(name.split(":"))
            keep = [0, *[k for nm, s in spans if nm != name and not parts < set(nm.split(":")) for k in s]]
            s = rss(keep) - rss(sorted(keep + own))
        else:
            s = rss([k for k in every if k not in own]) - full
        f = (s / len(own)) / (full / df_error)
        out.append({"term": name, "df": float(len(own)), "ss": s, "ms": s / len(own), "f": f, "p_value": sp.f_sf(f, len(own), df_error), "partial_eta_squared": s / (s + full)})
    out.append({"term": "Residual", "df": float(df_error), "ss": full, "ms": full / df_error, "f": float("nan"), "p_value": float("nan"), "partial_eta_squared": float("nan")})
    return out


def repeated_measures(df: DataFrame, y: str, subject: str, factor: str) -> dict:
    """One within factor, one observation per cell, with the Greenhouse-Geisser epsilon."""
    levels = sorted(r[0] for r in df.select(factor).distinct().collect())
    wide = df.groupBy(subject).agg(*[F.max(F.when(F.col(factor) == lv, operand(y))).alias(f"v{i}") for i, lv in enumerate(levels)])
    k = len(levels)
    mean, s, n = cross(wide, [f"v{i}" for i in range(k)])
    cov = s / (n - 1)
    ss_factor = n * ((mean - mean.mean()) ** 2).sum()
    total_within = np.trace(s) - s.sum() / k
    error = total_within
    f = (ss_factor / (k - 1)) / (error / ((k - 1) * (n - 1)))
    c = cov - cov.mean(0) - cov.mean(1)[:, None] + cov.mean()
    eps = np.trace(c) ** 2 / ((k - 1) * (c**2).sum())
    return {"f": f, "df1": float(k - 1), "df2": float((k - 1) * (n - 1)), "p_value": sp.f_sf(f, k - 1, (k - 1) * (n - 1)), "epsilon_greenhouse_geisser": eps, "p_value_corrected": sp.f_sf(f, eps * (k - 1), eps * (k - 1) * (n - 1))}


def manova(df: DataFrame, responses: list[str], factor: str) -> dict:
    """One factor: Wilks, Pillai, Hotelling-Lawley and Roy from the between and within matrices."""
    p = len(responses)
    mean, total, n = cross(df, responses)
    g = df.groupBy(factor).agg(F.count(F.lit(1)).alias("n"), *[F.avg(operand(c)).alias(f"m{i}") for i, c in enumerate(responses)]).toPandas()
    d = g[[f"m{i}" for i in range(p)]].to_numpy() - mean
    h = (d * g["n"].to_numpy()[:, None]).T @ d
    e = total - h
    ev = np.real(np.linalg.eigvals(np.linalg.solve(e, h)))
    wilks = float(np.prod(1 / (1 + ev)))
    q, v = len(g) - 1, n - len(g)
    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    w = v + q - (p + q + 1) / 2
    d1, d2 = p * q, w * t - (p * q - 2) / 2
    f = (1 - wilks ** (1 / t)) / wilks ** (1 / t) * d2 / d1
    return {"wilks": wilks, "pillai": float((ev / (1 + ev)).sum()), "hotelling_lawley": float(ev.sum()), "roy": float(ev.max()), "f": f, "df1": float(d1), "df2": float(d2), "p_value": sp.f_sf(f, d1, d2)}


def multiple_comparisons(df: DataFrame, y: str, group: str, adjustment: str = "tukey", confidence: float = 0.95) -> list[dict]:
    """All pairs of group means with pooled variance; tukey, bonferroni, holm, sidak or scheffe."""
    from tidewell.stats.core import group_moments

    g = group_moments(df, group, y)
    n, k = g["n"].sum(), len(g)
    v, mse = n - k, ((g["n"] - 1) * g["var"]).sum() / (n - k)
    out = []
    for i, j in itertools.combinations(range(k), 2):
        d = g["mean"][i] - g["mean"][j]
        se = math.sqrt(mse * (1 / g["n"][i] + 1 / g["n"][j]))
        out.append({"first": str(g[group][i]), "second": str(g[group][j]), "difference": d, "standard_error": se, "statistic": d / se, "p_raw": sp.t_two_sided(d / se, v)})
    m = len(out)
    if adjustment == "holm":
        run = 0.0
        for rank, r in enumerate(sorted(out, key=lambda r: r["p_raw"])):
            run = max(run, min(1.0, r["p_raw"] * (m - rank)))
            r["p_value"] = run
    for r in out:
        t = abs(r["statistic"])
        if adjustment == "tukey":
            r["p_value"] = sp.studentized_range_sf(t * math.sqrt(2), k, v)
        elif adjustment == "bonferroni":
            r["p_value"] = min(1.0, r["p_raw"] * m)
        elif adjustment == "sidak":
            r["p_value"] = 1 - (1 - r["p_raw"]) ** m
        elif adjustment == "scheffe":
            r["p_value"] = sp.f_sf(t * t / (k - 1), k - 1, v)
    return out


def confidence_intervals(df: DataFrame, estimate: str, se: str, confidence: float = 0.95) -> DataFrame:
    z = sp.normal_quantile(0.5 + confidence / 2)
    return df.withColumn("lower", operand(estimate) - z * operand(se)).withColumn("upper", operand(estimate) + z * operand(se))


# -- instruments ---------------------------------------------------------------------------------------------------


def iv(df: DataFrame, y: str, endogenous: list[str], exogenous: list[str], instruments: list[str], method: str = "2sls", constant: bool = True) -> dict:
    """Two-stage least squares, LIML or two-step GMM from the cross products of all columns."""
    names = [y, *endogenous, *exogenous, *instruments]
    g, n = gram(df, names, constant=constant)
    c = int(constant)
    iy = c
    ix = [*range(c + 1, c + 1 + len(endogenous) + len(exogenous)), *([0] if constant else [])]
    iz = [*range(c + 1 + len(endogenous), len(g)), *([0] if constant else [])]
    zz_inv = np.linalg.inv(g[np.ix_(iz, iz)])
    xz = g[np.ix_(ix, iz)]
    proj = lambda a, b: g[np.ix_(a, iz)] @ zz_inv @ g[np.ix_(iz, b)]
    kappa = 1.0
    if method == "liml":
        ye = [iy, *range(c + 1, c + 1 + len(endogenous))]
        ex = [*range(c + 1 + len(endogenous), c + 1 + len(endogenous) + len(exogenous)), *([0] if constant else [])]
        resid = lambda on: g[np.ix_(ye, ye)] - (g[np.ix_(ye, on)] @ np.linalg.solve(g[np.ix_(on, on)], g[np.ix_(on, ye)]) if on else 0)
        kappa = float(np.min(np.real(np.linalg.eigvals(np.linalg.solve(resid(iz), resid(ex))))))
    a = g[np.ix_(ix, ix)] * (1 - kappa) + kappa * proj(ix, ix)
    b = g[ix, iy] * (1 - kappa) + kappa * proj(ix, [iy])[:, 0]
    beta = np.linalg.solve(a, b)
    rss = g[iy, iy] - 2 * beta @ g[ix, iy] + beta @ g[np.ix_(ix, ix)] @ beta
    sigma2 = rss / (n - len(beta))
    cov = np.linalg.inv(a) * sigma2
    terms = [*endogenous, *exogenous, *(["Intercept"] if constant else [])]
    ze = g[iz, iy] - g[np.ix_(iz, ix)] @ beta
    over = len(iz) - len(ix)
    sargan = float(ze @ zz_inv @ ze / (rss / n)) if over > 0 else float("nan")
    if method == "gmm":
        cols = ([F.lit(1.0)] if constant else []) + [operand(x) for x in names]
        e = cols[iy]
        for bj, j in zip(beta, ix):
            e = e - F.lit(float(bj)) * cols[j]
        s = _meat(df, [cols[j] for j in iz], e * e)
        w = np.linalg.inv(s)
        m = xz @ w @ xz.T
        beta = np.linalg.solve(m, xz @ w @ g[iz, iy])
        cov = np.linalg.inv(m)
        ze = g[iz, iy] - g[np.ix_(iz, ix)] @ beta
        sargan = float(ze @ w @ ze)
    first = {}
    for k, name in enumerate(endogenous):
        j = c + 1 + k
        ex = [*range(c + 1 + len(endogenous), c + 1 + len(endogenous) + len(exogenous)), *([0] if constant else [])]
        r1 = g[j, j] - g[j, iz] @ zz_inv @ g[iz, j]
        r0 = g[j, j] - (g[j, ex] @ np.linalg.solve(g[np.ix_(ex, ex)], g[ex, j]) if ex else 0)
        first[name] = ((r0 - r1) / len(instruments)) / (r1 / (n - len(iz)))
    return {"terms": terms, "coefficients": beta, "covariance": cov, "standard_errors": np.sqrt(np.diag(cov)), "rss": float(rss), "n": n, "kappa": kappa, "overidentification": sargan, "overidentification_p": sp.chi2_sf(sargan, over) if over > 0 else float("nan"), "first_stage_f": first}


# -- panels --------------------------------------------------------------------------------------------------------


def _within(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Columns minus the means of their group, plus nothing; group means are joined back, not windowed, so that a large
    group is averaged by partial sums."""
    means = df.groupBy(by).agg(*[F.avg(operand(c)).alias(f"__m{i}") for i, c in enumerate(columns)])
    from tidewell.operators.skew import salted_join

    joined = salted_join(df, means, [by], [F.monotonically_increasing_id()], salts=8)
    return joined.select(*[c for c in df.columns if c not in columns], *[(operand(c) - F.col(f"__m{i}")).alias(c) for i, c in enumerate(columns)])


def panel(df: DataFrame, y: str, x: list[str], entity: str, time: str | None = None, method: str = "fe", covariance: str = "nonrobust") -> LinearFit:
    """fe, two_way, be, fd or re (feasible GLS with Swamy-Arora variances)."""
    cols = [y, *x]
    base = df.select(entity, *([time] if time else []), *[operand(c).alias(c) for c in cols])
    if method in ("fe", "two_way"):
        n_entities = base.select(entity).distinct().count()
        d, absorbed = _within(base, cols, entity), n_entities
        if method == "two_way":
            absorbed += base.select(time).distinct().count() - 1
            for _ in range(200):  # alternating projections; one round is enough for balanced panels
                before = d
                d = _within(d, cols, time)
                d = _within(d, cols, entity)
                from tidewell.runtime import materialise

                d = materialise(d, "within")
                drift = max(abs(v or 0.0) for v in d.groupBy(time).agg(*[F.avg(c).alias(c) for c in cols]).agg(*[F.max(F.abs(c)) for c in cols]).first())
                if drift < 1e-10:
                    break
        m = fit(d, y, x, constant=False, covariance=covariance if covariance != "cluster" else "nonrobust")
        df_resid = m.n - absorbed - len(x)
        cov = m.extra["inv"] * (m.rss / df_resid)
        if covariance == "cluster":
            e = operand(y) - fitted(x, m.beta, False)
            g = d.groupBy(entity).agg(*[F.sum(operand(c) * e).alias(f"s{i}") for i, c in enumerate(x)])
            meat = _meat(g, [F.col(f"s{i}") for i in range(len(x))], F.lit(1.0))
            k = g.count()
            cov = m.extra["inv"] @ meat @ m.extra["inv"] * k / (k - 1) * (m.n - 1) / (m.n - len(x) - (0 if True else absorbed))
        m.covariance, m.extra["df"], m.extra["absorbed"] = cov, df_resid, absorbed
        return m
    if method == "be":
        return fit(base.groupBy(entity).agg(*[F.avg(c).alias(c) for c in cols]), y, x)
    if method == "fd":
        w = Window.partitionBy(entity).orderBy(time)
        d = base.select((F.col(time) - F.lag(time).over(w)).alias("__gap"), *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in cols]).where("__gap = 1")
        return fit(d, y, x, constant=False)
    if method == "re":
        fe, be = panel(df, y, x, entity, method="fe"), panel(df, y, x, entity, method="be")
        sizes = base.groupBy(entity).agg(F.count(F.lit(1)).alias("__t"))
        t_bar = be.n / sizes.agg(F.sum(1.0 / F.col("__t"))).first()[0]
        s_e = fe.rss / fe.extra["df"]
        s_u = max(0.0, be.rss / be.df - s_e / t_bar)
        means = base.groupBy(entity).agg(F.count(F.lit(1)).alias("__t"), *[F.avg(c).alias(f"__m{i}") for i, c in enumerate(cols)])
        theta = 1 - F.sqrt(F.lit(s_e) / (F.lit(s_e) + F.lit(s_u) * F.col("__t")))
        from tidewell.operators.skew import salted_join

        j = salted_join(base, means, [entity], [F.monotonically_increasing_id()], salts=8)
        d = j.select((1 - theta).alias("__c"), *[(F.col(c) - theta * F.col(f"__m{i}")).alias(c) for i, c in enumerate(cols)])
        m = fit(d, y, ["__c", *x], constant=False)
        m.names[0], m.extra["sigma_u2"], m.extra["sigma_e2"] = "Intercept", s_u, s_e
        return m
    raise ValueError(f"unknown method {method}")


def hausman(fe: LinearFit, re: LinearFit) -> dict:
    b = fe.beta - re.beta[1:]
    v = fe.covariance - re.covariance[1:, 1:]
    stat = float(b @ np.linalg.pinv(v) @ b)
    return {"statistic": stat, "df": len(b), "p_value": sp.chi2_sf(stat, len(b))}


def did(df: DataFrame, y: str, treat: str, post: str, entity: str, time: str, x: list[str] = ()) -> LinearFit:
    """Two-way fixed effects with the interaction of treatment and period."""
    d = df.withColumn("did", operand(treat) * operand(post))
    return panel(d, y, ["did", *x], entity, time, "two_way", "cluster")


# -- diagnostics ---------------------------------------------------------------------------------------------------


def residuals(df: DataFrame, model: LinearFit) -> Column:
    return operand(model.y) - model.linear()


def vif(df: DataFrame, x: list[str]) -> list[dict]:
    _, s, _ = cross(df, x)
    d = np.sqrt(np.diag(s))
    inv = np.linalg.inv(s / np.outer(d, d))
    return [{"term": c, "vif": float(v)} for c, v in zip(x, np.diag(inv))]


def condition_number(df: DataFrame, x: list[str]) -> float:
    g, _ = gram(df, x)
    d = np.sqrt(np.diag(g))
    return float(np.sqrt(np.linalg.cond(g / np.outer(d, d))))


def breusch_pagan(df: DataFrame, model: LinearFit, koenker: bool = True) -> dict:
    e2 = residuals(df, model) ** 2
    d = df.select(e2.alias("__e2"), *[operand(c).alias(f"__x{i}") for i, c in enumerate(model.x)])
    m = fit(d, "__e2", [f"__x{i}" for i in range(len(model.x))])
    k = len(model.x)
    stat = m.n * (1 - m.rss / m.tss) if koenker else (m.tss - m.rss) / (2 * (model.rss / model.n) ** 2)
    return {"statistic": stat, "df": k, "p_value": sp.chi2_sf(stat, k)}


def white(df: DataFrame, model: LinearFit) -> dict:
    cols = [operand(c) for c in model.x]
    d = df.select((residuals(df, model) ** 2).alias("__e2"), *[c.alias(f"__x{i}") for i, c in enumerate(cols)], *[(cols[i] * cols[j]).alias(f"__q{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))])
    m = fit(d, "__e2", [c for c in d.columns if c != "__e2"])
    k = len(m.beta) - 1
    stat = m.n * (1 - m.rss / m.tss)
    return {"statistic": stat, "df": k, "p_value": sp.chi2_sf(stat, k)}


def goldfeld_quandt(df: DataFrame, y: str, x: list[str], by: str, drop: float = 0.2) -> dict:
    """The variances of the lower and the upper part by ``by``."""
    lo, hi = df.agg(F.percentile(operand(by), [(1 - drop) / 2, (1 + drop) / 2])).first()[0]
    a, b = fit(df.where(F.col(by) <= lo), y, x), fit(df.where(F.col(by) >= hi), y, x)
    stat = (b.rss / b.df) / (a.rss / a.df)
    return {"statistic": stat, "df1": b.df, "df2": a.df, "p_value": sp.f_sf(stat, b.df, a.df)}


def jarque_bera(df: DataFrame, x: Column | str) -> dict:
    d = df.select(operand(x).alias("e"))
    r = d.agg(F.count("e").alias("n"), F.skewness("e").alias("s"), F.kurtosis("e").alias("k")).first()
    stat = r["n"] / 6 * (r["s"] ** 2 + r["k"] ** 2 / 4)
    return {"statistic": stat, "skewness": r["s"], "excess_kurtosis": r["k"], "p_value": sp.chi2_sf(stat, 2)}


def durbin_watson(df: DataFrame, e: Column, order: list[str], partition: list[str] = ()) -> dict:
    w = Window.partitionBy(*partition).orderBy(*order)
    d = df.select(e.alias("e"), *order, *partition).select("e", F.lag("e").over(w).alias("l"))
    r = d.agg(F.sum((F.col("e") - F.col("l")) ** 2).alias("a"), F.sum(F.col("e") ** 2).alias("b")).first()
    return {"statistic": r["a"] / r["b"]}


def breusch_godfrey(df: DataFrame, model: LinearFit, order: str, lags: int = 1) -> dict:
    w = Window.orderBy(order)
    d = df.select(F.col(order), residuals(df, model).alias("__e"), *[operand(c).alias(f"__x{i}") for i, c in enumerate(model.x)])
    d = d.select("__e", *[f"__x{i}" for i in range(len(model.x))], *[F.coalesce(F.lag("__e", q).over(w), F.lit(0.0)).alias(f"__l{q}") for q in range(1, lags + 1)])
    m = fit(d, "__e", [c for c in d.columns if c != "__e"])
    stat = m.n * (1 - m.rss / m.tss)
    return {"statistic": stat, "df": lags, "p_value": sp.chi2_sf(stat, lags)}


def reset(df: DataFrame, model: LinearFit, powers: int = 3) -> dict:
    """Ramsey's test by powers of the fitted values, scaled to keep them small."""
    s = moments(df.select(model.linear().alias("f")), ["f"])["f"]
    f = (model.linear() - s["mean"]) / math.sqrt(s["var"])
    extra = [F.pow(f, F.lit(float(p))) for p in range(2, powers + 1)]
    big = fit(df, model.y, [*model.x, *extra])
    q = len(extra)
    stat = ((model.rss - big.rss) / q) / (big.rss / big.df)
    return {"statistic": stat, "df1": q, "df2": big.df, "p_value": sp.f_sf(stat, q, big.df)}


def chow(df: DataFrame, y: str, x: list[str], split: Column) -> dict:
    a, b, whole = fit(df.where(split), y, x), fit(df.where(~split), y, x), fit(df, y, x)
    k = len(whole.beta)
    stat = ((whole.rss - a.rss - b.rss) / k) / ((a.rss + b.rss) / (whole.n - 2 * k))
    return {"statistic": stat, "df1": k, "df2": whole.n - 2 * k, "p_value": sp.f_sf(stat, k, whole.n - 2 * k)}


def influence(df: DataFrame, model: LinearFit) -> DataFrame:
    """Adds residual, leverage, studentised residual, Cook's distance and DFFITS, as expressions."""
    design = _design(model.x, model.constant)
    inv, k, s2 = model.extra["inv"], len(model.beta), model.rss / model.df
    h = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            h = h + F.lit(float(inv[i, j])) * design[i] * design[j]
    d = df.withColumn("residual", residuals(df, model)).withColumn("leverage", h)
    e, lev = F.col("residual"), F.col("leverage")
    ext = F.sqrt((F.lit(model.rss) - e * e / (1 - lev)) / (model.df - 1))
    return d.withColumn("standardized", e / F.sqrt(s2 * (1 - lev))).withColumn("studentized", e / (ext * F.sqrt(1 - lev))).withColumn("cooks_distance", e * e * lev / (k * s2 * (1 - lev) ** 2)).withColumn("dffits", F.col("studentized") * F.sqrt(lev / (1 - lev)))


def wald(model: LinearFit, restriction: np.ndarray, value: np.ndarray) -> dict:
    """R b = r."""
    r = np.atleast_2d(restriction)
    d = r @ model.beta - value
    f = float(d @ np.linalg.solve(r @ model.covariance @ r.T, d)) / len(r)
    return {"statistic": f, "df1": len(r), "df2": model.df, "p_value": sp.f_sf(f, len(r), model.df)}


def likelihood_ratio(small: float, large: float, df: int) -> dict:
    stat = 2 * (large - small)
    return {"statistic": stat, "df": df, "p_value": sp.chi2_sf(stat, df)}


# -- workflows -----------------------------------------------------------------------------------------------------


def hierarchical(df: DataFrame, y: str, blocks: list[list[str]]) -> list[dict]:
    """Block entry: R squared and its change with each block."""
    out, used, before = [], [], None
    for i, b in enumerate(blocks):
        used = used + b
        m = fit(df, y, used)
        r2 = 1 - m.rss / m.tss
        f = ((before.rss - m.rss) / len(b)) / (m.rss / m.df) if before else (r2 / len(b)) / ((1 - r2) / m.df)
        out.append({"stage": i + 1, "r_squared": r2, "change": r2 - (1 - before.rss / before.tss if before else 0.0), "f_change": f, "p_value": sp.f_sf(f, len(b), m.df)})
        before = m
    return out


def stepwise(df: DataFrame, y: str, x: list[str], direction: str = "both", criterion: str = "aic") -> list[str]:
    """Selection on one Gram matrix: no further pass over the rows."""
    mean, s, n = cross(df, [y, *x])

    def score(use: tuple[int, ...]) -> float:
        idx = [i + 1 for i in use]
        rss = s[0, 0] - (s[0, idx] @ np.linalg.solve(s[np.ix_(idx, idx)], s[idx, 0]) if idx else 0.0)
        k = len(use) + 2
        return n * math.log(rss / n) + (2 * k if criterion == "aic" else k * math.log(n))

    use = set(range(len(x))) if direction == "backward" else set()
    while True:
        now = score(tuple(sorted(use)))
        moves = []
        if direction != "backward":
            moves += [use | {i} for i in range(len(x)) if i not in use]
        if direction != "forward":
            moves += [use - {i} for i in use]
        best = min(moves, key=lambda m: score(tuple(sorted(m))), default=None)
        if best is None or score(tuple(sorted(best))) >= now - 1e-10:
            return [x[i] for i in sorted(use)]
        use = best


def ridge(df: DataFrame, y: str, x: list[str], lam: float, standardize: bool = True) -> np.ndarray:
    """Constant and slopes; the penalty is ``lam`` times the squared standardised slopes per observation."""
    mean, s, n = cross(df, [y, *x])
    d = np.sqrt(np.diag(s)[1:] / n) if standardize else np.ones(len(x))
    a = s[1:, 1:] / np.outer(d, d) / n
    b = np.linalg.solve(a + lam * np.eye(len(x)), s[1:, 0] / d / n) / d
    return np.concatenate([[mean[0] - mean[1:] @ b], b])


def lasso(df: DataFrame, y: str, x: list[str], lam: float, mix: float = 1.0, standardize: bool = True, iterations: int = 10_000, tolerance: float = 1e-9) -> np.ndarray:
    """Coordinate descent on the Gram matrix; ``mix`` below 1 is the elastic net."""
    mean, s, n = cross(df, [y, *x])
    d = np.sqrt(np.diag(s)[1:] / n) if standardize else np.ones(len(x))
    a, c = s[1:, 1:] / np.outer(d, d) / n, s[1:, 0] / d / n
    b = np.zeros(len(x))
    for _ in range(iterations):
        old = b.copy()
        for j in range(len(x)):
            r = c[j] - a[j] @ b + a[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - lam * mix, 0.0) / (a[j, j] + lam * (1 - mix))
        if np.max(np.abs(b - old)) < tolerance:
            break
    b = b / d
    return np.concatenate([[mean[0] - mean[1:] @ b], b])


def pls(df: DataFrame, y: str, x: list[str], components: int, standardize: bool = True) -> np.ndarray:
    """One response; NIPALS on the Gram matrix."""
    mean, s, n = cross(df, [y, *x])
    d = np.sqrt(np.diag(s)[1:] / (n - 1)) if standardize else np.ones(len(x))
    a, c = s[1:, 1:] / np.outer(d, d), s[1:, 0] / d
    w_all, p_all, q_all = [], [], []
    axx, axy = a.copy(), c.copy()
    for _ in range(components):
        w = axy / np.linalg.norm(axy)
        tt = w @ axx @ w
        p, q = axx @ w / tt, axy @ w / tt
        w_all.append(w), p_all.append(p), q_all.append(q)
        axx = axx - tt * np.outer(p, p)
        axy = axy - tt * q * p
    w, p = np.array(w_all).T, np.array(p_all).T
    b = w @ np.linalg.solve(p.T @ w, np.array(q_all)) / d
    return np.concatenate([[mean[0] - mean[1:] @ b], b])


def deming(df: DataFrame, y: str, x: str, variance_ratio: float = 1.0) -> dict:
    mean, s, n = cross(df, [y, x])
    syy, sxx, sxy = s[0, 0], s[1, 1], s[0, 1]
    b = (syy - variance_ratio * sxx + math.sqrt((syy - variance_ratio * sxx) ** 2 + 4 * variance_ratio * sxy**2)) / (2 * sxy)
    return {"slope": b, "intercept": mean[0] - b * mean[1], "n": n}


def curve(df: DataFrame, y: str, x: str, family: str = "linear", degree: int = 2) -> LinearFit:
    """linear, polynomial, logarithmic, inverse, exponential, power (the last two fit the logarithm)."""
    v, u = operand(x), operand(y)
    target = F.ln(u) if family in ("exponential", "power") else u
    if family == "polynomial":
        m = moments(df, [x])[x]
        z = (v - m["mean"]) / math.sqrt(m["var"])
        cols = [F.pow(z, F.lit(float(p))) for p in range(1, degree + 1)]
    else:
        cols = [{"linear": v, "exponential": v, "logarithmic": F.ln(v), "power": F.ln(v), "inverse": 1 / v}[family]]
    return fit(df.select(target.alias("__y"), *[c.alias(f"__x{i}") for i, c in enumerate(cols)]), "__y", [f"__x{i}" for i in range(len(cols))])


def restricted_cubic_spline(df: DataFrame, y: str, x: str, knots: int = 4) -> LinearFit:
    at = [0.1, 0.5, 0.9] if knots == 3 else [float(v) for v in np.linspace(0.05, 0.95, knots)]
    t = df.agg(F.percentile(operand(x), at)).first()[0]
    v = operand(x)
    pos = lambda k: F.pow(F.greatest(v - t[k], F.lit(0.0)), F.lit(3.0))
    scale = (t[-1] - t[0]) ** 2
    basis = [(pos(j) - pos(knots - 2) * ((t[-1] - t[j]) / (t[-1] - t[-2])) + pos(knots - 1) * ((t[-2] - t[j]) / (t[-1] - t[-2]))) / scale for j in range(knots - 2)]
    m = fit(df, y, [x, *basis])
    m.extra["knots"] = t
    return m


def threshold(df: DataFrame, y: str, x: list[str], by: str, trimming: float = 0.15, candidates: int = 50) -> dict:
    """The split of ``by`` with the least residual sum; candidate quantiles are tried on Gram sums per interval, so the rows
    are read twice in all."""
    q = [trimming + (1 - 2 * trimming) * i / (candidates - 1) for i in range(candidates)]
    cuts = sorted(set(df.agg(F.percentile(operand(by), q)).first()[0]))
    cols = [F.lit(1.0), *[operand(c) for c in x], operand(y)]
    k = len(cols)
    slot = F.lit(0)
    for c in cuts:
        slot = slot + (operand(by) > c).cast("int")
    g = df.groupBy(slot.alias("s")).agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)], F.count(F.lit(1)).alias("n")).toPandas().set_index("s").sort_index()
    mats = np.zeros((len(cuts) + 1, k, k))
    for s in g.index:
        for i in range(k):
            for j in range(i, k):
                mats[s, i, j] = mats[s, j, i] = g.loc[s, f"g{i}_{j}"]

    def rss(m: np.ndarray) -> float:
        return float(m[-1, -1] - m[-1, :-1] @ np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0])

    total = [rss(mats[: i + 1].sum(0)) + rss(mats[i + 1 :].sum(0)) for i in range(len(cuts))]
    best = int(np.argmin(total))
    low, high = mats[: best + 1].sum(0), mats[best + 1 :].sum(0)
    return {"threshold": cuts[best], "rss": total[best], "low": np.linalg.solve(low[:-1, :-1], low[:-1, -1]), "high": np.linalg.solve(high[:-1, :-1], high[:-1, -1])}


def grouped(df: DataFrame, y: str, x: list[str], group: str) -> DataFrame:
    """OLS of each group from its own cross products, all groups in one aggregation."""
    import pandas as pd

    cols = [F.lit(1.0), *[operand(c) for c in x], operand(y)]
    k = len(cols)
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)])
    kind = dict(df.dtypes)[group]

    def run(it):  # noqa: ANN001, ANN202
        for p in it:
            rows = []
            for r in p.itertuples(index=False):
                m = np.zeros((k, k))
                at = 2
                for i in range(k):
                    for j in range(i, k):
                        m[i, j] = m[j, i] = r[at]
                        at += 1
                b = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
                rows += [(r[0], name, float(v), int(r[1])) for name, v in zip(["Intercept", *x], b)]
            yield pd.DataFrame(rows, columns=[group, "term", "coefficient", "n"])

    return g.mapInPandas(run, f"`{group}` {kind}, term string, coefficient double, n bigint")
