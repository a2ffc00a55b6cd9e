"""Queries of the statistical operators, and SQL for those whose statistics are arithmetic over sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.runtime import table as T
from tidewell.sources import samples
from tidewell.stats import association as AS
from tidewell.stats import decision as D
from tidewell.stats import families as FA
from tidewell.stats import hypothesis as H
from tidewell.stats import linear as L
from tidewell.stats import meta as M
from tidewell.stats import models as MO
from tidewell.stats import survival as S
from tidewell.stats import timeseries as TS
from tidewell.stats.core import frame, midranks

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None, *keep: str, name: str | None = None):  # noqa: ANN201
    """``keep``: of a dict or rows of dicts, the members that the query returns."""

    def register(f):  # noqa: ANN001, ANN202
        own = name or f.__name__

        def run(spark: SparkSession, d: str) -> DataFrame:
            got = f(spark, d)
            if isinstance(got, DataFrame):
                return got
            rows = [got] if isinstance(got, dict) else got
            rows = [{k: (float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v) for k, v in r.items() if (not keep or k in keep) and not isinstance(v, (np.ndarray, dict, list))} for r in rows]
            return frame(spark, rows)

        QUERIES[own] = run
        if sql is not None:
            SQL[own] = sql
        return f

    return register


def coefficients(r: dict, names: str = "terms", values: str = "parameters") -> list[dict]:
    return [{"term": str(t), "coefficient": float(v)} for t, v in zip(r[names], r[values])]


def _line(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with a binary return flag and the days from order to shipping."""
    rows = T(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("returned"), (F.col("l_discount") > 0.05).cast("int").alias("rebated"), (F.pmod("l_orderkey", F.lit(97)) + 1).cast("double").alias("days"))


_L = "WITH li AS (SELECT *, (l_returnflag = 'R')::INT AS returned, (l_discount > 0.05)::INT AS rebated, CAST(l_orderkey % 97 + 1 AS DOUBLE) AS days FROM lineitem) "


# -- tests ---------------------------------------------------------------------------------------------------------


@query("SELECT (avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df, avg(l_quantity) AS estimate FROM lineitem", "statistic", "df", "estimate")
def test_t_one_sample(spark: SparkSession, d: str) -> dict:
    return H.t_one_sample(T(spark, d, "lineitem"), "l_quantity", 25.0)


@query("SELECT avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))) AS statistic FROM lineitem", "statistic")
def test_t_paired(spark: SparkSession, d: str) -> dict:
    return H.t_paired(T(spark, d, "lineitem"), "l_discount", "l_tax")


_AB = "WITH g AS (SELECT o_orderstatus AS s, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), a AS (SELECT * FROM g WHERE s = 'F'), b AS (SELECT n AS n2, m AS m2, v AS v2 FROM g WHERE s = 'O') "


@query(_AB + "SELECT (m - m2) / sqrt(v / n + v2 / n2) AS statistic, pow(v / n + v2 / n2, 2) / (pow(v / n, 2) / (n - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM a, b", "statistic", "df")
def test_t_welch(spark: SparkSession, d: str) -> dict:
    return H.t_independent(T(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", "O")


@query(_AB + "SELECT (m - m2) / sqrt(((n - 1) * v + (n2 - 1) * v2) / (n + n2 - 2) * (1.0 / n + 1.0 / n2)) AS statistic, CAST(n + n2 - 2 AS DOUBLE) AS df FROM a, b", "statistic", "df")
def test_t_pooled(spark: SparkSession, d: str) -> dict:
    return H.t_independent(T(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", "O", True)


@query("SELECT (avg(l_quantity) - 25) / (14 / sqrt(count(*))) AS statistic FROM lineitem", "statistic")
def test_z_mean(spark: SparkSession, d: str) -> dict:
    return H.z_mean(T(spark, d, "lineitem"), "l_quantity", 25.0, 14.0)


@query(_L + "SELECT (avg(returned) - 0.25) / sqrt(0.25 * 0.75 / count(*)) AS statistic, avg(returned) AS estimate FROM li", "statistic", "estimate")
def test_z_proportion(spark: SparkSession, d: str) -> dict:
    return H.z_proportion(_line(spark, d), "returned", 0.25)


@query()
def test_binomial(spark: SparkSession, d: str) -> dict:
    return H.binomial(_line(spark, d), "returned", 0.25)


@query(_L + "SELECT sum(l_linenumber) / count(*) AS estimate FROM li", "estimate")
def test_poisson(spark: SparkSession, d: str) -> dict:
    return H.poisson_rate(_line(spark, d), "l_linenumber", 3.5)


@query(_L + ", g AS (SELECT l_linestatus AS s, sum(returned) AS k, count(*) AS n FROM li GROUP BY 1), a AS (SELECT k, n FROM g WHERE s = 'F'), b AS (SELECT k AS k2, n AS n2 FROM g WHERE s = 'O') SELECT (k / n - k2 / n2) / sqrt(((k + k2) / (n + n2)) * (1 - (k + k2) / (n + n2)) * (1.0 / n + 1.0 / n2)) AS statistic FROM a, b", "statistic")
def test_proportion_two(spark: SparkSession, d: str) -> dict:
    return H.proportion_two(_line(spark, d), "returned", "l_linestatus", "F", "O")


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT a, b, coalesce(n, 0) AS n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS x FROM c)
SELECT sum((n - x) * (n - x) / x) AS statistic, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS DOUBLE) AS df FROM e""", "statistic", "df")
def test_chi2_independence(spark: SparkSession, d: str) -> dict:
    return H.chi2_independence(T(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(_L + "SELECT pow(b - c, 2) / (b + c) AS statistic FROM (SELECT count(*) FILTER (returned = 0 AND rebated = 1) AS b, count(*) FILTER (returned = 1 AND rebated = 0) AS c FROM li)", "statistic")
def test_mcnemar(spark: SparkSession, d: str) -> dict:
    return H.mcnemar(_line(spark, d), "returned", "rebated")


@query()
def test_cmh(spark: SparkSession, d: str) -> dict:
    return H.cmh(_line(spark, d), "rebated", "returned", "l_linestatus")


@query()
def test_equivalence(spark: SparkSession, d: str) -> dict:
    return H.equivalence(T(spark, d, "lineitem"), "l_quantity", 24.0, 27.0)


_OW = "WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT sum(n) AS nn, sum(n * m) / sum(n) AS mm, count(*) AS k FROM g) "


@query(_OW + "SELECT (sum(n * pow(m - mm, 2)) / (any_value(k) - 1)) / (sum((n - 1) * v) / (any_value(nn) - any_value(k))) AS statistic, sum(n * pow(m - mm, 2)) AS ss_between FROM g, t", "statistic", "ss_between")
def anova_one_way(spark: SparkSession, d: str) -> dict:
    return H.one_way(T(spark, d, "orders"), "o_totalprice", "o_orderpriority")


@query(_OW + "SELECT ((any_value(nn) - any_value(k)) * ln(sum((n - 1) * v) / (any_value(nn) - any_value(k))) - sum((n - 1) * ln(v))) / (1 + (sum(1.0 / (n - 1)) - 1.0 / (any_value(nn) - any_value(k))) / (3 * (any_value(k) - 1))) AS statistic FROM g, t", "statistic")
def test_bartlett(spark: SparkSession, d: str) -> dict:
    return H.bartlett(T(spark, d, "orders"), "o_totalprice", "o_orderpriority")


for _name, _center in (("test_levene", "avg"), ("test_brown_forsythe", "median")):
    _z = f"WITH c AS (SELECT o_orderpriority AS p, {_center}(o_totalprice) AS c FROM orders GROUP BY 1), z AS (SELECT p, abs(o_totalprice - c) AS z FROM orders JOIN c ON p = o_orderpriority), g AS (SELECT p, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM z GROUP BY 1), t AS (SELECT sum(n) AS nn, sum(n * m) / sum(n) AS mm, count(*) AS k FROM g) "
    query(_z + "SELECT (sum(n * pow(m - mm, 2)) / (any_value(k) - 1)) / (sum((n - 1) * v) / (any_value(nn) - any_value(k))) AS statistic FROM g, t", "statistic", name=_name)(lambda spark, d, c=_center: H.levene(T(spark, d, "orders"), "o_totalprice", "o_orderpriority", "mean" if c == "avg" else c))


_RANKS = "WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem{}), t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*) AS c FROM lineitem{} GROUP BY l_quantity)), n AS (SELECT count(*) AS n FROM r) "


@query(_RANKS.format("", "") + ", h AS (SELECT g, sum(r) AS s, count(*) AS k FROM r GROUP BY 1) SELECT (12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / k) - 3 * (any_value(n) + 1)) / (1 - any_value(t) / (pow(any_value(n), 3) - any_value(n))) AS statistic FROM h, t, n", "statistic")
def test_kruskal_wallis(spark: SparkSession, d: str) -> dict:
    return H.kruskal_wallis(T(spark, d, "lineitem"), "l_quantity", "l_returnflag")


_AR = " WHERE l_returnflag IN ('A', 'R')"


@query(_RANKS.format(_AR, _AR) + "SELECT sum(r) - count(*) * (count(*) + 1) / 2 AS statistic FROM r WHERE g = 'A'", "statistic")
def test_mann_whitney(spark: SparkSession, d: str) -> dict:
    return H.mann_whitney(T(spark, d, "lineitem"), "l_quantity", "l_returnflag", "A", "R")


@query("WITH d AS (SELECT l_discount - l_tax AS d FROM lineitem WHERE l_discount - l_tax <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d) SELECT sum(r) FILTER (d > 0) AS statistic, CAST(count(*) AS DOUBLE) AS n FROM r", "statistic", "n")
def test_wilcoxon_paired(spark: SparkSession, d: str) -> dict:
    return H.wilcoxon_paired(T(spark, d, "lineitem"), "l_discount", "l_tax")


@query()
def test_mood_median(spark: SparkSession, d: str) -> dict:
    return H.mood_median(T(spark, d, "orders"), "o_totalprice", "o_orderpriority")


@query()
def test_friedman(spark: SparkSession, d: str) -> dict:
    return H.friedman(T(spark, d, "lineitem"), ["l_discount", "l_tax", "l_quantity"])


@query()
def test_cochran_q(spark: SparkSession, d: str) -> dict:
    return H.cochran_q(_line(spark, d).withColumn("big", (F.col("l_quantity") > 25).cast("int")), ["returned", "rebated", "big"])


@query("WITH s AS (SELECT user_id, (value > 50)::INT AS v, lag((value > 50)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT CAST(count(*) FILTER (p IS NULL OR p <> v) AS DOUBLE) AS runs FROM s", "runs")
def test_runs(spark: SparkSession, d: str) -> dict:
    return H.runs(T(spark, d, "events").withColumn("v", (F.col("value") > 50).cast("int")), "v", ["event_id"], ["user_id"])


@query()
def test_mann_kendall(spark: SparkSession, d: str) -> dict:
    return H.mann_kendall(T(spark, d, "orders"), "o_totalprice", "o_orderkey")


# -- association ---------------------------------------------------------------------------------------------------


@query("SELECT corr(l_quantity, l_extendedprice) AS coefficient, CAST(count(*) AS DOUBLE) AS observations FROM lineitem", "coefficient", "observations")
def correlation_pearson(spark: SparkSession, d: str) -> dict:
    return AS.pearson(T(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS b FROM lineitem) SELECT round(corr(a, b), 9) AS coefficient FROM r")
def correlation_spearman(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, {"coefficient": round(AS.spearman(T(spark, d, "lineitem"), "l_quantity", "l_discount")["coefficient"], 9)})


@query("WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem) SELECT (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS coefficient FROM r", "coefficient")
def correlation_partial(spark: SparkSession, d: str) -> dict:
    return AS.partial(T(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_discount"])


@query()
def correlation_kendall(spark: SparkSession, d: str) -> dict:
    return AS.kendall(T(spark, d, "lineitem"), "l_quantity", "l_discount")


@query(_L + ", p AS (SELECT avg((returned = rebated)::INT) AS o, avg(returned) AS a, avg(rebated) AS b FROM li) SELECT (o - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) AS kappa FROM p", "kappa")
def agreement_kappa(spark: SparkSession, d: str) -> dict:
    return AS.kappa(_line(spark, d), "returned", "rebated")


@query("SELECT avg(l_discount - l_tax) AS bias, stddev_samp(l_discount - l_tax) AS sd, avg(l_discount - l_tax) - 1.959963984540054 * stddev_samp(l_discount - l_tax) AS lower FROM lineitem", "bias", "sd", "lower")
def agreement_bland_altman(spark: SparkSession, d: str) -> dict:
    return AS.bland_altman(T(spark, d, "lineitem"), "l_discount", "l_tax")


@query()
def agreement_icc(spark: SparkSession, d: str) -> dict:
    return AS.icc(T(spark, d, "lineitem"), ["l_discount", "l_tax"])


@query("WITH g AS (SELECT l_returnflag, count(*) AS n, var_samp(l_linenumber) AS v FROM lineitem GROUP BY 1) SELECT l_returnflag, n, greatest(1 - v / 4.0, 0) AS rwg, v > 4.0 AS variance_truncated FROM g")
def agreement_rwg(spark: SparkSession, d: str) -> DataFrame:
    return AS.rwg(T(spark, d, "lineitem"), "l_returnflag", "l_linenumber", 7)


@query("WITH c AS (SELECT l_quantity AS v, count(*) AS k FROM lineitem GROUP BY 1), r AS (SELECT v, sum(k) OVER (ORDER BY v) - k + (k + 1) / 2 AS r FROM c) SELECT l_orderkey, l_linenumber, r AS rank FROM lineitem JOIN r ON v = l_quantity")
def mid_ranks(spark: SparkSession, d: str) -> DataFrame:
    return midranks(T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").select("l_orderkey", "l_linenumber", "rank")


# -- linear models -------------------------------------------------------------------------------------------------


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r_squared FROM lineitem")
def ols_simple(spark: SparkSession, d: str) -> DataFrame:
    m = L.fit(T(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return frame(spark, {"slope": round(float(m.beta[1]), 6), "intercept": round(float(m.beta[0]), 6), "r_squared": round(1 - m.rss / m.tss, 9)})


for _cov in ("nonrobust", "hc0", "hc1", "hc2", "hc3", "cluster"):
    query(name=f"ols_{_cov}")(lambda spark, d, c=_cov: L.fit(_line(spark, d), "l_extendedprice", ["l_quantity", "l_discount"], covariance=c, clusters="l_linestatus" if c == "cluster" else None).rows())


@query("SELECT l_orderkey, l_linenumber, regr_intercept(l_extendedprice, l_quantity) OVER () + regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity AS prediction FROM lineitem")
def ols_predict(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "lineitem")
    return L.predict(rows, L.fit(rows, "l_extendedprice", ["l_quantity"])).select("l_orderkey", "l_linenumber", "prediction")


@query()
def ols_weighted(spark: SparkSession, d: str) -> list:
    return L.fit(_line(spark, d), "l_extendedprice", ["l_quantity"], "days").rows()


@query()
def ols_summary(spark: SparkSession, d: str) -> dict:
    return L.fit(_line(spark, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).summary()


@query()
def anova_two_way(spark: SparkSession, d: str) -> list:
    return L.anova(T(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"], interactions=False)


@query()
def anova_covariance(spark: SparkSession, d: str) -> list:
    return L.anova(T(spark, d, "lineitem"), "l_extendedprice", ["l_linestatus"], ["l_quantity"])


@query()
def anova_multivariate(spark: SparkSession, d: str) -> dict:
    return L.manova(T(spark, d, "lineitem"), ["l_discount", "l_tax"], "l_returnflag")


@query()
def multiple_comparisons(spark: SparkSession, d: str) -> list:
    return L.multiple_comparisons(T(spark, d, "orders"), "o_totalprice", "o_orderpriority", "holm")


@query("SELECT o_orderkey, o_totalprice - 1.959963984540054 * 10 AS lower, o_totalprice + 1.959963984540054 * 10 AS upper FROM orders")
def confidence_intervals(spark: SparkSession, d: str) -> DataFrame:
    return L.confidence_intervals(T(spark, d, "orders").withColumn("se", F.lit(10.0)), "o_totalprice", "se").select("o_orderkey", "lower", "upper")


for _m in ("2sls", "liml", "gmm"):
    query(name=f"iv_{_m}")(lambda spark, d, m=_m: coefficients(L.iv(_line(spark, d), "l_extendedprice", ["l_quantity"], ["l_tax"], ["l_discount", "l_linenumber", "days"], m), values="coefficients"))


def _panel(spark: SparkSession, d: str, method: str) -> list[dict]:
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = T(spark, d, "events").withColumn("x", F.pmod("event_id", F.lit(13)).cast("double")).withColumn("t", turn)
    m = L.panel(rows, "value", ["x"], "user_id", "t", method)
    return [{"term": n, "coefficient": float(b)} for n, b in zip(m.names, m.beta)]


for _m in ("fe", "be", "fd", "re"):
    query(name=f"panel_{_m}")(lambda spark, d, m=_m: _panel(spark, d, m))
SQL["panel_fe"] = "WITH e AS (SELECT user_id, value, CAST(event_id % 13 AS DOUBLE) AS x FROM events), w AS (SELECT value - avg(value) OVER (PARTITION BY user_id) AS y, x - avg(x) OVER (PARTITION BY user_id) AS x FROM e) SELECT 'x' AS term, sum(x * y) / sum(x * x) AS coefficient FROM w"
SQL["panel_be"] = "WITH g AS (SELECT avg(value) AS y, avg(CAST(event_id % 13 AS DOUBLE)) AS x FROM events GROUP BY user_id) SELECT 'Intercept' AS term, regr_intercept(y, x) AS coefficient FROM g UNION ALL SELECT 'x', regr_slope(y, x) FROM g"


@query()
def panel_did(spark: SparkSession, d: str) -> list:
    e = T(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("y"))
    e = e.withColumn("treat", (F.col("user_id") % 2).cast("double")).withColumn("post", (F.col("day") > 15).cast("double"))
    m = L.did(e, "y", "treat", "post", "user_id", "day")
    return [{"term": n, "coefficient": float(b)} for n, b in zip(m.names, m.beta)]


@query("SELECT 'l_quantity' AS term, 1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)) AS vif FROM lineitem UNION ALL SELECT 'l_extendedprice', 1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)) FROM lineitem")
def diagnostic_vif(spark: SparkSession, d: str) -> list:
    return L.vif(T(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("WITH r AS (SELECT event_id, user_id, value - avg(value) OVER () AS e FROM events), l AS (SELECT e, lag(e) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM r) SELECT sum(pow(e - p, 2)) / sum(e * e) AS statistic FROM l")
def diagnostic_durbin_watson(spark: SparkSession, d: str) -> dict:
    e = T(spark, d, "events")
    return L.durbin_watson(e, F.col("value") - F.lit(e.agg(F.avg("value")).first()[0]), ["event_id"], ["user_id"])


@query()
def diagnostic_tests(spark: SparkSession, d: str) -> list:
    rows = _line(spark, d)
    m = L.fit(rows, "l_extendedprice", ["l_quantity", "l_discount"])
    tests = {"breusch_pagan": L.breusch_pagan(rows, m), "white": L.white(rows, m), "reset": L.reset(rows, m), "jarque_bera": L.jarque_bera(rows, L.residuals(rows, m)), "goldfeld_quandt": L.goldfeld_quandt(rows, "l_extendedprice", ["l_quantity"], "l_discount"), "chow": L.chow(rows, "l_extendedprice", ["l_quantity"], F.col("l_linestatus") == "F")}
    return [{"test": k, "statistic": v["statistic"], "p_value": v["p_value"]} for k, v in tests.items()]


@query()
def diagnostic_influence(spark: SparkSession, d: str) -> DataFrame:
    rows = _line(spark, d)
    return L.influence(rows, L.fit(rows, "l_extendedprice", ["l_quantity"])).select("l_orderkey", "l_linenumber", "residual", "leverage", "studentized", "cooks_distance")


@query()
def regression_ridge(spark: SparkSession, d: str) -> list:
    x = ["l_quantity", "l_discount", "l_tax"]
    return [{"term": t, "coefficient": float(v)} for t, v in zip(["Intercept", *x], L.ridge(_line(spark, d), "l_extendedprice", x, 0.1))]


@query()
def regression_lasso(spark: SparkSession, d: str) -> list:
    x = ["l_quantity", "l_discount", "l_tax"]
    return [{"term": t, "coefficient": float(v)} for t, v in zip(["Intercept", *x], L.lasso(_line(spark, d), "l_extendedprice", x, 50.0))]


@query()
def regression_pls(spark: SparkSession, d: str) -> list:
    x = ["l_quantity", "l_discount", "l_tax"]
    return [{"term": t, "coefficient": float(v)} for t, v in zip(["Intercept", *x], L.pls(_line(spark, d), "l_extendedprice", x, 2))]


@query("WITH s AS (SELECT var_samp(l_extendedprice) AS y, var_samp(l_quantity) AS x, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem) SELECT round((y - x + sqrt(pow(y - x, 2) + 4 * c * c)) / (2 * c), 5) AS slope FROM s")
def regression_deming(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, {"slope": round(L.deming(T(spark, d, "lineitem"), "l_extendedprice", "l_quantity")["slope"], 5)})


@query("SELECT l_returnflag, 'Intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 5) AS coefficient, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 5), count(*) FROM lineitem GROUP BY 1")
def regression_grouped(spark: SparkSession, d: str) -> DataFrame:
    return L.grouped(T(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "l_returnflag").withColumn("coefficient", F.round("coefficient", 5))


@query()
def regression_stepwise(spark: SparkSession, d: str) -> DataFrame:
    """No rows if the constant alone is best."""
    terms = L.stepwise(_line(spark, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "days"])
    return spark.createDataFrame([(t,) for t in terms], "term string")


@query()
def regression_hierarchical(spark: SparkSession, d: str) -> list:
    return L.hierarchical(_line(spark, d), "l_extendedprice", [["l_quantity"], ["l_discount", "l_tax"]])


@query()
def regression_spline(spark: SparkSession, d: str) -> list:
    return L.restricted_cubic_spline(_line(spark, d), "l_extendedprice", "l_quantity").rows()


@query(None, "threshold", "rss")
def regression_threshold(spark: SparkSession, d: str) -> dict:
    return L.threshold(_line(spark, d), "l_extendedprice", ["l_quantity"], "l_discount")


_MODELS = {
    "logit": lambda r: MO.logit(r, "returned", ["l_quantity", "l_discount"]),
    "probit": lambda r: MO.probit(r, "returned", ["l_quantity"]),
    "cloglog": lambda r: MO.cloglog(r, "returned", ["l_quantity"]),
    "poisson": lambda r: MO.poisson(r, "l_linenumber", ["l_quantity"]),
    "gamma": lambda r: MO.gamma(r, "l_extendedprice", ["l_quantity"]),
    "tobit": lambda r: MO.tobit(r, "l_discount", ["l_quantity"]),
    "robust_huber": lambda r: MO.robust(r, "l_extendedprice", ["l_quantity"], iterations=15),
    "quantile": lambda r: MO.quantile(r, "l_extendedprice", ["l_quantity"]),
    "firth": lambda r: MO.firth_logit(r, "returned", ["l_quantity"]),
}
for _n, _f in _MODELS.items():
    query(name=f"model_{_n}")(lambda spark, d, n=_n: coefficients(_MODELS[n](_line(spark, d))))


@query()
def mixed_random_intercept(spark: SparkSession, d: str) -> dict:
    r = MO.random_intercept(T(spark, d, "events").withColumn("x", F.pmod("event_id", F.lit(13)).cast("double")), "value", ["x"], "user_id")
    return {"intercept": float(r["parameters"][0]), "slope": float(r["parameters"][1]), "sigma2": r["sigma2"], "tau2": r["tau2"]}


@query()
def longitudinal_gee(spark: SparkSession, d: str) -> list:
    return coefficients(MO.gee(T(spark, d, "events").withColumn("x", F.pmod("event_id", F.lit(13)).cast("double")), "value", ["x"], "user_id"))


@query()
def causal_effects(spark: SparkSession, d: str) -> list:
    rows, x = _line(spark, d), ["l_quantity", "l_tax"]
    return [{"method": n, "ate": f(rows, "l_extendedprice", "returned", x)["ate"]} for n, f in (("ipw", MO.ipw), ("regression_adjustment", MO.regression_adjustment), ("aipw", MO.aipw), ("matching", MO.matching))]


@query()
def causal_rdd(spark: SparkSession, d: str) -> dict:
    return MO.rdd(_line(spark, d), "l_extendedprice", "l_quantity", 25.0, 10.0)


# -- survival ------------------------------------------------------------------------------------------------------

_LIFE = _L + ", c AS (SELECT l_linestatus AS g, days AS time, sum(returned) AS d, count(*) AS n FROM li GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY time DESC) AS r FROM c) "


@query(_LIFE + "SELECT g AS l_linestatus, time, CAST(d AS BIGINT) AS events, CAST(r AS BIGINT) AS at_risk, exp(sum(CASE WHEN d < r THEN ln(1 - d / r) END) OVER w) AS survival, exp(sum(CASE WHEN d < r THEN ln(1 - d / r) END) OVER w) * sqrt(sum(CASE WHEN d < r THEN d / (r * (r - d)) END) OVER w) AS standard_error FROM r WHERE d > 0 AND d < r WINDOW w AS (PARTITION BY g ORDER BY time)")
def survival_kaplan_meier(spark: SparkSession, d: str) -> DataFrame:
    return S.kaplan_meier(_line(spark, d), "days", "returned", ["l_linestatus"])


@query(_LIFE + "SELECT g AS l_linestatus, time, CAST(d AS BIGINT) AS events, CAST(r AS BIGINT) AS at_risk, sum(d / r) OVER w AS cumulative_hazard, sqrt(sum(d / (r * r)) OVER w) AS standard_error FROM r WHERE d > 0 WINDOW w AS (PARTITION BY g ORDER BY time)")
def survival_nelson_aalen(spark: SparkSession, d: str) -> DataFrame:
    return S.nelson_aalen(_line(spark, d), "days", "returned", ["l_linestatus"])


@query()
def survival_logrank(spark: SparkSession, d: str) -> dict:
    return S.logrank(_line(spark, d), "days", "returned", "l_linestatus")


@query()
def survival_competing_risks(spark: SparkSession, d: str) -> DataFrame:
    return S.competing_risks(_line(spark, d).withColumn("status", F.col("returned") + 2 * (F.col("l_returnflag") == "A").cast("int")), "days", "status")


@query()
def survival_cox(spark: SparkSession, d: str) -> list:
    return coefficients(S.cox(_line(spark, d), "days", "returned", ["l_quantity", "l_discount"], ties="breslow"), values="coefficients")


@query()
def survival_weibull(spark: SparkSession, d: str) -> list:
    return coefficients(S.parametric(_line(spark, d), "days", "returned", ["l_quantity"]))


# -- series --------------------------------------------------------------------------------------------------------


@query("WITH m AS (SELECT user_id, event_id, value - avg(value) OVER () AS d FROM events), l AS (SELECT d, lag(d, 1) OVER w AS a, lag(d, 2) OVER w AS b FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT CAST(0 AS DOUBLE) AS lag, CAST(1 AS DOUBLE) AS acf UNION ALL SELECT 1, sum(d * a) / sum(d * d) FROM l UNION ALL SELECT 2, sum(d * b) / sum(d * d) FROM l")
def series_acf(spark: SparkSession, d: str) -> list:
    return TS.acf(T(spark, d, "events"), "value", ["event_id"], 2, ["user_id"])


@query()
def series_adf(spark: SparkSession, d: str) -> dict:
    return TS.adf(_monthly(spark, d), "y", "t")


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t")).agg(F.avg("o_totalprice").alias("y"), F.count(F.lit(1)).cast("double").alias("n"), F.max("o_totalprice").alias("z"))
    return o


@query()
def series_var(spark: SparkSession, d: str) -> list:
    m = TS.var(_monthly(spark, d), ["y", "n"], "t", 2)
    return TS.granger(m)


@query()
def series_var_lag_order(spark: SparkSession, d: str) -> list:
    return TS.lag_order(_monthly(spark, d), ["y", "n"], "t", 3)


@query()
def series_johansen(spark: SparkSession, d: str) -> list:
    return TS.johansen(_monthly(spark, d), ["y", "n"], "t", 2)


@query()
def series_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """ARIMA, smoothing and grey forecasts of the monthly mean."""

    def run(y: np.ndarray) -> dict:
        return {"step": np.arange(1, 7), "arima": TS.arima(y, horizon=6)["forecast"], "ses": TS.ets(y, horizon=6)["forecast"], "holt": TS.ets(y, True, horizon=6)["forecast"], "grey": TS.grey(y, 6)["forecast"]}

    return TS.per_series(_monthly(spark, d), "y", ["t"], run, "step long, arima double, ses double, holt double, grey double")


# -- meta-analysis -------------------------------------------------------------------------------------------------

_STUDIES = "WITH s AS (SELECT c_nationkey AS study, avg(c_acctbal) / 1000 AS effect, var_samp(c_acctbal) / 1e6 / count(*) AS variance FROM customer GROUP BY 1) "


def _studies(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "customer").groupBy(F.col("c_nationkey").alias("study")).agg((F.avg("c_acctbal") / 1000).alias("effect"), (F.var_samp("c_acctbal") / 1e6 / F.count(F.lit(1))).alias("variance"))


@query(_STUDIES + "SELECT sum(effect / variance) / sum(1 / variance) AS effect, sqrt(1 / sum(1 / variance)) AS standard_error, sum(effect * effect / variance) - pow(sum(effect / variance), 2) / sum(1 / variance) AS q FROM s", "effect", "standard_error", "q")
def meta_fixed(spark: SparkSession, d: str) -> dict:
    return M.pool(_studies(spark, d))


@query(_STUDIES + ", a AS (SELECT sum(1 / variance) AS w, sum(1 / variance / variance) AS w2, sum(effect * effect / variance) - pow(sum(effect / variance), 2) / sum(1 / variance) AS q, count(*) AS k FROM s), t AS (SELECT greatest(0, (q - (k - 1)) / (w - w2 / w)) AS t FROM a) SELECT sum(effect / (variance + t)) / sum(1 / (variance + t)) AS effect, any_value(t) AS tau_squared FROM s, t", "effect", "tau_squared")
def meta_random(spark: SparkSession, d: str) -> dict:
    return M.pool(_studies(spark, d), "dl")


@query(_STUDIES + "SELECT study, (SELECT sum(b.effect / b.variance) / sum(1 / b.variance) FROM s b WHERE b.study <> s.study) AS effect FROM s")
def meta_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return M.leave_one_out(_studies(spark, d), "study").select("study", "effect")


@query(_STUDIES + "SELECT regr_intercept(effect / sqrt(variance), 1 / sqrt(variance)) AS intercept FROM s", "intercept")
def meta_egger(spark: SparkSession, d: str) -> dict:
    return M.egger(_studies(spark, d))


@query()
def meta_begg(spark: SparkSession, d: str) -> dict:
    return M.begg(_studies(spark, d))


@query()
def meta_sensitivity(spark: SparkSession, d: str) -> list:
    return M.sensitivity(_studies(spark, d))


@query(_STUDIES + "SELECT CAST(study AS VARCHAR) AS study, effect, effect - 1.959963984540054 * sqrt(variance) AS lower, effect + 1.959963984540054 * sqrt(variance) AS upper FROM s")
def meta_forest(spark: SparkSession, d: str) -> DataFrame:
    return M.forest(_studies(spark, d), "study")


# -- decisions, inequality, quality, others ------------------------------------------------------------------------

_CRITERIA = ["p_size", "p_retailprice"]
_NORM = "WITH x AS (SELECT p_partkey, (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()) AS a, (max(p_retailprice) OVER () - p_retailprice) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS b FROM part) "


@query(_NORM + ", s AS (SELECT sum(a) AS sa, sum(b) AS sb, count(*) AS n FROM x), h AS (SELECT -sum(CASE WHEN a > 0 THEN a / sa * ln(a / sa) ELSE 0 END) / ln(any_value(n)) AS ha, -sum(CASE WHEN b > 0 THEN b / sb * ln(b / sb) ELSE 0 END) / ln(any_value(n)) AS hb FROM x, s) SELECT (1 - ha) / (2 - ha - hb) AS p_size, (1 - hb) / (2 - ha - hb) AS p_retailprice FROM h")
def decision_entropy_weights(spark: SparkSession, d: str) -> dict:
    return dict(zip(_CRITERIA, map(float, D.entropy_weights(T(spark, d, "part"), _CRITERIA, ["p_retailprice"]))))


@query(_NORM + "SELECT p_partkey, 0.5 * a + 0.5 * b AS score FROM x")
def decision_composite(spark: SparkSession, d: str) -> DataFrame:
    return D.composite(T(spark, d, "part"), _CRITERIA, np.array([0.5, 0.5]), ["p_retailprice"]).select("p_partkey", "score")


@query("WITH n AS (SELECT p_partkey, 0.5 * p_size / sqrt(sum(p_size * p_size) OVER ()) AS a, 0.5 * p_retailprice / sqrt(sum(p_retailprice * p_retailprice) OVER ()) AS b FROM part), m AS (SELECT *, sqrt(pow(a - max(a) OVER (), 2) + pow(b - min(b) OVER (), 2)) AS u, sqrt(pow(a - min(a) OVER (), 2) + pow(b - max(b) OVER (), 2)) AS v FROM n) SELECT p_partkey, v / (u + v) AS closeness FROM m")
def decision_topsis(spark: SparkSession, d: str) -> DataFrame:
    return D.topsis(T(spark, d, "part"), _CRITERIA, np.array([0.5, 0.5]), ["p_retailprice"]).select("p_partkey", "closeness")


@query()
def decision_scores(spark: SparkSession, d: str) -> DataFrame:
    w = np.array([0.5, 0.5])
    p = T(spark, d, "part").select("p_partkey", *_CRITERIA)
    g = D.grey_relational(p, _CRITERIA, w, ["p_retailprice"])
    g = D.vikor(g, _CRITERIA, w, ["p_retailprice"])
    return D.rank_sum_ratio(g, _CRITERIA, w, ["p_retailprice"]).select("p_partkey", "grade", "q", "wrsr")


@query()
def decision_weights(spark: SparkSession, d: str) -> list:
    p = T(spark, d, "part")
    return [{"method": m, **dict(zip(_CRITERIA, map(float, D.weights(p, _CRITERIA, m, ["p_retailprice"]))))} for m in ("equal", "entropy", "critic", "information")]


@query("SELECT CAST(count(*) FILTER (l_linenumber + 3 >= 9) AS DOUBLE) AS promoters, CAST(count(*) FILTER (l_linenumber + 3 <= 6) AS DOUBLE) AS detractors, 100.0 * (count(*) FILTER (l_linenumber + 3 >= 9) - count(*) FILTER (l_linenumber + 3 <= 6)) / count(*) AS score FROM lineitem", "promoters", "detractors", "score")
def decision_nps(spark: SparkSession, d: str) -> dict:
    return D.nps(T(spark, d, "lineitem").withColumn("r", F.col("l_linenumber") + 3), "r")


@query()
def decision_rfm(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "orders").groupBy("o_custkey").agg(F.datediff(F.lit("2000-01-01"), F.max("o_orderdate")).alias("recency"), F.count(F.lit(1)).alias("frequency"), F.sum("o_totalprice").alias("monetary"))
    return D.rfm(o, "recency", "frequency", "monetary").select("o_custkey", "r", "f", "m")


@query("WITH r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders) SELECT 2 * sum(x * (i - 0.5)) / (any_value(n) * sum(x)) - 1 AS gini, avg(x) AS mean FROM r", "gini", "mean")
def inequality_gini(spark: SparkSession, d: str) -> dict:
    return FA.gini(T(spark, d, "orders"), "o_totalprice")


@query("WITH t AS (SELECT sum(o_totalprice * ln(o_totalprice)) / sum(o_totalprice) - ln(avg(o_totalprice)) AS t, sum(o_totalprice) AS s, count(*) AS n FROM orders), g AS (SELECT sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY o_orderpriority) SELECT any_value(t) AS theil_t, sum(g.s * ln(g.s / g.n)) / any_value(t.s) - ln(any_value(t.s) / any_value(t.n)) AS between FROM g, t", "theil_t", "between")
def inequality_theil(spark: SparkSession, d: str) -> dict:
    return FA.theil(T(spark, d, "orders"), "o_totalprice", "o_orderpriority")


@query()
def inequality_dagum(spark: SparkSession, d: str) -> dict:
    return FA.dagum_gini(T(spark, d, "orders"), "o_totalprice", "o_orderstatus")


@query("WITH m AS (SELECT event_id, user_id, value AS x, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS mr FROM events), s AS (SELECT avg(x) AS m, avg(mr) AS r FROM m) SELECT event_id, user_id, x AS value, m AS center, m - 3 * r / 1.128 AS lower, m + 3 * r / 1.128 AS upper, x < m - 3 * r / 1.128 OR x > m + 3 * r / 1.128 AS out FROM m, s")
def quality_control_chart(spark: SparkSession, d: str) -> DataFrame:
    return FA.control_chart(T(spark, d, "events"), "value", ["event_id"], partition=["user_id"])


@query("WITH m AS (SELECT value AS x, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS mr FROM events) SELECT 100 / (6 * avg(mr) / 1.128) AS cp, 100 / (6 * stddev_samp(x)) AS pp FROM m", "cp", "pp")
def quality_capability(spark: SparkSession, d: str) -> dict:
    return FA.process_capability(T(spark, d, "events"), "value", 0.0, 100.0, ["event_id"], ["user_id"])


@query("WITH c AS (SELECT var_samp(l_discount) + var_samp(l_tax) AS v, var_samp(l_discount + l_tax) AS t FROM lineitem) SELECT 2 * (1 - v / t) AS alpha FROM c", "alpha")
def psychometrics_alpha(spark: SparkSession, d: str) -> dict:
    return FA.reliability(T(spark, d, "lineitem"), ["l_discount", "l_tax"])


@query()
def psychometrics_validity(spark: SparkSession, d: str) -> dict:
    return FA.validity(T(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query()
def power_table(spark: SparkSession, d: str) -> list:
    return [{"effect": e, "n_for_80": float(FA.sample_size("mean_difference", 0.8, effect_size=e)), "power_50": FA.power_of("mean_difference", 50, effect_size=e)} for e in (0.2, 0.5, 0.8)]


@query()
def design_orthogonal(spark: SparkSession, d: str) -> list:
    return [{"run": float(i + 1), **{f"factor{j + 1}": float(v) for j, v in enumerate(r)}} for i, r in enumerate(FA.orthogonal_design(3, 4))]


@query("WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT CAST(1 AS DOUBLE) AS axis, round(1 + abs(r), 9) AS eigenvalue FROM c UNION ALL SELECT 2, round(1 - abs(r), 9) FROM c")
def multivariate_pca(spark: SparkSession, d: str) -> list:
    m = FA.pca(T(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return [{"axis": float(i + 1), "eigenvalue": round(float(v), 9)} for i, v in enumerate(m["eigenvalues"])]


@query()
def multivariate_discriminant(spark: SparkSession, d: str) -> DataFrame:
    return FA.discriminant(T(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag").groupBy("l_returnflag", "predicted").count()


@query()
def multivariate_canonical(spark: SparkSession, d: str) -> dict:
    return FA.canonical(T(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"])


@query()
def path_mediation(spark: SparkSession, d: str) -> dict:
    return FA.mediation(_line(spark, d), "l_extendedprice", "l_discount", "l_quantity", ["l_tax"])


@query()
def survey_mean(spark: SparkSession, d: str) -> dict:
    return FA.survey_mean(_line(spark, d), "l_extendedprice", "days", "l_linestatus", "l_orderkey")


@query()
def spatial_moran(spark: SparkSession, d: str) -> dict:
    p = T(spark, d, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 10).cast("double").alias("x"), (F.col("s_suppkey") / 10).cast("int").cast("double").alias("y"))
    return FA.morans_i(p, "s_suppkey", "s_acctbal", FA.row_standardised(FA.neighbour_pairs(p, "s_suppkey", "x", "y", 1.5)))


@query("SELECT CAST(range AS BIGINT) AS value FROM range(10, 0, -3)")
def source_int_range(spark: SparkSession, d: str) -> DataFrame:
    return samples.int_range(spark, 10, 0, -3)


@query()
def source_samples(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for n, p in (("normal", {"mean": 0.0, "standard_deviation": 1.0}), ("gamma", {"shape": 2.0, "rate": 3.0}), ("poisson", {"rate": 4.0})):
        s = samples.sample(spark, n, 10_000, 7, **p).agg(F.lit(n).alias("distribution"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
        out = s if out is None else out.unionByName(s)
    return out
