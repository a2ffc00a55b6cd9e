"""Queries of the relational operators over the whole test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import calendar, convert, logic, numeric, text
from tidewell.operators import aggregate as A
from tidewell.operators import align, combine, groups, plots, profile
from tidewell.operators import select as S
from tidewell.operators import window as W
from tidewell.runtime import table
from tidewell.types import ORDINAL, Meaning

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


T = table
PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS row_count, count(l_quantity) AS l_quantity_count, sum(l_quantity) AS l_quantity_sum, sum(l_extendedprice * (1 - l_discount)) AS revenue_sum, avg(l_discount) AS l_discount_mean, stddev_samp(l_quantity) AS l_quantity_std
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Filter, computed column, grouped aggregates."""
    rows = S.filter_rows(T(spark, d, "lineitem"), S.predicate("l_shipdate", "lessThanOrEqual", F.lit("1998-09-02").cast("timestamp_ntz")))
    rows = S.set_column(rows, F.col("l_extendedprice") * (1 - F.col("l_discount")), "revenue")
    return A.group_aggregate(rows, ["l_returnflag", "l_linestatus"], count=["l_quantity"], sum=["l_quantity", "revenue"], mean=["l_discount"], std=["l_quantity"])


@query("SELECT o_orderkey, o_totalprice FROM orders")
def project_columns(spark: SparkSession, d: str) -> DataFrame:
    return S.project(T(spark, d, "orders"), ["o_orderkey", "o_totalprice"])


@query("SELECT * EXCLUDE (o_orderstatus, o_orderdate) FROM orders")
def drop_columns(spark: SparkSession, d: str) -> DataFrame:
    return S.drop_columns(T(spark, d, "orders"), ["o_orderstatus", "o_orderdate"])


@query("SELECT r_regionkey, r_name AS region FROM region")
def rename_column(spark: SparkSession, d: str) -> DataFrame:
    return S.rename(T(spark, d, "region"), "r_name", "region")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('2-HIGH', '1-URGENT')")
def filter_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Ordering by the declared levels."""
    p = S.predicate("o_orderpriority", "greaterThan", "3-MEDIUM", Meaning(ORDINAL, PRIORITIES))
    return S.filter_rows(T(spark, d, "orders"), p).select("o_orderkey")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events")
    return e.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("k"))


_GAPS = "WITH g AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS v, CASE WHEN event_id % 5 <> 0 THEN event_type END AS k FROM events) "


@query(_GAPS + "SELECT event_id, v FROM g WHERE NOT coalesce(v > 50, false)")
def drop_rows_unknown_stay(spark: SparkSession, d: str) -> DataFrame:
    return S.drop_rows(_gaps(spark, d), F.col("v") > 50).select("event_id", "v")


@query(_GAPS + "SELECT event_id FROM g WHERE v > 50")
def filter_mask(spark: SparkSession, d: str) -> DataFrame:
    return S.filter_mask(_gaps(spark, d), F.col("v") > 50).select("event_id")


@query(_GAPS + "SELECT event_id FROM g WHERE v IS NOT NULL AND k IS NOT NULL")
def dropna_any(spark: SparkSession, d: str) -> DataFrame:
    return S.dropna_rows(_gaps(spark, d), ["v", "k"]).select("event_id")


@query(_GAPS + "SELECT event_id FROM g WHERE v IS NOT NULL OR k IS NOT NULL")
def dropna_all(spark: SparkSession, d: str) -> DataFrame:
    return S.dropna_rows(_gaps(spark, d), ["v", "k"], "all").select("event_id")


@query("SELECT event_id, user_id, ts FROM events")
def dropna_columns(spark: SparkSession, d: str) -> DataFrame:
    return S.dropna_columns(_gaps(spark, d))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def sort_limit(spark: SparkSession, d: str) -> DataFrame:
    """A page of a sorted table."""
    return S.sort(T(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], ["o_totalprice"], then=["o_orderkey"]).offset(10).limit(50)


_JOIN = "SELECT c_custkey, c_name, o_orderkey, o_custkey FROM customer {} JOIN orders ON c_custkey = o_custkey"


def _join(how: str):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        return combine.join(T(spark, d, "customer").select("c_custkey", "c_name"), T(spark, d, "orders").select("o_orderkey", "o_custkey"), [("c_custkey", "o_custkey")], how)

    return run


for _how in ("inner", "left", "right", "full"):
    QUERIES[f"join_{_how}"], SQL[f"join_{_how}"] = _join(_how), _JOIN.format(_how.upper())
QUERIES["join_semi"], SQL["join_semi"] = _join("semi"), "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"
QUERIES["join_anti"], SQL["join_anti"] = _join("anti"), "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"


@query("SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_right, b.n_name AS n_name_right, b.n_regionkey AS n_regionkey_right FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_suffixes(spark: SparkSession, d: str) -> DataFrame:
    n = T(spark, d, "nation")
    return combine.join(n, n, [("n_regionkey", "n_regionkey")])


@query("SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def concat_by_name(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return combine.concat_rows([c, T(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))])


@query("SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def concat_by_position(spark: SparkSession, d: str) -> DataFrame:
    return combine.concat_rows([T(spark, d, "customer").select("c_custkey", "c_acctbal"), T(spark, d, "supplier").select("s_suppkey", "s_acctbal")], "by_position")


@query("SELECT c_custkey AS a, c_acctbal AS b, c_custkey + 1 AS a_2 FROM customer")
def concat_columns(spark: SparkSession, d: str) -> DataFrame:
    return combine.concat_columns(T(spark, d, "customer"), [[F.col("c_custkey"), F.col("c_acctbal")], [F.col("c_custkey") + 1]], [["a", "b"], ["a"]])


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return combine.deduplicate(T(spark, d, "orders"), ["o_custkey"], "first", ["o_orderkey"])


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    return combine.deduplicate(T(spark, d, "orders"), ["o_custkey"], "last", ["o_orderkey"])


@query("SELECT * FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1")
def dedup_none(spark: SparkSession, d: str) -> DataFrame:
    return combine.deduplicate(T(spark, d, "orders"), ["o_custkey"], "none")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def dedup_all_columns(spark: SparkSession, d: str) -> DataFrame:
    return combine.deduplicate(T(spark, d, "customer").select("c_nationkey", "c_mktsegment"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position, o_orderkey FROM orders")
def dense_positions(spark: SparkSession, d: str) -> DataFrame:
    """Dense global positions without one task taking all rows."""
    return combine.row_numbers(T(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")]).select("position", "o_orderkey")


@query("SELECT o_orderstatus, count(*) AS row_count, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, median(o_totalprice) AS o_totalprice_median FROM orders GROUP BY 1")
def group_median(spark: SparkSession, d: str) -> DataFrame:
    return A.group_aggregate(T(spark, d, "orders"), ["o_orderstatus"], min=["o_totalprice"], max=["o_totalprice"], median=["o_totalprice"])


@query(_GAPS + "SELECT k, count(*) AS row_count, count(v) AS v_count, avg(v) AS v_mean FROM g GROUP BY 1")
def group_null_key(spark: SparkSession, d: str) -> DataFrame:
    return A.group_aggregate(_gaps(spark, d), ["k"], count=["v"], mean=["v"])


@query("""SELECT 'l_quantity' AS "column", count(l_quantity) AS count, count(*) - count(l_quantity) AS missing, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q25, median(l_quantity) AS median, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS max, CAST(NULL AS BIGINT) AS "unique" FROM lineitem
UNION ALL SELECT 'l_returnflag', count(l_returnflag), count(*) - count(l_returnflag), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT l_returnflag) FROM lineitem""")
def describe(spark: SparkSession, d: str) -> DataFrame:
    return A.describe(T(spark, d, "lineitem"), ["l_quantity"], ["l_returnflag"])


@query(_GAPS + "SELECT k AS value, count(*) AS frequency, count(*) / (SELECT count(*) FROM g) AS proportion FROM g GROUP BY 1")
def frequency_with_null(spark: SparkSession, d: str) -> DataFrame:
    return A.frequency(_gaps(spark, d), "k", True)


@query(_GAPS + "SELECT k AS value, count(*) AS frequency, count(*) / (SELECT count(k) FROM g) AS proportion FROM g WHERE k IS NOT NULL GROUP BY 1")
def frequency(spark: SparkSession, d: str) -> DataFrame:
    return A.frequency(_gaps(spark, d), "k")


@query("SELECT count(*) AS length, count(l_quantity) AS count, CAST(sum(CAST(l_orderkey AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS sum, avg(l_quantity) AS mean FROM lineitem")
def reductions(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "lineitem")
    return rows.agg(F.count(F.lit(1)).alias("length"), F.count("l_quantity").alias("count"), F.sum(F.col("l_orderkey").cast("decimal(38,0)")).cast("decimal(38,0)").alias("sum"), A.operation("mean", F.col("l_quantity")).alias("mean"))


@query("SELECT o_orderpriority, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS o, sum(o_totalprice) FILTER (o_orderstatus IS NULL) AS none FROM orders GROUP BY 1")
def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    return A.pivot(T(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", ["F", "O", None], ["f", "o", "none"])


@query("SELECT l_orderkey, l_linenumber, 'l_discount' AS variable, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def unpivot_rates(spark: SparkSession, d: str) -> DataFrame:
    return A.unpivot(T(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("SELECT date_trunc('month', ts)::TIMESTAMP AS ts, event_type, avg(value) AS value_mean FROM events GROUP BY ALL")
def resample_month(spark: SparkSession, d: str) -> DataFrame:
    return A.resample(T(spark, d, "events"), "ts", "month", ["event_type"], ["value"])


@query("SELECT *, o_orderstatus = 'F' AS is_f, o_orderstatus = 'O' AS is_o FROM (SELECT o_orderkey, o_orderstatus FROM orders)")
def encode_levels(spark: SparkSession, d: str) -> DataFrame:
    return A.encode(T(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], ["is_f", "is_o", "is_p"], "P", True)


for _m, _sql in (("mean", "avg(v)"), ("median", "median(v)")):
    QUERIES[f"impute_{_m}"] = lambda spark, d, m=_m: A.impute(_gaps(spark, d), "v", m).select("event_id", "v")
    SQL[f"impute_{_m}"] = _GAPS + f"SELECT event_id, coalesce(v, (SELECT {_sql} FROM g)) AS v FROM g"
QUERIES["impute_constant"] = lambda spark, d: A.impute(_gaps(spark, d), "v", "constant", 0.0).select("event_id", "v")
SQL["impute_constant"] = _GAPS + "SELECT event_id, coalesce(v, 0) AS v FROM g"
QUERIES["impute_mode"] = lambda spark, d: A.impute(_gaps(spark, d), "k", "mode").select("event_id", "k")
SQL["impute_mode"] = _GAPS + "SELECT event_id, coalesce(k, (SELECT k FROM g WHERE k IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 1)) AS k FROM g"


@query("SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS z FROM orders")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    return A.standardize(T(spark, d, "orders"), "o_totalprice", "z")[0].select("o_orderkey", "z")


_OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id{})"


def _window(name: str, make, sql: str) -> None:  # noqa: ANN001
    def run(spark: SparkSession, d: str) -> DataFrame:
        w = W.spec(["user_id"], ["ts", "event_id"])
        return _gaps(spark, d).select("event_id", make(F.col("v"), w).alias("x"))

    QUERIES[name], SQL[name] = run, _GAPS + f"SELECT event_id, {sql} AS x FROM g"


_window("window_lag2", lambda v, w: W.lag(v, w, 2), "lag(v, 2) " + _OVER.format(""))
_window("window_lead", lambda v, w: W.lag(v, w, 1, "lead"), "lead(v) " + _OVER.format(""))
_window("window_forward_fill", W.forward_fill, "last_value(v IGNORE NULLS) " + _OVER.format(" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"))
_window("window_backward_fill", W.backward_fill, "first_value(v IGNORE NULLS) " + _OVER.format(" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"))
_window("window_difference2", lambda v, w: W.difference(v, w, 2), f"v - 2 * lag(v) {_OVER.format('')} + lag(v, 2) {_OVER.format('')}")
_window("window_percent_change", W.percent_change, f"CASE WHEN lag(v) {_OVER.format('')} <> 0 THEN v / lag(v) {_OVER.format('')} - 1 END")
for _op, _f in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_samp")):
    _c = _OVER.format(" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    _window(f"window_cumulative_{_op}", lambda v, w, op=_op: W.cumulative(v, w, op), f"CASE WHEN count(v) {_c} >= 1 THEN {_f}(v) {_c} END")
    _r = _OVER.format(" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW")
    _window(f"window_rolling7_{_op}", lambda v, w, op=_op: W.rolling(v, w, 7, op, 3), f"CASE WHEN count(v) {_r} >= 3 THEN {_f}(v) {_r} END")


@query("SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY value) AS r, dense_rank() OVER (PARTITION BY user_id ORDER BY value) AS dr FROM events")
def window_rank(spark: SparkSession, d: str) -> DataFrame:
    w = W.spec(["user_id"], ["value"])
    return T(spark, d, "events").select("event_id", W.rank(w).alias("r"), W.rank(w, True).alias("dr"))


@query("SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM events")
def panel_difference(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "events").select("event_id", W.panel_difference(F.col("value"), "user_id", "event_id").alias("x"))


@query("SELECT r.t AS o_orderkey, o.o_totalprice FROM (SELECT unnest(range(min(o_orderkey), max(o_orderkey) + 1)) AS t FROM orders) r LEFT JOIN orders o ON o.o_orderkey = r.t")
def time_align(spark: SparkSession, d: str) -> DataFrame:
    return align.time_align(T(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1)


_PANEL = "WITH p AS (SELECT o_orderpriority AS e, CAST(date_trunc('day', o_orderdate) AS DATE) AS t, sum(o_totalprice) AS x FROM orders GROUP BY ALL), t AS (SELECT DISTINCT t FROM p), s AS (SELECT e, min(t) AS a, max(t) AS z FROM p GROUP BY 1) "


@query(_PANEL + "SELECT s.e, t.t, p.x FROM s JOIN t ON t.t BETWEEN s.a AND s.z LEFT JOIN p ON p.e = s.e AND p.t = t.t")
def panel_align(spark: SparkSession, d: str) -> DataFrame:
    p = T(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("e"), F.col("o_orderdate").cast("date").alias("t")).agg(F.sum("o_totalprice").alias("x"))
    return align.panel_align(p, "e", "t")


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_extendedprice + l_tax AS added, l_quantity - l_tax AS subtracted, l_quantity * l_extendedprice AS multiplied, l_extendedprice / l_quantity AS divided, pow(l_quantity, 2.0) AS powered, ln(l_quantity) / ln(3) AS logged, ln(l_quantity) AS ln, log2(l_quantity) AS log2, log10(l_quantity) AS log10, l_quantity * l_quantity AS squared, sqrt(l_quantity) AS root FROM lineitem")
def arithmetic(spark: SparkSession, d: str) -> DataFrame:
    q, p, x = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")
    n = numeric
    return T(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", n.add(q, p, x).alias("added"), n.subtract(q, x).alias("subtracted"), n.multiply(q, p).alias("multiplied"), n.divide(p, q).alias("divided"), n.power(q, F.lit(2.0)).alias("powered"),
        n.log(q, F.lit(3.0)).alias("logged"), n.ln(q).alias("ln"), n.log2(q).alias("log2"), n.log10(q).alias("log10"), n.square(q).alias("squared"), n.sqrt(q).alias("root"),
    )


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 10.0 WHEN l_quantity > 40 THEN 40.0 ELSE l_quantity END AS clipped, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS bin FROM lineitem")
def clip_and_bin(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numeric.clip(q, 10, 40).alias("clipped"), numeric.bins(q, [10, 30], ["low", "mid", "high"]).alias("bin"))


@query("SELECT l_orderkey, l_linenumber, l_discount = l_tax AS eq, l_discount <> l_tax AS ne, l_discount < l_tax AS lt, l_discount <= l_tax AS le, l_discount > l_tax AS gt, l_discount >= l_tax AS ge, abs(l_discount - l_tax) <= 0.0105 AS near FROM lineitem")
def comparisons(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_discount"), F.col("l_tax")
    names = dict(zip(("eq", "ne", "lt", "le", "gt", "ge"), logic.OPERATORS))
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[logic.compare(a, b, op).alias(n) for n, op in names.items()], logic.compare(a, b, "equal", 0.0105).alias("near"))


@query(_GAPS + "SELECT event_id, v > 50 AND k = 'click' AS a, v > 50 OR k = 'click' AS o, NOT v > 50 AS n, v IS NULL AS m, CASE WHEN v > 50 THEN 'big' ELSE 'rest' END AS c FROM g")
def three_valued_logic(spark: SparkSession, d: str) -> DataFrame:
    p, q = F.col("v") > 50, F.col("k") == "click"
    return _gaps(spark, d).select("event_id", (p & q).alias("a"), (p | q).alias("o"), (~p).alias("n"), F.col("v").isNull().alias("m"), logic.choose(p, F.lit("big"), F.lit("rest")).alias("c"))


@query(_GAPS + "SELECT event_id, CASE WHEN k IS NULL THEN 'none' WHEN k = 'click' THEN 'c' ELSE k END AS kept, CASE WHEN k IS NULL THEN 'none' WHEN k = 'click' THEN 'c' END AS nulled FROM g")
def map_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return _gaps(spark, d).select("event_id", logic.map_values(k, [None, "click"], ["none", "c"]).alias("kept"), logic.map_values(k, [None, "click"], ["none", "c"], "null").alias("nulled"))


@query("SELECT p_partkey, trim('  ' || p_name || ' ') AS t, lower(p_brand) AS l, upper(p_name) AS u, replace(p_type, 'A', '#') AS r, substring(p_name, 2, 4) AS s, split_part(p_type, ' ', -1) AS last, split_part(p_type, ' ', 9) AS none, p_brand || '/' || p_type AS c FROM part")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return T(spark, d, "part").select(
        "p_partkey", text.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"), text.lower(b).alias("l"), text.upper(n).alias("u"), text.replace(t, "A", "#").alias("r"),
        text.substring(n, 2, 4).alias("s"), text.split_part(t, " ", -1).alias("last"), text.split_part(t, " ", 9).alias("none"), text.concatenate([b, t], "/").alias("c"),
    )


@query("SELECT event_id, " + ", ".join(f"CAST({'isodow' if 0 else p}(ts) AS DOUBLE) AS p_{p}" if p not in ("doy", "dow") else f"CAST(date_part('{p}', ts) AS DOUBLE) AS p_{p}" for p in calendar.PARTS) + " FROM events")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "events").select("event_id", *[calendar.part(F.col("ts"), p).alias(f"p_{p}") for p in calendar.PARTS])


@query("SELECT event_id, " + ", ".join(f"CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS t_{u}" for u in calendar.TRUNCATIONS) + " FROM events")
def date_truncations(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "events").select("event_id", *[calendar.truncate(F.col("ts"), u).alias(f"t_{u}") for u in calendar.TRUNCATIONS])


@query("SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 2 YEAR AS y, o_orderdate + INTERVAL 3 WEEK AS w, o_orderdate + INTERVAL 90 SECOND AS s, date_diff('microsecond', TIMESTAMP '1995-01-01', o_orderdate) / 86400000000 AS days FROM orders")
def date_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderdate")
    return T(spark, d, "orders").select("o_orderkey", calendar.shift(o, 1, "month").alias("m"), calendar.shift(o, -2, "year").alias("y"), calendar.shift(o, 3, "week").alias("w"), calendar.shift(o, 90, "second").alias("s"), calendar.difference(o, F.lit("1995-01-01").cast("timestamp_ntz"), "day").alias("days"))


@query("SELECT o_orderkey, o_orderkey AS n, CAST(o_totalprice AS DOUBLE) AS x, o_orderstatus = 'F' AS b, CAST(o_orderdate AS TIMESTAMP) AS t, o_orderpriority AS k FROM orders")
def conversions(spark: SparkSession, d: str) -> DataFrame:
    """To text and back, exactly."""
    c = convert
    o = T(spark, d, "orders")
    return o.select(
        "o_orderkey", c.to_numeric(c.to_text(F.col("o_orderkey")), "integer").alias("n"), c.to_numeric(c.to_text(F.col("o_totalprice"))).alias("x"), c.to_binary(F.col("o_orderstatus"), ["f"], ["o", "p"]).alias("b"),
        c.to_datetime(F.concat(F.col("o_orderdate").cast("string"), F.lit("+02:00"))).alias("t"), c.to_category(F.col("o_orderpriority"), list(PRIORITIES)).alias("k"),
    )


@query(_GAPS + """SELECT 'v' AS "column", count(v) AS count, count(*) - count(v) AS nulls, min(v) AS min, max(v) AS max, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS std, var_samp(v) AS variance FROM g""")
def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    return profile.numeric_stats(_gaps(spark, d), ["v"])


@query(_GAPS + """SELECT 'k' AS "column", count(k) AS count, count(*) - count(k) AS nulls, count(*) FILTER (k = '') AS empty, count(DISTINCT k) AS "unique", (SELECT k FROM g WHERE k IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 1) AS mode FROM g""")
def profile_text(spark: SparkSession, d: str) -> DataFrame:
    return profile.text_stats(_gaps(spark, d), ["k"])


@query("""WITH r AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS z FROM orders), b AS (SELECT CAST(least(floor((o_totalprice - a) / ((z - a) / 20)), 19) AS INT) AS bin FROM orders, r)
SELECT CAST(i AS INT) AS bin, a + i * ((z - a) / 20) AS lower, a + (i + 1) * ((z - a) / 20) AS upper, (SELECT count(*) FROM b WHERE b.bin = i) AS frequency FROM range(20) t(i), r""")
def profile_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(T(spark, d, "orders"), "o_totalprice")


@query("""WITH c AS (SELECT CAST(p_brand AS VARCHAR) AS value, count(*) AS frequency FROM part GROUP BY 1), b AS (SELECT * FROM c ORDER BY frequency DESC, value LIMIT 15)
SELECT value, frequency, false AS other FROM b UNION ALL SELECT NULL, CAST(sum(frequency) AS BIGINT), true FROM c WHERE value NOT IN (SELECT value FROM b) HAVING count(*) > 0""")
def profile_top_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_values(T(spark, d, "part"), "p_brand")


@query(_GAPS + "SELECT count(*) AS row_count, CAST(5 AS BIGINT) AS column_count, CAST(sum((v IS NULL)::INT + (k IS NULL)::INT) AS BIGINT) AS nulls, count(*) FILTER (v IS NULL OR k IS NULL) AS rows_with_nulls FROM g")
def profile_overview(spark: SparkSession, d: str) -> DataFrame:
    return profile.overview(_gaps(spark, d))


@query("SELECT o_orderpriority AS \"group.o_orderpriority\", max(o_totalprice) - min(o_totalprice) AS spread, count(*) AS n FROM orders GROUP BY 1")
def group_apply(spark: SparkSession, d: str) -> DataFrame:
    """A user function over each group."""
    import pandas as pd

    return groups.apply(T(spark, d, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], lambda p: pd.DataFrame({"spread": [p.o_totalprice.max() - p.o_totalprice.min()], "n": [len(p)]}), "spread double, n bigint")


@query("SELECT o_orderkey, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS centred FROM orders")
def group_transform(spark: SparkSession, d: str) -> DataFrame:
    """The same as a window, which stays in the JVM."""
    from pyspark.sql import Window

    own = F.col("o_totalprice") - F.avg("o_totalprice").over(Window.partitionBy("o_orderpriority"))
    return groups.window_transform(T(spark, d, "orders"), {"centred": own}).select("o_orderkey", "centred")


@query("SELECT l_quantity AS value, count(*) AS n, sum(count(*)) OVER (ORDER BY l_quantity) / sum(count(*)) OVER () AS share FROM lineitem GROUP BY 1")
def plot_ecdf(spark: SparkSession, d: str) -> DataFrame:
    return plots.ecdf(T(spark, d, "lineitem"), "l_quantity")


@query("SELECT p_type AS category, count(*) AS n, sum(count(*)) OVER (ORDER BY count(*) DESC, p_type) / sum(count(*)) OVER () AS share FROM part GROUP BY 1")
def plot_pareto(spark: SparkSession, d: str) -> DataFrame:
    return plots.pareto(T(spark, d, "part"), "p_type")


@query("SELECT CASE WHEN l_quantity >= 25 AND l_discount >= 0.05 THEN 1 WHEN l_discount >= 0.05 THEN 2 WHEN l_quantity < 25 THEN 3 ELSE 4 END AS quadrant, count(*) AS n FROM lineitem GROUP BY 1")
def plot_quadrants(spark: SparkSession, d: str) -> DataFrame:
    return plots.quadrants(T(spark, d, "lineitem"), "l_quantity", "l_discount", 25, 0.05)


@query("""WITH q AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.75) AS q3, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderstatus, n, q1, median, q3, min(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lower, max(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS upper, count(*) FILTER (NOT o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outside
FROM orders JOIN q USING (o_orderstatus) GROUP BY ALL""")
def plot_box(spark: SparkSession, d: str) -> DataFrame:
    return plots.box(T(spark, d, "orders"), "o_totalprice", ["o_orderstatus"])


@query("""SELECT 'l_quantity' AS x, 'l_quantity' AS y, CAST(1 AS DOUBLE) AS r UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0""")
def plot_correlations(spark: SparkSession, d: str) -> DataFrame:
    return plots.correlations(T(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select("x", "y", F.round("r", 12).alias("r"))


SQL["plot_correlations"] = f"SELECT x, y, round(r, 12) AS r FROM ({SQL['plot_correlations']})"


@query("SELECT event_type AS word, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 256")
def plot_words(spark: SparkSession, d: str) -> DataFrame:
    return plots.word_counts(T(spark, d, "events"), "event_type")


@query("""WITH c AS (SELECT l_quantity AS threshold, sum((l_returnflag = 'R')::INT) AS p, sum((l_returnflag <> 'R')::INT) AS q FROM lineitem GROUP BY 1)
SELECT threshold, sum(q) OVER (ORDER BY threshold DESC) / sum(q) OVER () AS fpr, sum(p) OVER (ORDER BY threshold DESC) / sum(p) OVER () AS tpr FROM c""")
def plot_roc(spark: SparkSession, d: str) -> DataFrame:
    return plots.roc(T(spark, d, "lineitem").withColumn("y", F.col("l_returnflag") == "R"), "y", "l_quantity")


@query()
def plot_auc(spark: SparkSession, d: str) -> DataFrame:
    return plots.auc(plot_roc(spark, d))


@query()
def plot_kde(spark: SparkSession, d: str) -> DataFrame:
    return plots.kde(T(spark, d, "lineitem"), "l_quantity", 64)


@query()
def plot_qq(spark: SparkSession, d: str) -> DataFrame:
    return plots.qq(T(spark, d, "orders"), "o_totalprice")


@query()
def plot_scatter(spark: SparkSession, d: str) -> DataFrame:
    return plots.scatter(T(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber"])
