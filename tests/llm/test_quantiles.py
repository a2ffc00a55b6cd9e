import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import quantiles as Q

SCHEMA = "sample_id bigint, species string, measured_on date, x double, node string, cnt string, value string"


def check(values, got, k):
    """Each returned value is observed, and its rank is within the bound of its cell."""
    v = np.sort(values)
    n = len(v)
    for p, value in got:
        assert value in v
        e = Q.LEVELS * (n // k)
        assert np.searchsorted(v, value, "right") >= math.ceil(round(p * n, 6))
        cell = abs(value) / 4096
        assert np.searchsorted(v, value - cell, "left") <= p * n + e + 1


@pytest.mark.parametrize("k", [20, 200, Q.K])
def test_bound_holds_for_digests_merged_from_days(spark, k):
    rng = random.Random(k)
    rows = []
    for i in range(6000):
        hot = i % 3
        x = rng.choice([rng.gauss(5, 1), rng.lognormvariate(0, 3), -rng.random(), 1e300, 0.0]) if hot else round(rng.gauss(5, 0.3), 1)
        rows.append((i, "hot" if not hot else f"s{i % 5}", None, x, "clash", "clash", "clash"))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("measured_on", F.date_add(F.lit("2031-01-01"), (F.col("sample_id") % 9).cast("int")))
    days = Q.digests(df, ["species", "measured_on"], ["x"], k)
    got = Q.percentiles(Q.merge(days, ["species"], k), ["species"], [0.01, 0.25, 0.5, 0.9, 1.0], k).collect()
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r[3])
    assert len(got) == 5 * len(by)
    for s, values in by.items():
        mine = [r for r in got if r["species"] == s]
        assert all(r["n"] == len(values) for r in mine)
        check(values, [(r["p"], r["value"]) for r in mine], k)
    if k == 20:
        assert Q.merge(days, ["species"], k).groupBy("species").count().agg(F.max("count")).first()[0] <= 3 * k + Q.LEVELS


def test_compression_keeps_counts_and_sizes():
    g = np.zeros(5000, np.int64)
    node = (1 << Q.LEVELS) + np.sort(np.random.default_rng(1).choice(1 << Q.LEVELS, 5000, replace=False))
    _, n, c, _ = Q.compress(g, node.astype(np.int64), np.full(5000, 3, np.int64), np.arange(5000.0), 50)
    assert c.sum() == 15000 and len(n) <= 3 * 50 + 1 and len(set(n)) == len(n)
    assert all(x < 1 << Q.LEVELS and y <= 15000 // 50 or x >= 1 << Q.LEVELS or y < 15000 // 50 for x, y in zip(n, c))


def test_cells_keep_the_order_of_doubles(spark):
    rng = random.Random(5)
    xs = sorted({s * rng.random() * 10.0 ** rng.randint(-300, 300) for s in (1, -1) for _ in range(300)} | {0.0, 1.0, 2.0, 4.0, 0.5, -1.0, 5e-324, -5e-324, 1.7976931348623157e308})
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", Q.node_of(F.col("x")).alias("n"))
    nodes = [r["n"] for r in df.orderBy("x").collect()]
    assert nodes == sorted(nodes) and all(1 << Q.LEVELS <= n < 2 << Q.LEVELS for n in nodes)


def test_odd_values_and_rows(spark):
    rows = [(1, "a", None, 5.0), (1, "a", None, 5.0), (2, "a", None, None), (3, "a", None, math.nan), (4, "a", None, math.inf), (5, None, None, 1.0), (6, "", None, 2.0), (None, "a", None, 7.0), (None, "a", None, 7.0), (7, "none", None, None)]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    got = Q.percentiles(Q.digests(Q.distinct_samples(df), ["species"], ["x"]), ["species"], [0.5]).collect()
    assert {(r["species"], r["n"], r["value"]) for r in got} == {("a", 3, 7.0), (None, 1, 1.0), ("", 1, 2.0)}
    assert Q.percentiles(Q.digests(df.limit(0), ["species"], ["x"]), ["species"], [0.5]).count() == 0
