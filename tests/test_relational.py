import math

import pytest
from pyspark.sql import functions as F

from tidewell.functions import calendar, convert, guards, logic, numeric, text
from tidewell.operators import aggregate as A
from tidewell.operators import align, combine, groups, plots, profile
from tidewell.operators import select as S
from tidewell.operators import window as W
from tidewell.sources import overlay, readers, samples, writers
from tidewell.types import BINARY, ORDINAL, Meaning, MeaningError, infer


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first()["r"]


def fails(spark, column, **values):
    with pytest.raises(Exception):  # noqa: B017
        one(spark, column, **values)


def test_strict_numbers(spark):
    c = F.col
    assert one(spark, numeric.divide(c("a"), c("b")), a=1, b=4) == 0.25
    assert one(spark, numeric.add(c("a"), c("b"), integer=True), a=2**60, b=1) == 2**60 + 1
    fails(spark, numeric.divide(c("a"), c("b")), a=1, b=0)
    fails(spark, numeric.add(c("a"), c("b"), integer=True), a=2**63 - 1, b=1)
    fails(spark, numeric.ln(c("a")), a=0.0)
    fails(spark, numeric.sqrt(c("a")), a=-1.0)
    fails(spark, numeric.power(c("a"), c("b")), a=0.0, b=0.0)
    fails(spark, numeric.power(c("a"), c("b")), a=-8.0, b=1 / 3)
    fails(spark, numeric.add(c("a"), c("b")), a=None, b=1.0)
    fails(spark, guards.finite("a"), a=math.nan)
    fails(spark, guards.lossless("a"), a=2**53 + 1)
    assert one(spark, guards.lossless("a"), a=2**53) == float(2**53)
    assert one(spark, numeric.clip(c("a").cast("double"), 0, 1), a=None) is None
    assert [one(spark, numeric.bins(c("a"), [1.0, 2.0], ["x", "y", "z"]), a=v) for v in (0.5, 1.0, 2.0)] == ["x", "y", "z"]


def test_logic_and_text(spark):
    c = F.col
    assert one(spark, logic.compare(c("a"), c("b"), "equal", 1e-12, 1e-9), a=0.1 + 0.2, b=0.3)
    assert one(spark, logic.compare(c("a"), c("b"), "equal", 1e-12, 1e-9), a=1e308, b=-1e308) is False
    assert one(spark, logic.choose(c("a") > 1, F.lit("y"), F.lit("n")), a=None) == "n"
    assert one(spark, text.trim(c("a")), a=" \t x ") == "\t x"
    assert one(spark, text.split_part(c("a"), ",", -1), a="x,y") == "y" and one(spark, text.split_part(c("a"), ",", 5), a="x,y") == ""
    assert one(spark, text.concatenate([c("a"), c("b").cast("string")], "-"), a="x", b=None) is None


def test_conversions(spark):
    c = F.col("a")
    assert one(spark, convert.to_numeric(c, "integer"), a=" 001 ") == 1
    fails(spark, convert.to_numeric(c, "integer"), a="1.5")
    assert one(spark, convert.to_numeric(c, "integer", force=True), a="1.5") is None
    assert str(one(spark, convert.to_datetime(c), a="2024-03-01T10:00:00+05:00")) == "2024-03-01 10:00:00"
    fails(spark, convert.to_datetime(c), a="soon")
    assert one(spark, convert.to_binary(c), a="TRUE") is True
    fails(spark, convert.to_category(c, ["x"]), a="y")


def test_calendar(spark):
    t = F.col("a").cast("timestamp_ntz")
    assert str(one(spark, calendar.shift(t, 1, "month"), a="2024-01-31 10:00:00")) == "2024-02-29 10:00:00"
    assert one(spark, calendar.difference(t, F.lit("2024-01-01").cast("timestamp_ntz"), "day"), a="2024-01-02 12:00:00") == 1.5
    assert one(spark, calendar.part(t, "dow"), a="2024-01-07 00:00:00") == 0.0
    with pytest.raises(ValueError):
        calendar.shift(t, 1, "hour", "date")


def test_meanings():
    from pyspark.sql import types as T

    assert infer(T.BooleanType()).kind == BINARY
    with pytest.raises(MeaningError):
        Meaning(BINARY, (1, 2, 3))
    with pytest.raises(MeaningError):
        S.predicate("x", "lessThan", 1, Meaning("Categorical", (1, 2)))


def test_sort_by_levels_and_nulls(spark):
    df = spark.createDataFrame([("lo", 1), ("hi", 2), (None, 3), ("mid", 4)], "k string, i int")
    m = {"k": Meaning(ORDINAL, ("lo", "mid", "hi"))}
    assert [r["i"] for r in S.sort(df, ["k"], meanings=m).collect()] == [1, 4, 2, 3]
    assert [r["i"] for r in S.sort(df, ["k"], ["k"], True, m).collect()] == [3, 2, 4, 1]
    got, more = S.page(df, 1, 2, ["i"])
    assert [r["i"] for r in got.collect()] == [2, 3] and more


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, None, ""), (math.nan, None, "x"), (None, None, None)], "a double, b int, c string")
    assert S.dropna_rows(df, ["a"]).count() == 2
    assert S.dropna_columns(df, how="all").columns == ["a", "c"]
    assert S.dropna_columns(df.limit(0)).columns == ["a", "b", "c"]
    with pytest.raises(ValueError):
        S.drop_columns(df, ["a", "b", "c"])


def test_joins_keep_both_keys_and_nulls_never_match(spark):
    left = spark.createDataFrame([(2, "a"), (1, "b"), (None, "c")], "id bigint, label string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "w")], "id bigint, label string")
    full = combine.join(left, right, [("id", "id")], "full")
    assert full.columns == ["id", "label", "id_right", "label_right"] and full.count() == 2 + 2 + 2
    assert combine.join(left, right, [("id", "id")], "anti").count() == 2
    with pytest.raises(ValueError):
        combine.join(left, right.withColumn("id", F.col("id").cast("int")), [("id", "id")])
    assert combine.deduplicate(right, ["id"], "none").count() == 2
    assert sorted(r["label"] for r in combine.deduplicate(right, ["id"], "last", ["label"]).collect()) == ["w", "y", "z"]


def test_positions_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [r["position"] for r in combine.row_numbers(df, [F.col("v")]).orderBy("v").collect()] == list(range(1000))


def test_windows_and_groups(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 16.0), (3, 7.0), (4, None), (5, 13.0)], "i int, x double")
    w = W.spec([], ["i"])
    got = [tuple(r) for r in df.select(W.difference(F.col("x"), w, 2), W.rolling(F.col("x"), w, 2), W.cumulative(F.col("x"), w), W.forward_fill(F.col("x"), w)).collect()]
    assert got == [(None, None, 10.0, 10.0), (None, 13.0, 26.0, 16.0), (-15.0, 11.5, 33.0, 7.0), (None, None, 33.0, 7.0), (None, None, 46.0, 13.0)]
    with pytest.raises(Exception):  # noqa: B017
        spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0)], "e int, t int, x double").select(W.panel_difference(F.col("x"), "e", "t")).collect()
    out = groups.transform(df.withColumn("g", F.lit(1)), ["g"], lambda p: p.assign(x=p.x.fillna(0)), "i int, x double, g int", ["i"])
    assert out.agg(F.sum("x")).first()[0] == 46.0


def test_reshape_and_align(spark):
    wide = spark.createDataFrame([(1, 2, 5), (2, None, 7)], "id int, a int, b int")
    long = A.unpivot(wide, ["id"], ["a", "b"])
    assert long.count() == 4 and A.unpivot(wide, ["id"], ["a", "b"], include_null=False).count() == 3
    back = A.pivot(long, ["id"], "variable", "value", ["a", "b"], ["a", "b"])
    assert sorted(tuple(r) for r in back.collect()) == [(1, 2.0, 5.0), (2, None, 7.0)]
    grid = align.time_align(spark.createDataFrame([(1, 1.0), (5, 2.0)], "t bigint, x double"), "t", 2)
    assert sorted(tuple(r) for r in grid.collect()) == [(1, 1.0), (3, None), (5, 2.0)]
    with pytest.raises(ValueError):
        align.time_align(spark.createDataFrame([(1, 1.0), (4, 2.0), (5, 2.0)], "t bigint, x double"), "t", 2)
    with pytest.raises(ValueError):
        A.impute(spark.createDataFrame([(None,)], "x double"), "x")
    z, m, s = A.standardize(spark.createDataFrame([(1.0,), (3.0,)], "x double"), "x")
    assert m == 2.0 and abs(s - math.sqrt(2)) < 1e-12
    assert profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect()[0]["frequency"] == 2
    assert plots.word_counts(spark.createDataFrame([(" a ",), ("a",), (None,)], "w string"), "w").collect()[0]["n"] == 2


def test_overlay(spark, tmp_path):
    base = spark.createDataFrame([(i, float(i), i * 10, "v") for i in range(5)], "row_id bigint, display_order double, a int, b string")
    p = overlay.cell_edits(base, [(1, "a", 99), (2, "b", None)])
    new = overlay.insert_rows(base, [{"a": 7}], after=0.0)
    got = {r["row_id"]: (r["a"], r["b"]) for r in overlay.merge(base, p, new, overlay.delete_rows(base, [3])).collect()}
    assert got == {0: (0, "v"), 1: (99, "v"), 2: (20, None), 4: (40, "v"), 5: (7, None)}
    with pytest.raises(ValueError):
        overlay.cell_edits(base, [(1, "nope", 1)])
    with pytest.raises(Exception):  # noqa: B017
        overlay.cast_column(spark.createDataFrame([(1.5,)], "x double"), "x", "int").collect()
    assert overlay.compact(base, str(tmp_path / "c")).count() == 5


def test_sources(spark, tmp_path):
    import sqlite3

    f = tmp_path / "x.csv"
    f.write_text('id,t,name,code\n1,2024-01-01T10:00:00+02:00,"two\nlines",007\n2,,b,008\n')
    df = readers.read_csv(spark, str(f))
    assert dict(df.dtypes) == {"id": "bigint", "t": "timestamp_ntz", "name": "string", "code": "string"}
    assert str(df.orderBy("id").first()["t"]) == "2024-01-01 10:00:00" and df.count() == 2
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as con:
        con.execute('create table "a b" (i integer, x real, s text)')
        con.executemany('insert into "a b" values (?, ?, ?)', [(i, i / 2, str(i)) for i in range(100)])
        con.execute("create table bad (i integer)")
        con.execute("insert into bad values ('text')")
    assert readers.sqlite_tables(db) == ["a b", "bad"]
    assert readers.read_sqlite(spark, db, "a b", 30).agg(F.sum("x")).first()[0] == 2475.0
    with pytest.raises(Exception):  # noqa: B017
        readers.read_sqlite(spark, db, "bad").collect()
    writers.write_arrow(df, str(tmp_path / "x.arrow"))
    assert readers.read_arrow(spark, str(tmp_path / "x.arrow")).count() == 2
    writers.export_csv(df.limit(0), str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == df.columns


@pytest.mark.parametrize("name", samples.DISTRIBUTIONS)
def test_samples_have_their_means(spark, name):
    p = {
        "normal": ({"mean": 1.0, "standard_deviation": 2.0}, 1.0), "uniform": ({"lower_bound": 0.0, "upper_bound": 4.0}, 2.0), "exponential": ({"rate": 2.0}, 0.5), "cauchy": ({"location": 0.0, "scale": 1.0}, None),
        "log_normal": ({"mu": 0.0, "sigma": 0.5}, math.exp(0.125)), "weibull": ({"shape": 1.0, "scale": 3.0}, 3.0), "laplace": ({"location": 1.0, "scale": 1.0}, 1.0), "pareto": ({"shape": 5.0, "scale": 1.0}, 1.25),
        "triangular": ({"minimum": 0.0, "maximum": 3.0, "mode": 0.0}, 1.0), "bernoulli": ({"probability": 0.3}, 0.3), "geometric": ({"probability": 0.5}, 2.0), "discrete_uniform": ({"lower_bound": 1.0, "upper_bound": 3.0}, 2.0),
        "gamma": ({"shape": 2.0, "rate": 4.0}, 0.5), "beta": ({"alpha": 1.0, "beta": 3.0}, 0.25), "students_t": ({"degrees_of_freedom": 10.0}, 0.0), "chi_squared": ({"degrees_of_freedom": 3.0}, 3.0),
        "inverse_gamma": ({"shape": 5.0, "rate": 4.0}, 1.0), "fisher_snedecor": ({"numerator_degrees_of_freedom": 4.0, "denominator_degrees_of_freedom": 20.0}, 20 / 18), "erlang": ({"shape": 3.0, "rate": 3.0}, 1.0),
        "binomial": ({"trial_count": 10.0, "probability": 0.2}, 2.0), "poisson": ({"rate": 4.0}, 4.0), "negative_binomial": ({"success_count": 3.0, "probability": 0.5}, 3.0), "hypergeometric": ({"population_size": 20.0, "success_population": 5.0, "draw_count": 8.0}, 2.0),
    }[name]
    r = samples.sample(spark, name, 20_000, 3, **p[0]).agg(F.avg("value").alias("m"), F.stddev("value").alias("s"), F.count("value").alias("n")).first()
    assert r["n"] == 20_000
    if p[1] is not None:
        assert abs(r["m"] - p[1]) < 5 * r["s"] / math.sqrt(20_000)
