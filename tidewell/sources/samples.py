"""Random samples of 23 distributions, integer ranges and literal series.

Samples are seeded; one value per row of ``spark.range``, made in the JVM where an inverse distribution function is
at hand and by a generator per partition otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_INVERSE = {
    "normal": (("mean", "standard_deviation"), lambda u, n, m, s: n * s + m),
    "uniform": (("lower_bound", "upper_bound"), lambda u, n, a, b: u * (b - a) + a),
    "exponential": (("rate",), lambda u, n, r: -F.ln(1 - u) / r),
    "cauchy": (("location", "scale"), lambda u, n, m, s: F.tan((u - 0.5) * np.pi) * s + m),
    "log_normal": (("mu", "sigma"), lambda u, n, m, s: F.exp(n * s + m)),
    "weibull": (("shape", "scale"), lambda u, n, k, s: F.pow(-F.ln(1 - u), F.lit(1 / k)) * s),
    "laplace": (("location", "scale"), lambda u, n, m, s: F.lit(m) - F.signum(u - 0.5) * s * F.ln(1 - 2 * F.abs(u - 0.5))),
    "pareto": (("shape", "scale"), lambda u, n, k, s: F.lit(s) / F.pow(1 - u, F.lit(1 / k))),
    "triangular": (("minimum", "maximum", "mode"), lambda u, n, a, b, c: F.when(u < (c - a) / (b - a), F.lit(a) + F.sqrt(u * (b - a) * (c - a))).otherwise(F.lit(b) - F.sqrt((1 - u) * (b - a) * (b - c)))),
    "bernoulli": (("probability",), lambda u, n, p: (u < p).cast("double")),
    "geometric": (("probability",), lambda u, n, p: F.lit(1.0) if p >= 1 else F.ceil(F.ln(1 - u) / float(np.log1p(-p))).cast("double")),
    "discrete_uniform": (("lower_bound", "upper_bound"), lambda u, n, a, b: (F.floor(u * (b - a + 1)) + a).cast("double")),
}
_GENERATOR = {
    "gamma": (("shape", "rate"), lambda g, k, a, r: g.gamma(a, 1 / r, k)),
    "beta": (("alpha", "beta"), lambda g, k, a, b: g.beta(a, b, k)),
    "students_t": (("degrees_of_freedom",), lambda g, k, d: g.standard_t(d, k)),
    "chi_squared": (("degrees_of_freedom",), lambda g, k, d: g.chisquare(d, k)),
    "inverse_gamma": (("shape", "rate"), lambda g, k, a, r: 1 / g.gamma(a, 1 / r, k)),
    "fisher_snedecor": (("numerator_degrees_of_freedom", "denominator_degrees_of_freedom"), lambda g, k, a, b: g.f(a, b, k)),
    "erlang": (("shape", "rate"), lambda g, k, a, r: g.gamma(int(a), 1 / r, k)),
    "binomial": (("trial_count", "probability"), lambda g, k, n, p: g.binomial(int(n), p, k)),
    "poisson": (("rate",), lambda g, k, r: g.poisson(r, k)),
    "negative_binomial": (("success_count", "probability"), lambda g, k, r, p: g.negative_binomial(r, p, k)),
    "hypergeometric": (("population_size", "success_population", "draw_count"), lambda g, k, n, s, d: g.hypergeometric(int(s), int(n - s), int(d), k)),
}
DISTRIBUTIONS = (*_INVERSE, *_GENERATOR)


def sample(spark: SparkSession, distribution: str, sample_count: int, seed: int = 0, **parameters: float) -> DataFrame:
    """(position, value) of ``sample_count`` draws."""
    names, make = (_INVERSE | _GENERATOR)[distribution]
    if set(names) != set(parameters) or sample_count < 0:
        raise ValueError(f"{distribution} takes {names}")
    values = [float(parameters[n]) for n in names]
    rows = spark.range(sample_count)
    if distribution in _INVERSE:
        return rows.select(F.col("id").alias("position"), make(F.rand(seed), F.randn(seed), *values).cast("double").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                g = np.random.default_rng([seed, b.column(0)[0].as_py()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.asarray(make(g, b.num_rows, *values), float))], ["position", "value"])

    return rows.mapInArrow(run, "position bigint, value double")


def int_range(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """Half open; a negative step counts down."""
    if step == 0:
        raise ValueError("the step is not zero")
    return spark.range(start, end, step).select(F.col("id").alias("value"))


def literal_table(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A table of literal columns of equal length."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns of different lengths")
    return spark.createDataFrame(pa.table(columns))


def constant(value: object) -> Column:
    return F.lit(value)
