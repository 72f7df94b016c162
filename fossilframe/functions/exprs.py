"""Column expressions shared by the operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fossilframe.functions import special


def erf(x: Column) -> Column:
    t = 1 / (1 + special.ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(special.ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def two_sided_p(z: Column) -> Column:
    """2 (1 - Phi(|z|)) through the rational error function."""
    return 1 - erf(F.abs(z) / 2**0.5)


def erf_sql(x: str) -> str:
    t = f"(1 / (1 + {special.ERF_P} * abs({x})))"
    poly = "0.0"
    for a in reversed(special.ERF_A):
        poly = f"(({poly}) + ({a})) * {t}"
    return f"(sign({x}) * (1 - ({poly}) * exp(-({x}) * ({x}))))"


def two_sided_p_sql(z: str) -> str:
    return f"(1 - {erf_sql(f'(abs({z}) / sqrt(2.0::DOUBLE))')})"


def clean(c: Column) -> Column:
    """NaN becomes null: missing is null at rest."""
    return F.when(~F.isnan(c), c)


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda x, y: x + y)


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance of two arrays of doubles. Degenerate cases: 0 for proportions without a base, 1 for angles without a norm."""
    n = F.size(a)
    if metric == "euclidean":
        return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "cityblock":
        return _sum(a, b, lambda x, y: F.abs(x - y))
    if metric in ("bray_curtis", "braycurtis"):
        base = _sum(a, b, lambda x, y: x + y)
        return F.when(base > 0, _sum(a, b, lambda x, y: F.abs(x - y)) / base).otherwise(0.0)
    if metric == "cosine":
        norm = F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y))
        return F.when(norm > 0, 1 - _sum(a, b, lambda x, y: x * y) / norm).otherwise(1.0)
    if metric == "jaccard":
        base = _sum(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0))
        return F.when(base > 0, _sum(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)) / base).otherwise(0.0)
    if metric == "canberra":
        return _sum(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0))
    if metric == "correlation":
        sa, sb = _sum(a, a, lambda x, y: x), _sum(b, b, lambda x, y: x)
        cov = _sum(a, b, lambda x, y: x * y) - sa * sb / n
        va, vb = _sum(a, a, lambda x, y: x * y) - sa * sa / n, _sum(b, b, lambda x, y: x * y) - sb * sb / n
        return F.when((va > 1e-300) & (vb > 1e-300), 1 - cov / F.sqrt(va * vb)).otherwise(1.0)
    if metric == "hamming":
        return _sum(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)) / n
    raise ValueError(f"unknown metric {metric}")


METRICS = ("euclidean", "cityblock", "bray_curtis", "cosine", "jaccard", "canberra", "correlation", "hamming")


def register_functions(spark: SparkSession) -> None:
    """Normal, chi-square, t and F distribution functions for SQL."""
    for name, f, n in (("normal_cdf", special.normal_cdf, 1), ("normal_quantile", special.normal_quantile, 1), ("chi2_cdf", special.chi2_cdf, 2), ("t_cdf", special.t_cdf, 2), ("f_cdf", special.f_cdf, 3)):
        spark.udf.register(name, _typed(f, n))


def _typed(f, n: int):
    if n == 1:

        @F.pandas_udf(T.DoubleType())
        def one(x: pd.Series) -> pd.Series:
            return x.map(f)

        return one
    if n == 2:

        @F.pandas_udf(T.DoubleType())
        def two(x: pd.Series, a: pd.Series) -> pd.Series:
            return pd.Series([f(v, b) for v, b in zip(x, a, strict=True)])

        return two

    @F.pandas_udf(T.DoubleType())
    def three(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(v, c, d) for v, c, d in zip(x, a, b, strict=True)])

    return three
