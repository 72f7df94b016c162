"""Element-wise transforms, standardisation and imputation of long matrices (row, variable, value); null is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

V = F.col


def long(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """Wide to long; NaN becomes null."""
    d = df.select(F.col(row).alias("row"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    d = d.unpivot("row", columns, "variable", "value")
    return d.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def wide(m: DataFrame, columns: list[str]) -> DataFrame:
    return m.groupBy("row").pivot("variable", columns).agg(F.first("value"))


def _with(m: DataFrame, value: Column) -> DataFrame:
    return m.withColumn("value", value)


def log_transform(m: DataFrame, base: float = 10.0, offset: float = 1.0) -> DataFrame:
    """log_base(value + offset); null where that is not positive."""
    x = F.col("value") + offset
    return _with(m, F.when(x > 0, F.log(x) / F.log(F.lit(base))))


def sqrt_transform(m: DataFrame) -> DataFrame:
    if m.filter("value < 0").limit(1).count():
        raise ValueError("negative values have no square root")
    return _with(m, F.sqrt("value"))


def _axis(axis: int) -> str:
    return "variable" if axis == 0 else "row"


def _per(m: DataFrame, by: str, **aggs: Column) -> DataFrame:
    """Group statistics joined back; partial aggregation comes before the shuffle, unlike with a window."""
    return m.join(m.groupBy(by).agg(*[a.alias(n) for n, a in aggs.items()]), by)


def zscore(m: DataFrame, axis: int = 0) -> DataFrame:
    d = _per(m, _axis(axis), mean=F.avg("value"), sd=F.stddev_samp("value"))
    return _with(d, (F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).select(*m.columns)


def percent(m: DataFrame, axis: int = 1) -> DataFrame:
    """Share of the column (axis 0) or row total; a total of 0 counts as 1."""
    d = _per(m, _axis(axis), total=F.sum("value"))
    return _with(d, F.col("value") / F.when(F.col("total") != 0, F.col("total")).otherwise(1.0)).select(*m.columns)


def hellinger(m: DataFrame) -> DataFrame:
    return _with(percent(_with(m, F.greatest("value", F.lit(0.0))), 1), F.sqrt("value"))


def wisconsin(m: DataFrame) -> DataFrame:
    """Divided by the column maximum, then by the row total."""
    d = _per(m, "variable", top=F.max("value"))
    return percent(_with(d, F.col("value") / F.when(F.col("top") != 0, F.col("top")).otherwise(1.0)).select(*m.columns), 1)


def min_max(m: DataFrame) -> DataFrame:
    d = _per(m, "variable", low=F.min("value"), top=F.max("value"))
    return _with(d, F.when(F.col("top") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("top") - F.col("low"))).otherwise(F.when(F.col("value").isNotNull(), 0.0))).select(*m.columns)


def boxcox_lambda(m: DataFrame) -> DataFrame:
    """variable, lambda, likelihood: the best of -2, -1.9, ..., 2 by profile log-likelihood over positive values.

    One pass: the grid is a set of aggregates, no row is copied. With fewer than two positive values lambda is 1. The
    variance of (x^g - 1) / g is taken as that of x^g over g^2: for large x and negative g, x^g - 1 would lose x^g's digits.
    """
    x, lx = F.col("value"), F.log("value")
    grid = [round(-2 + 0.1 * k, 1) for k in range(41)]
    spread = lambda g: F.var_pop(lx) if g == 0 else F.var_pop(F.pow(x, F.lit(g))) / (g * g)
    n, s = F.count(x), F.sum(lx)
    a = m.filter("value > 0").groupBy("variable").agg(n.alias("n"), F.array(*[F.struct((-n / 2 * F.log(spread(g)) + (g - 1) * s).alias("likelihood"), F.lit(-abs(g - 1)).alias("near"), F.lit(g).alias("lambda")) for g in grid]).alias("all"))
    best = F.array_max(F.filter("all", lambda e: e["likelihood"].isNotNull() & (e["likelihood"] < 1e300)))
    a = a.withColumn("best", F.when(F.col("n") >= 2, best))
    return m.select("variable").distinct().join(a, "variable", "left").select("variable", F.coalesce("best.lambda", F.lit(1.0)).alias("lambda"), F.col("best.likelihood").alias("likelihood"))


def boxcox(m: DataFrame, value: float | None = None) -> DataFrame:
    lam = m.select("variable").distinct().withColumn("lambda", F.lit(value)) if value is not None else boxcox_lambda(m).select("variable", "lambda")
    d = m.join(lam, "variable")
    x, g = F.col("value"), F.col("lambda")
    return _with(d, F.when(x > 0, F.when(F.abs(g) < 1e-12, F.log(x)).otherwise((F.pow(x, g) - 1) / g))).select(*m.columns)


def impute_mean(m: DataFrame) -> DataFrame:
    """Column mean for missing values; 0 where a column has none."""
    d = _per(m, "variable", mean=F.avg("value"))
    return _with(d, F.coalesce("value", "mean", F.lit(0.0))).select(*m.columns)


def impute_knn(m: DataFrame, k: int = 5, rows: DataFrame | None = None) -> DataFrame:
    """Mean of the k nearest rows' values, over columns both rows have (not scaled by their number); ties by row.

    Only rows with a hole look for neighbours. Neighbours without the value are skipped; then the column mean is taken.
    """
    holes = m.filter("value IS NULL").select("row").distinct()
    seen = m.filter("value IS NOT NULL")
    mine = seen.join(holes, "row", "left_semi")
    d2 = mine.alias("x").join(seen.alias("y"), (F.col("x.variable") == F.col("y.variable")) & (F.col("x.row") != F.col("y.row"))).groupBy(F.col("x.row").alias("row"), F.col("y.row").alias("other")).agg(F.sum(F.pow(F.col("x.value") - F.col("y.value"), 2)).alias("d"))
    near = d2.withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy("d", "other"))).filter(F.col("k") <= k).select("row", "other")
    fill = m.filter("value IS NULL").select("row", "variable").join(near, "row").join(seen.select(F.col("row").alias("other"), "variable", F.col("value").alias("v")), ["other", "variable"]).groupBy("row", "variable").agg(F.avg("v").alias("fill"))
    means = m.groupBy("variable").agg(F.avg("value").alias("mean"))
    d = m.join(fill, ["row", "variable"], "left").join(means, "variable")
    return _with(d, F.coalesce("value", "fill", "mean", F.lit(0.0))).select(*m.columns)


def missing_report(m: DataFrame) -> DataFrame:
    """scope, name, missing, share: for the whole, each column and each row."""
    gone = F.count_if(F.col("value").isNull())
    part = lambda d, s, n: d.agg(gone.alias("missing"), (gone / F.count("*")).alias("share")).select(F.lit(s).alias("scope"), n.cast("string").alias("name"), "missing", "share")
    return part(m.groupBy(), "total", F.lit("")).union(part(m.groupBy("variable"), "variable", F.col("variable"))).union(part(m.groupBy("row"), "row", F.col("row")))


def sums(m: DataFrame, axis: int = 0) -> DataFrame:
    return m.groupBy(_axis(axis)).agg(F.sum("value").alias("sum"))
