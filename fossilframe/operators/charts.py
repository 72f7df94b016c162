"""The data behind charts, as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fossilframe.functions import special
from fossilframe.operators.hypothesis import order_statistic, ranked


def histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """bin, low, high, n of column x; equal widths, the last bin closed; constant data get width 1."""
    r = df.agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    r = r.withColumn("w", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0))
    b = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    g = df.filter("x IS NOT NULL").crossJoin(F.broadcast(r)).groupBy(b.alias("bin")).agg(F.first("lo").alias("lo"), F.first("w").alias("w"), F.count("*").alias("n"))
    return g.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n")


def box_plot(df: DataFrame) -> DataFrame:
    """group, q1, median, q3, low, high: quartiles without interpolation, whiskers clipped at 1.5 spans."""
    q = order_statistic(df, "x", ["group"], {"q1": "floor(n * 0.25)", "median": "floor(n * 0.5)", "q3": "floor(n * 0.75)"})
    m = df.groupBy("group").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    s = 1.5 * (F.col("q3") - F.col("q1"))
    return q.join(m, "group").select("group", "q1", "median", "q3", F.greatest("lo", F.col("q1") - s).alias("low"), F.least("hi", F.col("q3") + s).alias("high"))


def rose(angles: DataFrame, bins: int = 12) -> DataFrame:
    """bin, centre, n of angle_deg."""
    w = 360 / bins
    b = F.floor(F.pmod(F.col("angle_deg"), F.lit(360.0)) / w).cast("int")
    return angles.groupBy(b.alias("bin")).agg(F.count("*").alias("n")).select("bin", ((F.col("bin") + 0.5) * w).alias("centre"), "n")


def shares(df: DataFrame) -> DataFrame:
    """label, value, share of the total."""
    t = df.agg(F.sum("value").alias("t"))
    return df.crossJoin(F.broadcast(t)).select("label", "value", F.when(F.col("t") != 0, F.col("value") / F.col("t")).otherwise(0.0).alias("share"))


def heatmap(m: DataFrame) -> DataFrame:
    """row, variable, value scaled to 0..1 over the whole matrix."""
    r = m.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return m.crossJoin(F.broadcast(r)).select("row", "variable", F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("value"))


def shepard(original: DataFrame, fitted: DataFrame) -> DataFrame:
    return original.select("i", "j", F.col("d").alias("original")).join(fitted.select("i", "j", F.col("d").alias("fitted")), ["i", "j"])


def qq(df: DataFrame) -> DataFrame:
    """x, theoretical: each distinct value with the normal quantile of its first place."""

    @F.pandas_udf(T.DoubleType())
    def q(p: pd.Series) -> pd.Series:
        return p.map(special.normal_quantile)

    r = ranked(df.filter("x IS NOT NULL AND NOT isnan(x)"), "x", [])
    return r.filter("n >= 3").select("x", q((F.col("last") - F.col("c") + 0.5) / F.col("n")).alias("theoretical"))


def confidence_ellipse(df: DataFrame, level: float = 0.95) -> DataFrame:
    """group, centre, half axes and angle of (group, x, y) from the 2 x 2 covariance in closed form."""
    radius = 3.035 if level == 0.99 else 2.447
    g = df.groupBy("group").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_samp("x").alias("a"), F.var_samp("y").alias("b"), F.covar_samp("x", "y").alias("c"))
    half, gap = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.col("c") * F.col("c"))
    return g.select("group", "cx", "cy", (radius * F.sqrt(half + gap)).alias("major"), (radius * F.sqrt(F.greatest(half - gap, F.lit(0.0)))).alias("minor"), (0.5 * F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))).alias("angle"))


def abundance_rank(community: DataFrame) -> DataFrame:
    """sample, log_rank, log_abundance."""
    w = Window.partitionBy("sample").orderBy(F.desc("abundance"), "taxon")
    return community.filter("abundance > 0").select("sample", F.log10(F.row_number().over(w)).alias("log_rank"), F.log10("abundance").alias("log_abundance"))


def top_contributions(simper: DataFrame, n: int = 15) -> DataFrame:
    """The n largest contributions: the report that the bar chart shows."""
    return simper.orderBy(F.desc("mean"), "variable").limit(n)


def null_histogram(simulated: DataFrame, observed: float, bins: int = 50) -> DataFrame:
    """bin, low, high, n, observed (whether the observed score is in the bin): equal widths from the least to the largest
    of all scores; every bin has a row."""
    r = simulated.agg(F.least(F.min("x"), F.lit(float(observed))).alias("lo"), F.greatest(F.max("x"), F.lit(float(observed))).alias("hi"))
    r = r.withColumn("w", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0))

    def place(x):
        return F.least(F.floor((x - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")

    n = simulated.filter("x IS NOT NULL").crossJoin(F.broadcast(r)).groupBy(place(F.col("x")).alias("bin")).agg(F.count("*").alias("n"))
    edges = simulated.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(r))
    low = F.col("lo") + F.col("bin") * F.col("w")
    return edges.join(F.broadcast(n), "bin", "left").select("bin", low.alias("low"), (low + F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), (place(F.lit(float(observed))) == F.col("bin")).alias("observed"))


def dendrogram(linkage: DataFrame) -> DataFrame:
    """step, height, position, left_height, left_position, right_height, right_position of a linkage (step, left, right,
    height): leaf k stands at position k and height 0, a merge midway between its two parts. A linkage has n - 1 rows of
    the at most 5000 objects that `clustering.dense` admits."""
    rows = linkage.select("step", "left", "right", "height").limit(5001).collect()
    if len(rows) > 5000:
        raise ValueError("a dendrogram takes at most 5000 merges")
    n, at, out = len(rows) + 1, {}, []
    for step, left, right, height in sorted(rows):
        (hl, pl), (hr, pr) = (at.get(x, (0.0, float(x))) for x in (left, right))
        at[n + step] = (height, (pl + pr) / 2)
        out.append((step, height, (pl + pr) / 2, hl, pl, hr, pr))
    return linkage.sparkSession.createDataFrame(out, "step int, height double, position double, left_height double, left_position double, right_height double, right_position double")
