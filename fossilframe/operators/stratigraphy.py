"""Ordered series and sections. A series is (series, pos, x, y); operators partition by series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fossilframe.functions import special
from fossilframe.operators.clustering import agglomerate, cut_tree
from fossilframe.operators.hypothesis import order_statistic


def _type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def coniss(sections: DataFrame, zones: int = 4) -> DataFrame:
    """series, pos, zone, and the height of the merge that joined each sample to the one below: Ward over neighbours.

    sections: (series, pos, features). A series is one task's work: its merges depend on each other.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = np.array(pdf["features"].tolist(), float)
        merges = agglomerate(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), "ward", adjacent=True)
        gap = np.zeros(len(x))
        first = {i: i for i in range(len(x))}
        for k, (a, b, h, _) in enumerate(merges):
            left, right = sorted((first[a], first[b]))
            gap[right] = h
            first[len(x) + k] = left
        return pd.DataFrame({"series": pdf["series"], "pos": pdf["pos"], "zone": cut_tree(len(x), merges, zones), "height": gap})

    return sections.select("series", "pos", "features").groupBy("series").applyInPandas(run, f"series {_type(sections, 'series')}, pos {_type(sections, 'pos')}, zone int, height double")


def transitions(states: DataFrame) -> DataFrame:
    """from_state, to_state, n of consecutive states (seq_id, pos, state) within each sequence."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    return states.select(F.col("state").alias("from_state"), F.lead("state").over(w).alias("to_state")).filter("to_state IS NOT NULL").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


MAX_STATES = 2000


def markov(states: DataFrame) -> dict[str, DataFrame]:
    """transitions with probability and expectation; test (chi2, df, p_value, is_markovian); stationary (state, p).

    At most MAX_STATES states: their transition matrix comes to the driver.
    """
    t = transitions(states)
    t = t.withColumn("r", F.sum("n").over(Window.partitionBy("from_state"))).withColumn("c", F.sum("n").over(Window.partitionBy("to_state")))
    t = t.crossJoin(F.broadcast(t.agg(F.sum("n").alias("total"))))
    t = t.select("from_state", "to_state", "n", (F.col("n") / F.col("r")).alias("p"), (F.col("r") * F.col("c") / F.col("total")).alias("expected"))
    if t.select("from_state").union(t.select("to_state")).distinct().count() > MAX_STATES:
        raise ValueError(f"more than {MAX_STATES} states")
    rows = [tuple(r) for r in t.select("from_state", "to_state", "n", "p").collect()]
    names = sorted({r[0] for r in rows} | {r[1] for r in rows})
    at = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, _, p in rows:
        m[at[a], at[b]] = p
    v = np.full(len(names), 1 / max(1, len(names)))
    for _ in range(100):
        v = v @ m
    n = np.zeros_like(m)
    for a, b, c, _ in rows:
        n[at[a], at[b]] = c
    e = np.outer(n.sum(1), n.sum(0)) / max(n.sum(), 1)
    chi2 = float(((n - e)[e > 0] ** 2 / e[e > 0]).sum())
    df = (len(names) - 1) ** 2
    p = special.chi2_sf(chi2, df) if df else 1.0
    spark = states.sparkSession
    return {
        "transitions": t,
        "test": spark.createDataFrame([(chi2, df, p, p < 0.05)], "chi2 double, df int, p_value double, is_markovian boolean"),
        "stationary": spark.createDataFrame([(s, float(x)) for s, x in zip(names, v, strict=True)], f"state {_type(states, 'state')}, p double"),
    }


def directional(angles: DataFrame) -> DataFrame:
    """n, mean direction, resultant length, circular variance and Rayleigh test of angle_deg."""
    a = F.radians("angle_deg")
    d = angles.agg(F.count("angle_deg").alias("n"), F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s"))
    r = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))
    z = F.col("n") * r * r
    deg = F.degrees(F.atan2("s", "c"))
    return d.select("n", F.when(deg < 0, deg + 360).otherwise(deg).alias("mean_direction"), r.alias("r"), (1 - r).alias("circular_variance"), z.alias("rayleigh_z"), (F.exp(-z) * (1 + (2 * z - z * z) / (4 * F.col("n")))).alias("p_value"))


def extinction_ci(lads: DataFrame, method: str = "marshall", conf: float = 0.95) -> DataFrame:
    """rank, lad, lower, upper. lads: (rank, lad), rank from 1."""
    if method == "marshall":
        return lads.select("rank", "lad", F.col("lad").alias("lower"), (F.col("lad") - math.log(1 - conf) / (F.col("rank") / 0.7)).alias("upper"))

    @F.pandas_udf(T.DoubleType())
    def q(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([special.beta_quantile(conf, a, b - a + 1) for a, b in zip(r, n, strict=True)])

    t = lads.agg(F.count("*").alias("n"), F.max("lad").alias("top"))
    d = lads.crossJoin(F.broadcast(t))
    extra = F.greatest(F.lit(0.0), q("rank", "n") - F.col("rank") / (F.col("n") + 1)) * F.greatest(F.lit(1.0), F.col("top"))
    return d.select("rank", "lad", F.col("lad").alias("lower"), (F.col("lad") + extra).alias("upper"))


def _values(series: DataFrame, col: str = "x") -> DataFrame:
    """series, v: the values of each series in order of pos."""
    return series.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(col).cast("double").alias("x")))), lambda s: s["x"]).alias("v"))


def periodogram(series: DataFrame) -> DataFrame:
    """series, k, frequency, power, is_peak for k = 1 .. n div 2, after removing the mean; a fast transform per series."""

    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            for s, v in zip(pdf["series"], pdf["v"], strict=True):
                x = np.array(v, float)
                p = np.abs(np.fft.rfft(x - x.mean())[1 : len(x) // 2 + 1]) ** 2 / len(x)
                k = np.arange(1, len(p) + 1)
                yield pd.DataFrame({"series": [s] * len(p), "k": k, "frequency": k / len(x), "power": p, "is_peak": k == (int(p.argmax()) + 1 if len(p) else 0)})

    return _values(series).mapInPandas(run, f"series {_type(series, 'series')}, k int, frequency double, power double, is_peak boolean")


def section_correlation(sections: DataFrame) -> DataFrame:
    """section_a, section_b, r, matched: Pearson over common places of (section, pos, value); undefined counts as 0."""
    s = sections.select("section", "pos", F.col("value").cast("double").alias("value"))
    p = s.alias("a").join(s.alias("b"), (F.col("a.pos") == F.col("b.pos")) & (F.col("a.section") < F.col("b.section")))
    r = p.groupBy(F.col("a.section").alias("section_a"), F.col("b.section").alias("section_b")).agg(F.corr("a.value", "b.value").alias("r"))
    r = r.withColumn("r", F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)))
    return r.withColumn("matched", F.col("r") > 0.5)


def cooccurrence(events: DataFrame) -> DataFrame:
    """a, b, n: sections in which both events (section, event, fad, lad) are present (fad or lad above 0)."""
    e = events.filter("fad > 0 OR lad > 0").select("section", "event").distinct()
    return e.alias("x").join(e.alias("y"), (F.col("x.section") == F.col("y.section")) & (F.col("x.event") < F.col("y.event"))).groupBy(F.col("x.event").alias("a"), F.col("y.event").alias("b")).agg(F.count("*").alias("n"))


def unitary_associations(events: DataFrame, min_occurrence: int = 1) -> DataFrame:
    """zone, event: greedy first-fit cliques (two events or more) of the co-occurrence graph, events in order of name.

    The graph is one node an event; it comes to the driver (at most 20 000 events).
    """
    edges = {(r["a"], r["b"]) for r in cooccurrence(events).filter(F.col("n") >= min_occurrence).collect()}
    names = sorted({x for e in edges for x in e})
    if len(names) > 20_000:
        raise ValueError("too many events")
    cliques: list[list] = []
    for x in names:
        for c in cliques:
            if all((min(x, y), max(x, y)) in edges for y in c):
                c.append(x)
                break
        else:
            cliques.append([x])
    rows = [(k + 1, x) for k, c in enumerate(c for c in cliques if len(c) > 1) for x in c]
    return events.sparkSession.createDataFrame(rows, f"zone int, event {_type(events, 'event')}")


def isotopes(series: DataFrame) -> DataFrame:
    """series, n, mean, sd, slope, maxima: x is the depth, y the value; maxima are strict local ones in order of pos."""
    w = Window.partitionBy("series").orderBy("pos")
    d = series.withColumn("top", (F.col("y") > F.lag("y").over(w)) & (F.col("y") > F.lead("y").over(w)))
    return d.groupBy("series").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.expr("regr_slope(y, x)").alias("slope"), F.count_if("top").alias("maxima"))


def wavelet(series: DataFrame, low: int = 2, high: int = 60, step: int = 2) -> DataFrame:
    """series, scale, period, power, is_peak: mean power of the real Morlet transform at each scale."""
    scales = np.arange(low, high + 1, step)

    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            for s, v in zip(pdf["series"], pdf["v"], strict=True):
                x = np.array(v, float)
                n = len(x)
                lag = np.arange(-(n - 1), n)
                size = 1 << (3 * n).bit_length()
                fx, power = np.fft.rfft(x, size), []
                for a in scales:
                    t = lag / a
                    k = np.exp(-t * t / 2) * np.cos(5 * t)
                    power.append(float((np.fft.irfft(fx * np.fft.rfft(k, size), size)[n - 1 : 2 * n - 1] ** 2 / a).mean()))
                yield pd.DataFrame({"series": [s] * len(scales), "scale": scales, "period": 1.03 * scales, "power": power, "is_peak": np.arange(len(scales)) == int(np.argmax(power))})

    return _values(series).mapInPandas(run, f"series {_type(series, 'series')}, scale int, period double, power double, is_peak boolean")


def lowess(series: DataFrame, frac: float = 0.3) -> DataFrame:
    """series, pos, x, smooth: tricube-weighted mean of the k nearest in x; ties by place. One series is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        k, out = max(2, int(frac * len(x))), np.empty(len(x))
        for i in range(len(x)):
            d = np.abs(x - x[i])
            near = np.argsort(d, kind="stable")[:k]
            top = d[near].max()
            w = (1 - np.minimum(1, d[near] / top) ** 3) ** 3 if top > 0 else np.ones(len(near))
            out[i] = (w @ y[near]) / w.sum() if w.sum() > 0 else y[near].mean()
        return pd.DataFrame({"series": pdf["series"], "pos": pdf["pos"], "x": x, "smooth": out})

    return series.select("series", "pos", "x", "y").groupBy("series").applyInPandas(run, f"series {_type(series, 'series')}, pos {_type(series, 'pos')}, x double, smooth double")


def polynomial_trend(series: DataFrame, degree: int = 2) -> DataFrame:
    """series, coefficients, r2: least squares from power sums, one aggregate pass; x is centred and scaled for the solve."""
    c = series.groupBy("series").agg(F.avg("x").alias("m"), F.coalesce(F.nullif(F.stddev_pop("x"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    d = series.join(c, "series").withColumn("u", (F.col("x") - F.col("m")) / F.col("s"))
    powers = [F.sum(F.pow("u", F.lit(float(k)))).alias(f"p{k}") for k in range(2 * degree + 1)]
    cross = [F.sum(F.pow("u", F.lit(float(k))) * F.col("y")).alias(f"c{k}") for k in range(degree + 1)]
    a = d.groupBy("series").agg(F.first("m").alias("m"), F.first("s").alias("s"), F.sum(F.col("y") * F.col("y")).alias("yy"), *powers, *cross)

    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            rows = []
            for r in pdf.to_dict("records"):
                g = np.array([[r[f"p{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
                b = np.array([r[f"c{i}"] for i in range(degree + 1)])
                w = np.linalg.lstsq(g, b, rcond=None)[0]
                sst, sse = r["yy"] - b[0] ** 2 / g[0, 0], r["yy"] - w @ b
                poly = np.polynomial.Polynomial(w)(np.polynomial.Polynomial([-r["m"] / r["s"], 1 / r["s"]]))
                rows.append((r["series"], poly.coef.tolist(), 1 - sse / sst if sst > 0 else 0.0))
            yield pd.DataFrame(rows, columns=["series", "coefficients", "r2"])

    return a.mapInPandas(run, f"series {_type(series, 'series')}, coefficients array<double>, r2 double")


def cross_validate(series: DataFrame, degree: int = 2) -> DataFrame:
    """series, press, q2: leave-one-out errors from leverages, e / (1 - h)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        v = np.vander((x - x.mean()) / (x.std() or 1), degree + 1)
        q, _ = np.linalg.qr(v)
        e = (y - q @ (q.T @ y)) / np.maximum(1 - (q * q).sum(1), 1e-12)
        sst = ((y - y.mean()) ** 2).sum()
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "press": [float(e @ e)], "q2": [float(1 - e @ e / sst) if sst > 0 else 0.0]})

    return series.select("series", "x", "y").groupBy("series").applyInPandas(run, f"series {_type(series, 'series')}, press double, q2 double")


def moving_average(series: DataFrame, window: int = 5) -> DataFrame:
    """Centred mean over window div 2 places on either side, fewer at the ends."""
    h = window // 2
    return series.withColumn("average", F.avg("x").over(Window.partitionBy("series").orderBy("pos").rowsBetween(-h, h)))


def flag_outliers(df: DataFrame, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """(group, x) with is_outlier: strictly outside the fences, or |z| above the threshold. Quartiles aren't interpolated."""
    x = F.col("x")
    if method == "zscore":
        s = df.groupBy("group").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
        return df.join(F.broadcast(s), "group").select("group", "x", F.coalesce(F.abs(x - F.col("m")) / F.nullif("sd", F.lit(0.0)) > threshold, F.lit(False)).alias("is_outlier"))
    q = order_statistic(df, "x", ["group"], {"q1": "floor(n * 0.25)", "q3": "floor(n * 0.75)"})
    span = (F.col("q3") - F.col("q1")) * threshold
    return df.join(q, "group", "left").select("group", "x", ((x < F.col("q1") - span) | (x > F.col("q3") + span)).alias("is_outlier"))


def remove_outliers(df: DataFrame, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    return flag_outliers(df, method, threshold).filter("NOT is_outlier").select("group", "x")


def excursions(series: DataFrame, threshold: float = 2.0) -> DataFrame:
    """series, pos, x, z, direction of values at least `threshold` sample deviations from their series' mean."""
    s = series.groupBy("series").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    z = (F.col("x") - F.col("m")) / F.nullif("sd", F.lit(0.0))
    return series.join(F.broadcast(s), "series").withColumn("z", z).filter(F.abs("z") >= threshold).select("series", "pos", "x", "z", F.when(F.col("z") > 0, "positive").otherwise("negative").alias("direction"))


def autocovariances(series: DataFrame, lags: int) -> DataFrame:
    """series, lag, value: biased autocovariances (divided by n)."""
    w = Window.partitionBy("series").orderBy("pos")
    m = series.groupBy("series").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    d = series.join(F.broadcast(m), "series").withColumn("e", F.col("x") - F.col("m"))
    parts: list[Column] = [F.struct(F.lit(k).alias("lag"), (F.col("e") * F.lag("e", k).over(w)).alias("v")) for k in range(lags + 1)]
    d = d.select("series", "n", F.array(*parts).alias("p")).select("series", "n", F.explode("p").alias("p"))
    return d.groupBy("series", "p.lag").agg((F.sum("p.v") / F.first("n")).alias("value"))


def levinson(r: np.ndarray, p: int) -> np.ndarray:
    """Autoregressive coefficients from autocovariances r[0..p]."""
    phi, v = np.zeros(0), r[0]
    for k in range(1, p + 1):
        a = (r[k] - phi @ r[k - 1 : 0 : -1][: len(phi)]) / v if v > 0 else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        v *= 1 - a * a
    return phi


def fit_arma(series: DataFrame, p: int = 1, q: int = 0) -> DataFrame:
    """series, mean, phi, theta (zeros), sigma2, aic by Yule-Walker; residuals from place p on."""

    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            rows = []
            for s, v in zip(pdf["series"], pdf["v"], strict=True):
                x = np.array(v, float)
                n, e = len(x), x - x.mean()
                phi = levinson(np.array([e[k:] @ e[: n - k] / n for k in range(p + 1)]), p)
                res = np.array([e[t] - phi @ e[t - p : t][::-1] for t in range(p, n)])
                ss = float(res @ res)
                rows.append((s, float(x.mean()), phi.tolist(), [0.0] * q, ss / max(1, len(res)), n * math.log(ss / n + 1e-10) + 2 * (p + q + 1), e[-p:][::-1].tolist() if p else []))
            yield pd.DataFrame(rows, columns=["series", "mean", "phi", "theta", "sigma2", "aic", "last"])

    return _values(series).mapInPandas(run, f"series {_type(series, 'series')}, mean double, phi array<double>, theta array<double>, sigma2 double, aic double, last array<double>")


def forecast(model: DataFrame, steps: int) -> DataFrame:
    """series, step, value: mean + sum of phi times the last deviations, rolled forward."""

    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            rows = []
            for r in pdf.to_dict("records"):
                last, phi = list(r["last"]), np.array(r["phi"])
                for k in range(steps):
                    e = float(phi @ np.array(last[: len(phi)])) if len(phi) else 0.0
                    rows.append((r["series"], k + 1, r["mean"] + e))
                    last.insert(0, e)
            yield pd.DataFrame(rows, columns=["series", "step", "value"])

    return model.mapInPandas(run, f"series {_type(model, 'series')}, step int, value double")
