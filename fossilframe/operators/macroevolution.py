"""Survivorship, diversification, hazards and growth."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fossilframe.functions import special
from fossilframe.functions.exprs import two_sided_p
from fossilframe.operators.hypothesis import PIECES


def _overlapping(ranges: DataFrame, intervals: DataFrame, touch: str) -> DataFrame:
    """Ranges (taxon, first, last) with the intervals (t_start, t_end) they meet. The intervals are a small, broadcast side
    up to 10 000; beyond that Spark plans the range join itself."""
    few = intervals.limit(10_001).count() <= 10_000
    return ranges.join(F.broadcast(intervals) if few else intervals, F.expr(touch))


def cohort_survivorship(ranges: DataFrame, intervals: DataFrame) -> DataFrame:
    """t_start, t_end, survivors, fb, lb, total, p, extinction, origination, ci_low, ci_high in forward time.

    Classes, the first that matches: survivors begin by the start and last to the end; fb begin inside and last beyond;
    lb began before and end inside. The limits are Wilson's at z = 1.96.
    """
    j = _overlapping(ranges, intervals, "first <= t_end AND last >= t_start")
    cls = F.when((F.col("first") <= F.col("t_start")) & (F.col("last") >= F.col("t_end")), "s").when((F.col("first") >= F.col("t_start")) & (F.col("first") < F.col("t_end")) & (F.col("last") >= F.col("t_end")), "f").when((F.col("last") >= F.col("t_start")) & (F.col("last") < F.col("t_end")) & (F.col("first") < F.col("t_start")), "l")
    g = j.withColumn("cls", cls).groupBy("t_start", "t_end").agg(*[F.count_if(F.col("cls") == k).alias(n) for k, n in (("s", "survivors"), ("f", "fb"), ("l", "lb"))])
    g = intervals.select("t_start", "t_end").join(g, ["t_start", "t_end"], "left").fillna(0, ["survivors", "fb", "lb"])
    n = F.col("survivors") + F.col("fb") + F.col("lb")
    g = g.withColumn("total", n).withColumn("p", F.when(F.col("total") > 0, F.col("survivors") / F.col("total")))
    dt, p, t, z = F.abs(F.col("t_end") - F.col("t_start")), F.col("p"), F.col("total"), 1.96
    mid, half = (p + z * z / (2 * t)) / (1 + z * z / t), z * F.sqrt(p * (1 - p) / t + z * z / (4 * t * t)) / (1 + z * z / t)
    some = F.col("total") > 0
    return g.select("t_start", "t_end", "survivors", "fb", "lb", "total", "p", F.when(some & (p > 0), (0 - F.log(p)) / dt).alias("extinction"), F.when(some & (p < 1), (0 - F.log(1 - p)) / dt).alias("origination"), F.when(some, mid - half).alias("ci_low"), F.when(some, mid + half).alias("ci_high"))


def diversity_dynamics(ranges: DataFrame, intervals: DataFrame) -> DataFrame:
    """midpoint, richness (range-through), net_rate per unit of time against the interval before."""
    mid = (F.col("t_start") + F.col("t_end")) / 2
    i = intervals.withColumn("midpoint", mid)
    g = _overlapping(ranges, i, "first <= midpoint AND last >= midpoint").groupBy("t_start", "t_end").agg(F.count("*").alias("richness"))
    d = i.join(g, ["t_start", "t_end"], "left").fillna(0, ["richness"])
    w = Window.orderBy("midpoint")  # one row for each interval
    return d.select("midpoint", "richness", ((F.col("richness") - F.lag("richness").over(w)) / (F.col("midpoint") - F.lag("midpoint").over(w))).alias("net_rate"))


def simulate_fbd(spark, birth: float, death: float, sampling: float, time: float, n0: int = 1, replicates: int = 1, seed: int = 0, max_events: int = 100_000) -> DataFrame:
    """replicate, lineages (alive at the end), total, fossils, curve array<struct<t, n>>: fossilised birth-death by Gillespie."""

    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            for r in pdf["id"]:
                rnd, t, n, total, fossils, events = np.random.default_rng([seed, int(r)]), 0.0, n0, n0, 0, 0
                curve, rate = [(0.0, n0)], birth + death + sampling
                while n and rate > 0 and events < max_events:
                    t += rnd.exponential(1 / (n * rate))
                    if t > time:
                        break
                    u = rnd.random() * rate
                    if u < birth:
                        n, total = n + 1, total + 1
                    elif u < birth + death:
                        n -= 1
                    else:
                        fossils += 1
                    events += 1
                    if u < birth + death:
                        curve.append((t, n))
                yield pd.DataFrame({"replicate": [int(r)], "lineages": [n], "total": [total], "fossils": [fossils], "curve": [[{"t": a, "n": b} for a, b in curve]]})

    return spark.range(replicates).mapInPandas(run, "replicate int, lineages long, total long, fossils long, curve array<struct<t:double,n:long>>")


def simulate_neutral(spark, n: int, time: float, speciation: float = 0.1, extinction: float = 0.05, dt: float = 0.1, replicates: int = 1, seed: int = 0) -> DataFrame:
    """replicate, t, n, births, deaths: Poisson births, deaths capped at the number alive."""

    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            for r in pdf["id"]:
                rnd, alive, rows = np.random.default_rng([seed, int(r)]), n, []
                for k in range(1, int(round(time / dt)) + 1):
                    b = int(rnd.poisson(alive * speciation * dt))
                    d = min(int(rnd.poisson(alive * extinction * dt)), alive + b)
                    alive += b - d
                    rows.append((int(r), k * dt, alive, b, d))
                yield pd.DataFrame(rows, columns=["replicate", "t", "n", "births", "deaths"])

    return spark.range(replicates).mapInPandas(run, "replicate int, t double, n long, births long, deaths long")


def cox(df: DataFrame, max_iter: int = 50, tol: float = 1e-6) -> DataFrame:
    """variable, beta, hazard_ratio, se, z, p_value, log_likelihood, concordance: Newton with Breslow's handling of ties.

    df: (id, time, event, x array<double>). Each step sums risk terms by distinct time in Spark; only those sums, one row
    for each distinct time, are accumulated on the driver.
    """
    x = df.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).orderBy("k").collect()
    mean = np.array([r["m"] for r in x])
    p = len(mean)
    d = df.select(F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"), F.zip_with(F.col("x").cast("array<double>"), F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b).alias("x")).persist()
    beta, loglik, info = np.zeros(p), 0.0, np.eye(p)

    xs = [F.col("x")[k] for k in range(p)]
    upper = [(i, j) for i in range(p) for j in range(i, p)]

    def sums(beta: np.ndarray) -> list:
        """Risk sums of each distinct time: plain aggregates, combined before the shuffle."""
        lp = sum((x * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))
        w = d.withColumn("w", F.exp(F.least(lp, F.lit(20.0))))
        return (
            w.groupBy("time")
            .agg(
                F.sum("event").cast("double").alias("d"),
                F.sum("w").alias("s0"),
                F.array(*[F.sum(F.col("w") * x) for x in xs]).alias("s1"),
                F.array(*[F.sum(F.col("w") * xs[i] * xs[j]) for i, j in upper]).alias("s2"),
                F.array(*[F.sum(F.col("event") * x) for x in xs]).alias("sx"),
            )
            .orderBy(F.desc("time"))
            .collect()
        )

    def square(v: list) -> np.ndarray:
        m = np.zeros((p, p))
        for (i, j), x in zip(upper, v, strict=True):
            m[i, j] = m[j, i] = x
        return m

    for _ in range(max_iter):
        s0, s1, s2 = 0.0, np.zeros(p), np.zeros((p, p))
        loglik, score, info = 0.0, np.zeros(p), np.zeros((p, p))
        for r in sums(beta):
            s0, s1, s2 = s0 + r["s0"], s1 + np.array(r["s1"]), s2 + square(r["s2"])
            if r["d"]:
                m = s1 / s0
                loglik += float(beta @ np.array(r["sx"])) - r["d"] * math.log(s0)
                score += np.array(r["sx"]) - r["d"] * m
                info += r["d"] * (s2 / s0 - np.outer(m, m))
        step = np.linalg.solve(info + 1e-12 * np.eye(p), score)
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    lp = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(b)) for b in beta]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    c = _concordance(d.select("time", "event", lp.alias("lp")))
    d.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(info + 1e-12 * np.eye(p))))
    rows = [(k, float(beta[k]), float(math.exp(beta[k])), float(se[k]), float(beta[k] / se[k]), float(2 * special.normal_cdf(-abs(beta[k] / se[k]))), float(loglik), float(c)) for k in range(p)]
    return df.sparkSession.createDataFrame(rows, "variable int, beta double, hazard_ratio double, se double, z double, p_value double, log_likelihood double, concordance double")


def _concordance(d: DataFrame) -> float:
    """Share of comparable pairs (the earlier one an event) whose order the predictor gives; equal predictors are half right.

    Exact. The distinct (time, lp) are cut into PIECES ranges of lp. Pairs within a range are counted in its task, by halving
    the ranks of its predictors, a bit at a time; pairs across ranges from the sums by range and time, which alone reach the
    driver.
    """
    g = d.filter("time IS NOT NULL AND lp IS NOT NULL").groupBy("time", "lp").agg(F.coalesce(F.sum("event"), F.lit(0)).cast("double").alias("e"), F.count("*").cast("double").alias("n")).persist()
    ends = g.agg(F.percentile_approx("lp", [k / PIECES for k in range(1, PIECES)], 1000)).first()[0]
    if not ends:
        g.unpersist()
        return 0.5
    g = g.withColumn("piece", F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(ends))]), lambda x: x < F.col("lp"))))
    good = g.groupBy("piece").applyInArrow(_ordered_pairs, "good double").agg(F.sum("good")).first()[0]
    t = g.groupBy("piece", "time").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).toArrow()
    g.unpersist()
    times, at = np.unique(t.column("time").to_numpy(), return_inverse=True)
    e, n = np.zeros((PIECES, len(times))), np.zeros((PIECES, len(times)))
    e[t.column("piece").to_numpy(), at], n[t.column("piece").to_numpy(), at] = t.column("e").to_numpy(), t.column("n").to_numpy()
    later = n.sum(1)[:, None] - np.cumsum(n, 1)
    below = np.cumsum(later, 0) - later
    all_ = float((e.sum(0) * later.sum(0)).sum())
    return (good + float((e * below).sum())) / all_ if all_ else 0.5


def _ordered_pairs(t: pa.Table) -> pa.Table:
    """good: the pairs of an event and a row of later time and lower lp, and half of those of equal lp."""
    time, lp, e, n = (t.column(c).to_numpy() for c in ("time", "lp", "e", "n"))
    order = np.argsort(-time, kind="stable")
    time, lp, e, n = time[order], lp[order], e[order], n[order]
    rank = np.unique(lp, return_inverse=True)[1]

    def later(group: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each row, the weight of the rows of its group with a later time."""
        o = np.argsort(group, kind="stable")
        gs, ts = group[o], time[o]
        before = np.cumsum(weight[o]) - weight[o]
        start = np.concatenate([[True], gs[1:] != gs[:-1]])
        tied = start | np.concatenate([[True], ts[1:] != ts[:-1]])
        out = np.empty(len(o))
        out[o] = before[np.flatnonzero(tied)[np.cumsum(tied) - 1]] - before[np.flatnonzero(start)[np.cumsum(start) - 1]]
        return out

    good = float(e @ later(rank, n)) / 2
    for bit in range(int(rank.max()).bit_length()):
        upper = (rank >> bit & 1) == 1
        good += float(e[upper] @ later(rank >> (bit + 1), np.where(upper, 0.0, n))[upper])
    return pa.table({"good": [good]})


def log_rank(df: DataFrame, first, second) -> DataFrame:
    """observed, expected, variance, chi2, p_value of two groups of (time, event, group); at risk at t: time >= t."""
    one = (F.col("group") == first).cast("int")
    t = df.filter(F.col("group").isin(first, second)).groupBy("time").agg(F.sum("event").alias("d"), F.sum(F.col("event") * one).alias("d1"), F.count("*").alias("c"), F.sum(one).alias("c1"))
    w = Window.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)  # distinct times only
    t = t.withColumn("n", F.sum("c").over(w)).withColumn("n1", F.sum("c1").over(w)).filter("d > 0")
    e = F.col("d") * F.col("n1") / F.col("n")
    v = F.when(F.col("n") > 1, e * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    s = t.agg(F.sum("d1").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("variance"))
    chi2 = F.pow(F.col("observed") - F.col("expected"), 2) / F.col("variance")
    return s.select("observed", "expected", "variance", chi2.alias("chi2"), two_sided_p(F.sqrt(chi2)).alias("p_value"))


def fit_exponential(df: DataFrame) -> DataFrame:
    """rate, n0, r2, aic of ln v on t."""
    d = df.select(F.col("t").cast("double").alias("t"), F.log(F.greatest(F.col("v").cast("double"), F.lit(1e-10))).alias("y"))
    mse = "regr_syy(y, t) * (1 - coalesce(regr_r2(y, t), 0)) / count(*)"
    return d.agg(F.expr("regr_slope(y, t)").alias("rate"), F.exp(F.expr("regr_intercept(y, t)")).alias("n0"), F.expr("regr_r2(y, t)").alias("r2"), F.expr(f"count(*) * ln({mse} + 1e-10) + 4").alias("aic"))


def fit_logistic(df: DataFrame) -> DataFrame:
    """k, rate, midpoint, r2, aic: the best of four capacities (1.5, 2, 3, 5 times the maximum) by R2 of the logit."""
    top = df.agg(F.max(F.col("v").cast("double")).alias("top"))
    d = df.crossJoin(F.broadcast(top)).select("t", "v", F.explode(F.transform(F.array(*map(F.lit, (1.5, 2.0, 3.0, 5.0))), lambda f: f * F.col("top"))).alias("k"))
    d = d.select("k", F.col("t").cast("double").alias("t"), F.log(F.greatest(F.col("k") / F.greatest(F.col("v").cast("double"), F.lit(1e-10)) - 1, F.lit(1e-10))).alias("y"))
    mse = "regr_syy(y, t) * (1 - coalesce(regr_r2(y, t), 0)) / count(*)"
    g = d.groupBy("k").agg(F.expr("regr_slope(y, t)").alias("s"), F.expr("regr_intercept(y, t)").alias("i"), F.expr("regr_r2(y, t)").alias("r2"), F.expr(f"count(*) * ln({mse} + 1e-10) + 6").alias("aic"))
    best = g.agg(F.max(F.struct("r2", -F.col("k"), "k", "s", "i", "aic")).alias("b"))
    return best.select(F.col("b.k").alias("k"), (-F.col("b.s")).alias("rate"), (-F.col("b.i") / F.col("b.s")).alias("midpoint"), F.col("b.r2").alias("r2"), F.col("b.aic").alias("aic"))


def fbd_log_likelihood(nodes: DataFrame, birth: float, death: float, sampling: float, rho: float = 1.0) -> DataFrame:
    """log_likelihood of nodes (age, is_extant, is_fossil) under closed-form E(t); minus infinity where E is 0."""
    c1 = math.sqrt((birth - death - sampling) ** 2 + 4 * birth * sampling)
    c2 = -(birth - death - 2 * birth * rho - sampling) / c1
    t = F.col("age").cast("double")
    ex = F.exp(-c1 * t)
    e = (birth + death + sampling + c1 * (ex * (1 - c2) - (1 + c2)) / (ex * (1 - c2) + (1 + c2))) / (2 * birth)
    e = F.least(F.lit(1.0), F.greatest(F.lit(0.0), e))
    ln_e = F.when(e > 0, F.log(e)).otherwise(F.lit(-math.inf))
    ln = lambda v: math.log(v) if v > 0 else -math.inf
    term = -(birth + death + sampling) * t + F.when(F.col("is_extant"), F.lit(ln(rho))).when(F.col("is_fossil"), F.lit(ln(sampling)) + ln_e).otherwise(F.lit(ln(birth)) + ln_e)
    return nodes.agg(F.sum(term).alias("log_likelihood"))


def equilibrium(df: DataFrame) -> DataFrame:
    """origination, extinction, ratio, z, p_value for rates (origination, extinction)."""
    o, e = F.col("origination").cast("double"), F.col("extinction").cast("double")
    z = (o - e) / F.sqrt(o * o + e * e)
    return df.select("origination", "extinction", F.when(e > 0, o / e).otherwise(F.lit(math.inf)).alias("ratio"), z.alias("z"), F.when(e > 0, two_sided_p(z)).otherwise(0.0).alias("p_value"))
