"""Diversity, richness, community comparison. Communities are long: (sample, taxon, abundance); absent cells are zero."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fossilframe.operators.clustering import all_pairs
from fossilframe.operators.multivariate import symmetric_eigen


def totals(community: DataFrame) -> DataFrame:
    """One row for each cell with a positive abundance, repeated cells summed."""
    return community.filter("abundance > 0").groupBy("sample", "taxon").agg(F.sum("abundance").cast("double").alias("abundance"))


def diversity(community: DataFrame) -> DataFrame:
    """Richness, total, Shannon, Simpson (1 - D), Pielou, Margalef and evenness of each sample.

    With N the total, H = ln N - (sum a ln a) / N and D = (sum a^2) / N^2: one pass, sums alone are shuffled.
    """
    a = F.col("abundance")
    s = totals(community).groupBy("sample").agg(F.count("*").alias("richness"), F.sum(a).alias("total"), F.sum(a * F.log(a)).alias("alna"), F.sum(a * a).alias("sq"))
    h = F.log("total") - F.col("alna") / F.col("total")
    s = s.withColumn("shannon", h)
    pielou = F.when(F.col("richness") > 1, F.col("shannon") / F.log("richness")).otherwise(0.0)
    return s.select(
        "sample",
        "richness",
        "total",
        "shannon",
        (1 - F.col("sq") / (F.col("total") * F.col("total"))).alias("simpson"),
        pielou.alias("pielou"),
        F.when(F.col("total") > 1, (F.col("richness") - 1) / F.log("total")).otherwise(0.0).alias("margalef"),
        pielou.alias("evenness"),
    )


def shannon(community: DataFrame) -> DataFrame:
    return diversity(community).select("sample", "shannon")


def simpson(community: DataFrame) -> DataFrame:
    return diversity(community).select("sample", "simpson")


def rarefaction(community: DataFrame, max_n: int | None = None, points: int = 50) -> DataFrame:
    """sample, n, expected: expected richness of n individuals, for n = 1, 1 + step, ... below max_n (half the total)."""

    @F.pandas_udf(T.DoubleType())
    def kept(total: pd.Series, count: pd.Series, n: pd.Series) -> pd.Series:
        def one(big: float, c: float, k: float) -> float:
            if big - c < k:
                return 1.0
            lg = math.lgamma
            return 1 - math.exp(lg(big - c + 1) - lg(big - c - k + 1) - lg(big + 1) + lg(big - k + 1))

        return pd.Series([one(*x) for x in zip(total, count, n, strict=True)])

    c = totals(community)
    t = c.groupBy("sample").agg(F.sum("abundance").alias("total"))
    top = F.lit(max_n).cast("long") if max_n else F.floor(F.col("total") / 2)
    t = t.withColumn("top", top).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("top") / points)))
    t = t.filter("top > 1").withColumn("n", F.explode(F.expr("sequence(1L, top - 1, step)")))
    cells = c.groupBy("sample", "abundance").count()  # equal counts share one term
    return cells.join(t.select("sample", "total", "n"), "sample").groupBy("sample", "n").agg(F.sum(F.col("count") * kept("total", "abundance", F.col("n").cast("double"))).alias("expected"))


def beta_diversity(community: DataFrame, index: str = "jaccard", variant: str = "plain") -> DataFrame:
    """a, b, c, total, turnover, nestedness of each pair of samples. variant `baselga` takes the published Sorensen parts."""
    present = totals(community).select("sample", "taxon")
    rich = present.groupBy("sample").agg(F.count("*").alias("r"))
    both = present.alias("x").join(present.alias("y"), (F.col("x.taxon") == F.col("y.taxon")) & (F.col("x.sample") < F.col("y.sample")))
    both = both.groupBy(F.col("x.sample").alias("sample_a"), F.col("y.sample").alias("sample_b")).agg(F.count("*").alias("shared"))
    pairs = all_pairs(rich, "sample", "r").toDF("sample_a", "sample_b", "ra", "rb")
    p = pairs.join(both, ["sample_a", "sample_b"], "left").withColumn("a", F.coalesce("shared", F.lit(0)))
    p = p.withColumn("b", F.col("ra") - F.col("a")).withColumn("c", F.col("rb") - F.col("a"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    low, gap = F.least(b, c), F.abs(b - c)
    div = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    if index == "jaccard":
        parts = div(b + c, a + b + c), div(2 * low, a + 2 * low), div(a * gap, (a + b + c) * (a + 2 * low))
    elif variant == "baselga":
        parts = div(b + c, 2 * a + b + c), div(low, a + low), div(a * gap, (2 * a + b + c) * (a + low))
    else:
        parts = div(b + c, 2 * a + b + c), div(low, 2 * a + low), div(a * gap, (2 * a + b + c) * (2 * a + low))
    return p.select("sample_a", "sample_b", "a", "b", "c", *[x.alias(n) for x, n in zip(parts, ("total", "turnover", "nestedness"), strict=True)])


def c_score(community: DataFrame) -> DataFrame:
    """One row: mean of (r_i - S)(r_j - S) over pairs of taxa, and the number of checkerboard units."""
    t = totals(community).select("sample", "taxon")
    flip = t.select(F.col("taxon").alias("sample"), F.col("sample").alias("taxon"))
    p = beta_diversity(flip.withColumn("abundance", F.lit(1.0)))
    return p.agg(F.avg(F.col("b") * F.col("c")).alias("c_score"), F.sum(F.col("b") * F.col("c")).alias("checkerboard"))


def null_model(community: DataFrame, statistic: str = "c_score", permutations: int = 999, seed: int = 0, variant: str = "fill") -> DataFrame:
    """observed, mean, sd, ses, p of the statistic under random swaps (`fill`: any two cells; `fixed_fixed`: checkerboards).

    The presence matrix is broadcast (taxa x samples, at most 20 million cells); the replicates run in parallel, each with
    a generator of its own.
    """
    t = totals(community)
    cells = math.prod(t.agg(F.countDistinct("taxon"), F.countDistinct("sample")).first())
    if cells > 20_000_000:
        raise ValueError(f"a matrix of {cells} cells; at most 20 million can be permuted in one task")
    rows, cols = (np.array(sorted(r[0] for r in t.select(c).distinct().collect())) for c in ("taxon", "sample"))
    m = np.zeros((len(rows), len(cols)), np.int8)
    for s, x in t.select("sample", "taxon").collect():
        m[np.searchsorted(rows, x), np.searchsorted(cols, s)] = 1

    def score(x: np.ndarray) -> float:
        r = x.sum(1).astype(float)
        shared = x.astype(float) @ x.T
        i, j = np.triu_indices(len(x), 1)
        units = (r[i] - shared[i, j]) * (r[j] - shared[i, j])
        return float(units.mean() if statistic == "c_score" else units.sum()) if len(units) else 0.0

    shared = t.sparkSession.sparkContext.broadcast(m)

    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            out = []
            for k in pdf["id"]:
                rnd, x = np.random.default_rng([seed, int(k)]), shared.value.copy()
                for _ in range(int(0.1 * x.size)):
                    a, b = rnd.integers(x.shape[0], size=2)
                    c, d = rnd.integers(x.shape[1], size=2)
                    if variant == "fill":
                        x[a, c], x[b, d] = x[b, d], x[a, c]
                    elif x[a, c] == x[b, d] != x[a, d] == x[b, c]:
                        x[a, [c, d]], x[b, [c, d]] = x[a, [d, c]], x[b, [d, c]]
                out.append(score(x))
            yield pd.DataFrame({"value": out})

    sims = t.sparkSession.range(permutations).mapInPandas(run, "value double")
    observed = score(m)
    return sims.agg(F.lit(observed).alias("observed"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), (F.lit(observed) - F.avg("value")).alias("gap"), (F.count_if(F.col("value") >= observed) / F.count("*")).alias("p")).select("observed", "mean", "sd", F.when(F.col("sd") > 0, F.col("gap") / F.col("sd")).otherwise(0.0).alias("ses"), "p")


def dtw(series: DataFrame, pairs: DataFrame, window: int | None = None) -> DataFrame:
    """a, b, distance, path_length: dynamic time warping of pairs (a, b) of series (series, pos, value)."""
    s = series.groupBy("series").agg(F.expr("transform(array_sort(collect_list(struct(pos, value))), x -> x.value)").alias("v"))
    p = pairs.join(s.select(F.col("series").alias("a"), F.col("v").alias("va")), "a").join(s.select(F.col("series").alias("b"), F.col("v").alias("vb")), "b")

    def one(x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
        n, m = len(x), len(y)
        w = max(window, abs(n - m)) if window else max(n, m)
        cost = np.full((n, m), np.inf)
        for i in range(n):
            for j in range(m):
                d = abs(x[i] - y[j])
                if i == 0 or j == 0:
                    cost[i, j] = d + (0 if i == j == 0 else cost[i, j - 1] if i == 0 else cost[i - 1, j])
                elif abs(i - j) <= w:
                    cost[i, j] = d + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
        i, j, steps = n - 1, m - 1, 1
        while i or j:
            if i == 0 or j == 0:
                i, j = max(0, i - 1), max(0, j - 1) if i == 0 else j
            else:
                best = min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
                i, j = (i - 1, j - 1) if cost[i - 1, j - 1] == best else (i - 1, j) if cost[i - 1, j] == best else (i, j - 1)
            steps += 1
        return float(cost[-1, -1]), steps

    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            got = [one(np.array(x), np.array(y)) for x, y in zip(pdf["va"], pdf["vb"], strict=True)]
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "distance": [g[0] for g in got], "path_length": [g[1] for g in got]})

    kind = series.schema["series"].dataType.simpleString()
    return p.mapInPandas(run, f"a {kind}, b {kind}, distance double, path_length long")


def lb_keogh(query: DataFrame, reference: DataFrame, window: int = 5) -> DataFrame:
    """bound: lower bound of the warping distance of query (pos, value) to reference (pos, value). Places beyond the
    reference use its last envelope."""
    w = Window.orderBy("pos").rowsBetween(-window, window)
    env = reference.select("pos", F.max("value").over(w).alias("hi"), F.min("value").over(w).alias("lo"))
    last = reference.agg(F.max("pos").alias("last"))
    q = query.crossJoin(F.broadcast(last)).select("value", F.least("pos", "last").alias("pos"))
    over = F.when(F.col("value") > F.col("hi"), F.col("value") - F.col("hi")).when(F.col("value") < F.col("lo"), F.col("lo") - F.col("value")).otherwise(0.0)
    return q.join(env, "pos").agg(F.sqrt(F.sum(over * over)).alias("bound"))


def abundance_models(community: DataFrame) -> DataFrame:
    """Log-normal, geometric and broken-stick fits of each sample's rank abundances."""
    c = totals(community)
    w = Window.partitionBy("sample").orderBy(F.desc("abundance"), "taxon")
    r = c.withColumn("rank", F.row_number().over(w))
    r = r.withColumn("x", F.log("rank")).withColumn("y", F.log("abundance"))
    whole = Window.partitionBy("sample")
    r = r.withColumn("s", F.count("*").over(whole)).withColumn("total", F.sum("abundance").over(whole))
    tail = Window.partitionBy("sample").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("stick", F.col("total") / F.col("s") * F.sum(1 / F.col("rank")).over(tail))
    g = r.groupBy("sample").agg(
        F.first("s").alias("s"),
        F.expr("regr_slope(y, x)").alias("lognormal_slope"),
        F.expr("regr_intercept(y, x)").alias("lognormal_intercept"),
        F.expr("regr_r2(y, x)").alias("lognormal_r2"),
        F.expr("regr_syy(y, x) * (1 - coalesce(regr_r2(y, x), 0)) / count(*)").alias("mse"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.min("abundance") / F.max("abundance"))).alias("geometric_k"),
        F.sum(F.pow(F.col("abundance") - F.col("stick"), 2)).alias("stick_ss"),
        (F.var_pop("abundance") * F.count("*")).alias("ss"),
    )
    return g.select(
        "sample",
        "lognormal_slope",
        "lognormal_intercept",
        "lognormal_r2",
        (F.col("s") * F.log(F.when(F.col("mse") > 0, F.col("mse")).otherwise(1.0)) + 4).alias("lognormal_aic"),
        "geometric_k",
        F.when(F.col("ss") > 0, 1 - F.col("stick_ss") / F.col("ss")).otherwise(0.0).alias("broken_stick_r2"),
        (F.col("s") * F.log(F.when(F.col("stick_ss") > 0, F.col("stick_ss") / F.col("s")).otherwise(1.0)) + 2).alias("broken_stick_aic"),
    )


def she(community: DataFrame, variant: str = "per_sample") -> DataFrame:
    """step, sample, ln_s, ln_h, ln_e in ascending order of total; `cumulative` adds each sample to those before."""
    if variant == "cumulative":
        order = totals(community).groupBy("sample").agg(F.sum("abundance").alias("t")).select("sample", F.row_number().over(Window.orderBy("t", "sample")).alias("step"))
        c = totals(community).join(order, "sample")
        steps = order.select(F.col("step").alias("upto"), F.col("sample").alias("name"))
        c = c.join(steps, F.col("step") <= F.col("upto")).select(F.col("name").alias("sample"), "taxon", "abundance")
        d = diversity(c)
    else:
        d = diversity(community)
    step = F.row_number().over(Window.orderBy("total", "sample"))
    return d.select(step.alias("step"), "sample", F.log(F.col("richness") + 1).alias("ln_s"), F.log(F.col("shannon") + 0.001).alias("ln_h"), F.log(F.col("evenness") + 0.001).alias("ln_e"))


def paleo_environment(community: DataFrame, heights: DataFrame) -> DataFrame:
    """sample, score, correlation, inertia: the first correspondence axis, signed to rise with (sample, height).

    Only the taxa x taxa matrix of chi-square products comes to the driver (at most 4000 taxa).
    """
    c = totals(community)
    n, k = c.agg(F.sum("abundance"), F.countDistinct("taxon")).first()
    if k > 4000:
        raise ValueError(f"{k} taxa; at most 4000 fit a dense eigenproblem")
    c = c.withColumn("r", F.sum("abundance").over(Window.partitionBy("sample"))).withColumn("t", F.sum("abundance").over(Window.partitionBy("taxon")))
    # (O - E) / sqrt(E) = O / sqrt(E) - sqrt(E); products of the dense second part have a closed form
    c = c.withColumn("z", F.col("abundance") / F.sqrt(F.col("r") * F.col("t") / n))
    taxa = [tuple(r) for r in c.select("taxon", "t").distinct().orderBy("taxon").collect()]
    at = {x[0]: i for i, x in enumerate(taxa)}
    pair = c.select("sample", "taxon", "z").alias("x").join(c.select("sample", "taxon", "z").alias("y"), "sample").groupBy(F.col("x.taxon").alias("i"), F.col("y.taxon").alias("j")).agg(F.sum(F.col("x.z") * F.col("y.z")).alias("v"))
    g = np.zeros((len(taxa), len(taxa)))
    for i, j, v in pair.collect():
        g[at[i], at[j]] = v
    # sum over samples of sqrt(E_si) z_sj = sqrt(t_i / t_j) sum_s O_sj = sqrt(t_i t_j); the sum of sqrt(E) sqrt(E) is the same
    root = np.sqrt([x[1] for x in taxa])
    g -= np.outer(root, root)
    values, vectors = symmetric_eigen(g)
    axis = c.sparkSession.createDataFrame([(x[0], float(v)) for x, v in zip(taxa, vectors[:, 0], strict=True)], f"taxon {c.schema['taxon'].dataType.simpleString()}, v double")
    shift = float(root @ vectors[:, 0])
    s = c.join(axis, "taxon").groupBy("sample").agg((F.sum(F.col("z") * F.col("v")) - F.sqrt(F.first("r") / n) * F.lit(shift)).alias("score"))
    s = s.join(heights, "sample")
    r = s.agg(F.corr("height", "score")).first()[0] or 0.0
    return s.select("sample", (F.col("score") * (-1.0 if r < 0 else 1.0)).alias("score"), F.lit(abs(r)).alias("correlation"), F.lit(float(values[0] / values.sum()) if values.sum() > 0 else 0.0).alias("inertia"))


def fisher_alpha(s: float, n: float) -> float:
    """The alpha that solves S = alpha ln(1 + N / alpha)."""
    if s <= 0 or n <= s:
        return math.inf if s > 0 else 0.0
    low, high = 1e-9, 1e9
    for _ in range(200):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if mid * math.log1p(n / mid) < s else (low, mid)
    return mid


def log_series(community: DataFrame) -> DataFrame:
    """sample, alpha, x, i, observed, expected: number of taxa with i individuals against the log series."""
    c = totals(community)
    t = c.groupBy("sample").agg(F.count("*").cast("double").alias("s"), F.sum("abundance").alias("n")).withColumn("alpha", _alpha("s", "n"))
    f = c.groupBy("sample", F.floor("abundance").alias("i")).agg(F.count("*").alias("observed"))
    x = F.col("n") / (F.col("alpha") + F.col("n"))
    return f.join(t, "sample").select("sample", "alpha", x.alias("x"), "i", "observed", (F.col("alpha") * F.pow(x, F.col("i")) / F.col("i")).alias("expected"))


@F.pandas_udf(T.DoubleType())
def _alpha(s: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([fisher_alpha(a, b) for a, b in zip(s, n, strict=True)])


def sample_rarefaction(community: DataFrame, points: int = 50, variant: str = "first") -> DataFrame:
    """n, expected: taxa in the first n samples (by sample), or `exact` expectation over all choices of n samples."""
    t = totals(community)
    samples = t.select("sample").distinct()
    count = samples.count()
    step = max(1, count // points)
    n = t.sparkSession.range(1, count + 1, step).select(F.col("id").alias("n"))
    if variant == "exact":
        m = t.groupBy("taxon").agg(F.count("*").alias("m")).groupBy("m").agg(F.count("*").alias("k"))

        @F.pandas_udf(T.DoubleType())
        def miss(m: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([math.comb(count - int(a), int(b)) / math.comb(count, int(b)) for a, b in zip(m, n, strict=True)])

        return m.crossJoin(F.broadcast(n)).groupBy("n").agg(F.sum(F.col("k") * (1 - miss("m", "n"))).alias("expected"))
    place = samples.withColumn("pos", F.row_number().over(Window.orderBy("sample")))
    first = t.join(place, "sample").groupBy("taxon").agg(F.min("pos").alias("pos")).groupBy("pos").agg(F.count("*").alias("new"))
    return n.join(first, F.col("pos") <= F.col("n")).groupBy("n").agg(F.sum("new").cast("double").alias("expected"))


def filter_endemic(community: DataFrame, max_samples: int = 1) -> DataFrame:
    """taxon, occurrences, endemic: endemic taxa occur in at most max_samples samples (all-zero taxa too)."""
    o = community.groupBy("taxon").agg(F.countDistinct(F.when(F.col("abundance") > 0, F.col("sample"))).alias("occurrences"))
    return o.withColumn("endemic", F.col("occurrences") <= max_samples)


def presence(c: Column) -> Column:
    return (c > 0).cast("int")
