"""Landmark shapes. A configuration is (specimen, config array<double>), blocked x_1 ... x_k y_1 ... y_k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fossilframe.functions import special
from fossilframe.operators.multivariate import moments, pca


def _complex(rows) -> np.ndarray:
    x = np.array(list(rows), float)
    k = x.shape[1] // 2
    return x[:, :k] + 1j * x[:, k:]


def gpa(configs: DataFrame, max_iter: int = 100, tol: float = 1e-8) -> dict[str, DataFrame]:
    """aligned (specimen, config, centroid_size, distance), mean (landmark, x, y) and iterations.

    Each round rotates all shapes to the mean and sums them: one row a task comes back. Plane rotations are closed-form
    in complex numbers; there is no reflection.
    """
    c = configs.select("specimen", F.col("config").cast("array<double>").alias("config")).persist()

    def shapes(rows) -> tuple[np.ndarray, np.ndarray]:
        z = _complex(rows)
        z = z - z.mean(1, keepdims=True)
        size = np.sqrt((np.abs(z) ** 2).sum(1))
        return z / np.where(size > 0, size, 1)[:, None], size

    first = c.orderBy("specimen").first()
    if first is None:
        raise ValueError("no configurations")
    mean = shapes([first["config"]])[0][0]
    steps = 0
    for steps in range(1, max_iter + 1):

        def turn(it, mean=mean):
            for pdf in it:
                if pdf.empty:
                    continue
                z, _ = shapes(pdf["config"])
                r = (z.conj() * mean).sum(1)
                s = (z * (r / np.where(np.abs(r) > 0, np.abs(r), 1))[:, None]).sum(0)
                yield pd.DataFrame({"s": [np.concatenate([s.real, s.imag]).tolist()]})

        total = c.select("config").mapInPandas(turn, "s array<double>").select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        new = _complex([[r["v"] for r in total]])[0]
        new = new / np.sqrt((np.abs(new) ** 2).sum())
        gap = float((np.abs(new - mean) ** 2).sum())
        mean = new
        if gap < tol:
            break

    def align(it):
        for pdf in it:
            if pdf.empty:
                continue
            z, size = shapes(pdf["config"])
            r = (z.conj() * mean).sum(1)
            a = z * (r / np.where(np.abs(r) > 0, np.abs(r), 1))[:, None]
            yield pd.DataFrame({"specimen": pdf["specimen"], "config": np.concatenate([a.real, a.imag], 1).tolist(), "centroid_size": size, "distance": np.sqrt((np.abs(a - mean) ** 2).sum(1))})

    kind = configs.schema["specimen"].dataType.simpleString()
    spark = configs.sparkSession
    return {
        "aligned": configs.select("specimen", F.col("config").cast("array<double>").alias("config")).mapInPandas(align, f"specimen {kind}, config array<double>, centroid_size double, distance double"),
        "mean": spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(mean)], "landmark int, x double, y double"),
        "iterations": spark.createDataFrame([(steps,)], "iterations int"),
    }


def elliptic_fourier(contours: DataFrame, harmonics: int = 10) -> DataFrame:
    """contour, harmonic, a, b, c, d of closed contours (contour, pos, x, y); a contour without length gives none."""
    first = contours.groupBy("contour").agg(F.min(F.struct("pos", "x", "y")).alias("f"), F.max("pos").alias("top"))
    closed = contours.select("contour", "pos", "x", "y").unionByName(first.select("contour", (F.col("top") + 1).alias("pos"), F.col("f.x").alias("x"), F.col("f.y").alias("y")))
    w = Window.partitionBy("contour").orderBy("pos")
    s = closed.withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("dy", F.col("y") - F.lag("y").over(w)).filter("dx IS NOT NULL").withColumn("dt", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    s = s.withColumn("t", F.sum("dt").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("dt").over(Window.partitionBy("contour"))).filter("dt > 0")
    s = s.withColumn("harmonic", F.explode(F.sequence(F.lit(1), F.lit(harmonics))))
    turn = lambda t: 2 * F.lit(np.pi) * F.col("harmonic") * t / F.col("total")
    dc = F.cos(turn(F.col("t"))) - F.cos(turn(F.col("t") - F.col("dt")))
    ds = F.sin(turn(F.col("t"))) - F.sin(turn(F.col("t") - F.col("dt")))
    scale = F.first("total") / (2 * np.pi * np.pi * F.col("harmonic") * F.col("harmonic"))
    part = lambda d, e: (F.sum(F.col(d) / F.col("dt") * e) * scale)
    return s.groupBy("contour", "harmonic").agg(part("dx", dc).alias("a"), part("dx", ds).alias("b"), part("dy", dc).alias("c"), part("dy", ds).alias("d"))


def allometry(configs: DataFrame) -> dict[str, DataFrame]:
    """coefficients (coordinate, slope, intercept) on the log of size (root of the sum of squares), fit (r2, f, p_value)."""
    size = F.sqrt(F.aggregate(F.col("config").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    d = configs.withColumn("size", F.log(size)).select("size", F.posexplode(F.col("config").cast("array<double>")).alias("coordinate", "v"))
    g = d.groupBy("coordinate").agg(F.expr("regr_slope(v, size)").alias("slope"), F.expr("regr_intercept(v, size)").alias("intercept"), F.expr("regr_syy(v, size)").alias("sst"), F.expr("regr_sxy(v, size) * regr_slope(v, size)").alias("ssr"), F.count("*").alias("n"))

    @F.pandas_udf(T.DoubleType())
    def p(f: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([special.f_sf(a, 1, b) for a, b in zip(f, df, strict=True)])

    t = g.agg(F.sum("sst").alias("sst"), F.sum("ssr").alias("ssr"), (F.max("n") - 2).alias("df"))
    t = t.withColumn("r2", F.col("ssr") / F.col("sst")).withColumn("f", F.col("ssr") / ((F.col("sst") - F.col("ssr")) / F.col("df")))
    return {"coefficients": g.select("coordinate", "slope", "intercept"), "fit": t.select("r2", "f", p("f", "df").alias("p_value"))}


def evolution_rate(series: DataFrame) -> DataFrame:
    """series, n, model, aic and weights of random walk, directional change and stasis for (series, pos, x)."""
    w = Window.partitionBy("series").orderBy("pos")
    d = series.withColumn("step", F.col("x") - F.lag("x").over(w))
    g = d.groupBy("series").agg(F.count("x").alias("n"), F.avg("step").alias("m"), F.avg(F.col("step") * F.col("step")).alias("rw"), F.var_pop("step").alias("dir"), F.var_pop("x").alias("st"))
    ll = lambda v, n: -n / 2 * (F.log(2 * F.lit(np.pi) * F.greatest(v, F.lit(1e-10))) + 1)
    n1 = F.col("n") - 1
    aic = [2 * k - 2 * ll(F.col(c), m) for c, k, m in (("rw", 1, n1), ("dir", 2, n1), ("st", 1, F.col("n")))]
    g = g.select("series", "n", *[a.alias(f"aic_{c}") for a, c in zip(aic, ("random_walk", "directional", "stasis"), strict=True)])
    names = ("random_walk", "directional", "stasis")
    best = F.least(*[f"aic_{c}" for c in names])
    e = [F.exp(-(F.col(f"aic_{c}") - best) / 2) for c in names]
    total = e[0] + e[1] + e[2]
    model = F.when(F.col("n") < 3, "unknown")
    for c in names:
        model = model.when(F.col(f"aic_{c}") == best, c)
    return g.select("*", *[(x / total).alias(f"weight_{c}") for x, c in zip(e, names, strict=True)], model.alias("model"))


def thin_plate_spline(pairs: DataFrame, grid: int = 15) -> dict[str, DataFrame]:
    """deformed grid (gx, gy, x, y) over the source's box grown by 1, and the bending energy. pairs: (lm, sx, sy, tx, ty)."""
    rows = np.array([tuple(r) for r in pairs.orderBy("lm").select(*[F.col(c).cast("double") for c in ("sx", "sy", "tx", "ty")]).collect()])
    if len(rows) > 3000:
        raise ValueError("too many landmarks for a dense system")
    s, t, n = rows[:, :2], rows[:, 2:], len(rows)

    def u(r2: np.ndarray) -> np.ndarray:
        return np.where(r2 > 0, r2 * np.log(np.sqrt(np.maximum(r2, 1e-300))), 0.0)

    k = u(((s[:, None] - s[None]) ** 2).sum(-1))
    p = np.hstack([np.ones((n, 1)), s])
    system = np.block([[k, p], [p.T, np.zeros((3, 3))]])
    w = np.linalg.lstsq(system, np.vstack([t, np.zeros((3, 2))]), rcond=None)[0]
    energy = float(np.trace(w[:n].T @ k @ w[:n]))
    low, high = s.min(0) - 1, s.max(0) + 1
    spark = pairs.sparkSession
    g = spark.range(grid * grid).select((F.col("id") % grid).alias("i"), F.floor(F.col("id") / grid).alias("j"))
    g = g.select(*[(F.lit(float(low[a])) + F.col(c) * float(high[a] - low[a]) / max(1, grid - 1)).alias(f"g{x}") for a, (c, x) in enumerate((("i", "x"), ("j", "y")))])

    def place(it):
        for pdf in it:
            if pdf.empty:
                continue
            q = pdf[["gx", "gy"]].to_numpy()
            z = np.hstack([u(((q[:, None] - s[None]) ** 2).sum(-1)), np.ones((len(q), 1)), q]) @ w
            yield pd.DataFrame({"gx": q[:, 0], "gy": q[:, 1], "x": z[:, 0], "y": z[:, 1]})

    return {"grid": g.mapInPandas(place, "gx double, gy double, x double, y double"), "energy": spark.createDataFrame([(energy,)], "bending_energy double")}


def relative_warps(configs: DataFrame, components: int | None = None) -> dict[str, DataFrame]:
    """Principal components of the configurations' covariance."""
    return pca(configs.select(F.col("specimen").alias("id"), F.col("config").alias("features")), components)


def divide_blocks(configs: DataFrame, method: str = "anterior_posterior", seed: int = 1) -> DataFrame:
    """specimen, block_a, block_b: the first and second half of the landmarks, or halves by a seeded shuffle."""
    first = configs.first()
    k = len(first["config"]) // 2
    order = list(range(k))
    if method == "random":
        state = seed % 2147483647 or 1
        for i in range(k - 1, 0, -1):  # minimal standard generator, multiplier 16807
            state = state * 16807 % 2147483647
            j = state % (i + 1)
            order[i], order[j] = order[j], order[i]
    half = k // 2
    pick = lambda idx: F.array(*[F.col("config")[i] for i in idx], *[F.col("config")[k + i] for i in idx])
    return configs.select("specimen", pick(order[:half]).alias("block_a"), pick(order[half:]).alias("block_b"))


def escoufier_rv(configs: DataFrame) -> float:
    """RV coefficient of two blocks (block_a, block_b)."""
    p = len(configs.first()["block_a"])
    n, s, c = moments(configs, ("block_a", "block_b"))[""]
    c = c - np.outer(s, s) / n
    a, b, ab = c[:p, :p], c[p:, p:], c[:p, p:]
    return float((ab * ab).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def mesh_area(triangles: DataFrame) -> DataFrame:
    """mesh, area of triangles (mesh, ax, ay, az, bx, ..., cz): half the norm of the cross product."""
    v = lambda p, c: F.col(p + c) - F.col("a" + c)
    n = [v("b", "y") * v("c", "z") - v("b", "z") * v("c", "y"), v("b", "z") * v("c", "x") - v("b", "x") * v("c", "z"), v("b", "x") * v("c", "y") - v("b", "y") * v("c", "x")]
    return triangles.groupBy("mesh").agg((F.sum(F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])) / 2).alias("area"))
