"""The registered queries of the statistics operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fossilframe.functions.exprs import two_sided_p_sql
from fossilframe.operators import charts, clustering, ecology, hypothesis, macroevolution, morphometrics, multivariate, phylogenetics, stratigraphy, tables, transforms
from fossilframe.plans import inputs as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def mark(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return mark


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits: sums of floats depend on their order in the last places."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- communities ---------------------------------------------------------------------------------------------------

DIVERSITY = f"""WITH {I.DENSE}, p AS (SELECT sample, abundance AS a, sum(abundance) OVER (PARTITION BY sample) AS n FROM community WHERE abundance > 0),
d AS (SELECT sample, count(*) AS richness, max(n) AS total, -sum(a / n * ln(a / n)) AS h, 1 - sum((a / n) * (a / n)) AS s FROM p GROUP BY sample)
SELECT sample, richness, round(total, 6) AS total, round(h, 6) AS shannon, round(s, 6) AS simpson, round(CASE WHEN richness > 1 THEN h / ln(richness) ELSE 0 END, 6) AS pielou,
  round(CASE WHEN total > 1 THEN (richness - 1) / ln(total) ELSE 0 END, 6) AS margalef, round(CASE WHEN richness > 1 THEN h / ln(richness) ELSE 0 END, 6) AS evenness FROM d"""


@query(DIVERSITY)
def diversity_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ecology.diversity(I.community(spark, sf)))


@query(f"SELECT sample, shannon FROM ({DIVERSITY})")
def shannon(spark, sf):
    return rounded(ecology.shannon(I.community(spark, sf)))


@query(f"SELECT sample, simpson FROM ({DIVERSITY})")
def simpson(spark, sf):
    return rounded(ecology.simpson(I.community(spark, sf)))


@query(
    f"""WITH {I.COUNTED}, t AS (SELECT sample, sum(abundance) AS total FROM community GROUP BY sample),
s AS (SELECT sample, total, floor(total / 2) AS top, greatest(1, floor(floor(total / 2) / 10)) AS step FROM t WHERE floor(total / 2) > 1),
n AS (SELECT s.sample, total, CAST(k AS BIGINT) AS n FROM s, range(1, 100000) r(k) WHERE k < top AND (k - 1) % step = 0)
SELECT n.sample, n.n, round(sum(CASE WHEN total - abundance < n.n THEN 1 ELSE 1 - exp(lgamma(total - abundance + 1) - lgamma(total - abundance - n.n + 1) - lgamma(total + 1) + lgamma(total - n.n + 1)) END), 6) AS expected
FROM n JOIN community c ON n.sample = c.sample GROUP BY n.sample, n.n"""
)
def rarefaction(spark, sf):
    return rounded(ecology.rarefaction(I.counts(spark, sf), points=10))


BETA = """WITH {c}, p AS (SELECT sample, taxon FROM community WHERE abundance > 0), r AS (SELECT sample, count(*) AS r FROM p GROUP BY sample),
s AS (SELECT x.sample AS sa, y.sample AS sb, count(*) AS a FROM p x JOIN p y ON x.taxon = y.taxon AND x.sample < y.sample GROUP BY 1, 2),
q AS (SELECT x.sample AS sample_a, y.sample AS sample_b, coalesce(a, 0) AS a, x.r - coalesce(a, 0) AS b, y.r - coalesce(a, 0) AS c
  FROM r x JOIN r y ON x.sample < y.sample LEFT JOIN s ON sa = x.sample AND sb = y.sample)
SELECT sample_a, sample_b, a, b, c, {parts} FROM q"""


def _div(x: str, y: str) -> str:
    return f"round(CASE WHEN {y} > 0 THEN CAST({x} AS DOUBLE) / ({y}) ELSE 0 END, 6)"


def _beta_sql(total: tuple, turnover: tuple, nested: tuple) -> str:
    return BETA.format(c=I.SPARSE, parts=f"{_div(*total)} AS total, {_div(*turnover)} AS turnover, {_div(*nested)} AS nestedness")


@query(_beta_sql(("b + c", "a + b + c"), ("2 * least(b, c)", "a + 2 * least(b, c)"), ("a * abs(b - c)", "(a + b + c) * (a + 2 * least(b, c))")))
def beta_jaccard(spark, sf):
    return rounded(ecology.beta_diversity(I.community(spark, sf, True)))


@query(_beta_sql(("b + c", "2 * a + b + c"), ("least(b, c)", "2 * a + least(b, c)"), ("a * abs(b - c)", "(2 * a + b + c) * (2 * a + least(b, c))")))
def beta_sorensen(spark, sf):
    return rounded(ecology.beta_diversity(I.community(spark, sf, True), "sorensen"))


@query(
    f"""WITH {I.SPARSE}, t AS (SELECT taxon, count(*) AS r FROM community GROUP BY taxon),
s AS (SELECT x.taxon AS i, y.taxon AS j, count(*) AS s FROM community x JOIN community y ON x.sample = y.sample AND x.taxon < y.taxon GROUP BY 1, 2)
SELECT round(avg((x.r - coalesce(s, 0)) * (y.r - coalesce(s, 0))), 6) AS c_score, CAST(sum((x.r - coalesce(s, 0)) * (y.r - coalesce(s, 0))) AS BIGINT) AS checkerboard
FROM t x JOIN t y ON x.taxon < y.taxon LEFT JOIN s ON i = x.taxon AND j = y.taxon"""
)
def c_score(spark, sf):
    return rounded(ecology.c_score(I.community(spark, sf, True)))


@query()
def null_model(spark, sf):
    return ecology.null_model(I.community(spark, sf, True), permutations=99)


@query()
def dtw(spark, sf):
    s = I.series(spark, sf).select("series", "pos", F.col("y").alias("value"))
    ids = s.select(F.col("series").alias("a")).distinct()
    return rounded(ecology.dtw(s, ids.join(ids.select(F.col("a").alias("b")), F.col("a") < F.col("b"))))


@query(
    f"""WITH {I.DAILY}, q AS (SELECT pos, y FROM series WHERE series = 'click'), r AS (SELECT pos, max(y) OVER w AS hi, min(y) OVER w AS lo FROM series WHERE series = 'view' WINDOW w AS (ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT round(sqrt(sum(CASE WHEN y > hi THEN (y - hi) * (y - hi) WHEN y < lo THEN (lo - y) * (lo - y) ELSE 0 END)), 6) AS bound FROM (SELECT least(pos, (SELECT max(pos) FROM r)) AS pos, y FROM q) q JOIN r USING (pos)"""
)
def lb_keogh(spark, sf):
    s = I.series(spark, sf).select("series", "pos", F.col("y").alias("value"))
    return rounded(ecology.lb_keogh(s.filter("series = 'click'"), s.filter("series = 'view'")))


@query(
    f"""WITH {I.DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY abundance DESC, taxon) AS rk, count(*) OVER (PARTITION BY sample) AS s, sum(abundance) OVER (PARTITION BY sample) AS n FROM community),
f AS (SELECT *, n / s * sum(1.0::DOUBLE / rk) OVER (PARTITION BY sample ORDER BY rk DESC) AS stick, ln(rk) AS x, ln(abundance) AS y FROM r),
g AS (SELECT sample, max(s) AS s, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_syy(y, x) * (1 - regr_r2(y, x)) / count(*) AS mse, 1 - min(abundance) / max(abundance) AS k,
  sum((abundance - stick) * (abundance - stick)) AS ss, var_pop(abundance) * count(*) AS st FROM f GROUP BY sample)
SELECT sample, round(b, 6) AS lognormal_slope, round(a, 6) AS lognormal_intercept, round(r2, 6) AS lognormal_r2, round(s * ln(mse) + 4, 6) AS lognormal_aic, round(least(1, greatest(0, k)), 6) AS geometric_k,
  round(1 - ss / st, 6) AS broken_stick_r2, round(s * ln(ss / s) + 2, 6) AS broken_stick_aic FROM g"""
)
def abundance_models(spark, sf):
    return rounded(ecology.abundance_models(I.community(spark, sf)))


@query(f"SELECT row_number() OVER (ORDER BY total, sample) AS step, sample, round(ln(richness + 1), 4) AS ln_s, round(ln(shannon + 0.001), 4) AS ln_h, round(ln(evenness + 0.001), 4) AS ln_e FROM ({DIVERSITY})")
def she(spark, sf):
    return rounded(ecology.she(I.community(spark, sf)), 4)


@query()
def paleo_environment(spark, sf):
    c = I.community(spark, sf)
    return rounded(ecology.paleo_environment(c, c.groupBy("sample").agg(F.max("sample").cast("double").alias("height"))))


@query(
    f"""WITH RECURSIVE {I.COUNTED}, c AS (SELECT sample, taxon, sum(abundance) AS a FROM community WHERE abundance > 0 GROUP BY sample, taxon),
t AS (SELECT sample, CAST(count(*) AS DOUBLE) AS s, CAST(sum(a) AS DOUBLE) AS n FROM c GROUP BY sample),
z AS (SELECT 0 AS k, sample, s, n, 1e-9::DOUBLE AS lo, 1e9::DOUBLE AS hi FROM t WHERE n > s
  UNION ALL SELECT k + 1, sample, s, n, CASE WHEN sqrt(lo * hi) * ln(1 + n / sqrt(lo * hi)) < s THEN sqrt(lo * hi) ELSE lo END, CASE WHEN sqrt(lo * hi) * ln(1 + n / sqrt(lo * hi)) < s THEN hi ELSE sqrt(lo * hi) END FROM z WHERE k < 100),
f AS (SELECT sample, CAST(floor(a) AS BIGINT) AS i, count(*) AS observed FROM c GROUP BY 1, 2)
SELECT sample, round(lo, 6) AS alpha, round(n / (lo + n), 6) AS x, i, observed, round(lo * pow(n / (lo + n), i) / i, 6) AS expected FROM z JOIN f USING (sample) WHERE k = 100"""
)
def log_series(spark, sf):
    """The SQL finds alpha by bisection."""
    return rounded(ecology.log_series(I.counts(spark, sf)))


@query(
    f"""WITH {I.SPARSE}, o AS (SELECT sample, row_number() OVER (ORDER BY sample) AS pos FROM (SELECT DISTINCT sample FROM community)),
f AS (SELECT taxon, min(pos) AS pos FROM community JOIN o USING (sample) GROUP BY taxon)
SELECT o.pos AS n, CAST(count(*) AS DOUBLE) AS expected FROM o JOIN f ON f.pos <= o.pos GROUP BY o.pos"""
)
def sample_rarefaction(spark, sf):
    return ecology.sample_rarefaction(I.community(spark, sf, True))


@query(f"WITH {I.SPARSE} SELECT taxon, count(DISTINCT sample) AS occurrences, count(DISTINCT sample) <= 10 AS endemic FROM community GROUP BY taxon")
def filter_endemic(spark, sf):
    return ecology.filter_endemic(I.community(spark, sf, True), 10)


@query(
    f"""WITH {I.COUNTED}, n AS (SELECT sample, sum(abundance) AS n FROM community GROUP BY sample), b AS (SELECT x.sample AS i, y.sample AS j, sum(least(x.abundance, y.abundance)) AS m FROM community x JOIN community y ON x.taxon = y.taxon AND x.sample < y.sample GROUP BY 1, 2)
SELECT x.sample AS i, y.sample AS j, round(1 - 2 * coalesce(m, 0) / (x.n + y.n), 6) AS d FROM n x JOIN n y ON x.sample < y.sample LEFT JOIN b ON i = x.sample AND j = y.sample"""
)
def community_bray_curtis(spark, sf):
    return rounded(clustering.community_distances(I.counts(spark, sf)))


# --- distances, ordination, clusters -------------------------------------------------------------------------------

LISTS = {
    "euclidean": "sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.v[k] - b.v[k]) * (a.v[k] - b.v[k]))))",
    "cityblock": "list_sum(list_transform(range(1, 65), lambda k: abs(a.v[k] - b.v[k])))",
    "cosine": "1 - list_sum(list_transform(range(1, 65), lambda k: a.v[k] * b.v[k])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x))))",
    "canberra": "list_sum(list_transform(range(1, 65), lambda k: CASE WHEN abs(a.v[k]) + abs(b.v[k]) > 0 THEN abs(a.v[k] - b.v[k]) / (abs(a.v[k]) + abs(b.v[k])) ELSE 0 END))",
    "hamming": "list_sum(list_transform(range(1, 65), lambda k: CASE WHEN a.v[k] <> b.v[k] THEN 1.0::DOUBLE ELSE 0 END)) / 64",
    "jaccard": "list_sum(list_transform(range(1, 65), lambda k: CASE WHEN a.v[k] <> b.v[k] THEN 1.0::DOUBLE ELSE 0 END)) / list_sum(list_transform(range(1, 65), lambda k: CASE WHEN a.v[k] <> 0 OR b.v[k] <> 0 THEN 1.0::DOUBLE ELSE 0 END))",
    "correlation": "1 - (list_sum(list_transform(range(1, 65), lambda k: a.v[k] * b.v[k])) - list_sum(a.v) * list_sum(b.v) / 64) / sqrt((list_sum(list_transform(a.v, lambda x: x * x)) - list_sum(a.v) * list_sum(a.v) / 64) * (list_sum(list_transform(b.v, lambda x: x * x)) - list_sum(b.v) * list_sum(b.v) / 64))",
    "bray_curtis": "list_sum(list_transform(range(1, 65), lambda k: abs(abs(a.v[k]) - abs(b.v[k])))) / list_sum(list_transform(range(1, 65), lambda k: abs(a.v[k]) + abs(b.v[k])))",
}


def _distance_query(metric: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = I.specimens(spark, sf)
        if metric == "bray_curtis":
            s = s.withColumn("features", F.transform("features", F.abs))
        return clustering.distance_matrix(s, metric, digits=6)

    QUERIES[f"distance_{metric}"] = run
    SQL[f"distance_{metric}"] = f"WITH {I.SPECIMENS} SELECT a.id AS i, b.id AS j, round({LISTS[metric]}, 6) AS d FROM specimens a JOIN specimens b ON a.id < b.id"


for _metric in LISTS:
    _distance_query(_metric)


@query()
def pca_variance(spark, sf):
    return rounded(multivariate.pca(I.specimens(spark, sf))["variance"])


@query(
    f"""WITH {I.SPECIMENS}, c AS (SELECT k, avg(v[k]) AS m, var_samp(v[k]) AS s FROM specimens, range(1, 65) t(k) GROUP BY k)
SELECT round(sum(s), 4) AS total FROM c"""
)
def pca_total_variance(spark, sf):
    v = multivariate.pca(I.specimens(spark, sf))["variance"]
    return v.agg(F.round(F.sum("eigenvalue"), 4).alias("total"))


@query(
    f"""WITH {I.SPECIMENS}, c AS (SELECT k, avg(v[k]) AS m FROM specimens, range(1, 65) t(k) GROUP BY k),
z AS (SELECT id, k, v[k] - m AS x FROM specimens, c), s AS (SELECT a.k AS i, b.k AS j, sum(a.x * b.x) / (SELECT count(*) - 1 FROM specimens) AS s FROM z a JOIN z b ON a.id = b.id GROUP BY 1, 2)
SELECT round(sqrt(sum(s * s)), 4) AS norm FROM s"""
)
def pca_norm(spark, sf):
    """The root of the sum of squared eigenvalues: the Frobenius norm of the covariance matrix."""
    v = multivariate.pca(I.specimens(spark, sf))["variance"]
    return v.agg(F.round(F.sqrt(F.sum(F.col("eigenvalue") * F.col("eigenvalue"))), 4).alias("norm"))


@query(
    f"""WITH {I.SPECIMENS}, c AS (SELECT k, var_samp(v[k]) AS s FROM specimens, range(1, 65) t(k) GROUP BY k)
SELECT CAST(64 AS BIGINT) AS components, round(sum(s) * (SELECT count(*) - 1 FROM specimens), 3) AS total FROM c"""
)
def pcoa_total(spark, sf):
    """Of Euclidean distances, as many eigenvalues as features, and their sum is that of the squared deviations."""
    v = multivariate.pcoa_features(I.specimens(spark, sf), 64)
    return v.filter("eigenvalue > 1e-6").agg(F.count("*").alias("components"), F.round(F.sum("eigenvalue"), 3).alias("total"))


@query()
def pca_scores(spark, sf):
    return multivariate.pca(I.specimens(spark, sf), 2, "correlation")["scores"]


@query()
def pcoa(spark, sf):
    return rounded(multivariate.pcoa_features(I.specimens(spark, sf)))


@query()
def nmds(spark, sf):
    return multivariate.nmds(clustering.distance_matrix(I.specimens(spark, sf)))["stress"]


@query()
def lda_confusion(spark, sf):
    return multivariate.lda(I.specimens(spark, sf))["confusion"]


def _blocks(spark, sf):
    return I.specimens(spark, sf).select("id", F.slice("features", 1, 32).alias("a"), F.slice("features", 33, 32).alias("b"))


@query()
def rda(spark, sf):
    return rounded(multivariate.constrained(_blocks(spark, sf).select(F.col("a").alias("y"), F.col("b").alias("x"))))


@query()
def cca(spark, sf):
    d = _blocks(spark, sf).select(F.transform("a", lambda v: F.abs(v)).alias("y"), F.col("b").alias("x"))
    return rounded(multivariate.constrained(d, method="cca"))


@query()
def pls(spark, sf):
    return rounded(multivariate.pls(_blocks(spark, sf))["axes"])


@query(f"WITH {I.SPECIMENS}, r AS (SELECT k, max(v[k]) - min(v[k]) AS r FROM specimens, range(1, 5) t(k) GROUP BY k) SELECT round(product(r), 6) AS measure FROM r")
def bounding_box(spark, sf):
    return rounded(multivariate.convex_hull(I.specimens(spark, sf).select(F.slice("features", 1, 4).alias("features"))))


@query(
    f"""WITH RECURSIVE {I.SPECIMENS}, p AS (SELECT DISTINCT CAST(v[1] AS DOUBLE) AS x, CAST(v[2] AS DOUBLE) AS y FROM specimens), o AS (SELECT x, y FROM p ORDER BY x, y LIMIT 1),
h AS (SELECT 0 AS i, x, y, -pi() / 2 AS turn, x AS x0, y AS y0 FROM o
  UNION ALL SELECT i + 1, b.x, b.y, b.turn, x0, y0 FROM (
    SELECT i, x0, y0, arg_min({{'x': p.x, 'y': p.y, 'turn': atan2(p.y - h.y, p.x - h.x)}}, (atan2(p.y - h.y, p.x - h.x) - h.turn + 4 * pi()) % (2 * pi())) AS b
    FROM h, p WHERE (p.x <> h.x OR p.y <> h.y) AND (h.i = 0 OR h.x <> h.x0 OR h.y <> h.y0) AND h.i < 1000 GROUP BY i, x0, y0))
SELECT round(sum(a.x * b.y - b.x * a.y) / 2, 6) AS measure FROM h a JOIN h b ON b.i = a.i + 1"""
)
def convex_hull(spark, sf):
    """The SQL walks around the points, turning as little as it can."""
    return rounded(multivariate.convex_hull(I.specimens(spark, sf).select(F.slice("features", 1, 2).alias("features"))))


@query(
    f"""WITH {I.SPECIMENS}, d AS (SELECT {LISTS["euclidean"]} AS d FROM specimens a JOIN specimens b ON a.id < b.id),
c AS (SELECT k, var_pop(v[k]) AS s, max(v[k]) - min(v[k]) AS r FROM specimens, range(1, 65) t(k) GROUP BY k)
SELECT round((SELECT sum(s) FROM c), 6) AS centroid_ms, round(var_pop(d), 6) AS pairwise_variance, round(avg(d), 6) AS pairwise_mean, round((SELECT sum(r) FROM c), 6) AS range_sum FROM d"""
)
def disparity(spark, sf):
    return rounded(multivariate.disparity(I.specimens(spark, sf)))


@query()
def spanning_tree(spark, sf):
    return rounded(clustering.nearest_links(I.specimens(spark, sf)))


@query()
def linkage_ward(spark, sf):
    return rounded(clustering.linkage_features(I.specimens(spark, sf), "ward"))


@query()
def clusters_average(spark, sf):
    return clustering.cluster_labels(I.specimens(spark, sf), 3)


# --- tests ---------------------------------------------------------------------------------------------------------


def _grouped_summary() -> str:
    return f"""WITH {I.PRICES}, r AS (SELECT grp, x, row_number() OVER (PARTITION BY grp ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY grp) AS n FROM prices),
md AS (SELECT grp, max(CASE WHEN k = n // 2 THEN x END) AS median FROM r GROUP BY grp),
a AS (SELECT grp, count(x) AS n, avg(x) AS m, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi, skewness(x) AS sk, kurtosis(x) AS ku FROM prices GROUP BY grp)
SELECT grp AS variable, n, round(m, 4) AS mean, round(sd, 4) AS sd, round(sd * sd, 2) AS variance, lo AS min, hi AS max, median, round(sd / sqrt(n), 4) AS se, round(m - 1.96 * sd / sqrt(n), 4) AS ci_low, round(m + 1.96 * sd / sqrt(n), 4) AS ci_high,
  round(sk, 4) AS skewness, round(ku, 4) AS kurtosis FROM a JOIN md USING (grp)"""


@query(_grouped_summary())
def univariate_summary(spark, sf):
    s = hypothesis.summary(I.prices(spark, sf).withColumnRenamed("group", "variable"))
    return s.select("variable", "n", *[F.round(c, 2 if c == "variance" else 4).alias(c) for c in ("mean", "sd", "variance")], "min", "max", "median", *[F.round(c, 4).alias(c) for c in ("se", "ci_low", "ci_high", "skewness", "kurtosis")])


@query(
    f"""WITH {I.PRICES}, a AS (SELECT count(*) FILTER (grp = 'A') AS n1, avg(x) FILTER (grp = 'A') AS m1, var_samp(x) FILTER (grp = 'A') AS v1, count(*) FILTER (grp = 'N') AS n2, avg(x) FILTER (grp = 'N') AS m2, var_samp(x) FILTER (grp = 'N') AS v2 FROM prices),
t AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t FROM a) SELECT round(t, 6) AS statistic, round({two_sided_p_sql("t")}, 6) AS p_value, n1 + n2 - 2 AS df, round(m1, 6) AS m1, round(m2, 6) AS m2 FROM t"""
)
def t_test(spark, sf):
    return rounded(hypothesis.t_test(I.prices(spark, sf), "A", "N"))


@query(
    f"""WITH {I.PRICES}, g AS (SELECT grp, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM prices GROUP BY grp), o AS (SELECT avg(x) AS mm, count(*) AS t FROM prices),
s AS (SELECT sum(n * (m - mm) * (m - mm)) AS b, sum(ss) AS w, count(*) - 1 AS d1, max(t) - count(*) AS d2 FROM g, o)
SELECT CAST(d1 AS BIGINT) AS df1, CAST(d2 AS BIGINT) AS df2, round(b / d1 / (w / d2), 3) AS f, round(b / w * 1e6, 3) AS ratio_ppm,
  CASE WHEN d1 = 2 THEN round(pow(1 + 2 * (b / d1 / (w / d2)) / d2, -d2 / 2.0::DOUBLE), 5) END AS p_value FROM s"""
)
def anova(spark, sf):
    """ratio_ppm: ssb of ssw in millionths. Three groups: the p-value has a closed form."""
    a = hypothesis.anova(I.prices(spark, sf))
    return a.select("df1", "df2", F.round("f", 3).alias("f"), F.round(F.col("ssb") / F.col("ssw") * 1e6, 3).alias("ratio_ppm"), F.round("p_value", 5).alias("p_value"))


@query(
    f"""WITH {I.PRICES}, r AS (SELECT grp, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0::DOUBLE AS r FROM prices), g AS (SELECT grp, sum(r) AS s, count(*) AS n FROM r GROUP BY grp)
, t AS (SELECT 12.0::DOUBLE / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1) AS h, count(*) - 1 AS df FROM g)
SELECT round(h, 4) AS h, CAST(df AS BIGINT) AS df, CASE WHEN df = 2 THEN round(exp(-h / 2), 5) END AS p_value FROM t"""
)
def kruskal_wallis(spark, sf):
    return rounded(hypothesis.kruskal_wallis(I.prices(spark, sf, "l_quantity")).withColumn("h", F.round("h", 4)), 5)


@query(
    f"""WITH {I.PRICES}, r AS (SELECT grp, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0::DOUBLE AS r FROM prices WHERE grp IN ('A', 'R')),
g AS (SELECT sum(r) FILTER (grp = 'A') AS r1, CAST(count(*) FILTER (grp = 'A') AS DOUBLE) AS n1, CAST(count(*) FILTER (grp = 'R') AS DOUBLE) AS n2 FROM r),
u AS (SELECT *, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - r1 + n1 * (n1 + 1) / 2) AS u FROM g), z AS (SELECT u, (u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM u)
SELECT round(u, 4) AS u, round(z, 4) AS z, round({two_sided_p_sql("z")}, 4) AS p_value FROM z"""
)
def mann_whitney(spark, sf):
    return rounded(hypothesis.mann_whitney(I.prices(spark, sf, "l_quantity"), "A", "R"), 4)


@query()
def permanova(spark, sf):
    return hypothesis.permanova_features(I.specimens(spark, sf))


PAIRS = f"""{I.SPECIMENS}, pairs AS (SELECT a.id AS i, b.id AS j, a.grp AS ga, b.grp AS gb, {LISTS["euclidean"]} AS d, {LISTS["cityblock"]} AS c FROM specimens a JOIN specimens b ON a.id < b.id),
size AS (SELECT grp, CAST(count(*) AS DOUBLE) AS n FROM specimens GROUP BY grp), whole AS (SELECT sum(n) AS n, count(*) AS k FROM size)"""


@query(
    f"""WITH {PAIRS}, t AS (SELECT sum(d * d) / max(n) AS total FROM pairs, whole),
w AS (SELECT sum(s / n) AS within FROM (SELECT ga, sum(d * d) AS s FROM pairs WHERE ga = gb GROUP BY ga) JOIN size ON ga = grp)
SELECT round((total - within) / (k - 1) / (within / (n - k)), 6) AS statistic FROM t, w, whole"""
)
def permanova_f(spark, sf):
    """The statistic of permanova; its p-value depends on the generator."""
    return rounded(hypothesis.permanova_features(I.specimens(spark, sf), permutations=1).select("statistic"))


@query(
    f"""WITH {PAIRS}, r AS (SELECT ga = gb AS same, row_number() OVER (ORDER BY d, i, j) AS r FROM pairs)
SELECT round((avg(r) FILTER (NOT same) - avg(r) FILTER (same)) / (max(n) * (max(n) - 1) / 4), 6) AS statistic FROM r, whole"""
)
def anosim_r(spark, sf):
    """The statistic of anosim."""
    return rounded(hypothesis.anosim_features(I.specimens(spark, sf), permutations=1).select("statistic"))


@query(f"WITH {PAIRS} SELECT round(corr(d, c), 6) AS statistic FROM pairs")
def mantel_r(spark, sf):
    """The statistic of mantel."""
    return rounded(hypothesis.mantel_statistic(I.specimens(spark, sf)))


@query()
def anosim(spark, sf):
    return hypothesis.anosim_features(I.specimens(spark, sf))


@query()
def mantel(spark, sf):
    s = I.specimens(spark, sf)
    return hypothesis.mantel_features(s)


@query(
    f"""WITH {I.SPECIMENS}, p AS (SELECT list_transform(a.v, lambda x: abs(x)) AS a, list_transform(b.v, lambda x: abs(x)) AS b FROM specimens a JOIN specimens b ON a.grp < b.grp),
c AS (SELECT k - 1 AS variable, abs(a[k] - b[k]) / (list_sum(a) + list_sum(b)) AS c FROM p, range(1, 65) t(k)), s AS (SELECT CAST(variable AS INT) AS variable, avg(c) AS m, stddev_samp(c) AS sd FROM c GROUP BY variable)
SELECT variable, round(m, 8) AS mean, round(sd, 8) AS sd, round(m / sd, 4) AS ratio, round(sum(m) OVER (ORDER BY m DESC, variable) / sum(m) OVER (), 6) AS cumulative FROM s"""
)
def simper(spark, sf):
    s = I.specimens(spark, sf).withColumn("features", F.transform("features", F.abs))
    d = hypothesis.simper(s.select("id", "features"), s.select("id", "group"))
    return d.select("variable", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), F.round("ratio", 4).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))


# --- series --------------------------------------------------------------------------------------------------------


@query()
def coniss(spark, sf):
    s = I.series(spark, sf).select("series", "pos", F.array("y").alias("features"))
    return rounded(stratigraphy.coniss(s))


TRANSITIONS = f"""WITH {I.STATES}, n AS (SELECT state AS a, lead(state) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM states), t AS (SELECT a, b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY a, b)"""


@query(TRANSITIONS + " SELECT a AS from_state, b AS to_state, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS p, round(CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) * sum(n) OVER (PARTITION BY b) / sum(n) OVER (), 6) AS expected FROM t")
def markov_transitions(spark, sf):
    return rounded(stratigraphy.markov(I.states(spark, sf))["transitions"])


@query(TRANSITIONS + """, e AS (SELECT n, CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM t), c AS (SELECT sum((n - e) * (n - e) / e) AS x, (SELECT (count(DISTINCT a) - 1) * (count(DISTINCT a) - 1) FROM t) AS df FROM e),
p AS (SELECT x, df, CASE WHEN df % 2 = 0 THEN exp(-x / 2) * (SELECT sum(pow(x / 2, k) / gamma(k + 1)) FROM range(0, 1000) r(k) WHERE k < df / 2) END AS p FROM c)
SELECT round(x, 5) AS chi2, CAST(df AS INT) AS df, round(p, 5) AS p_value, p < 0.05 AS is_markovian FROM p""")
def markov_test(spark, sf):
    """Five states: the chi-square tail of an even number of degrees of freedom is a finite sum."""
    return rounded(stratigraphy.markov(I.states(spark, sf))["test"], 5)


@query(
    TRANSITIONS.replace("WITH", "WITH RECURSIVE", 1)
    + """, p AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM t), s AS (SELECT a FROM t UNION SELECT b FROM t),
v AS (SELECT 0 AS i, a, 1.0::DOUBLE / (SELECT count(*) FROM s) AS v FROM s UNION ALL SELECT i + 1, p.b, sum(v * p) FROM v JOIN p ON v.a = p.a WHERE i < 100 GROUP BY i + 1, p.b)
SELECT a AS state, round(v, 6) AS p FROM v WHERE i = 100"""
)
def markov_stationary(spark, sf):
    return rounded(stratigraphy.markov(I.states(spark, sf))["stationary"])


@query(
    f"""WITH {I.ANGLES}, d AS (SELECT count(*) AS n, avg(cos(radians(a))) AS c, avg(sin(radians(a))) AS s FROM angles), e AS (SELECT n, degrees(atan2(s, c)) AS m, sqrt(c * c + s * s) AS r FROM d)
SELECT n, round(CASE WHEN m < 0 THEN m + 360 ELSE m END, 5) AS mean_direction, round(r, 6) AS r, round(1 - r, 6) AS circular_variance, round(n * r * r, 5) AS rayleigh_z, round(exp(-n * r * r) * (1 + (2 * n * r * r - n * r * r * n * r * r) / (4 * n)), 5) AS p_value FROM e"""
)
def directional(spark, sf):
    return stratigraphy.directional(I.angles(spark, sf)).select("n", F.round("mean_direction", 5).alias("mean_direction"), F.round("r", 6).alias("r"), F.round("circular_variance", 6).alias("circular_variance"), F.round("rayleigh_z", 5).alias("rayleigh_z"), F.round("p_value", 5).alias("p_value"))


@query(f"WITH {I.LADS} SELECT rank, lad, lad AS lower, round(lad - ln(1 - 0.95::DOUBLE) / (rank / 0.7::DOUBLE), 6) AS upper FROM lads")
def extinction_marshall(spark, sf):
    return rounded(stratigraphy.extinction_ci(I.lads(spark, sf)))


@query(
    f"""WITH RECURSIVE {I.LADS}, t AS (SELECT rank, lad, count(*) OVER () AS n, max(lad) OVER () AS top FROM lads),
z AS (SELECT 0 AS i, rank, lad, n, top, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM t
  UNION ALL SELECT i + 1, rank, lad, n, top, CASE WHEN p < 0.95 THEN m ELSE lo END, CASE WHEN p < 0.95 THEN hi ELSE m END FROM (SELECT *, (lo + hi) / 2 AS m,
    list_sum(list_transform(range(rank, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2)))) AS p FROM z WHERE i < 45))
SELECT rank, lad, lad AS lower, round(lad + greatest(0, (lo + hi) / 2 - CAST(rank AS DOUBLE) / (n + 1)) * greatest(1, top), 6) AS upper FROM z WHERE i = 45"""
)
def extinction_strauss_sadler(spark, sf):
    """The SQL finds the quantile by bisection of the binomial tail, which is the beta distribution at whole numbers."""
    return rounded(stratigraphy.extinction_ci(I.lads(spark, sf), "strauss_sadler"))


@query(
    f"""WITH {I.DAILY}, s AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY pos) - 1 AS t, y - avg(y) OVER (PARTITION BY series) AS e, count(*) OVER (PARTITION BY series) AS n FROM series),
p AS (SELECT series, k, max(n) AS n, sum(e * cos(2 * pi() * k * t / n)) AS re, sum(e * sin(2 * pi() * k * t / n)) AS im FROM s, range(1, 1000) r(k) WHERE k <= n // 2 GROUP BY series, k)
SELECT series, CAST(k AS INT) AS k, round(k / n, 6) AS frequency, round((re * re + im * im) / n, 4) AS power, row_number() OVER (PARTITION BY series ORDER BY (re * re + im * im) DESC, k) = 1 AS is_peak FROM p"""
)
def periodogram(spark, sf):
    p = stratigraphy.periodogram(I.values(spark, sf))
    return p.select("series", "k", F.round("frequency", 6).alias("frequency"), F.round("power", 4).alias("power"), "is_peak")


@query(f"WITH {I.DAILY} SELECT a.series AS section_a, b.series AS section_b, round(corr(a.y, b.y), 6) AS r, corr(a.y, b.y) > 0.5 AS matched FROM series a JOIN series b ON a.pos = b.pos AND a.series < b.series GROUP BY 1, 2")
def section_correlation(spark, sf):
    return rounded(stratigraphy.section_correlation(I.series(spark, sf).select(F.col("series").alias("section"), "pos", F.col("y").alias("value"))))


@query(f"WITH {I.EVENTS}, e AS (SELECT DISTINCT section, event FROM sections WHERE fad > 0 OR lad > 0) SELECT x.event AS a, y.event AS b, count(*) AS n FROM e x JOIN e y ON x.section = y.section AND x.event < y.event GROUP BY 1, 2")
def cooccurrence(spark, sf):
    return stratigraphy.cooccurrence(I.sections(spark, sf))


@query()
def unitary_associations(spark, sf):
    return stratigraphy.unitary_associations(I.sections(spark, sf))


@query(
    f"""WITH {I.DAILY}, m AS (SELECT *, y > lag(y) OVER w AND y > lead(y) OVER w AS top FROM series WINDOW w AS (PARTITION BY series ORDER BY pos))
SELECT series, count(*) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd, round(regr_slope(y, x), 6) AS slope, count(*) FILTER (top) AS maxima FROM m GROUP BY series"""
)
def isotopes(spark, sf):
    return rounded(stratigraphy.isotopes(I.series(spark, sf)))


@query(
    f"""WITH {I.DAILY}, v AS (SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY pos) AS DOUBLE) AS t, y FROM series),
c AS (SELECT a.series, a.t, s * 2 AS sc, sum(b.y * exp(-((b.t - a.t) / (s * 2)) * ((b.t - a.t) / (s * 2)) / 2) * cos(5 * (b.t - a.t) / (s * 2))) AS w FROM v a JOIN v b ON a.series = b.series, range(1, 31) r(s) GROUP BY 1, 2, 3),
p AS (SELECT series, sc, avg(w * w / sc) AS p FROM c GROUP BY 1, 2)
SELECT series, CAST(sc AS INT) AS scale, round(1.03::DOUBLE * sc, 6) AS period, round(p, 3) AS power, row_number() OVER (PARTITION BY series ORDER BY p DESC, sc) = 1 AS is_peak FROM p"""
)
def wavelet(spark, sf):
    return stratigraphy.wavelet(I.values(spark, sf)).select("series", "scale", F.round("period", 6).alias("period"), F.round("power", 3).alias("power"), "is_peak")


@query(
    f"""WITH {I.DAILY}, n AS (SELECT a.series, a.pos, a.x, b.y, abs(b.x - a.x) AS d, row_number() OVER (PARTITION BY a.series, a.pos ORDER BY abs(b.x - a.x), b.pos) AS k, count(*) OVER (PARTITION BY a.series, a.pos) AS n
  FROM series a JOIN series b ON a.series = b.series),
t AS (SELECT *, max(d) OVER (PARTITION BY series, pos) AS top FROM n WHERE k <= greatest(2, floor(0.3::DOUBLE * n))),
w AS (SELECT *, CASE WHEN top > 0 THEN pow(1 - pow(least(1.0::DOUBLE, d / top), 3), 3) ELSE 1.0::DOUBLE END AS w FROM t)
SELECT series, pos, x, round(CASE WHEN sum(w) > 0 THEN sum(w * y) / sum(w) ELSE avg(y) END, 6) AS smooth FROM w GROUP BY series, pos, x"""
)
def lowess(spark, sf):
    return rounded(stratigraphy.lowess(I.series(spark, sf)))


@query(f"WITH {I.DAILY} SELECT series, round(regr_r2(y, x), 6) AS r2, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 5) AS intercept FROM series GROUP BY series")
def linear_trend(spark, sf):
    p = stratigraphy.polynomial_trend(I.series(spark, sf), 1)
    return p.select("series", F.round("r2", 6).alias("r2"), F.round(F.col("coefficients")[1], 6).alias("slope"), F.round(F.col("coefficients")[0], 5).alias("intercept"))


@query(
    f"""WITH {I.DAILY}, m AS (SELECT series, avg(x) AS mx, avg(y) AS my FROM series GROUP BY series), u AS (SELECT series, x - mx AS u, (x - mx) * (x - mx) AS s, y - my AS y FROM series JOIN m USING (series)),
g AS (SELECT series, regr_slope(s, u) AS b, regr_intercept(s, u) AS a FROM u GROUP BY series), q AS (SELECT series, u, s - a - b * u AS q, y FROM u JOIN g USING (series))
SELECT series, round((sum(y * u) * sum(y * u) / sum(u * u) + sum(y * q) * sum(y * q) / sum(q * q)) / sum(y * y), 6) AS r2 FROM q GROUP BY series"""
)
def polynomial_trend(spark, sf):
    return rounded(stratigraphy.polynomial_trend(I.series(spark, sf), 2).select("series", "r2"))


@query(
    f"""WITH {I.DAILY}, h AS (SELECT *, y - (avg(y) OVER w + regr_slope(y, x) OVER w * (x - avg(x) OVER w)) AS e, 1.0::DOUBLE / count(*) OVER w + (x - avg(x) OVER w) * (x - avg(x) OVER w) / (var_pop(x) OVER w * count(*) OVER w) AS lev, y - avg(y) OVER w AS c FROM series WINDOW w AS (PARTITION BY series))
SELECT series, round(sum((e / (1 - lev)) * (e / (1 - lev))), 3) AS press, round(1 - sum((e / (1 - lev)) * (e / (1 - lev))) / sum(c * c), 6) AS q2 FROM h GROUP BY series"""
)
def cross_validation(spark, sf):
    return stratigraphy.cross_validate(I.series(spark, sf), 1).select("series", F.round("press", 3).alias("press"), F.round("q2", 6).alias("q2"))


@query(f"WITH {I.DAILY} SELECT series, pos, round(y, 6) AS x, round(avg(y) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS average FROM series")
def moving_average(spark, sf):
    return rounded(stratigraphy.moving_average(I.values(spark, sf)))


OUTLIERS = f"""WITH {I.PRICES}, r AS (SELECT grp, x, row_number() OVER (PARTITION BY grp ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY grp) AS n FROM prices),
q AS (SELECT grp, max(CASE WHEN k = CAST(floor(n * 0.25) AS BIGINT) THEN x END) AS q1, max(CASE WHEN k = CAST(floor(n * 0.75) AS BIGINT) THEN x END) AS q3, max(CASE WHEN k = CAST(floor(n * 0.5) AS BIGINT) THEN x END) AS q2, min(x) AS lo, max(x) AS hi FROM r GROUP BY grp)"""


@query(OUTLIERS + ' SELECT p.grp AS "group", count(*) AS n, count(*) FILTER (x < q1 - 0.5 * (q3 - q1) OR x > q3 + 0.5 * (q3 - q1)) AS outliers FROM prices p JOIN q USING (grp) GROUP BY 1')
def outliers_iqr(spark, sf):
    d = stratigraphy.flag_outliers(I.prices(spark, sf), threshold=0.5)
    return d.groupBy("group").agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("outliers"))


@query(f'WITH {I.PRICES}, s AS (SELECT grp, avg(x) AS m, stddev_samp(x) AS sd FROM prices GROUP BY grp) SELECT grp AS "group", count(*) AS n, round(sum(x), 2) AS total FROM prices JOIN s USING (grp) WHERE abs(x - m) / sd <= 1.5 GROUP BY grp')
def remove_outliers_zscore(spark, sf):
    return stratigraphy.remove_outliers(I.prices(spark, sf), "zscore").groupBy("group").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"))


@query(f"WITH {I.DAILY}, z AS (SELECT series, pos, y, (y - avg(y) OVER (PARTITION BY series)) / stddev_samp(y) OVER (PARTITION BY series) AS z FROM series) SELECT series, pos, round(y, 6) AS x, round(z, 6) AS z, CASE WHEN z > 0 THEN 'positive' ELSE 'negative' END AS direction FROM z WHERE abs(z) >= 1.5")
def excursions(spark, sf):
    return rounded(stratigraphy.excursions(I.values(spark, sf), 1.5))


@query(
    f"""WITH {I.DAILY}, e AS (SELECT series, pos, y - avg(y) OVER (PARTITION BY series) AS e, count(*) OVER (PARTITION BY series) AS n FROM series),
l AS (SELECT series, n, e, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2 FROM e WINDOW w AS (PARTITION BY series ORDER BY pos))
SELECT series, CAST(unnest([0, 1, 2]) AS INT) AS lag, round(unnest([sum(e * e) / max(n), sum(e * e1) / max(n), sum(e * e2) / max(n)]), 5) AS value FROM l GROUP BY series"""
)
def autocovariances(spark, sf):
    return stratigraphy.autocovariances(I.values(spark, sf), 2).select("series", "lag", F.round("value", 5).alias("value"))


@query(
    f"""WITH {I.DAILY}, e AS (SELECT series, pos, y - avg(y) OVER (PARTITION BY series) AS e, avg(y) OVER (PARTITION BY series) AS m FROM series), l AS (SELECT *, lag(e) OVER (PARTITION BY series ORDER BY pos) AS p FROM e)
SELECT series, round(max(m), 5) AS mean, round(sum(e * p) / sum(e * e), 6) AS phi1 FROM l GROUP BY series"""
)
def arma_fit(spark, sf):
    return stratigraphy.fit_arma(I.values(spark, sf)).select("series", F.round("mean", 5).alias("mean"), F.round(F.col("phi")[0], 6).alias("phi1"))


@query()
def arma_forecast(spark, sf):
    return rounded(stratigraphy.forecast(stratigraphy.fit_arma(I.values(spark, sf), 2), 5))


# --- macroevolution ------------------------------------------------------------------------------------------------


@query(
    f"""WITH {I.RANGES}, j AS (SELECT t_start, t_end, CASE WHEN first <= t_start AND last >= t_end THEN 's' WHEN first >= t_start AND first < t_end AND last >= t_end THEN 'f' WHEN last >= t_start AND last < t_end AND first < t_start THEN 'l' END AS c
  FROM intervals LEFT JOIN ranges ON first <= t_end AND last >= t_start), g AS (SELECT t_start, t_end, count(*) FILTER (c = 's') AS s, count(*) FILTER (c = 'f') AS f, count(*) FILTER (c = 'l') AS l FROM j GROUP BY 1, 2),
p AS (SELECT *, s + f + l AS n, CASE WHEN s + f + l > 0 THEN s / (s + f + l) END AS p FROM g), w AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS mid, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS half FROM (SELECT * REPLACE (CAST(n AS DOUBLE) AS n) FROM p))
SELECT t_start, t_end, s AS survivors, f AS fb, l AS lb, CAST(n AS BIGINT) AS total, round(p, 6) AS p, round(CASE WHEN p > 0 THEN (0 - ln(p)) / (t_end - t_start) END, 6) AS extinction, round(CASE WHEN p < 1 THEN (0 - ln(1 - p)) / (t_end - t_start) END, 6) AS origination,
  round(CASE WHEN n > 0 THEN mid - half END, 6) AS ci_low, round(CASE WHEN n > 0 THEN mid + half END, 6) AS ci_high FROM w"""
)
def cohort_survivorship(spark, sf):
    return rounded(macroevolution.cohort_survivorship(I.ranges(spark, sf), I.intervals(spark)))


@query(
    f"""WITH {I.RANGES}, d AS (SELECT (t_start + t_end) / 2 AS midpoint, count(taxon) AS richness FROM intervals LEFT JOIN ranges ON first <= (t_start + t_end) / 2 AND last >= (t_start + t_end) / 2 GROUP BY 1)
SELECT midpoint, richness, round((richness - lag(richness) OVER w) / (midpoint - lag(midpoint) OVER w), 6) AS net_rate FROM d WINDOW w AS (ORDER BY midpoint)"""
)
def diversity_dynamics(spark, sf):
    return rounded(macroevolution.diversity_dynamics(I.ranges(spark, sf), I.intervals(spark)))


@query()
def fbd_simulation(spark, sf):
    return macroevolution.simulate_fbd(spark, 0.5, 0.2, 0.1, 5, replicates=20).select("replicate", "lineages", "total", "fossils")


@query()
def neutral_simulation(spark, sf):
    return macroevolution.simulate_neutral(spark, 50, 5, replicates=5)


@query()
def cox_regression(spark, sf):
    return rounded(macroevolution.cox(I.survival(spark, sf)), 4)


@query(
    f"""WITH {I.SURVIVAL}, t AS (SELECT time, sum(event) AS d, sum(CASE WHEN grp = 0 THEN event ELSE 0 END) AS d1, count(*) AS c, count(*) FILTER (grp = 0) AS c1 FROM survival GROUP BY time),
r AS (SELECT CAST(d AS DOUBLE) AS d, d1, CAST(sum(c) OVER w AS DOUBLE) AS n, CAST(sum(c1) OVER w AS DOUBLE) AS n1 FROM t WINDOW w AS (ORDER BY time DESC)),
s AS (SELECT CAST(sum(d1) AS BIGINT) AS o, sum(d * n1 / n) AS e, sum(CASE WHEN n > 1 THEN d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM r WHERE d > 0)
SELECT o AS observed, round(e, 5) AS expected, round(v, 5) AS variance, round((o - e) * (o - e) / v, 5) AS chi2, round({two_sided_p_sql("sqrt((o - e) * (o - e) / v)")}, 5) AS p_value FROM s"""
)
def log_rank(spark, sf):
    return rounded(macroevolution.log_rank(I.survival(spark, sf), 0, 1), 5)


@query(f"WITH {I.GROWTH}, l AS (SELECT t, ln(greatest(v, 1e-10)) AS y FROM growth) SELECT round(regr_slope(y, t), 8) AS rate, round(exp(regr_intercept(y, t)), 5) AS n0, round(regr_r2(y, t), 6) AS r2, round(count(*) * ln(regr_syy(y, t) * (1 - regr_r2(y, t)) / count(*) + 1e-10) + 4, 5) AS aic FROM l")
def fit_exponential(spark, sf):
    return macroevolution.fit_exponential(I.growth(spark, sf)).select(F.round("rate", 8).alias("rate"), F.round("n0", 5).alias("n0"), F.round("r2", 6).alias("r2"), F.round("aic", 5).alias("aic"))


@query(
    f"""WITH {I.GROWTH}, k AS (SELECT f * (SELECT max(v) FROM growth) AS k FROM (VALUES (1.5::DOUBLE), (2.0), (3.0), (5.0)) x(f)), l AS (SELECT k, t, ln(greatest(k / greatest(v, 1e-10) - 1, 1e-10)) AS y FROM growth, k),
g AS (SELECT k, regr_slope(y, t) AS s, regr_intercept(y, t) AS i, regr_r2(y, t) AS r2, count(*) * ln(regr_syy(y, t) * (1 - regr_r2(y, t)) / count(*) + 1e-10) + 6 AS aic FROM l GROUP BY k)
SELECT k, round(-s, 6) AS rate, round(-i / s, 4) AS midpoint, round(r2, 6) AS r2, round(aic, 4) AS aic FROM g ORDER BY r2 DESC, k LIMIT 1"""
)
def fit_logistic(spark, sf):
    return macroevolution.fit_logistic(I.growth(spark, sf)).select("k", F.round("rate", 6).alias("rate"), F.round("midpoint", 4).alias("midpoint"), F.round("r2", 6).alias("r2"), F.round("aic", 4).alias("aic"))


@query()
def fbd_likelihood(spark, sf):
    nodes = spark.sql("SELECT * FROM VALUES (0.0D, true, false), (0.0D, true, false), (1.2D, false, true), (2.0D, false, false), (3.5D, false, false) AS t(age, is_extant, is_fossil)")
    return rounded(macroevolution.fbd_log_likelihood(nodes, 0.5, 0.2, 0.1, 0.8))


@query(
    f"""WITH v AS (SELECT * FROM (VALUES (0.5::DOUBLE, 0.2::DOUBLE), (0.1, 0.3), (0.4, 0.4)) x(o, e)), z AS (SELECT *, (o - e) / sqrt(o * o + e * e) AS z FROM v)
SELECT o AS origination, e AS extinction, round(o / e, 6) AS ratio, round(z, 6) AS z, round({two_sided_p_sql("z")}, 6) AS p_value FROM z"""
)
def equilibrium(spark, sf):
    d = spark.sql("SELECT * FROM VALUES (0.5D, 0.2D), (0.1D, 0.3D), (0.4D, 0.4D) AS t(origination, extinction)")
    return rounded(macroevolution.equilibrium(d))


# --- shapes --------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {I.SPECIMENS}, p AS (SELECT id, v[k] AS x, v[k + 32] AS y FROM specimens, range(1, 33) t(k))
SELECT id AS specimen, round(sqrt(32 * (var_pop(x) + var_pop(y))), 4) AS centroid_size FROM p GROUP BY id"""
)
def gpa_sizes(spark, sf):
    return rounded(morphometrics.gpa(I.configurations(spark, sf))["aligned"].select("specimen", "centroid_size"), 4)


@query()
def gpa(spark, sf):
    return rounded(morphometrics.gpa(I.configurations(spark, sf))["aligned"].select("specimen", "centroid_size", "distance"), 4)


EFA = """WITH c AS (SELECT vec_id AS contour, k AS pos, CAST(embedding[k] AS DOUBLE) AS x, CAST(embedding[k + 32] AS DOUBLE) AS y FROM embeddings, range(1, 33) t(k)),
z AS (SELECT * FROM c UNION ALL SELECT contour, 33, x, y FROM c WHERE pos = 1),
d AS (SELECT contour, pos, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM z WINDOW w AS (PARTITION BY contour ORDER BY pos)),
l AS (SELECT *, sqrt(dx * dx + dy * dy) AS dt FROM d WHERE dx IS NOT NULL), t AS (SELECT *, sum(dt) OVER (PARTITION BY contour ORDER BY pos) AS t, sum(dt) OVER (PARTITION BY contour) AS tot FROM l),
h AS (SELECT contour, h AS harmonic, tot, dx / dt AS vx, dy / dt AS vy, cos(2 * pi() * h * t / tot) - cos(2 * pi() * h * (t - dt) / tot) AS dc, sin(2 * pi() * h * t / tot) - sin(2 * pi() * h * (t - dt) / tot) AS ds FROM t, range(1, 4) r(h) WHERE dt > 0)
SELECT contour, CAST(harmonic AS INT) AS harmonic, round(sum(vx * dc) * max(tot) / (2 * pi() * pi() * harmonic * harmonic), 6) AS a, round(sum(vx * ds) * max(tot) / (2 * pi() * pi() * harmonic * harmonic), 6) AS b,
  round(sum(vy * dc) * max(tot) / (2 * pi() * pi() * harmonic * harmonic), 6) AS c, round(sum(vy * ds) * max(tot) / (2 * pi() * pi() * harmonic * harmonic), 6) AS d FROM h GROUP BY contour, harmonic"""


@query(EFA)
def elliptic_fourier(spark, sf):
    c = I.configurations(spark, sf).select(F.col("specimen").alias("contour"), F.posexplode(F.arrays_zip(F.slice("config", 1, 32).alias("x"), F.slice("config", 33, 32).alias("y"))).alias("pos", "p"))
    return rounded(morphometrics.elliptic_fourier(c.select("contour", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y")), 3))


@query(
    f"""WITH {I.SPECIMENS}, s AS (SELECT v, ln(sqrt(list_sum(list_transform(v, lambda x: x * x)))) AS size FROM specimens)
SELECT CAST(k - 1 AS INT) AS coordinate, round(regr_slope(v[k], size), 6) AS slope, round(regr_intercept(v[k], size), 6) AS intercept FROM s, range(1, 65) t(k) GROUP BY k"""
)
def allometry(spark, sf):
    return rounded(morphometrics.allometry(I.configurations(spark, sf))["coefficients"])


@query(
    f"""WITH {I.SPECIMENS}, d AS (SELECT k, v[k] AS v, ln(sqrt(list_sum(list_transform(v, lambda x: x * x)))) AS s FROM specimens, range(1, 65) t(k)),
g AS (SELECT k, regr_syy(v, s) AS t, regr_syy(v, s) * regr_r2(v, s) AS r, count(*) - 2 AS df FROM d GROUP BY k)
SELECT round(sum(r) / sum(t), 6) AS r2, round(sum(r) / ((sum(t) - sum(r)) / max(df)), 4) AS f FROM g"""
)
def allometry_r2(spark, sf):
    f = morphometrics.allometry(I.configurations(spark, sf))["fit"]
    return f.select(F.round("r2", 6).alias("r2"), F.round("f", 4).alias("f"))


@query()
def allometry_fit(spark, sf):
    return rounded(morphometrics.allometry(I.configurations(spark, sf))["fit"])


@query(
    f"""WITH {I.DAILY}, d AS (SELECT series, y, y - lag(y) OVER (PARTITION BY series ORDER BY pos) AS s FROM series),
g AS (SELECT series, count(*) AS n, avg(s * s) AS rw, var_pop(s) AS di, var_pop(y) AS st FROM d GROUP BY series),
l AS (SELECT series, n, 2 + (n - 1) * (ln(2 * pi() * greatest(rw, 1e-10)) + 1) AS a, 4 + (n - 1) * (ln(2 * pi() * greatest(di, 1e-10)) + 1) AS b, 2 + n * (ln(2 * pi() * greatest(st, 1e-10)) + 1) AS c FROM g),
e AS (SELECT *, exp((least(a, b, c) - a) / 2) AS ea, exp((least(a, b, c) - b) / 2) AS eb, exp((least(a, b, c) - c) / 2) AS ec FROM l)
SELECT series, n, round(a, 4) AS aic_random_walk, round(b, 4) AS aic_directional, round(c, 4) AS aic_stasis, round(ea / (ea + eb + ec), 4) AS weight_random_walk, round(eb / (ea + eb + ec), 4) AS weight_directional,
  round(ec / (ea + eb + ec), 4) AS weight_stasis, CASE WHEN n < 3 THEN 'unknown' WHEN a = least(a, b, c) THEN 'random_walk' WHEN b = least(a, b, c) THEN 'directional' ELSE 'stasis' END AS model FROM e"""
)
def evolution_rate(spark, sf):
    return rounded(morphometrics.evolution_rate(I.values(spark, sf)), 4)


@query()
def thin_plate_spline(spark, sf):
    p = spark.sql("SELECT * FROM VALUES (1, 0D, 0D, 0D, 0D), (2, 1D, 0D, 1D, 0.2D), (3, 1D, 1D, 1.1D, 1D), (4, 0D, 1D, 0D, 1D), (5, 0.5D, 0.5D, 0.6D, 0.5D) AS t(lm, sx, sy, tx, ty)")
    return rounded(morphometrics.thin_plate_spline(p)["grid"])


@query()
def relative_warps(spark, sf):
    return rounded(morphometrics.relative_warps(I.configurations(spark, sf), 5)["variance"])


@query()
def divide_blocks(spark, sf):
    return morphometrics.divide_blocks(I.configurations(spark, sf), "random", 7)


# --- trees ---------------------------------------------------------------------------------------------------------


@query()
def newick_nodes(spark, sf):
    return phylogenetics.read_trees(spark.range(1).select(F.lit("t").alias("tree_id"), F.lit(I.TREE).alias("newick")))


@query("SELECT * FROM (VALUES ('t', 'A', 'B', 3.0::DOUBLE), ('t', 'A', 'C', 4.5), ('t', 'A', 'D', 3.5), ('t', 'B', 'C', 5.5), ('t', 'B', 'D', 4.5), ('t', 'C', 'D', 2.0)) x(tree_id, i, j, d)")
def patristic_distances(spark, sf):
    return phylogenetics.patristic_distances(newick_nodes(spark, sf))


@query("SELECT * FROM (VALUES (0, 1), (1, 1), (2, 1)) x(site, changes)")
def fitch(spark, sf):
    return phylogenetics.fitch(I.tree(), I.characters(spark))


@query("SELECT 3::BIGINT AS length, 3::BIGINT AS variable_sites, 1.0::DOUBLE AS consistency, 1.0::DOUBLE AS retention")
def parsimony_indices(spark, sf):
    return phylogenetics.parsimony_indices(I.tree(), I.characters(spark))


@query()
def independent_contrasts(spark, sf):
    t = spark.createDataFrame([("size", k, v) for k, v in I.TRAITS.items()], "trait string, taxon string, value double")
    return rounded(phylogenetics.independent_contrasts(spark, I.tree(), t))


@query()
def phylogenetic_signal(spark, sf):
    return phylogenetics.phylogenetic_signal(spark, I.tree(), I.TRAITS, 99)


@query()
def phylogenetic_anova(spark, sf):
    return phylogenetics.phylogenetic_anova(spark, I.tree(), I.TRAITS, I.GROUPS, 99)


@query()
def ancestral_states(spark, sf):
    return spark.createDataFrame(sorted(phylogenetics.ancestral_states(I.tree(), I.TRAITS).items()), "node_id int, value double")


@query()
def parsimony_search(spark, sf):
    return phylogenetics.search_trees(I.characters(spark), 4)


def _trees(spark):
    return spark.createDataFrame([("1", "((A,B),(C,D));"), ("2", "((A,B),C,D);"), ("3", "((A,C),(B,D));")], "tree_id string, newick string")


@query("SELECT * FROM (VALUES (['A', 'B'], 2::BIGINT, 0.666667::DOUBLE), (['A', 'C'], 1, 0.333333), (['B', 'D'], 1, 0.333333), (['C', 'D'], 1, 0.333333)) x(clade, n, share)")
def clade_frequencies(spark, sf):
    return rounded(phylogenetics.clade_frequencies(_trees(spark)))


@query()
def consensus_trees(spark, sf):
    t = _trees(spark)
    return spark.createDataFrame([("majority", phylogenetics.consensus(t).newick()), ("strict", phylogenetics.strict_consensus(t).newick())], "kind string, newick string")


@query()
def neighbor_joining(spark, sf):
    return phylogenetics.neighbor_nodes(I.specimens(spark, sf), "nj")


@query()
def upgma(spark, sf):
    return phylogenetics.upgma_nodes(I.specimens(spark, sf), "upgma")


# --- transforms, imputation, tables --------------------------------------------------------------------------------

ROUND = "round(value, 6) AS value"


def _matrix_query(name: str, f, sql: str, holes: bool = False) -> None:
    QUERIES[name] = lambda spark, sf: rounded(f(I.long_matrix(spark, sf, holes)).select("row", "variable", "value"))
    SQL[name] = f"WITH {I.HOLES if holes else I.MATRIX}, o AS ({sql}) SELECT \"row\", variable, {ROUND} FROM o"


_matrix_query("transform_log", transforms.log_transform, 'SELECT "row", variable, ln(value + 1) / ln(10.0::DOUBLE) AS value FROM m')
_matrix_query("transform_sqrt", transforms.sqrt_transform, 'SELECT "row", variable, sqrt(value) AS value FROM m')
_matrix_query("transform_zscore", transforms.zscore, 'SELECT "row", variable, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM m WINDOW w AS (PARTITION BY variable)')
_matrix_query("transform_percent", transforms.percent, 'SELECT "row", variable, value / sum(value) OVER (PARTITION BY "row") AS value FROM m')
_matrix_query("transform_hellinger", transforms.hellinger, 'SELECT "row", variable, sqrt(value / sum(value) OVER (PARTITION BY "row")) AS value FROM m')
_matrix_query("transform_wisconsin", transforms.wisconsin, 'SELECT "row", variable, v / sum(v) OVER (PARTITION BY "row") AS value FROM (SELECT "row", variable, value / max(value) OVER (PARTITION BY variable) AS v FROM m)')
_matrix_query("transform_min_max", transforms.min_max, 'SELECT "row", variable, CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END AS value FROM m WINDOW w AS (PARTITION BY variable)')
_matrix_query("impute_mean", transforms.impute_mean, 'SELECT "row", variable, coalesce(value, avg(value) OVER (PARTITION BY variable), 0) AS value FROM m', True)
_matrix_query(
    "impute_knn",
    transforms.impute_knn,
    """WITH d AS (SELECT x."row" AS r, y."row" AS o, sum((x.value - y.value) * (x.value - y.value)) AS d FROM m x JOIN m y ON x.variable = y.variable AND x."row" <> y."row" WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1, 2),
n AS (SELECT r, o FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, o) AS k FROM d) WHERE k <= 5),
f AS (SELECT m."row" AS r, m.variable AS v, avg(y.value) AS f FROM m JOIN n ON n.r = m."row" JOIN m y ON y."row" = n.o AND y.variable = m.variable WHERE m.value IS NULL GROUP BY 1, 2)
SELECT m."row", m.variable, coalesce(m.value, f, avg(m.value) OVER (PARTITION BY m.variable), 0) AS value FROM m LEFT JOIN f ON f.r = m."row" AND f.v = m.variable""",
    True,
)


@query(
    f"""WITH {I.HOLES} SELECT 'total' AS scope, '' AS name, count(*) FILTER (value IS NULL) AS missing, round(count(*) FILTER (value IS NULL) / count(*), 6) AS share FROM m
UNION ALL SELECT 'variable', variable, count(*) FILTER (value IS NULL), round(count(*) FILTER (value IS NULL) / count(*), 6) FROM m GROUP BY variable
UNION ALL SELECT 'row', CAST("row" AS VARCHAR), count(*) FILTER (value IS NULL), round(count(*) FILTER (value IS NULL) / count(*), 6) FROM m GROUP BY "row" """
)
def missing_report(spark, sf):
    return rounded(transforms.missing_report(I.long_matrix(spark, sf, True)))


@query(
    f"""WITH {I.MATRIX}, g AS (SELECT variable, k / 10.0::DOUBLE AS g, CASE WHEN k = 0 THEN ln(value) ELSE (value ** (k / 10.0::DOUBLE) - 1) / (k / 10.0::DOUBLE) END AS y, ln(value) AS l FROM m, range(-20, 21) t(k) WHERE value > 0),
l AS (SELECT variable, g, -count(*) / 2.0::DOUBLE * ln(var_pop(y)) + (g - 1) * sum(l) AS ll FROM g GROUP BY variable, g)
SELECT variable, round(arg_max(g, ll), 4) AS lambda, round(max(ll), 4) AS likelihood FROM l GROUP BY variable"""
)
def boxcox(spark, sf):
    return rounded(transforms.boxcox_lambda(I.long_matrix(spark, sf)), 4)


@query(f'WITH {I.MATRIX} SELECT variable AS "row", CAST("row" AS VARCHAR) AS variable, value FROM m')
def transpose(spark, sf):
    return tables.transpose(I.long_matrix(spark, sf))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00012')")
def filter_labels(spark, sf):
    return tables.filter_labels(I.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "00012")


@query("SELECT count(l_quantity) + count(l_discount) AS count, round((sum(l_quantity) + sum(l_discount)) / (count(l_quantity) + count(l_discount)), 6) AS mean, round((SELECT stddev_samp(x) FROM (SELECT l_quantity AS x FROM lineitem UNION ALL SELECT l_discount FROM lineitem)), 6) AS sd FROM lineitem")
def selection_statistics(spark, sf):
    return rounded(tables.selection_statistics(I.table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]))


@query('SELECT count(*) AS rows, 7 AS columns, 0::BIGINT AS missing, true AS valid FROM lineitem')
def validate(spark, sf):
    d = I.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return tables.validate(d)


# --- chart data ----------------------------------------------------------------------------------------------------


@query(
    f"""WITH {I.PRICES}, r AS (SELECT min(x) AS lo, (max(x) - min(x)) / 30 AS w FROM prices), b AS (SELECT least(floor((x - lo) / w), 29) AS b, lo, w FROM prices, r)
SELECT CAST(b AS INT) AS bin, round(max(lo) + b * max(w), 6) AS low, round(max(lo) + (b + 1) * max(w), 6) AS high, count(*) AS n FROM b GROUP BY b"""
)
def chart_histogram(spark, sf):
    return rounded(charts.histogram(I.prices(spark, sf)))


@query(OUTLIERS + ' SELECT grp AS "group", q1, q2 AS median, q3, round(greatest(lo, q1 - 1.5 * (q3 - q1)), 6) AS low, round(least(hi, q3 + 1.5 * (q3 - q1)), 6) AS high FROM q')
def chart_box_plot(spark, sf):
    return rounded(charts.box_plot(I.prices(spark, sf)))


@query(f"WITH {I.ANGLES} SELECT CAST(floor(a / 30) AS INT) AS bin, (floor(a / 30) + 0.5) * 30 AS centre, count(*) AS n FROM angles GROUP BY floor(a / 30)")
def chart_rose(spark, sf):
    return charts.rose(I.angles(spark, sf))


@query(f"WITH {I.DENSE} SELECT sample, round(log10(row_number() OVER (PARTITION BY sample ORDER BY abundance DESC, taxon)), 6) AS log_rank, round(log10(abundance), 6) AS log_abundance FROM community")
def chart_abundance_rank(spark, sf):
    return rounded(charts.abundance_rank(I.community(spark, sf)))


@query(
    """WITH g AS (SELECT l_returnflag AS grp, avg(l_quantity) AS cx, avg(l_extendedprice / 1000) AS cy, var_samp(l_quantity) AS a, var_samp(l_extendedprice / 1000) AS b, covar_samp(l_quantity, l_extendedprice / 1000) AS c FROM lineitem GROUP BY 1)
SELECT grp AS "group", round(cx, 5) AS cx, round(cy, 5) AS cy, round(2.447 * sqrt((a + b) / 2 + sqrt(((a - b) / 2) * ((a - b) / 2) + c * c)), 5) AS major, round(2.447 * sqrt((a + b) / 2 - sqrt(((a - b) / 2) * ((a - b) / 2) + c * c)), 5) AS minor, round(0.5 * atan2(2 * c, a - b), 5) AS angle FROM g"""
)
def chart_ellipse(spark, sf):
    d = I.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("group"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(charts.confidence_ellipse(d), 5)


PHI = "(0.5 + exp(-{x} * {x} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 100), lambda k: pow({x}, 2 * k + 1) * sqrt(pi()) / (gamma(k + 1.5::DOUBLE) * pow(2.0::DOUBLE, k + 1)))))"


@query(
    f"""WITH RECURSIVE {I.PRICES}, c AS (SELECT q AS x, count(*) AS c FROM prices WHERE q IS NOT NULL GROUP BY q),
p AS (SELECT x, (sum(c) OVER (ORDER BY x) - c + 0.5) / CAST(sum(c) OVER () AS DOUBLE) AS p, sum(c) OVER () AS n FROM c),
z AS (SELECT 0 AS i, x, p, -8.0::DOUBLE AS lo, 8.0::DOUBLE AS hi FROM p WHERE n >= 3
  UNION ALL SELECT i + 1, x, p, CASE WHEN {PHI.format(x="((lo + hi) / 2)")} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {PHI.format(x="((lo + hi) / 2)")} < p THEN hi ELSE (lo + hi) / 2 END FROM z WHERE i < 50)
SELECT x, round((lo + hi) / 2, 6) AS theoretical FROM z WHERE i = 50"""
)
def chart_qq(spark, sf):
    """The SQL finds each quantile by bisection of the series of the normal distribution."""
    return rounded(charts.qq(I.prices(spark, sf, "l_quantity")))


