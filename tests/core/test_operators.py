"""Operators against textbook values and plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fossilframe import registry
from fossilframe.functions import special
from fossilframe.functions.exprs import register_functions
from fossilframe.operators import charts, clustering, ecology, hypothesis, macroevolution, morphometrics, multivariate, phylogenetics, stratigraphy, tables, transforms
from fossilframe.sources.delimited import read_any, read_matrix, write_matrix
from fossilframe.sources.nexus import read_nexus_characters, read_tps
from fossilframe.streaming.windows import windowed_counts


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")


@pytest.fixture(scope="module")
def cloud():
    rnd = np.random.default_rng(0)
    return rnd.normal(size=(40, 4)) @ np.diag([3, 2, 1, 0.5])


def test_special_functions():
    assert special.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)
    assert special.normal_quantile(0.01) == pytest.approx(-2.326348, abs=1e-6)
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.t_cdf(2.228139, 10) == pytest.approx(0.975, abs=1e-6)
    assert special.betainc(2, 2, 0.5) == pytest.approx(0.5) and special.betainc(1, 1, 0.3) == pytest.approx(0.3)
    assert special.gammainc(2, 5) == pytest.approx(1 - 6 * math.exp(-5))
    assert special.beta_quantile(0.5, 1, 3) == pytest.approx(1 - 0.5 ** (1 / 3))
    assert abs(special.erf_as(0.5) - math.erf(0.5)) < 2e-7


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT normal_cdf(0D) a, chi2_cdf(3.841459D, 1D) b, f_cdf(4.964603D, 1D, 10D) c").first()
    assert (round(r["a"], 6), round(r["b"], 4), round(r["c"], 4)) == (0.5, 0.95, 0.95)


def test_pca_against_svd(spark, cloud):
    got = multivariate.pca(points(spark, cloud))
    x = cloud - cloud.mean(0)
    s = np.linalg.svd(x, compute_uv=False)
    assert [r["eigenvalue"] for r in got["variance"].collect()] == pytest.approx((s**2 / 39).tolist())
    scores = np.array([r["pc"] for r in got["scores"].orderBy("id").collect()])
    assert scores.var(0, ddof=1) == pytest.approx((s**2 / 39).tolist())
    wide = multivariate.pca(points(spark, cloud[:3]))["variance"].collect()
    assert len(wide) == 2


def test_pcoa_gives_pca(spark, cloud):
    d = clustering.distance_matrix(points(spark, cloud))
    values = [r["eigenvalue"] for r in multivariate.pcoa(d)["variance"].collect()][:4]
    s = np.linalg.svd(cloud - cloud.mean(0), compute_uv=False)
    assert values == pytest.approx((s**2).tolist())


def test_nmds_is_reproducible(spark, cloud):
    d = clustering.distance_matrix(points(spark, cloud[:12]))
    a, b = (sorted(r["stress"] for r in multivariate.nmds(d, restarts=3, max_iter=50)["stress"].collect()) for _ in range(2))
    assert a == b and a[0] < 0.2


def test_lda_separates(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], (rnd.normal(size=3) + 6 * (i % 2)).tolist()) for i in range(40)]
    got = multivariate.lda(spark.createDataFrame(rows, "id long, group string, features array<double>"))
    assert got["accuracy"].first()[0] == 1.0


def test_rda_of_a_linear_map(spark, cloud):
    y = cloud @ np.random.default_rng(2).normal(size=(4, 2))
    d = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(y, cloud, strict=True)], "y array<double>, x array<double>")
    got = [r["eigenvalue"] for r in multivariate.constrained(d).collect()]
    assert got == pytest.approx(np.linalg.eigvalsh(np.cov(y.T))[::-1].tolist())
    assert sum(r["percent"] for r in multivariate.constrained(d).collect()) == pytest.approx(100)


def test_cca_against_numpy(spark):
    rnd = np.random.default_rng(3)
    y, x = rnd.integers(1, 9, size=(20, 5)).astype(float), rnd.normal(size=(20, 2))
    d = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(y, x, strict=True)], "y array<double>, x array<double>")
    p = y / y.sum()
    r, c = p.sum(1), p.sum(0)
    q = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    z = np.sqrt(r)[:, None] * (x - r @ x)
    fit = z @ np.linalg.pinv(z) @ q
    want = np.linalg.svd(fit, compute_uv=False)[:2] ** 2
    assert [v["eigenvalue"] for v in multivariate.constrained(d, method="cca").collect()] == pytest.approx(want.tolist())


def test_hull_and_tree(spark):
    square = points(spark, [(0, 0), (2, 0), (2, 1), (0, 1), (1, 0.5)])
    assert multivariate.convex_hull(square).first()[0] == 2.0
    assert multivariate.convex_hull(square.limit(2)).first()[0] == 0.0
    d = clustering.distance_matrix(points(spark, [(0,), (1,), (3,), (7,), (7.5,)]))
    assert sum(r["d"] for r in multivariate.spanning_tree(d).collect()) == pytest.approx(7.5)


@pytest.mark.parametrize("method", ["single", "complete", "average", "ward"])
def test_linkage_cuts(spark, method):
    x = [(0,), (0.1,), (5,), (5.1,), (9,)]
    got = clustering.hierarchical_clusters(clustering.distance_matrix(points(spark, x)), 3, method)
    assert [r["label"] for r in got["labels"].orderBy("id").collect()] == [1, 1, 2, 2, 3]
    h = [r["height"] for r in got["linkage"].orderBy("step").collect()]
    assert h == sorted(h)


def test_permutation_tests(spark):
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(size=(10, 2)), rnd.normal(size=(10, 2)) + 5])
    p = points(spark, x)
    d, g = clustering.distance_matrix(p), p.select("id", F.when(F.col("id") < 10, "a").otherwise("b").alias("group"))
    f = hypothesis.permanova(d, g, 99).first()
    a, b = x[:10], x[10:]
    within = ((a - a.mean(0)) ** 2).sum() + ((b - b.mean(0)) ** 2).sum()
    total = ((x - x.mean(0)) ** 2).sum()
    assert f["statistic"] == pytest.approx((total - within) / (within / 18)) and f["p_value"] <= 0.02
    assert hypothesis.anosim(d, g, 99).first()["statistic"] > 0.9
    assert hypothesis.mantel(d, d, 49).first()["statistic"] == pytest.approx(1.0)


def test_null_models_keep_their_margins(spark):
    rows = [(s, t, 1.0) for s in range(5) for t in range(6) if (s * t + s) % 3]
    c = spark.createDataFrame(rows, "sample int, taxon int, abundance double")
    for variant in ("fill", "fixed_fixed"):
        r = ecology.null_model(c, permutations=20, variant=variant).first()
        assert 0 <= r["p"] <= 1 and r["observed"] == pytest.approx(ecology.c_score(c).first()["c_score"])


def test_correspondence_axis(spark):
    rnd = np.random.default_rng(5)
    o = rnd.integers(0, 9, size=(8, 6)).astype(float) + 0.5
    rows = [(i, j, float(o[i, j])) for i in range(8) for j in range(6)]
    c = spark.createDataFrame(rows, "sample int, taxon int, abundance double")
    got = ecology.paleo_environment(c, spark.createDataFrame([(i, float(i)) for i in range(8)], "sample int, height double")).orderBy("sample").collect()
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    u, s, _ = np.linalg.svd((o - e) / np.sqrt(e))
    axis = u[:, 0] * s[0]
    axis = axis if np.corrcoef(axis, range(8))[0, 1] >= 0 else -axis
    assert [r["score"] for r in got] == pytest.approx(axis.tolist()) and got[0]["inertia"] == pytest.approx(s[0] ** 2 / (s**2).sum())


def test_dtw_and_fisher(spark):
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 3, 4])] + [("b", i, float(v)) for i, v in enumerate([1, 1, 2, 3, 4])], "series string, pos int, value double")
    assert ecology.dtw(s, spark.createDataFrame([("a", "b")], "a string, b string")).first()["distance"] == 0.0
    a = ecology.fisher_alpha(20, 100)
    assert a * math.log1p(100 / a) == pytest.approx(20)


def test_series(spark):
    rows = [("s", i, float(i), 2.0 + 3 * i + (0.5 if i % 2 else -0.5)) for i in range(20)]
    s = spark.createDataFrame(rows, "series string, pos int, x double, y double")
    c = stratigraphy.polynomial_trend(s, 2).first()["coefficients"]
    want = np.polyfit(range(20), [r[3] for r in rows], 2)[::-1]
    assert c == pytest.approx(want.tolist())
    x, y = np.arange(20.0), np.array([r[3] for r in rows])
    press = sum((y[i] - np.polyval(np.polyfit(np.delete(x, i), np.delete(y, i), 2), x[i])) ** 2 for i in range(20))
    assert stratigraphy.cross_validate(s, 2).first()["press"] == pytest.approx(press)
    wave = spark.createDataFrame([("w", i, math.sin(2 * math.pi * 5 * i / 50)) for i in range(50)], "series string, pos int, x double")
    assert stratigraphy.periodogram(wave).filter("is_peak").first()["k"] == 5
    ar = stratigraphy.fit_arma(wave, 2).first()
    assert len(ar["phi"]) == 2 and stratigraphy.forecast(stratigraphy.fit_arma(wave, 2), 3).count() == 3
    r = np.array([2.0, 1.0, 0.3])
    assert stratigraphy.levinson(r, 2) == pytest.approx(np.linalg.solve([[2, 1], [1, 2]], [1, 0.3]).tolist())


def test_coniss_zones(spark):
    v = [1, 1.1, 1.2, 8, 8.1, 8.2, 3, 3.1]
    s = spark.createDataFrame([("s", i, [float(x)]) for i, x in enumerate(v)], "series string, pos int, features array<double>")
    assert [r["zone"] for r in stratigraphy.coniss(s, 3).orderBy("pos").collect()] == [1, 1, 1, 2, 2, 2, 3, 3]


def test_cox_and_simulations(spark):
    rows = [(i, float(t), e, [float(x)]) for i, (t, e, x) in enumerate([(5, 1, 0), (6, 1, 1), (7, 0, 0), (8, 1, 1), (9, 1, 0), (10, 0, 1), (3, 1, 1), (2, 1, 1)])]
    r = macroevolution.cox(spark.createDataFrame(rows, "id long, time double, event int, x array<double>")).first()

    def loglik(b):
        return sum(b * x[0] - math.log(sum(math.exp(b * y[0]) for _, u, _, y in rows if u >= t)) for _, t, e, x in rows if e)

    grid = [b / 1000 for b in range(-3000, 3000)]
    assert r["beta"] == pytest.approx(max(grid, key=loglik), abs=2e-3)
    a, b = (macroevolution.simulate_fbd(spark, 0.5, 0.2, 0.1, 4, replicates=5, seed=3).select("lineages", "fossils").collect() for _ in range(2))
    assert a == b


def test_shapes(spark):
    base = np.array([[0, 0], [2, 0], [2, 1], [0, 1.5]])
    rows = []
    for i, a in enumerate((0.0, 0.4, 1.2)):
        q = (base * (i + 1)) @ np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]) + i
        rows.append((i, q.T.ravel().tolist()))
    c = spark.createDataFrame(rows, "specimen long, config array<double>")
    got = morphometrics.gpa(c)
    assert max(r["distance"] for r in got["aligned"].collect()) < 1e-7
    p = spark.createDataFrame([(i, *map(float, s), *map(float, (2 * s[0] + s[1] + 1, s[1]))) for i, s in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)])], "lm int, sx double, sy double, tx double, ty double")
    assert abs(morphometrics.thin_plate_spline(p)["energy"].first()[0]) < 1e-9
    blocks = morphometrics.divide_blocks(c).first()
    assert blocks["block_a"] == rows[0][1][:2] + rows[0][1][4:6]
    t = spark.createDataFrame([("m", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "mesh string, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    assert morphometrics.mesh_area(t).first()["area"] == 0.5


def test_trees(spark):
    t = phylogenetics.parse_newick("((A:1,B:2):1,(C:1.5,D:0.5):1);")
    assert t.newick() == "((A:1,B:2):1,(C:1.5,D:0.5):1);" and t.is_binary() and t.total_length() == 7
    assert t.depths() == {"A": 2, "B": 3, "C": 2.5, "D": 1.5} and t.height() == 3
    assert phylogenetics.Tree.distance(t.find("A"), t.find("D")) == 3.5
    assert t.prune({"B"}).newick() == "(A:1,(C:1.5,D:0.5):1);"
    assert t.prune({"B"}, "sum_lengths").newick() == "(A:2,(C:1.5,D:0.5):1);"
    with pytest.raises(ValueError):
        phylogenetics.parse_newick("((A,B);")
    d = spark.createDataFrame([("A", "B", 3.0), ("A", "C", 4.5), ("A", "D", 3.5), ("B", "C", 5.5), ("B", "D", 4.5), ("C", "D", 2.0)], "i string, j string, d double")
    nj = phylogenetics.neighbor_joining(d)
    assert phylogenetics.Tree.distance(nj.find("A"), nj.find("D")) == pytest.approx(3.5)
    up = phylogenetics.upgma(d)
    assert list(up.depths().values()) == pytest.approx([up.height()] * 4)
    # every four-taxon topology by exhaustion is no shorter than the search's best
    chars = spark.createDataFrame([("A", "AACC"), ("B", "AACT"), ("C", "GGTC"), ("D", "GGTT")], "taxon string, seq string")
    best = min(r["length"] for r in phylogenetics.search_trees(chars, 2).collect())
    seqs = {r["taxon"]: r["seq"] for r in chars.collect()}
    alls = ["((A,B),(C,D));", "((A,C),(B,D));", "((A,D),(B,C));"]
    assert best == min(sum(phylogenetics.fitch_site(phylogenetics.parse_newick(x), {k: v[i] for k, v in seqs.items()}) for i in range(4)) for x in alls)


def test_transforms_with_missing(spark):
    m = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", 3.0), (2, "b", 4.0), (3, "a", None), (3, "b", 0.0)], "row int, variable string, value double")
    with pytest.raises(ValueError):
        transforms.sqrt_transform(m.withColumn("value", F.lit(-1.0)))
    assert [r["value"] for r in transforms.impute_mean(m).orderBy("row", "variable").collect()] == [1.0, 2.0, 3.0, 4.0, 2.0, 0.0]
    assert transforms.boxcox_lambda(m.filter("row = 1")).filter("variable = 'a'").first()["lambda"] == 1.0
    assert transforms.missing_report(m).filter("scope = 'total'").first()["missing"] == 2
    assert tables.validate_distances(spark.createDataFrame([(1, 2, 0.5)], "i int, j int, d double")).first()["square"]


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('Sample,Var1,"Va,r2",Var3\nA,5.1,NA,"1.4"\n\nB,4.9,-,\nC,x, 3.2abc,2e1\n')
    got = [tuple(r)[1:] for r in read_matrix(spark, str(p)).orderBy("row_idx").collect()]
    assert got == [("A", 5.1, None, 1.4), ("B", 4.9, None, None), ("C", None, 3.2, 20.0)]
    out = str(tmp_path / "out")
    write_matrix(read_matrix(spark, str(p)), out, one_file=True)
    assert spark.read.text(out).count() == 4
    t = tmp_path / "x.nwk"
    t.write_text("((A:1,B:2):1,C:3);\n")
    assert read_any(spark, str(t)).filter("is_leaf").count() == 3
    e = tmp_path / "e.csv"
    e.write_text("\n")
    with pytest.raises(ValueError):
        read_matrix(spark, str(e))


def test_empty_communities(spark):
    c = spark.createDataFrame([], "sample int, taxon string, abundance double")
    assert ecology.diversity(c).count() == 0 and ecology.beta_diversity(c).count() == 0 and ecology.rarefaction(c).count() == 0


def test_charts(spark):
    x = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [tuple(r) for r in charts.histogram(x).collect()] == [(0, 1.0, 2.0, 2)]
    assert charts.qq(x).count() == 0


def test_registry(spark):
    @registry.operator("double", version="2")
    def double(df, by=2):
        """Doubles x."""
        return df.select((F.col("x") * by).alias("x"))

    assert registry.names() == ["double"] and registry.get("double").version == "2"
    assert registry.analyze("double", spark.range(1).select(F.lit(3).alias("x")), by=3).first()["x"] == 9
    with pytest.raises(ValueError):
        registry.operator("double")(double)
    registry.remove("double")


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-05 00:00:00", "b")], "ts string, kind string").select(F.to_timestamp("ts").alias("ts"), "kind").write.parquet(src)
    s = spark.readStream.schema("ts timestamp, kind string").parquet(src)
    q = windowed_counts(s, "ts", "kind").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.read.schema("sample timestamp, taxon string, abundance long").parquet(out).collect()
    assert [(r["taxon"], r["abundance"]) for r in rows] == [("a", 2)]


def test_concordance_is_exact(spark):
    rnd = np.random.default_rng(3)
    rows = [(float(t), int(e), float(x)) for t, e, x in zip(rnd.integers(1, 40, 300), rnd.integers(0, 2, 300), np.round(rnd.normal(size=300), 1), strict=True)]
    rows.append((20.0, 1, 1e6))  # stretches the range
    pairs = [(a[2] > b[2]) + 0.5 * (a[2] == b[2]) for a in rows if a[1] for b in rows if b[0] > a[0]]
    got = macroevolution._concordance(spark.createDataFrame(rows, "time double, event int, lp double"))
    assert got == pytest.approx(sum(pairs) / len(pairs), abs=1e-12)


def test_tps_files(spark, tmp_path):
    (tmp_path / "a.tps").write_text("LM=2\n1.5 2\n-3 4e1\nIMAGE=shell LMx.jpg\nID=first\nSCALE=0.5\nLM=1\n7 8\n9 9\n\nLM3=1\r\n1 2 3\r\nID=deep\r\n")
    got = read_any(spark, str(tmp_path / "a.tps")).orderBy("row_idx", "landmark").collect()
    assert [tuple(r[c] for c in ("landmark", "x", "y", "z", "scale")) for r in got] == [(1, 0.75, 1.0, None, 0.5), (2, -1.5, 20.0, None, 0.5), (1, 7.0, 8.0, None, None), (1, 1.0, 2.0, 3.0, None)]
    assert [got[0]["specimen"], got[0]["image"], got[3]["specimen"]] == ["first", "shell LMx.jpg", "deep"]
    raw = read_tps(spark, str(tmp_path / "a.tps"), scaled=False).filter("specimen = 'first' AND landmark = 1").first()
    assert (raw["x"], raw["y"]) == (1.5, 2.0)


def test_nexus_files(spark, tmp_path):
    text = """#NEXUS
[a comment]
BEGIN DATA;
  DIMENSIONS NTAX=2 NCHAR=6;
  FORMAT DATATYPE=STANDARD;
  MATRIX
    'Homo sapiens' 01 0
    Pan   111

    'Homo sapiens' 222
    Pan   33?
  ;
END;
BEGIN TREES;
  TRANSLATE 1 'Homo sapiens', 2 Pan, 3 Gorilla;
  TREE best = [&R] ((1:1,2:1):0.5,3:2);
  TREE other = ((1,3),2);
END;
"""
    (tmp_path / "a.nex").write_text(text)
    assert {r["taxon"]: r["seq"] for r in read_nexus_characters(spark, str(tmp_path / "a.nex")).collect()} == {"Homo sapiens": "010222", "Pan": "11133?"}
    leaves = read_any(spark, str(tmp_path / "a.nex")).filter("is_leaf").orderBy("tree_id", "node_id").collect()
    assert [(r["tree_id"], r["name"]) for r in leaves] == [("best", "Homo sapiens"), ("best", "Pan"), ("best", "Gorilla"), ("other", "Homo sapiens"), ("other", "Gorilla"), ("other", "Pan")]


def test_blank_separated_files(spark, tmp_path):
    (tmp_path / "a.dat").write_text("name  v w\n a 1   NA\n\nb\t-2.5 3\n")
    assert [(r["label"], r["values"]) for r in read_any(spark, str(tmp_path / "a.dat")).orderBy("row_idx").collect()] == [("a", [1.0, None]), ("b", [-2.5, 3.0])]


def test_dendrogram_and_null_histogram(spark):
    t = spark.createDataFrame([(0, 0, 2, 1.0), (1, 1, 3, 4.0)], "step int, left int, right int, height double")
    assert [tuple(r) for r in charts.dendrogram(t).orderBy("step").collect()] == [(0, 1.0, 1.0, 0.0, 0.0, 0.0, 2.0), (1, 4.0, 1.0, 0.0, 1.0, 1.0, 1.0)]
    h = charts.null_histogram(spark.createDataFrame([(float(x),) for x in (0, 1, 1, 5)], "x double"), 10.0, 5).orderBy("bin").collect()
    assert [(r["n"], r["observed"]) for r in h] == [(3, False), (0, False), (1, False), (0, False), (0, True)]
    assert (h[0]["low"], h[4]["high"]) == (0.0, 10.0)


def test_library_registry(spark):
    names = registry.load()
    assert registry.load() == names and {"ecology.diversity", "multivariate.pca", "charts.histogram"} <= set(names)
    df = spark.createDataFrame([(float(x),) for x in range(4)], "x double")
    assert registry.analyze("charts.histogram", df, bins=2).count() == 2


def test_order_statistics_in_pieces(spark):
    rng = np.random.default_rng(5)
    rows = [("wide", float(v)) for v in rng.normal(1e6, 1e-3, 3000)] + [("ties", float(v)) for v in rng.integers(0, 3, 500)]
    rows += [("one", 4.0), ("one", None), ("none", None), ("zero", 0.0), ("zero", -0.0)]
    df = spark.createDataFrame(rows, "group string, x double")
    got = {r["group"]: (r["low"], r["mid"], r["top"]) for r in hypothesis.order_statistic(df, "x", ["group"], {"low": "0", "mid": "floor(n * 0.5)", "top": "n - 1"}).collect()}
    for g in ("wide", "ties", "one", "zero"):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got.pop(g) == (v[0], v[len(v) // 2], v[-1])
    assert not got
    values = sorted(x for _, x in rows if x is not None)
    for r in hypothesis.ranked(df, "x", []).collect():
        assert (r["c"], r["last"], r["n"]) == (values.count(r["x"]), sum(v <= r["x"] for v in values), len(values))
    assert hypothesis.order_statistic(df.limit(0), "x", ["group"], {"mid": "n div 2"}).count() == 0
    assert hypothesis.order_statistic(df.limit(0), "x", [], {"mid": "n div 2"}).first()["mid"] is None


def test_pairs_of_blocks(spark):
    x = np.random.default_rng(6).normal(size=(70, 3))
    left = spark.createDataFrame([(f"s{i:02}", [float(v) for v in r]) for i, r in enumerate(x[:40])], "id string, features array<double>")
    right = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[40:])], "id int, features array<double>")
    got = {(r["i"], r["j"]): r["d"] for r in clustering.cross_distances(left, right, block=7).collect()}
    assert len(got) == 40 * 30
    for (i, j), d in got.items():
        assert d == pytest.approx(np.linalg.norm(x[int(i[1:])] - x[40 + j]))
    assert clustering.cross_distances(left.limit(0), right).count() == 0
    for n in (0, 1, 5, 60):
        df = spark.range(n).select(F.col("id").alias("sample"), (F.col("id") * 10).alias("r"))
        rows = [tuple(r) for r in clustering.all_pairs(df, "sample", "r", block=9).collect()]
        assert sorted(rows) == [(a, b, 10 * a, 10 * b) for a in range(n) for b in range(a + 1, n)]


def test_limits_are_checked_first(spark, monkeypatch):
    d = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 3.0)], "i int, j int, d double")
    assert sorted(tuple(r) for r in multivariate.spanning_tree(d).collect()) == [(1, 2, 1.0), (2, 3, 2.0)]
    monkeypatch.setattr(multivariate, "MAX_NODES", 2)
    with pytest.raises(ValueError):
        multivariate.spanning_tree(d)
    monkeypatch.setattr(stratigraphy, "MAX_STATES", 1)
    with pytest.raises(ValueError):
        stratigraphy.markov(spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "seq_id string, pos int, state string"))
    with pytest.raises(ValueError):
        multivariate.moments(spark.createDataFrame([(None,)], "features array<double>"))


def test_moments_of_groups(spark):
    x = np.random.default_rng(7).normal(size=(50, 4))
    rows = [(f"g{i % 3}", [float(v) for v in r]) for i, r in enumerate(x)] + [("g0", None), ("g1", [1.0, float("nan"), 0.0, 0.0])]
    got = multivariate.moments(spark.createDataFrame(rows, "grp string, features array<double>").repartition(6), by="grp")
    for k in range(3):
        n, s, c = got[f"g{k}"]
        part = x[k::3]
        assert n == len(part) and np.allclose(s, part.sum(0)) and np.allclose(c, part.T @ part)
