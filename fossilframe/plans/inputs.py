"""The test tables in the shapes that the operators take, as DataFrames and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fossilframe.operators.phylogenetics import Tree, parse_newick


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


COMMUNITY = """community AS (
  SELECT c_nationkey AS sample, p_brand AS taxon, CAST(sum(l_quantity) AS DOUBLE) AS abundance
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
  {where} GROUP BY c_nationkey, p_brand)"""
DENSE = COMMUNITY.format(where="")
SPARSE_WHERE = "l_returnflag = 'R' AND l_quantity = 50"
SPARSE = COMMUNITY.format(where=f"WHERE {SPARSE_WHERE}").replace("sum(l_quantity)", "count(*)")

COUNTED = DENSE.replace("sum(l_quantity)", "count(*)")


def community(spark: SparkSession, sf: str, sparse: bool = False) -> DataFrame:
    """sample (nation), taxon (brand), abundance: quantities sold, or for the sparse one the number of large returns."""
    li = table(spark, sf, "lineitem")
    li = li.where(SPARSE_WHERE) if sparse else li
    d = li.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return d.groupBy(F.col("c_nationkey").alias("sample"), F.col("p_brand").alias("taxon")).agg((F.count("*") if sparse else F.sum("l_quantity")).cast("double").alias("abundance"))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """sample (nation), taxon (brand), abundance: the number of sales, over all of lineitem."""
    li = table(spark, sf, "lineitem")
    d = li.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return d.groupBy(F.col("c_nationkey").alias("sample"), F.col("p_brand").alias("taxon")).agg(F.count("*").cast("double").alias("abundance"))


SPECIMENS = "specimens AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def specimens(spark: SparkSession, sf: str) -> DataFrame:
    """id, group, features array<double>."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("group"), F.col("embedding").cast("array<double>").alias("features"))


def few(spark: SparkSession, sf: str) -> DataFrame:
    """One mean vector for each label: ten objects."""
    s = specimens(spark, sf).select("group", F.posexplode("features").alias("k", "v")).groupBy("group", "k").agg(F.avg("v").alias("v"))
    return s.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("features")).withColumnRenamed("group", "id")


PRICES = "prices AS (SELECT l_returnflag AS grp, CAST(l_extendedprice AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS q FROM lineitem)"


def prices(spark: SparkSession, sf: str, column: str = "l_extendedprice") -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("group"), F.col(column).cast("double").alias("x"))


DAILY = """daily AS (
  SELECT event_type AS series, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS pos, avg(value) AS y
  FROM events GROUP BY 1, 2), series AS (SELECT series, pos, CAST(pos AS DOUBLE) AS x, y FROM daily)"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    """series (type of event), pos (day), x (day), y (mean value of the day)."""
    d = table(spark, sf, "events").select(F.col("event_type").alias("series"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("pos"), "value")
    return d.groupBy("series", "pos").agg(F.avg("value").alias("y")).select("series", "pos", F.col("pos").cast("double").alias("x"), "y")


def values(spark: SparkSession, sf: str) -> DataFrame:
    """series, pos, x: the daily means as the values."""
    return series(spark, sf).select("series", "pos", F.col("y").alias("x"))


ANGLES = "angles AS (SELECT (extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts))) * 360.0 / 86400 AS a FROM events)"


def angles(spark: SparkSession, sf: str) -> DataFrame:
    s = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf, "events").select((s * F.lit(360.0) / 86400).alias("angle_deg"))


STATES = "states AS (SELECT user_id AS seq_id, ts AS pos, event_type AS state FROM events)"


def states(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("seq_id"), F.col("ts").alias("pos"), F.col("event_type").alias("state"))


RANGES = """ranges AS (
  SELECT o_custkey AS taxon, CAST(min(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) AS DOUBLE) AS first,
    CAST(max(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) AS DOUBLE) AS last FROM orders GROUP BY o_custkey),
intervals AS (SELECT CAST(i * 365 AS DOUBLE) AS t_start, CAST((i + 1) * 365 AS DOUBLE) AS t_end FROM range(0, 7) t(i))"""


def days(c: str):
    return F.datediff(F.to_date(c), F.lit("1995-01-01").cast("date")).cast("double")


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("taxon")).agg(F.min(days("o_orderdate")).alias("first"), F.max(days("o_orderdate")).alias("last"))


def intervals(spark: SparkSession) -> DataFrame:
    return spark.range(7).select((F.col("id") * 365).cast("double").alias("t_start"), ((F.col("id") + 1) * 365).cast("double").alias("t_end"))


SURVIVAL = """survival AS (
  SELECT o_orderkey AS id, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS time,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event, CAST(o_custkey % 2 AS INT) AS grp FROM orders)"""


def survival(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    x = F.array((F.col("o_totalprice") / 100000).cast("double"), (F.col("o_custkey") % 3).cast("double"))
    return o.select(F.col("o_orderkey").alias("id"), days("o_orderdate").alias("time"), (F.col("o_orderstatus") == "F").cast("int").alias("event"), (F.col("o_custkey") % 2).cast("int").alias("group"), x.alias("x"))


GROWTH = """monthly AS (
  SELECT (extract(year FROM o_orderdate) - 1990) * 12 + extract(month FROM o_orderdate) AS t, count(*) AS n FROM orders GROUP BY 1),
growth AS (SELECT CAST(t AS DOUBLE) AS t, CAST(sum(n) OVER (ORDER BY t) AS DOUBLE) AS v FROM monthly)"""


def growth(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    m = table(spark, sf, "orders").groupBy(((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).alias("t")).agg(F.count("*").alias("n"))
    return m.select(F.col("t").cast("double").alias("t"), F.sum("n").over(Window.orderBy("t")).cast("double").alias("v"))  # one row a month


def configurations(spark: SparkSession, sf: str) -> DataFrame:
    """specimen, config: 32 landmarks, blocked."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("specimen"), F.col("embedding").cast("array<double>").alias("config"))


LADS = """lads AS (
  SELECT CAST(row_number() OVER (ORDER BY lad DESC, brand) AS INT) AS rank, lad FROM (
    SELECT p_brand AS brand, CAST(max(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))) AS DOUBLE) AS lad
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand))"""


def lads(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(F.max(days("l_shipdate")).alias("lad"))
    return d.select(F.row_number().over(Window.orderBy(F.desc("lad"), "brand")).alias("rank"), "lad")  # one row a brand


EVENTS = """sections AS (
  SELECT r_name AS section, p_type AS event, CAST(min(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))) AS DOUBLE) AS fad,
    CAST(max(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))) AS DOUBLE) AS lad
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE l_quantity >= 49 AND l_returnflag = 'R' AND l_discount >= 0.08 GROUP BY 1, 2)"""


def sections(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    d = t("lineitem").where("l_quantity >= 49 AND l_returnflag = 'R' AND l_discount >= 0.08").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.groupBy(F.col("r_name").alias("section"), F.col("p_type").alias("event")).agg(F.min(days("l_shipdate")).alias("fad"), F.max(days("l_shipdate")).alias("lad"))


TREE = "((A:1,B:2):1,(C:1.5,D:0.5):1);"
TRAITS = {"A": 1.0, "B": 3.0, "C": 6.0, "D": 8.0}
GROUPS = {"A": "x", "B": "x", "C": "y", "D": "y"}


def tree() -> Tree:
    return parse_newick(TREE)


def characters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A", "AAC"), ("B", "AGC"), ("C", "GGC"), ("D", "GGT")], "taxon string, seq string")


def long_matrix(spark: SparkSession, sf: str, holes: bool = False) -> DataFrame:
    """row, variable, value: the community as a matrix; with holes, every eleventh cell by nation and brand is missing."""
    m = community(spark, sf).select(F.col("sample").alias("row"), F.col("taxon").alias("variable"), F.col("abundance").alias("value"))
    gone = (F.col("row") * 7 + F.replace("variable", F.lit("Brand#"), F.lit("")).cast("int")) % 11 == 0
    return m.withColumn("value", F.when(~gone, F.col("value"))) if holes else m


MATRIX = DENSE + ", m AS (SELECT sample AS \"row\", taxon AS variable, abundance AS value FROM community)"
HOLES = DENSE + ", m AS (SELECT sample AS \"row\", taxon AS variable, CASE WHEN (sample * 7 + CAST(replace(taxon, 'Brand#', '') AS INT)) % 11 = 0 THEN NULL ELSE abundance END AS value FROM community)"
