"""Delimited text as matrices, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The cells that mean a missing number; the wider list is an option.
MISSING = ("NA", "NaN", "-", "", "nan", "null")
MISSING_WIDE = (*MISSING, "N/A", "n/a", ".")
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def number(c, missing=MISSING):
    """A cell as a double: null for missing cells, else the number that the text starts with, else null."""
    t = F.trim(c)
    found = F.regexp_extract(t, NUMBER, 1)
    return F.when(~t.isin(*missing) & (found != ""), found.try_cast("double"))


def read_matrix(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, row_labels: bool = True, missing=MISSING) -> DataFrame:
    """row_idx, label, and a double column for each variable; short rows are padded with nulls, blank lines dropped.

    The width is that of the header, or without one of the widest line.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if not lines.take(1):
        raise ValueError("empty text")
    bare = F.regexp_replace("value", '"[^"]*"', "")  # delimiters inside quotes don't count
    width = lines.agg(F.max(F.size(F.split(bare, _literal(delimiter), -1)))).first()[0]
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.schema(schema).csv(path, sep=delimiter, header=False, mode="PERMISSIVE", quote='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="\u0000", emptyValue="")
    d = raw.withColumn("row_idx", F.monotonically_increasing_id())
    first = 1 if row_labels else 0
    names = [f"Var_{i + 1}" for i in range(width - first)]
    if header:
        top = d.orderBy("row_idx").first()
        names = [(top[f"_c{i + first}"] or f"Var_{i + 1}").strip() for i in range(width - first)]
        d = d.where(F.col("row_idx") > top["row_idx"])
    label = F.trim(F.col("_c0")) if row_labels else F.concat(F.lit("Sample_"), (F.col("row_idx") + (0 if header else 1)).cast("string"))
    return d.select("row_idx", label.alias("label"), *[number(F.coalesce(F.col(f"_c{i + first}"), F.lit("")), missing).alias(n) for i, n in enumerate(names)])


def read_blank_separated(spark: SparkSession, path: str, missing=MISSING) -> DataFrame:
    """row_idx, label, values array<double>: a label and numbers a line, with blanks or tabs between; blank lines dropped.

    A line whose second cell is neither a number nor missing (a header) is dropped too.
    """
    part = F.split(F.trim("value"), r"\s+")
    d = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("row_idx"), part.alias("c"))
    d = d.where(F.get("c", 1).isNull() | F.get("c", 1).rlike(NUMBER) | F.get("c", 1).isin(*missing))
    return d.select("row_idx", F.col("c")[0].alias("label"), F.transform(F.expr("slice(c, 2, size(c) - 1)"), lambda x: number(x, missing)).alias("values"))


def _literal(delimiter: str) -> str:
    return "\\Q" + delimiter + "\\E"


def write_matrix(df: DataFrame, path: str, delimiter: str = ",", label: str = "label", one_file: bool = False) -> None:
    """Header with a blank first name; missing cells as NA. one_file gathers small results into a single file."""
    cols = [c for c in df.columns if c not in (label, "row_idx")]
    out = df.orderBy("row_idx") if "row_idx" in df.columns else df
    out = out.select(F.col(label).alias(" "), *[F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) for c in cols])
    (out.coalesce(1) if one_file else out).write.csv(path, sep=delimiter, header=True, nullValue="NA")


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """By suffix: .csv and .txt, .tsv, .nwk and .tree (one tree a line), .nex (its trees), .tps, .dat (columns apart by
    blanks), .parquet."""
    from fossilframe.operators.phylogenetics import read_trees
    from fossilframe.sources.nexus import read_nexus_trees, read_tps

    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "txt"):
        return read_matrix(spark, path, **options)
    if suffix in ("tsv", "tab"):
        return read_matrix(spark, path, delimiter="\t", **options)
    if suffix in ("nwk", "newick", "tree", "tre"):
        lines = spark.read.text(path).where(F.trim("value") != "")
        return read_trees(lines.select(F.monotonically_increasing_id().cast("string").alias("tree_id"), F.col("value").alias("newick")))
    if suffix in ("nex", "nexus"):
        return read_nexus_trees(spark, path)
    if suffix == "tps":
        return read_tps(spark, path, **options)
    if suffix == "dat":
        return read_blank_separated(spark, path, **options)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown type {suffix}")
