"""Operations on whole tables: projection, selection, transposition, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transpose(m: DataFrame) -> DataFrame:
    """Rows and variables of a long matrix change places."""
    return m.select(F.col("variable").alias("row"), F.col("row").cast("string").alias("variable"), "value")


def subset(df: DataFrame, rows: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows with these row_idx, the columns by name; both exactly as listed."""
    d = df.where(F.col("row_idx").isin(rows)) if rows is not None else df
    return d.select("row_idx", *columns) if columns is not None else d


def filter_labels(df: DataFrame, label: str, text: str) -> DataFrame:
    return df.where(F.contains(F.lower(label), F.lit(text.lower())))


def sort_column(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Missing counts as the largest; equal values stay in order of row_idx."""
    key = F.desc_nulls_first(column) if descending else F.asc_nulls_last(column)
    return df.orderBy(key, "row_idx")


def validate(df: DataFrame) -> DataFrame:
    """rows, columns, missing, valid of the numeric columns."""
    cols = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]
    bad = sum((F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in cols), F.lit(0))
    return df.agg(F.count("*").alias("rows"), F.lit(len(cols)).alias("columns"), bad.alias("missing")).withColumn("valid", (F.col("rows") > 0) & (F.col("missing") == 0))


def validate_distances(distances: DataFrame) -> DataFrame:
    """objects, pairs, square: whether every pair of the objects has one non-negative distance."""
    n = distances.select(F.col("i").alias("x")).union(distances.select("j")).distinct().agg(F.count("*").alias("objects"))
    p = distances.agg(F.count("*").alias("pairs"), F.count_if((F.col("d") < 0) | F.col("d").isNull() | F.isnan("d")).alias("bad"))
    return n.crossJoin(p).select("objects", "pairs", ((F.col("pairs") == F.col("objects") * (F.col("objects") - 1) / 2) & (F.col("bad") == 0)).alias("square"))


def selection_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean and sample sd over all cells of the columns that aren't missing."""
    d = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    return d.agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
