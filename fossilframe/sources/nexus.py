"""Landmark files (TPS) and Nexus files, split by Spark's reader at the formats' own separators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fossilframe.operators.phylogenetics import read_trees


def _field(name: str) -> Column:
    """The value of a line NAME=value of a specimen, null without one."""
    found = F.regexp_extract("value", rf"(?im)^\s*{name}\s*=[ \t]*([^\r\n]*)", 1)
    return F.when(F.trim(found) != "", F.trim(found))


def read_tps(spark: SparkSession, path: str, scaled: bool = True) -> DataFrame:
    """row_idx, specimen, image, scale, landmark (from 1), x, y, z of a file whose specimens begin with LM=n or LM3=n.

    row_idx grows in the order of the file; a specimen without ID is named by it. Coordinates are multiplied by SCALE
    unless scaled is false. z is null in two dimensions; lines that are no numbers, and those after the n-th, are left out.
    Specimens are the reader's records, so a file of any number of them is split over tasks.
    """
    records = spark.read.option("lineSep", "\nLM").text(path).where(F.col("value").rlike(r"^\s*(LM)?3?\s*=\s*\d"))
    d = records.select(
        F.monotonically_increasing_id().alias("row_idx"),
        _field("ID").alias("id"),
        _field("IMAGE").alias("image"),
        _field("SCALE").try_cast("double").alias("scale"),
        F.regexp_extract("value", r"^\s*(?:LM)?3?\s*=\s*(\d+)", 1).cast("int").alias("n"),
        F.expr(r"filter(slice(split(value, '\r?\n'), 2, size(split(value, '\r?\n'))), l -> l RLIKE '^\\s*[-+.0-9][-+.0-9eE]*\\s+[-+.0-9]')").alias("lines"),
    )
    d = d.select("row_idx", F.coalesce("id", F.col("row_idx").cast("string")).alias("specimen"), "image", "scale", F.posexplode(F.expr("slice(lines, 1, n)")).alias("pos", "line"))
    part = F.split(F.trim("line"), r"\s+")
    by = F.coalesce("scale", F.lit(1.0)) if scaled else F.lit(1.0)
    axes = [(F.get(part, i).try_cast("double") * by).alias(c) for i, c in enumerate("xyz")]
    return d.select("row_idx", "specimen", "image", "scale", (F.col("pos") + 1).alias("landmark"), *axes)


def _commands(spark: SparkSession, path: str) -> DataFrame:
    """at, command: the commands of a Nexus file, without comments. A comment can't hold a semicolon."""
    raw = spark.read.option("lineSep", ";").text(path)
    text = F.trim(F.regexp_replace("value", r"(?s)\[[^\]]*\]|^\s*#NEXUS", ""))
    return raw.select(F.monotonically_increasing_id().alias("at"), F.regexp_replace(text, r"^\s+", "").alias("command"))


def read_nexus_trees(spark: SparkSession, path: str) -> DataFrame:
    """The node table (as of `read_trees`) of the TREE commands, tree_id the tree's name; TRANSLATE renames the nodes."""
    c = _commands(spark, path)
    tree = r"(?is)^U?TREE\s+\*?\s*('[^']*'|[^\s=]+)\s*=\s*(.*)$"
    trees = c.where(F.col("command").rlike(tree)).select(F.trim(F.regexp_replace(F.regexp_extract("command", tree, 1), "'", "")).alias("tree_id"), F.concat(F.regexp_extract("command", tree, 2), F.lit(";")).alias("newick"))
    pairs = c.where(F.col("command").rlike(r"(?i)^TRANSLATE\s")).select(F.explode(F.split(F.regexp_replace("command", r"(?i)^TRANSLATE\s+", ""), ",")).alias("p"))
    pair = F.split(F.trim(F.regexp_replace("p", r"\s+", " ")), " ", 2)
    names = pairs.select(pair[0].alias("name"), F.trim(F.regexp_replace(F.get(pair, 1), "'", "")).alias("full")).where("full IS NOT NULL").dropDuplicates(["name"])
    nodes = read_trees(trees)
    return nodes.join(names, "name", "left").withColumn("name", F.coalesce("full", "name")).select(*nodes.columns)


def read_nexus_characters(spark: SparkSession, path: str) -> DataFrame:
    """taxon, seq of the MATRIX commands; the pieces of an interleaved matrix are joined in the file's order."""
    m = _commands(spark, path).where(F.col("command").rlike(r"(?i)^MATRIX\s"))
    lines = m.select("at", F.posexplode(F.split(F.regexp_replace("command", r"(?i)^MATRIX\s+", ""), r"\r?\n")).alias("pos", "line"))
    row = r"^\s*('[^']*'|\S+)\s+(\S.*?)\s*$"
    part = lines.where(F.col("line").rlike(row)).select("at", "pos", F.regexp_replace(F.regexp_extract("line", row, 1), "'", "").alias("taxon"), F.regexp_replace(F.regexp_extract("line", row, 2), r"\s+", "").alias("piece"))
    pieces = F.array_sort(F.collect_list(F.struct("at", "pos", "piece")))
    return part.groupBy("taxon").agg(F.array_join(F.transform(pieces, lambda s: s["piece"]), "").alias("seq"))
