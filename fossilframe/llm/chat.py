"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role become one block (their texts
aggregated into an array); the blocks are concatenated:

    <|role|>\\n text <|turn|> text ... <|end|>\\n

Inside texts and roles `&`, `<`, `[` (and `>` in roles) are written as entities, so that no control string, of this or
another common template, can stand in a text; the escape is undone on reading. A block keeps the seams of the turns that
it merges, so reading gives every turn back. The loss mask covers the assistants' texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END, TURN = "<|end|>\n", "<|turn|>"


def escape(c: Column, role: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), *([(">", "&gt;")] if role else [])):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("&gt;", ">"), ("&#91;", "["), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted: one row for each conversation of (conv_id, turn, role, text).

    Null role or text is taken as empty, a null turn sorts first, equal turns by role and text; repeated rows are
    repeated turns; rows with null conv_id are one conversation. The row of a conversation holds all its turns, however
    many: that is the result asked for.
    """
    t = rows.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    t = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # 1-based places at which a block of one role starts, and one past the end
    t = t.withColumn("starts", F.expr("filter(sequence(1, size(turns)), i -> i = 1 OR turns[i - 1].role <> turns[i - 2].role)"))
    t = t.withColumn("blocks", F.expr("transform(starts, (s, k) -> struct(turns[s - 1].role AS role, transform(slice(turns, s, coalesce(get(starts, k + 1), size(turns) + 1) - s), t -> t.text) AS texts))"))
    block = lambda b: F.concat(F.lit("<|"), escape(b["role"], True), F.lit("|>\n"), F.array_join(F.transform(b["texts"], lambda x: escape(x)), TURN), F.lit(END))
    return t.select("conv_id", F.array_join(F.transform("blocks", block), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds blocks array<struct<role, texts>>, read from the formatted text."""
    pieces = F.split("formatted", r"<\|end\|>\n")
    body = lambda x: F.split(F.substr(x, F.instr(x, "|>\n") + F.lit(3)), r"<\|turn\|>")
    block = lambda x: F.struct(unescape(F.substr(x, F.lit(3), F.instr(x, "|>\n") - F.lit(3))).alias("role"), F.transform(body(x), lambda t: unescape(t)).alias("texts"))
    return formatted.withColumn("pieces", pieces).withColumn("blocks", F.transform(F.slice("pieces", F.lit(1), F.size("pieces") - 1), block)).drop("pieces")


def digest_conversations(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text."""
    d = read_back(format_conversations(rows))
    turns = F.array_join(F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n"))))), "")
    loss = F.array_join(F.flatten(F.transform(F.filter("blocks", lambda b: b["role"] == "assistant"), lambda b: b["texts"])), "")
    d = d.withColumn("loss", loss)
    return d.select(
        "conv_id",
        F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.size(b["texts"])).alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_control_case(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows and conversation -1: a user and an assistant, both saying control strings of another template."""
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(added)


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS x,
    replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '>', '&gt;') AS r,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS merged
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(x) + CASE WHEN merged THEN 8 ELSE 13 + length(r) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
