"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fossilframe.llm import chat, sql
from fossilframe.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fossilframe.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fossilframe.llm.jaccard import duplicate_components

    return duplicate_components(table(spark, sf_dir, "documents"), 4, 85, 100)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fossilframe.llm.shards import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 8)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest_conversations(spark, chat.with_control_case(spark, table(spark, sf_dir, "conversations")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fossilframe.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fossilframe.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fossilframe.llm.language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fossilframe.llm.private import find_private

    return find_private(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fossilframe.llm.passages import digest_removed

    return digest_removed(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fossilframe.llm.pieces import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_sharding": op3_sharding,
    "op4_language_id": op4_language_id,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_decontamination": op6_decontamination,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_pii": op8_pii,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sentencepiece": op10_sentencepiece,
}

SQL: dict[str, str] = {
    "op2_jaccard_join": sql.JACCARD,
    "op5_chat_formatting": chat.SQL,
    "op6_decontamination": sql.DECONTAMINATION,
    "op9_substring_dedup": sql.PASSAGES,
}
