"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, encoding.

Each stage takes the documents that the one before kept and returns them with all their columns; the last returns the
encoded documents. Between stages the documents are written as Parquet to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fossilframe.llm.common import drop_stored, stored, table
from fossilframe.llm.decontaminate import remove_contamination
from fossilframe.llm.jaccard import keep_one
from fossilframe.llm.language import keep_identified
from fossilframe.llm.pieces import encode_documents
from fossilframe.llm.private import mask_private
from fossilframe.llm.queries import tokenizer_path


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars as of the text that is left."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no one language, go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 over five-word shingles, the one with the smallest id stays."""
    return keep_one(docs, 5, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten words of a benchmark item are cut out; documents that are mostly such passages go."""
    return _measured(remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _measured(mask_private(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded: the ids of the text and the end id, and the text read back from them."""
    return encode_documents(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: Suffix automata, iterated pattern scores and byte-pair merges have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
