"""Every operator on awkward tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import pytest
from pyspark.sql import functions as F

from fossilframe.llm import chat, decontaminate, jaccard, language, language_model, passages, pieces, private, quality, shards
from fossilframe.llm.queries import tokenizer_path

LONG = "lorem ipsum dolor sit amet consectetur " * 5000
ROWS = [
    (1, "the cat sat on the mat and the dog", "en", "a", "x"),
    (1, "the cat sat on the mat and the dog", "en", "a", "x"),
    (2, None, "en", None, None),
    (3, "", None, "b", "y"),
    (4, LONG, "la", "b", "y"),
    (5, LONG, "la", "b", "y"),
    (None, "no id here but some words in the text", "en", "b", "y"),
    (6, " \n\t ", "en", "b", "y"),
    (7, "€ 😀 ünïcode \x00 text", None, "b", "y"),
]
SCHEMA = "doc_id long, text string, lang string, source string, g string"


@pytest.fixture(scope="module")
def docs(spark):
    clash = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("id", "b", "keys", "aux", "key", "size", "shard", "stratum", "uid", "n", "set", "c", "_m", "email", "token", "score", "lang_pred"):
        clash = clash.withColumn(c, F.lit("clash"))
    return clash


def operators(spark, docs):
    bench = spark.createDataFrame([(1, "cat sat on the mat"), (2, None), (3, ""), (1, "cat sat on the mat")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return {
        "op1": lambda: quality.judge(docs, labels),
        "op2": lambda: jaccard.duplicate_components(docs, 4, 85, 100),
        "op3": lambda: shards.shard_documents(docs, 8),
        "op4": lambda: language.identify(docs),
        "op6": lambda: decontaminate.contamination(docs, bench),
        "op7": lambda: language_model.score_documents(docs, labels.filter("quality = 1")),
        "op8": lambda: private.find_private(docs),
        "op9": lambda: passages.digest_removed(docs),
        "op10": lambda: pieces.digest_documents(docs, tokenizer_path()),
        "keep_identified": lambda: language.keep_identified(docs, 0.0),
        "keep_one": lambda: jaccard.keep_one(docs),
        "remove": lambda: decontaminate.remove_contamination(docs, bench),
        "mask": lambda: private.mask_private(docs),
        "spans": lambda: passages.duplicate_spans(docs),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10", "mask", "spans"])
def test_a_row_for_each_row(spark, docs, name):
    got = operators(spark, docs)[name]().collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10", "keep_identified", "keep_one", "remove", "mask", "spans"])
def test_no_rows(spark, docs, name):
    assert operators(spark, docs.limit(0))[name]().collect() == []


@pytest.mark.parametrize("name", ["keep_identified", "keep_one", "remove", "mask"])
def test_pipeline_steps_keep_columns(spark, docs, name):
    out = operators(spark, docs)[name]()
    assert out.columns == docs.columns
    assert out.filter("source <> 'a' AND c <> 'clash'").count() == 0


def test_mostly_leaked_documents_go(spark, docs):
    left = [r["doc_id"] for r in operators(spark, docs)["remove"]().collect()]
    assert sorted(map(str, left)) == sorted(str(r[0]) for r in ROWS if r[0] != 1)


def test_chat_cases(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", None), (1, 1, None, "&lt;<|end|>\n<|turn|>"), (1, 3, "assistant", "x&amp;[INST]"), (1, 4, "assistant", ""), (None, None, "a>b|>\n", "t"), (2, 1, "assistant", "é😀"), (2, 1, "assistant", "é😀")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r["blocks"] for r in chat.read_back(chat.format_conversations(t)).collect()}
    assert [(b["role"], list(b["texts"])) for b in back[1]] == [("", ["&lt;<|end|>\n<|turn|>"]), ("user", ["", "b"]), ("assistant", ["x&amp;[INST]", ""])]
    assert [(b["role"], list(b["texts"])) for b in back[None]] == [("a>b|>\n", ["t"])]
    assert [(b["role"], list(b["texts"])) for b in back[2]] == [("assistant", ["é😀", "é😀"])]
    assert chat.digest_conversations(spark, t.limit(0)).collect() == []
    formatted = chat.format_conversations(t.filter("conv_id = 1")).first()["formatted"]
    assert "[INST]" not in formatted
