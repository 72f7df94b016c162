"""The pipeline against plain versions of its stages, each on its own input."""

import random
import re

import pytest

import corpus_pipeline
from fossilframe.llm.common import stored
from fossilframe.llm.queries import tokenizer_path

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD, LEAK = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import sentencepiece

    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns = d.columns
    states = [d]
    for _, stage in corpus_pipeline.STAGES:
        states.append(stored(stage(spark, states[-1], SF)))
    texts = [{r["doc_id"]: r for r in s.collect()} for s in states]
    assert all(s.columns == columns for s in states[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "encoding"]

    # language: all of these are prose of a known language
    assert set(texts[1]) == {i for i, r in texts[0].items() if re.search(r"[^\W\d_]", r["text"])}

    # near duplicates: the smallest id of each component stays
    sets = {}
    for i, r in texts[1].items():
        w = WORD.findall(r["text"].translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert set(texts[2]) == {i for i in ids if root(i) == i}

    # decontamination: hit words are gone, documents without a hit are untouched
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = LEAK.findall(r["text"].translate(LOW))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    for i, r in texts[2].items():
        w = LEAK.findall(r["text"].translate(LOW))
        hit = set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if 2 * len(hit) > len(w):
            assert i not in texts[3]
        elif hit:
            assert LEAK.findall(texts[3][i]["text"].translate(LOW)) == [x for k, x in enumerate(w) if k not in hit]
        else:
            assert texts[3][i]["text"] == r["text"]
        if i in texts[3]:
            assert texts[3][i]["n_chars"] == len(texts[3][i]["text"])

    # personal data: no address is left, documents without digits or @ are untouched
    assert set(texts[4]) == set(texts[3])
    for i, r in texts[4].items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r["text"])
        if not re.search("[0-9@]", texts[3][i]["text"]):
            assert r["text"] == texts[3][i]["text"]

    # encoding: as the library does
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    for i, r in texts[5].items():
        assert list(r["ids"]) == lib.encode(texts[4][i]["text"], add_eos=True) and r["decoded"] == lib.decode(list(r["ids"]))
    run = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {i: list(r["ids"]) for i, r in texts[5].items()}


def test_hot_copies(spark):
    """A third of the rows copies of one text, a third near copies of another: one of each stays."""
    from fossilframe.llm.jaccard import keep_one
    from fossilframe.llm.passages import digest_removed

    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(120)) for _ in range(2)]
    rows = [(i, base[0]) for i in range(100)]
    for i in range(100, 200):
        w = base[1].split()
        w[rnd.randrange(120)] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(rnd.choice(words) for _ in range(120))) for i in range(200, 300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = sorted(r["doc_id"] for r in keep_one(d, 5, 80, 100).collect())
    assert kept == [0, 100, *range(200, 300)]
    removed = {r["doc_id"]: r["n_removed"] for r in digest_removed(d).collect()}
    assert all(removed[i] == 120 for i in range(1, 100)) and removed[0] == 0 and all(removed[i] == 0 for i in range(200, 300))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_documents(spark, name):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, d, SF).collect() == []
