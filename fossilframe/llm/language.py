"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to ORDER, counted on a bounded sample of labelled documents and then
frozen. A byte is coded in the longest context of the tree; where that context hasn't seen it, an escape (method C: as
probable as the context has distinct successors) leads to the next shorter one, at last to 256 equal bytes. The language
whose tree gives the whole text the shortest code is the prediction.

With frozen statistics the code length of a byte depends on the run of ORDER + 1 bytes that it ends alone. Each language
keeps its whole tree as sorted arrays (`Tree`), so that neither the number of languages nor the bytes they use take
contexts from one another. A block of texts is scored by its distinct runs: their code lengths are worked out once a
language, then summed over the texts' places.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fossilframe.llm.common import batches_of, ranged_scan, release

ORDER = 3
#: Sampled labelled documents for each language, at most about.
SAMPLE = 1500
#: Bytes of text that are scored together, about.
BLOCK = 2 << 20
LETTER = re.compile(r"[^\W\d_]")
START = b"\n"


def text_bytes(text: str) -> bytes:
    return START + text.lower().encode("utf-8", "replace")


def coded(b: bytes, order: int) -> np.ndarray:
    """Runs of order + 1 bytes as numbers, the first byte highest."""
    x = np.frombuffer(b, np.uint8).astype(np.uint64)
    n = max(0, len(x) - order)
    code = np.zeros(n, np.uint64)
    for d in range(order + 1):
        code = (code << np.uint64(8)) | x[d : d + n]
    return code


def low(order: int) -> np.uint64:
    return np.uint64((1 << 8 * order) - 1)


class Tree:
    """One language's tree: for each order the runs seen with their bits, and the contexts with the bits of their escape."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int):
        """codes: distinct runs of order + 1 bytes as numbers; counts: how often each occurs."""
        self.levels = []
        for k in range(order, -1, -1):
            runs, at = np.unique(codes & low(k + 1), return_inverse=True)
            n = np.bincount(at, counts, len(runs))
            contexts, at, distinct = np.unique(runs >> np.uint64(8), return_inverse=True, return_counts=True)
            whole = np.bincount(at, n, len(contexts)) + distinct
            self.levels.append((k, runs, np.log2(whole[at] / n), contexts, np.log2(whole / distinct)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for k, runs, cost, contexts, escape in self.levels:
            for keys, values, wanted in ((runs, cost, codes[open_] & low(k + 1)), (contexts, escape, None)):
                if wanted is None:
                    wanted = (codes[open_] & low(k + 1)) >> np.uint64(8)
                at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
                out[open_[hit]] += values[at[hit]]
                if keys is runs:
                    open_ = open_[~hit]
        out[open_] += 8
        return out


class Model:
    """Frozen trees of all languages."""

    def __init__(self, counts: dict[str, dict[bytes, int] | tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """counts: for each language, how often each run of order + 1 bytes occurs: by run, or runs as numbers and counts."""
        self.languages = sorted(counts)
        self.order = order
        self.trees = []
        for x in self.languages:
            c = counts[x]
            if isinstance(c, dict):
                c = np.array([int.from_bytes(g, "big") for g in c], np.uint64), np.array(list(c.values()), np.int64)
            self.trees.append(Tree(*c, order))

    @staticmethod
    def _tree(grams: dict[bytes, int], order: int) -> dict[bytes, dict[int, int]]:
        tree: dict[bytes, dict[int, int]] = {}
        for g, m in grams.items():
            for k in range(len(g)):
                nxt = tree.setdefault(g[k:-1], {})
                nxt[g[-1]] = nxt.get(g[-1], 0) + m
        return tree

    def all_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits that each language's tree needs for each text."""
        out = np.zeros((len(texts), len(self.languages)))
        codes, owners, size = [], [], 0
        for i, t in enumerate(texts):
            # the bytes before a text are its start mark
            b = START * (self.order - 1) + text_bytes(t) if self.order else text_bytes(t)[1:]
            for begin in range(0, max(1, len(b) - self.order), BLOCK):  # bounded memory for very long texts
                c = coded(b[begin : begin + BLOCK + self.order], self.order)
                if len(c):
                    codes.append(c)
                    owners.append(i)
                    size += len(c)
                if size >= BLOCK:
                    self._add(out, codes, owners)
                    codes, owners, size = [], [], 0
        self._add(out, codes, owners)
        return out

    def _add(self, out: np.ndarray, codes: list[np.ndarray], owners: list[int]) -> None:
        if not codes:
            return
        all_ = np.concatenate(codes)
        distinct = np.unique(all_)
        at = np.searchsorted(distinct, all_)
        starts = np.cumsum([0, *map(len, codes[:-1])])
        for j, tree in enumerate(self.trees):
            np.add.at(out[:, j], owners, np.add.reduceat(tree.bits(distinct)[at], starts))

    def lengths(self, text: str) -> np.ndarray:
        """Bits that each language's tree needs for the text."""
        return self.all_lengths([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its posterior probability under equal priors; `und` and 0 without a letter or without languages."""
        got: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and self.languages and LETTER.search(t)]
        if some:
            bits = self.all_lengths([texts[i] for i in some])
            best = bits.argmin(1)
            score = 1 / np.exp2(np.clip(bits.min(1)[:, None] - bits, -1000, 0)).sum(1)
            for i, k, p in zip(some, best.tolist(), score.tolist(), strict=True):
                got[i] = (self.languages[k], p)
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def gram_counts(texts: Iterator[str], order: int = ORDER) -> dict[bytes, int]:
    """Runs of order + 1 bytes, the text's start padded with its start mark."""
    total: dict[bytes, int] = {}
    for t in texts:
        b = START * (order - 1) + text_bytes(t)
        code = coded(b, order)
        for c, m in zip(*(v.tolist() for v in np.unique(code, return_counts=True)), strict=True):
            total[c] = total.get(c, 0) + m
    return {c.to_bytes(order + 1, "big"): m for c, m in total.items()}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> Model:
    """A model from about `sample` documents of each language (all, where there are fewer) that are not held out and have a label.

    Every language that labels a document which is not held out is learned. The sample is that part of the ids' hash range that holds as many documents; it depends on ids alone.
    """
    d = ranged_scan(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    if not counts:
        return Model({}, order)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limits = d.sparkSession.createDataFrame([(k, int(min(1.0, sample / n) * (1 << 30))) for k, n in counts.items()], "lang string, most long")
    d = d.join(F.broadcast(limits), "lang")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[bytes, int]] = {}
        for b in batches_of(it, BLOCK):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = total.setdefault(lang, {})
                for g, m in gram_counts([text], order).items():
                    mine[g] = mine.get(g, 0) + m
        for lang, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t)), pa.array([int.from_bytes(g, "big") for g in t], pa.int64()), pa.array(list(t.values()), pa.int64())], ["lang", "gram", "n"])

    rows = d.filter((part < F.col("most")) & F.col("text").isNotNull()).select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    t = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").toArrow().combine_chunks()
    lang, gram, n = t.column("lang").to_pandas().to_numpy(), t.column("gram").to_numpy().astype(np.uint64), t.column("n").to_numpy()
    cuts = [0, *(np.flatnonzero(lang[1:] != lang[:-1]) + 1).tolist(), len(lang)] if len(lang) else [0]
    return Model({lang[s]: (gram[s:e], n[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)}, order)


def identify(docs: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, with the columns named in `keep`.

    Null text, or text without a letter, is `und` with score 0. Without any label every text is `und`. Repeated rows
    stay repeated. The model grows with the number of languages alone (a bounded sample of each) and is broadcast.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = list(dict.fromkeys(["doc_id", "text", *keep]))
    d = ranged_scan(docs, *cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + ", lang_pred string, score double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches_of(it, BLOCK):
            got = m.predict_all(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*cols, "lang_pred", "score"])

    d = d.mapInArrow(run, schema)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", *[c for c in keep if c != "doc_id"])


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known with at least this probability, with docs' columns unchanged."""
    if not docs.columns:
        return docs
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches_of(it, BLOCK):
            got = m.predict_all(b.column(at).to_pylist())
            yield b.filter(pa.array([g[0] != "und" and g[1] >= least for g in got], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
