"""Cross-entropy difference of a target and a background n-gram model.

Both models are word bigram models of one form over one vocabulary, the distinct lower-cased words of all documents. Words
and bigrams are counted each under its own 64-bit key, so what is counted grows with the corpus: the background over every
document, the target over those labelled good and not toxic. The background's counts are scaled to the target's number of
tokens, so that smoothing weighs on both alike (matched models).

    p(w | v) = (c(v, w) + MU p(w)) / (c(v) + MU),   p(w) = (c(w) + 1) / (N + V)

V is the number of distinct words, VOCABULARY at least (what a smaller vocabulary leaves is for words not seen).
A document's score is the mean over its tokens of the target's loss less the background's, in bits; low is target-like.

No process holds a model. Documents are dealt into groups; a group sends each of its distinct keys once, with its counts,
to the bucket of the key. A bucket adds up and answers each group with the sums of the keys that it sent, in their order,
and with its own part of N and V; as each group asks every bucket, a group knows both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fossilframe.llm.common import _mix, ranged_scan, word_arrays
from fossilframe.llm.exchange import planes, sizes, unplanes

#: The least vocabulary, and the id of a document's start as a history (words have negative ids).
VOCABULARY, MU = 1 << 16, 16.0
SENT = "b int, g int, keys binary, every binary, mine binary"
SUMS = "b int, g int, every binary, mine binary, words long, n_every long, n_mine long"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of all texts (negative), the id before each (VOCABULARY at a start), and the texts' offsets."""
    h, offsets = word_arrays(texts, True)
    ids = ~(h >> np.uint64(1)).astype(np.int64)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    before[starts] = VOCABULARY
    return ids, before, offsets


def word_keys(ids: np.ndarray) -> np.ndarray:
    """Odd numbers for words, so that a bucket can tell them from the rest."""
    return _mix(ids.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def cells(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """An even key for each bigram, 63 bits of a hash of both ids."""
    return _mix(_mix(before.view(np.uint64)) + ids.view(np.uint64) * np.uint64(0xD1B54A32D192ED03)) & ~np.uint64(1)


#: The key that counts documents with words.
BEGIN = np.uint64(0)


def group_of(doc_id: Column, otherwise: Column, groups: int) -> Column:
    return F.pmod(F.when(doc_id.isNotNull(), F.xxhash64(doc_id.cast("long"))).otherwise(F.xxhash64(otherwise)), F.lit(groups)).cast("int")


def summed(d: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """b, g, every, mine: for each group and bucket, in the order of the group's keys there, the corpus's counts of them."""

    def ask(key: tuple, docs: pa.Table, of: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({f: pa.array([], t) for f, t in zip(("b", "g", "keys", "every", "mine"), (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)})
        good = set(of.column("doc_id").to_pylist())
        ids, before, offsets = tokens(docs.column("text").to_pylist())
        asked = np.concatenate([word_keys(ids), cells(before, ids), np.full(np.count_nonzero(before == VOCABULARY), BEGIN)])
        mine = np.repeat([i in good for i in docs.column("doc_id").to_pylist()], np.diff(offsets))
        some, n = np.unique(asked[np.concatenate([mine, mine, mine[before == VOCABULARY]])], return_counts=True)
        keys, every = np.unique(asked, return_counts=True)
        mine = np.zeros(len(keys), np.int64)
        mine[np.searchsorted(keys, some)] = n
        # buckets are ranges of keys, so a group's slices are in order; each is asked, for its part of the totals
        ends = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(1, buckets, dtype=np.uint64))
        cols = [pa.array([planes(x) for x in np.split(x, ends)], pa.binary()) for x in (keys, every.astype(np.int64), mine)]
        return pa.table([pa.array(range(buckets), pa.int32()), pa.array([key[0].as_py()] * buckets, pa.int32()), *cols], ["b", "g", "keys", "every", "mine"])

    def add(t: pa.Table) -> pa.Table:
        keys = [unplanes(x.as_py(), np.uint64) for x in t.column("keys")]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        k = np.concatenate(keys)
        del keys
        words = k % np.uint64(2) == 1
        order = np.argsort(k)
        k = k[order]
        first = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        at = np.empty(len(k), np.int64)
        at[order] = np.cumsum(first) - 1
        sums, totals = [], [np.count_nonzero(k[first] % np.uint64(2))]
        for column in ("every", "mine"):
            c = np.concatenate([unplanes(x.as_py()) for x in t.column(column)])
            totals.append(c[words].sum())
            total = np.add.reduceat(c[order], np.flatnonzero(first))[at] if len(k) else c
            sums.append(pa.array([planes(x) for x in np.split(total, ends)], pa.binary()))
        return pa.table([t.column("b"), t.column("g"), *sums, *[pa.array([x] * t.num_rows, pa.int64()) for x in totals]], ["b", "g", "every", "mine", "words", "n_every", "n_mine"])

    asked = d.groupBy("g").cogroup(target.groupBy("g")).applyInArrow(ask, SENT)
    return asked.groupBy("b").applyInArrow(add, SUMS)


def score_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference of every document.

    Null or wordless texts have no tokens and null losses. Repeated rows count and are scored each. Without target
    documents both models are uniform and every difference is 0. target may list an id more than once.
    """
    groups = buckets = sizes(docs)
    target = target.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    d = ranged_scan(docs, "doc_id", "text").select(group_of(F.col("doc_id"), F.col("text"), groups).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sums = summed(d, target.select(group_of(F.col("doc_id"), F.col("doc_id"), groups).alias("g"), "doc_id"), buckets)

    def run(key: tuple, docs: pa.Table, answer: pa.Table) -> pa.Table:
        ids, before, offsets = tokens(docs.column("text").to_pylist())
        some = np.diff(offsets) > 0
        start = before == VOCABULARY
        keys, at = np.unique(np.concatenate([word_keys(ids), cells(before, ids), np.full(min(1, len(ids)), BEGIN)]), return_inverse=True)
        word, cell = at[: len(ids)], at[len(ids) : 2 * len(ids)]
        history = np.empty_like(word)
        history[1:] = word[:-1]
        history[start] = at[-1:]
        answer = answer.sort_by("b")
        vocabulary, n, m = (sum(answer.column(c).to_pylist()) for c in ("words", "n_mine", "n_every"))
        vocabulary, scale = max(VOCABULARY, vocabulary), n / m if m else 0.0
        loss = []
        for column, s in (("mine", 1.0), ("every", scale)):
            mean = np.full(len(some), np.nan)
            if len(ids):
                c = np.concatenate([unplanes(x) for x in answer.column(column).to_pylist()]) * s
                if len(c) != len(keys):
                    raise RuntimeError(f"{len(c)} sums for {len(keys)} keys")
                p = (c[word] + 1) / (n + vocabulary)
                bits = -np.log2((c[cell] + MU * p) / (c[history] + MU))
                mean[some] = np.add.reduceat(bits, offsets[:-1][some]) / np.diff(offsets)[some]
            loss.append(mean)
        cols = [pa.array(x, pa.float64(), mask=~some) for x in (*loss, loss[0] - loss[1])]
        return pa.table([docs.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), *cols], ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    return d.groupBy("g").cogroup(sums.groupBy("g")).applyInArrow(run, SCORES)
