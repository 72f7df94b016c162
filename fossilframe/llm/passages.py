"""Removal of passages that an earlier document has, by a relative Lempel-Ziv parse.

A document is factored against reference blocks, the groups of `exchange`, whose windows of WINDOW words are indexed by
hash. The index knows where a window starts first: the place in the document with the smallest id. At a word whose window
starts in a document with a smaller id, a factor (source document, place in it, length) begins. It takes that source, and
goes on word by word as long as the index names the next place of the same source; a word that starts no such window is a
literal. At a factor's end the parse goes on with the window that starts there, or else with the last window that
starts inside the factor and reaches beyond it: such a window is a part of no factor, and its words past the end are the
next factor, shorter than a window. So every word that a repeated window covers is in a factor, no other word is, and
factors don't overlap. The source is the earliest, not the one with the longest match of all: that needs every source of
every window in one place, as many as there are copies.

The index is dealt by hash, in two steps:
1. Each window has an anchor, the smallest hash of its runs of ANCHOR words; equal windows have equal anchors. A block
   asks which of its distinct anchors (about one for five windows) any other block holds.
2. For windows at such anchors alone, it asks for the first place in another block.
Windows of documents in one block are compared there. Hashes stand for words: 64 bits of a window within a block, and 32
bits of a second hash besides between blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fossilframe.llm.common import gram_hashes, mixed
from fossilframe.llm.exchange import LAST, PACKED, SHORT, Words, answers, grouped, meet, member, pack, runs, sizes

WINDOW, ANCHOR = 13, 5
#: A place and 32 bits of the second hash share a number.
PLACE = np.int64(2**32 - 1)


def anchors(h: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each run of `window` words the smallest hash, cut short, of its runs of `anchor` words."""
    g = gram_hashes(h, anchor, 1)
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = g[:n].copy()
    for j in range(1, window - anchor + 1):
        np.minimum(out, g[j : j + n], out=out)
    return out & SHORT


def parse(found: np.ndarray, source: np.ndarray, place: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """The factors of a block's words, rows of first word, length, source, place in it.

    For each word: whether its window has an earlier source, that source and place, and the document the word is in.
    """
    at = np.flatnonzero(found)
    if not len(at):
        return np.empty((0, 4), np.int64)
    go = (np.diff(at) == 1) & (np.diff(doc[at]) == 0) & (source[at[1:]] == source[at[:-1]]) & (np.diff(place[at]) == 1)
    first, last = at[np.concatenate([[True], ~go])], at[np.concatenate([~go, [True]])]
    begins, ends = first.tolist(), (last + window).tolist()  # runs of windows in step with one source, and where they reach
    out, e, k, n = [], 0, 0, len(begins)
    while True:
        while k + 1 < n and begins[k + 1] <= e:
            k += 1
        if begins[k] <= e < ends[k]:  # the last window up to e reaches beyond it
            out.append((e, ends[k], k))
            e = ends[k]
        elif begins[k] > e:
            e = begins[k]
        elif k + 1 < n:
            e = begins[k + 1]
        else:
            break
    b, e, k = np.array(out, np.int64).T
    return np.stack([b, e - b, source[first[k]], place[first[k]] + b - first[k]], axis=1)


def earliest(keys: np.ndarray, row: np.ndarray, aux: np.ndarray) -> tuple:
    """For a bucket's sorted windows, whether another block has each in a smaller document, and its first place: of
    entries (document, second hash and place) only those with the same second hash are the same window."""
    order = np.lexsort((aux[:, 0], aux[:, 1] >> 32, keys))
    k, second, ids = keys[order], aux[order, 1] >> 32, aux[order, 0]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (second[1:] != second[:-1])])
    first = order[new][np.cumsum(new) - 1]  # the smallest document of the same window
    hit, where = np.empty(len(keys), bool), np.empty((len(keys), 2), np.int64)
    hit[order] = ids > aux[first, 0]
    where[order] = np.stack([aux[first, 0], aux[first, 1] & PLACE], axis=1)
    return hit, where


def _repeated(docs: DataFrame, window: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """The grouped documents, and for windows of each group that start in a smaller document of another one, where first."""
    buckets = sizes(docs)
    d = grouped(docs, buckets)

    def ask_anchors(key: tuple, t: pa.Table) -> pa.Table:
        w = Words(t)
        a = anchors(w.h, window, anchor)[w.valid(window)]
        return pack(key[0].as_py(), buckets, np.unique(a))

    def elsewhere(keys: np.ndarray, row: np.ndarray, aux: None) -> tuple:
        first, number = runs(keys)
        return np.diff(np.append(first, len(keys)))[number] > 1, None

    def ask_windows(key: tuple, t: pa.Table, known: pa.Table) -> pa.Table:
        shared, _ = answers(known)
        if not t.num_rows or not len(shared):
            return pack(0, buckets, np.empty(0, np.uint64))
        w = Words(t)
        at = w.valid(window)
        at = at[member(anchors(w.h, window, anchor)[at], shared)]
        g = gram_hashes(w.h, window)[at]
        order = np.argsort(g, kind="stable")  # the first of a key is in the smallest document
        first, _ = runs(g[order])
        keys, at = g[order][first], at[order[first]]
        second = gram_hashes(mixed(w.h), window)[at].view(np.int64) & ~PLACE
        return pack(key[0].as_py(), buckets, keys, np.stack([w.ids[w.doc[at]], second | w.place(at)], axis=1))

    known = meet(d.groupBy("g").applyInArrow(ask_anchors, PACKED), elsewhere)
    asked = d.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(ask_windows, PACKED)
    return d, meet(asked, earliest)


def _sources(w: Words, known: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the group's words whether its window starts in a smaller document, in which first, and where there."""
    found, source, place = np.zeros(len(w.h), bool), np.zeros(len(w.h), np.int64), np.zeros(len(w.h), np.int64)
    at = w.valid(window)
    g = gram_hashes(w.h, window)[at]
    order = np.argsort(g, kind="stable")
    first, number = runs(g[order])
    if not len(g):
        return found, source, place
    here, there = at[order], at[order[first]][number]
    source[here], place[here] = w.ids[w.doc[there]], w.place(there)
    found[here] = w.ids[w.doc[here]] > source[here]
    keys, where = answers(known)
    if len(keys):
        k = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        hit = keys[k] == g
        at, k = at[hit], k[hit]
        found[at], source[at], place[at] = True, where[k, 0], where[k, 1]
    return found, source, place


def _parsed(docs: DataFrame, window: int, anchor: int, make, schema: str) -> DataFrame:
    """make(words, ids, factors), of a group's Words, builds the rows of a group; ids has the null ids back as None, and
    factors has the rows of `parse` for each document, first words counted within it."""
    d, known = _repeated(docs, window, anchor)

    def run(key: tuple, t: pa.Table, k: pa.Table) -> pa.Table:
        if not t.num_rows:
            return make(None, [], [])
        w = Words(t)
        f = parse(*_sources(w, k, window), w.doc, window)
        cuts = np.searchsorted(f[:, 0], w.starts[1:])
        f[:, 0] = w.place(f[:, 0])
        return make(w, [None if i == LAST else i for i in w.ids.tolist()], np.split(f, cuts))

    return d.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(run, schema)


def spans(factors: np.ndarray) -> list[tuple[int, int]]:
    """Factors of a document that touch, merged: (first word, last word + 1)."""
    if not len(factors):
        return []
    first, end = factors[:, 0], factors[:, 0] + factors[:, 1]
    apart = first[1:] != end[:-1]
    return list(zip(first[np.concatenate([[True], apart])].tolist(), end[np.concatenate([apart, [True]])].tolist(), strict=True))


def kept_words(w: Words, i: int, cut: list[tuple[int, int]]) -> bytes:
    """The words of the group's document i that no span covers, with one space between."""
    out, last, begin = [], int(w.starts[i]), int(w.starts[i])
    for a, b in [*cut, (int(w.ends[i]) - begin, 0)]:
        if begin + a > last:
            out.append(w.joined(last, begin + a))
        last = begin + b
    return b" ".join(out)


def duplicate_factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, factors array<struct<first, length, source_id, source_first>>: the factors of every document in order.

    The words from `first` on, `length` of them, are the words from `source_first` on of the document source_id, which has
    a smaller id. Where two rows have that id, it is one of them.
    """

    def make(w: Words | None, ids: list, factors: list) -> pa.Table:
        of = np.concatenate(factors) if len(factors) else np.empty((0, 4), np.int64)
        names = ["first", "length", "source_id", "source_first"]
        flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in of.T], names)
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in factors])]).astype(np.int32)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "factors": pa.ListArray.from_arrays(pa.array(offsets), flat)})

    return _parsed(docs, window, anchor, make, "doc_id long, factors array<struct<first:long,length:long,source_id:long,source_first:long>>")


def duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, spans array<struct<first, last>>: the duplicate spans of every document, in words, `last` exclusive."""

    def make(w: Words | None, ids: list, factors: list) -> pa.Table:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "spans": pa.array([[{"first": a, "last": b} for a, b in spans(f)] for f in factors], kind)})

    return _parsed(docs, window, anchor, make, "doc_id long, spans array<struct<first:int,last:int>>")


def digest_removed(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    Null text has no words; a text of fewer words than a window loses nothing. Rows with the same id don't remove each
    other's words; each is cut by smaller ids. A null id counts as larger than all others.
    """

    def make(w: Words | None, ids: list, factors: list) -> pa.Table:
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_words": pa.array(w.ends - w.starts if w else [], pa.int64()),
                "n_removed": pa.array([int(f[:, 1].sum()) for f in factors], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(kept_words(w, i, spans(f))).hexdigest() for i, f in enumerate(factors)], pa.string()),
            }
        )

    return _parsed(docs, window, anchor, make, "doc_id long, n_words long, n_removed long, kept_sha256 string")
