"""Quality rules with risk-controlled thresholds.

A rule rejects documents whose feature lies at its cutoff or beyond; a set of cutoffs rejects what any of its rules does.
Labelled documents (quality 1: good) are the holdout, each stratum (language) by itself. A third of them
proposes a path: cutoffs added one by one, each that which separates best what is left, the share of bad
documents it rejects less COST times that of good ones. So the path's sets are nested and were chosen before the rest of
the labels, all of it, is looked at. On that rest the sets are tested in order: "the rules together reject more than ALPHA
of the good documents" is refuted where the exact (Clopper-Pearson) upper bound of that rate is at most ALPHA, with an
error of DELTA over the number of strata (Bonferroni); the first set that isn't refuted ends the sequence, which needs no
further correction. The last set that passed is used. So with probability 1 - DELTA, in no stratum do the rules together
reject more than ALPHA of good documents. A stratum with too few labels (under ln(error) / ln(1 - ALPHA) good ones in the
rest) certifies nothing and keeps all that the base rules keep.

The features of all documents are computed once and stored; the rest of the labels is reduced in Spark to counts by step.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fossilframe.llm.common import WORD, batches_of, drop_stored, ranged_scan, stored

ALPHA, DELTA, COST = 0.05, 0.05, 10.0
#: Labelled documents of a stratum that propose its path, at most: all of its third do.
TUNE = math.inf
#: Rules: per mille, rejected at the cutoff and above.
RULES = ("symbols", "marks", "dup_lines", "repeats", "long_words", "capitals")
GRID = tuple(range(10, 1001, 10))
SYMBOLS = "#*$%&|<>"
NOT_MARK, NOT_UPPER = re.compile(r"[\w\s]+"), re.compile(r"[^A-Z]+")
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"{r} int" for r in RULES)

NAMES = [x.split()[0] for x in FEATURES.split(", ")]
KINDS = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]] for x in FEATURES.split(", ")]


def features(text: str | None) -> tuple:
    """The columns of FEATURES."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    dup_lines, lines = 0, 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if WORD.search(line):
                lines += 1
                if line in seen:
                    dup_lines += 1
                seen.add(line)
    repeats = 0
    if n > 3:
        ids: dict[str, int] = {}
        w = [ids.setdefault(x, len(ids)) for x in words]
        m = len(ids)
        grams = [(a * m + b) * m + c for a, b, c in zip(w, w[1:], w[2:], strict=False)]
        if len(set(grams)) < len(grams):
            often = Counter(grams)
            last = 0  # words before it are counted
            for i, g in enumerate(grams):
                if often[g] > 1:
                    repeats += i + 3 - max(i, last)
                    last = i + 3
    joined = "".join(words)
    marks = len(NOT_MARK.sub("", joined))
    upper = len(NOT_UPPER.sub("", joined)) if joined.isascii() else sum(map(str.isupper, joined))
    mille = lambda a, b: min(1000, 1000 * a // b) if b else 0
    failed = n < 50 or 100 * repeats > 50 * n
    return n, chars, symbols, dup_lines, repeats, failed, mille(symbols, chars), mille(marks, chars), mille(dup_lines, lines), mille(repeats, n), min(1000, 10 * chars // n) if n else 0, mille(upper, chars)


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the rate at which k or fewer of n have probability `error`, found by bisection on the exact sum."""
    if k >= n:
        return 1.0
    coefficient = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        a, b = math.log(p) if p else -math.inf, math.log1p(-p) if p < 1 else -math.inf
        tail = sum(math.exp(c + (i * a if i else 0.0) + (n - i) * b) for i, c in enumerate(coefficient)) if p < 1 else 0.0
        low, high = (p, high) if tail > error else (low, p)
    return high


def most_failures(n: int, rate: float, error: float) -> int:
    """The largest k with upper_bound(k, n, error) <= rate, or -1: the sum of the binomial's lower tail at `rate`, term by term."""
    total, k = 0.0, -1
    for i in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate))
        if total > error:
            break
        k = i
    return k


def propose(good: np.ndarray, values: np.ndarray, count: np.ndarray | None = None) -> list[tuple[str, int]]:
    """The path: (rule, cutoff) after (rule, cutoff), until none gains. values: a row of features for each document, or for
    each `count` documents alike in the grid's steps.

    Of equal gains the earliest rule's highest cutoff is taken. What each cutoff rejects is summed over the grid's steps.
    """
    path: list[tuple[str, int]] = []
    count = np.ones(len(good)) if count is None else count.astype(float)
    n, m = max(1, int(count[good].sum())), max(1, int(count[~good].sum()))
    step, left = np.minimum(values // GRID[0], len(GRID)), np.ones(len(good), bool)
    while True:
        best, most = None, 1e-12
        for r in range(len(RULES)):
            lost, hit = (np.cumsum(np.bincount(step[of, r], count[of], len(GRID) + 1)[::-1]) for of in (left & good, left & ~good))
            for cutoff, gain in zip(reversed(GRID), (hit / m - COST * lost / n).tolist(), strict=False):
                if gain > most + 1e-12:
                    best, most = (r, cutoff), gain
        if best is None:
            return path
        path.append((RULES[best[0]], best[1]))
        left &= values[:, best[0]] < best[1]


def certified(lost: dict[int, int], steps: int, n: int, alpha: float, error: float) -> int:
    """How many steps of a path may be taken. lost: good documents by the step that rejects them first; n: all good ones."""
    allowed, total = most_failures(n, alpha, error) if n else -1, 0
    for k in range(steps):
        total += lost.get(k, 0)
        if total > allowed:
            return k
    return steps


def feature_table(docs: DataFrame, stratum: str | None = "lang") -> DataFrame:
    """doc_id, stratum and FEATURES of every document, stored. A null stratum is one of its own."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 4 << 20):
            got = list(zip(*map(features, b.column(2).to_pylist()), strict=True)) or [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(got, KINDS, strict=True)]], ["doc_id", "stratum", *NAMES])

    d = ranged_scan(docs, "doc_id", *([stratum] if stratum else []), "text")
    d = d.select("doc_id", (F.col(stratum).cast("string") if stratum else F.lit("")).alias("stratum"), "text")
    return stored(d.mapInArrow(run, "doc_id long, stratum string, " + FEATURES))


def cutoffs(table: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the certified cutoffs, stored; strata and rules without one are absent.

    A document labelled more than once counts once, as good if any of its labels says so. Documents that fail the base
    rules are not part of the holdout: they go anyway.
    """
    said = ranged_scan(labels, "doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality IS NOT NULL")
    held = table.filter("NOT base_failed").join(said, "doc_id").select("doc_id", "stratum", (F.col("quality") == 1).alias("good"), *RULES)
    sizes = stored(held.groupBy("stratum").agg(F.count("*").alias("labels")).withColumnRenamed("stratum", "s"))
    strata = max(1, sizes.count())
    tuned = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.least(F.lit(1 / 3), F.lit(float(TUNE)) / F.col("labels")) * (1 << 30)
    held = held.join(sizes, F.col("stratum").eqNullSafe(F.col("s"))).withColumn("tunes", tuned)

    def path(key: tuple, t: pa.Table) -> pa.Table:
        steps = propose(t.column("good").to_numpy(), np.stack([t.column(r).to_numpy() for r in RULES], 1), t.column("n").to_numpy())
        return pa.table({"s": pa.array([key[0].as_py()] * len(steps), pa.string()), "step": pa.array(range(len(steps)), pa.int32()), "rule": pa.array([r for r, _ in steps], pa.string()), "cutoff": pa.array([c for _, c in steps], pa.int32())})

    cells = held.filter("tunes").groupBy("stratum", "good", *[(F.col(r) - F.col(r) % GRID[0]).alias(r) for r in RULES]).agg(F.count("*").alias("n"))
    paths = stored(cells.groupBy("stratum").applyInArrow(path, "s string, step int, rule string, cutoff int"))
    listed = paths.groupBy("s").agg(F.collect_list(F.struct("step", "rule", "cutoff")).alias("path")).withColumnRenamed("s", "of")
    value = "CASE " + " ".join(f"WHEN x.rule = '{r}' THEN {r}" for r in RULES) + " END"
    rest = held.filter("NOT tunes AND good").join(listed, F.col("stratum").eqNullSafe(F.col("of")))
    rest = rest.select("stratum", F.expr(f"array_min(transform(filter(path, x -> {value} >= x.cutoff), x -> x.step))").alias("first"), F.expr("size(path)").alias("steps"))
    counts = rest.groupBy("stratum", "steps", "first").agg(F.count("*").alias("n"))

    def test(key: tuple, t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        taken = certified({r["first"]: r["n"] for r in rows}, rows[0]["steps"], sum(r["n"] for r in rows), alpha, delta / strata)
        return pa.table({"stratum": pa.array([key[0].as_py()], pa.string()), "taken": pa.array([taken], pa.int32())})

    taken = stored(counts.groupBy("stratum").applyInArrow(test, "stratum string, taken int"))
    out = taken.join(paths, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("step") < F.col("taken"))).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    out = stored(out)
    drop_stored(sizes, paths, taken)
    return out


def judge(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    Null or empty text has no words and fails the base rules. Without labels the base rules alone decide. Repeated rows
    stay repeated, each judged by itself.
    """
    t = feature_table(docs, stratum)
    c = cutoffs(t, labels, alpha, delta).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    c = c.select(F.col("stratum").alias("s"), *[F.col(r).alias(f"cut_{r}") for r in RULES])
    d = t.join(c, F.col("stratum").eqNullSafe(F.col("s")), "left")
    by = F.filter(F.array(*[F.when(F.col(r) >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size(by) == 0)).alias("kept"), by.alias("rejected_by"))
