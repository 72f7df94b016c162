"""Sharding by a minimax contiguous partition.

Documents of equal text are one atomic group; groups are ordered by the md5 of their text. The smallest capacity is
searched by bisection such that cutting greedily in that order needs at most the given number of shards; the cuts of
that greedy pass are the shards' bounds. So sizes in bytes are as near equal as an ordered cut of whole groups allows.

The sizes are summed in Spark by hash prefix, an *atom* being all groups under one prefix. Only atoms that a cut could
fall into are opened, level by level, so the driver holds a bounded number of sums, never the groups. A group too
large for a shard stays whole and sets the capacity.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fossilframe.llm.common import ranged_scan, stored

#: Hex digits of the hash by which an atom is opened: at most 16 ** LEVEL atoms for each one opened.
LEVEL = 3


class Atom:
    __slots__ = ("prefix", "size", "single")

    def __init__(self, prefix: str, size: int, single: bool):
        self.prefix, self.size, self.single = prefix, size, single


def _greedy(atoms: list[Atom], capacity: int, shards: int, split: bool) -> list[int] | None:
    """Ends of the shards on the line of sizes; None if more shards are needed. split: atoms that aren't one group may be cut anywhere."""
    ends, start, at = [], 0, 0
    for a in atoms:
        if at + a.size - start > capacity:
            if a.size > capacity and (a.single or not split):
                return None
            if split and not a.single:
                while at + a.size - start > capacity:
                    start += capacity
                    ends.append(start)
                    if len(ends) >= shards:
                        return None
            else:
                ends.append(at)
                start = at
                if len(ends) >= shards:
                    return None
        at += a.size
    return [*ends, *[at] * (shards - len(ends))]


def _least(atoms: list[Atom], shards: int, split: bool) -> int:
    total = sum(a.size for a in atoms)
    low, high = max(1, -(-total // shards)), max(1, total)
    while low < high:
        mid = (low + high) // 2
        if _greedy(atoms, mid, shards, split) is None:
            low = mid + 1
        else:
            high = mid
    return low


def cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Of groups (key hex string, size long): the first key of shards 1, 2, ..., and the capacity. Fewer cuts if shards stay empty."""

    def opened(prefix_length: int, parents: list[str]) -> list[Atom]:
        rows = groups.filter(F.substring("key", 1, prefix_length - LEVEL).isin(parents)) if parents else groups
        rows = rows.groupBy(F.substring("key", 1, prefix_length).alias("p")).agg(F.sum("size").alias("s"), F.min("key").alias("a"), F.max("key").alias("b"))
        return sorted((Atom(r["a"] if r["a"] == r["b"] else r["p"], r["s"], r["a"] == r["b"]) for r in rows.collect()), key=lambda a: a.prefix)

    atoms = opened(LEVEL, [])
    while True:
        low, high = _least(atoms, shards, True), _least(atoms, shards, False)
        near, far = _earliest(atoms, low, shards), _greedy(atoms, high, shards, True)
        at, todo = 0, []
        for a in atoms:
            if not a.single and any(x < at + a.size and y > at for x, y in zip(near[:-1], far[:-1], strict=True)):
                todo.append(a)
            at += a.size
        if not todo:
            break
        # Atoms with a large group in them blur the bounds: they alone are opened first.
        todo = [a for a in todo if a.size > 4 * at >> 4 * LEVEL] or todo
        known = {a.prefix for a in todo}
        atoms = [a for a in atoms if a.prefix not in known]
        for depth in {len(x) for x in known}:
            atoms += opened(depth + LEVEL, [x for x in known if len(x) == depth])
        atoms.sort(key=lambda a: a.prefix)
    capacity = _least(atoms, shards, False)
    firsts, start, at = [], 0, 0
    for a in atoms:
        if at + a.size - start > capacity:
            firsts.append(a.prefix)
            start = at
        at += a.size
    return firsts, capacity


def _earliest(atoms: list[Atom], capacity: int, shards: int) -> list[int]:
    """Lower bounds of the greedy ends at this capacity or more: each shard takes whole atoms only, perhaps none."""
    ends, at, bounds = [], 0, [0]
    for a in atoms:
        at += a.size
        bounds.append(at)
    start = 0
    for _ in range(shards):
        start = bounds[bisect.bisect_right(bounds, start + capacity) - 1] if start + capacity < at else at
        ends.append(start)
    return ends


def text_size(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 1


def shard_documents(docs: DataFrame, shards: int = 8, salt: int = 512) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Null text counts as empty (size 1, CRC 0) and is of one group with empty texts. Repeated rows are separate rows of
    one group. With fewer groups than shards the last shards stay empty. grown_shard is null: the law is `bytes`.
    Slots count from 0 in each shard without a gap: rows are numbered within `salt` parts of the shard, in order of
    doc_id, behind the rows of the parts before; so no task numbers a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = stored(ranged_scan(docs, "doc_id", "text").select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key")))
    firsts, _ = cuts(stored(d.groupBy("key").agg(F.sum("size").alias("size"))), shards)
    shard = sum((F.when(F.col("key") >= f, 1).otherwise(0) for f in firsts), F.lit(0)).cast("int")
    d = d.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(salt)).cast("int").alias("part"))
    counts = d.groupBy("shard", "part").agg(F.count("*").alias("n"))  # at most shards * salt rows
    before = counts.selectExpr("shard", "part", "sum(n) OVER (PARTITION BY shard ORDER BY part) - n AS before")
    d = d.selectExpr("*", "row_number() OVER (PARTITION BY shard, part ORDER BY doc_id, text_crc32) - 1 AS k").join(F.broadcast(before), ["shard", "part"])
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
