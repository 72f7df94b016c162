"""A packed exchange of hashes between groups of documents and buckets of the hash space.

Documents are dealt into groups by their id. A group asks about its distinct hashes: one row for each bucket, holding all
of the group's hashes there as one binary. A bucket puts the rows of all groups side by side, decides, and answers each
group with one row. So a hash that a third of all documents hold is asked about once by each group, whatever the number
of documents; a million hashes travel as a few rows of plain bytes.

All phases read one shuffle of the texts (Spark reuses the equal exchange).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fossilframe.llm.common import hash_text, ranged_scan, text_buffer

#: Hashes that only propose candidates travel as 48 bits: a chance agreement costs work, never a wrong result.
SHORT = np.uint64(2**64 - 2**16)
#: Stands for a null id: after all others.
LAST = 2**63 - 1
PRIME, FACTOR = 2_147_483_647, 48_271
#: Bytes of text in a group, about, where that gives more groups than there are shuffle partitions.
GROUP_BYTES = 8 << 20
PACKED = "b int, g int, keys binary, aux binary"
ANSWER = "g int, keys binary, aux binary"


def parts(df: DataFrame, bytes_: int) -> int:
    """How many groups hold so many bytes: by their number, the session's shuffle partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // GROUP_BYTES))


def sizes(docs: DataFrame) -> int:
    """The number of groups, and of buckets: by the bytes of all texts."""
    return parts(docs, ranged_scan(docs, "text").agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def group_of(id_: Column, groups: int) -> Column:
    return F.pmod(F.pmod(F.pmod(id_, F.lit(PRIME)) * F.lit(FACTOR), F.lit(PRIME)), F.lit(groups)).cast("int")


def grouped(docs: DataFrame, groups: int) -> DataFrame:
    """g, id, text: the documents and the group that each is dealt to."""
    d = ranged_scan(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "text")
    return d.select(group_of(F.col("id"), groups).alias("g"), "id", "text")


def planes(x: np.ndarray) -> bytes:
    """The bytes of 8-byte numbers, all first bytes, then all second ones: small numbers then compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(b: bytes, dtype: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(dtype).ravel()


def numbers(b: bytes, n: int) -> np.ndarray:
    """What `planes` made of the numbers of n keys: one for each, or a row of them for each."""
    x = unplanes(b)
    return x if len(x) in (0, n) else x.reshape(-1, n).T


def pack(g: int, buckets: int, keys: np.ndarray, aux: np.ndarray | None = None) -> pa.Table:
    """Rows for the buckets of one group's sorted distinct keys, with a number (or a row of them) for each if aux is given."""
    b = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    b, keys = b[order], keys[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    starts, ends = np.concatenate([[0], cuts]).astype(np.int64), np.concatenate([cuts, [len(b)]]).astype(np.int64)
    if not len(b):
        starts = ends = np.empty(0, np.int64)
    aux = aux[order] if aux is not None else None
    return pa.table(
        {
            "b": pa.array(b[starts] if len(b) else [], pa.int32()),
            "g": pa.array([g] * len(starts), pa.int32()),
            "keys": pa.array([planes(keys[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary()),
            "aux": pa.array([planes(aux[s:e].T) if aux is not None else b"" for s, e in zip(starts, ends, strict=True)], pa.binary()),
        }
    )


def meet(entries: DataFrame, decide: Callable) -> DataFrame:
    """Answers to the packed rows. decide(keys, row, aux) sees a bucket's sorted keys, the row each came from and its
    number (None if there are none); it returns which entries to answer and the numbers to send along (or None)."""

    def run(t: pa.Table) -> pa.Table:
        keys = [unplanes(x, np.uint64) for x in t.column("keys").to_pylist()]
        aux = [numbers(x, len(k)) for x, k in zip(t.column("aux").to_pylist(), keys, strict=True)]
        gs = t.column("g").to_numpy()
        row = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
        k = np.concatenate(keys)
        a = np.concatenate(aux) if any(len(x) for x in aux) else None
        order = np.argsort(k, kind="stable")
        k, row = k[order], row[order]
        a = a[order] if a is not None else None
        hit, number = decide(k, row, a)
        k, row, number = k[hit], row[hit], number[hit] if number is not None else None
        order = np.argsort(row, kind="stable")
        k, row, number = k[order], row[order], number[order] if number is not None else None
        cuts = np.flatnonzero(np.diff(row)) + 1
        starts = np.concatenate([[0], cuts]).astype(np.int64) if len(row) else np.empty(0, np.int64)
        ends = np.concatenate([cuts, [len(row)]]).astype(np.int64) if len(row) else starts
        return pa.table(
            {
                "g": pa.array(gs[row[starts]] if len(row) else [], pa.int32()),
                "keys": pa.array([planes(k[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary()),
                "aux": pa.array([planes(number[s:e].T) if number is not None else b"" for s, e in zip(starts, ends, strict=True)], pa.binary()),
            }
        )

    return entries.groupBy("b").applyInArrow(run, ANSWER)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the first place of each distinct key, and for each entry the number of its key."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def answers(t: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    """A group's answered keys, sorted, and their numbers."""
    keys = [unplanes(x, np.uint64) for x in t.column("keys").to_pylist()]
    aux = [numbers(x, len(k)) for x, k in zip(t.column("aux").to_pylist(), keys, strict=True) if x]
    k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    order = np.argsort(k)
    return k[order], np.concatenate(aux)[order] if aux else None


def member(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of x is among the sorted keys."""
    if not len(keys) or not len(x):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x


class Words:
    """The documents of one group, by id, as one array of word hashes."""

    def __init__(self, t: pa.Table, lower: bool = False):
        t = t.select(["id", "text"]).sort_by("id").combine_chunks()
        self.ids = t.column("id").to_numpy()
        text = t.column("text")
        self.buffer, self.offsets = text_buffer(text.chunk(0) if text.num_chunks else pa.array([], pa.string()))
        self.h, self.first, self.last = hash_text(self.buffer, self.offsets, lower)
        bounds = np.searchsorted(self.first, self.offsets)
        self.starts, self.ends = bounds[:-1], bounds[1:]
        #: The document, by its place in ids, of each word.
        self.doc = np.repeat(np.arange(len(self.ids)), self.ends - self.starts)

    def joined(self, a: int, b: int) -> bytes:
        """The words from place a up to b, which are of one document, with one space between."""
        return b" ".join(self.buffer[self.first[a] : self.last[b - 1]].tobytes().split()) if b > a else b""

    def place(self, at: np.ndarray) -> np.ndarray:
        """The places of words in their documents."""
        return at - self.starts[self.doc[at]]

    def valid(self, k: int) -> np.ndarray:
        """Places at which k words of one document start."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
