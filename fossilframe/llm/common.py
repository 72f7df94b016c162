"""What the corpus operators share: column handling, stored intermediate tables, word hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

with contextlib.suppress(OSError, AttributeError):
    # Arrays of a megabyte and more go back to the system once freed (glibc would keep up to 32 MB blocks, and a worker
    # that waits for the next stage holds on to them).
    ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)



def release() -> None:
    """Gives memory that a worker has freed back to the system: workers outlive their tasks, and those of the stages to come
    share an executor's memory with what these leave."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Words of most contracts: runs of anything but space and the ASCII controls from tab to carriage return.
WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower_ascii(text: str) -> str:
    """text with A-Z, and nothing else, lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. A session that names none gets a local one if it runs on this machine
    alone (as tests do); on a cluster that would lose rows, so it is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file:///tmp/fossilframe-checkpoints"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/fossilframe-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Deletes the files of tables that `stored` gave and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranged_scan(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name neither clash nor get read."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def batches_of(it: Iterable[pa.RecordBatch], max_bytes: int = 48 << 20) -> Iterator[pa.RecordBatch]:
    """Small enough slices of each batch for bounded memory in a worker."""
    for b in it:
        n = max(1, -(-b.nbytes // max_bytes))
        step = max(1, -(-b.num_rows // n))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed(h: np.ndarray) -> np.ndarray:
    """Word hashes for a second hash of the same runs of words."""
    return _mix(h ^ np.uint64(0x94D049BB133111EB))


class _Powers:
    """Powers of an odd number modulo 2^64 and their inverses, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b))])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _GRAMS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PLAIN = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]
#: Bytes of text that are hashed together, about.
_CHUNK = 1 << 18
#: Runs of words that are hashed together.
_RUN = 1 << 17


def _cuts(buffer: np.ndarray, begin: np.ndarray) -> list[int]:
    """Places that cut the buffer into chunks without cutting a word: document starts or spaces."""
    out, at, n = [0], 0, len(buffer)
    while n - at > _CHUNK:
        at += _CHUNK
        k = int(np.searchsorted(begin, at))
        after = int(begin[k]) if k < len(begin) else n
        step = 4096
        while at < after:  # the next space, unless a document starts before it
            hit = np.flatnonzero(_SPACE[buffer[at : min(after, at + step)]])
            if len(hit):
                after = at + int(hit[0])
                break
            at = min(after, at + step)
            step *= 2
        at = after
        if at < n:
            out.append(at)
    return [*out, n]


def hash_text(buffer: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words in texts that lie one after another in a buffer of UTF-8: 64-bit hashes, first bytes, ends.

    Words are those of WORD; its separators are single bytes that occur in no other character. A word's hash is the sum
    of random numbers of its bytes times powers of an odd base, mixed with its length: one running sum serves all words.
    """
    begin = np.unique(offsets)
    table = _FOLDED if lower else _PLAIN
    hashes, starts, ends = [], [], []
    cuts = _cuts(buffer, begin)
    for a, b in zip(cuts, cuts[1:], strict=False):
        x = buffer[a:b]
        if not len(x):
            continue
        word = ~_SPACE[x]
        edge = np.zeros(len(x) + 1, bool)  # a document's border also ends a word
        edge[begin[np.searchsorted(begin, a) : np.searchsorted(begin, b, "right")] - a] = True
        edge[0] = edge[-1] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _BYTES.get(len(x))
        total = np.concatenate([[np.uint64(0)], np.cumsum(table[x] * up)])
        hashes.append(_mix((total[e] - total[s]) * down[s] ^ ((e - s).astype(np.uint64) << np.uint64(40))))
        starts.append(s + a)
        ends.append(e + a)
    none = np.empty(0, np.int64)
    return np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate([none, *starts]), np.concatenate([none, *ends])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and the places of the texts in them; a null text is empty."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    big = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.null_count:
        size = np.diff(offsets)
        if size[texts.is_null().to_numpy(zero_copy_only=False)].any():
            return text_buffer(texts.fill_null(""))
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buffer[offsets[0] : offsets[-1]], offsets - offsets[0]


def gram_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; len(h) - k + 1 of them (none if negative)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _GRAMS.get(min(n, _RUN) + k - 1)
    mark = np.uint64(0x9E3779B97F4A7C15 * (seed + k + 1) & (2**64 - 1))
    out = np.empty(n, np.uint64)
    for a in range(0, n, _RUN):
        b = min(n, a + _RUN)
        total = np.concatenate([[np.uint64(0)], np.cumsum(h[a : b + k - 1] * up[: b + k - 1 - a])])
        out[a:b] = _mix((total[k:] - total[: b - a]) * down[: b - a] + mark)
    return out


def word_arrays(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts one after another, and the offsets of the texts in them."""
    buffer, offsets = text_buffer(pa.array(texts, pa.large_string()))
    h, starts, _ = hash_text(buffer, offsets, lower)
    return h, np.searchsorted(starts, offsets).astype(np.int64)
