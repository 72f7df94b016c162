"""Benchmark decontamination by a generalised suffix automaton of the benchmark's words.

The automaton of all items is built once for each worker process. Each document is streamed through it once, word by
word, tracking the longest suffix read that occurs in an item. Where that length reaches the window (10 words, or the
whole item if it is shorter), the words of the window are hit. Hit spans can be cut out, and a document that is mostly
hit can be dropped.

The benchmark is cut into blocks of BLOCK_WORDS words with an automaton each, and the blocks into parts of PART_WORDS, so
that a worker holds a part's automata at once. A part is broadcast, which bounds the broadcast whatever the benchmark's
size. Documents pass all parts in turn, each adding its spans and items; between two parts they are written to the shared
folder. Most benchmarks are one part.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fossilframe.llm.common import LOWER, batches_of, drop_stored, ranged_scan, release, stored

#: Words once A-Z is lower-cased; over the text as it stands the same words are found with A-Z allowed.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLOCK_WORDS, PART_WORDS = 100_000, 400_000
#: Words of documents that an automaton remembers, at most.
CACHED = 20_000
#: Bytes of documents that are streamed through a part's blocks together, about.
BATCH = 1 << 20


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with what is needed to read windows and their items from a match."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int):
        self.window = window
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        paths = []
        for item, words in items:
            state, path = 0, []
            for w in words:
                state = self._extend(state, self.vocabulary.setdefault(w, len(self.vocabulary)))
                path.append(state)
            paths.append((item, path))
        self._mark(paths, items)
        self.cache: dict[str, int] = {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _mark(self, paths: list, items: list) -> None:
        """owners[v]: the items that have the window-long suffix of v. shorts[v]: (words, item) of whole short items that end v."""
        w, n = self.window, len(self.next)
        through: list[set] = [set() for _ in range(n)]
        ends: list[list] = [[] for _ in range(n)]
        for item, path in paths:
            if not path:
                continue
            if len(path) < w:
                v = path[-1]
                while self.length[self.link[v]] >= len(path):
                    v = self.link[v]
                ends[v].append((len(path), item))
                continue
            for v in path[w - 1 :]:
                while v > 0 and item not in through[v]:
                    through[v].add(item)
                    v = self.link[v]
        order = sorted(range(n), key=self.length.__getitem__)
        self.owners: list[frozenset] = [frozenset()] * n
        self.shorts: list[tuple] = [()] * n
        for v in order[1:]:
            up = self.link[v]
            self.shorts[v] = tuple(ends[v]) + self.shorts[up]
            self.owners[v] = self.owners[up] if self.length[up] >= w else frozenset(through[v])

    def ids(self, words: list[str]) -> list[int]:
        cache, known = self.cache, self.vocabulary
        if len(cache) > CACHED:
            cache.clear()
        out = list(map(cache.get, words))
        if None in out:
            for k, i in enumerate(out):
                if i is None:
                    out[k] = cache[words[k]] = known.get(words[k].translate(LOWER), -1)
        return out

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set]:
        """The hit spans (first word, last word + 1), merged, and the items whose windows occur."""
        nxt, link, length, window, shorts = self.next, self.link, self.length, self.window, self.shorts
        state = matched = 0
        found: list[tuple[int, int]] = []
        items: set = set()
        for at, c in enumerate(self.ids(words)):
            if c < 0:
                state = matched = 0
                continue
            while c not in nxt[state]:
                if not state:
                    matched = -1
                    break
                state = link[state]
                matched = length[state]
            else:
                state = nxt[state][c]
            matched += 1
            if not state:
                continue
            if matched >= window:
                found.append((at + 1 - window, at + 1))
                items |= self.owners[state]
            for m, item in shorts[state]:
                if m <= matched:
                    found.append((at + 1 - m, at + 1))
                    items.add(item)
        return merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: The automata of one call of with_hits, for all tasks of a worker.
_BUILT: dict[tuple, SuffixAutomaton] = {}


def _automaton(key: tuple, items: list, window: int) -> SuffixAutomaton:
    if key not in _BUILT:
        for other in [k for k in _BUILT if k[0] != key[0]]:
            del _BUILT[other]
        if len(_BUILT) >= 4:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = SuffixAutomaton(items, window)
    return _BUILT[key]


def _forget() -> None:
    """What a task leaves its worker: the automata without the words that they met, and none that is soon built again."""
    for a in _BUILT.values():
        a.cache.clear()
    if sum(len(a.next) for a in _BUILT.values()) < 50_000:
        _BUILT.clear()
    release()


def parts(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[list]]:
    """The items as words, in parts of blocks, read one part at a time. Items without words have no window."""
    b = ranged_scan(benchmark, id_col, text_col).filter(F.col(text_col).isNotNull())
    blocks, held, all_ = [[]], 0, 0
    for item, text in b.toLocalIterator():
        words = [w.translate(LOWER) for w in WORD.findall(text)]
        if held and held + len(words) > BLOCK_WORDS:
            if all_ + len(words) > PART_WORDS:
                yield blocks
                blocks, all_ = [], 0
            blocks.append([])
            held = 0
        if words:
            blocks[-1].append((item, words))
            held += len(words)
            all_ += len(words)
    yield blocks


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int, finish: Callable, made: StructType, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """finish(row, texts, words, spans, items) of each batch of docs, with the schema `made`.

    row: docs' columns but the text, as one array; words: how many; spans: the hit ones; items: whose windows occur.
    """
    spark = docs.sparkSession
    kind = dict(ranged_scan(benchmark, item_col).dtypes)[item_col]
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(None).cast("int").alias("none")]
    d = docs.select(F.struct(*rest).alias("row"), "text", F.expr("CAST(array() AS array<array<int>>)").alias("spans"), F.expr(f"CAST(array() AS array<{kind}>)").alias("items"))
    before, todo = None, parts(benchmark, item_col, item_text)
    part = next(todo)
    while part is not None:
        after = next(todo, None)
        shared, token, last = spark.sparkContext.broadcast(part), uuid.uuid4().hex, after is None

        def run(it: Iterator[pa.RecordBatch], shared=shared, token=token, last=last) -> Iterator[pa.RecordBatch]:
            for b in batches_of(it, BATCH):
                texts = b.column(1).to_pylist()
                words = [WORD.findall(t) if t else [] for t in texts]
                spans, items = (b.column(c).to_pylist() for c in (2, 3))
                for j, block in enumerate(shared.value):
                    if block:
                        a = _automaton((token, j), block, window)
                        for i, w in enumerate(words):
                            s, found = a.scan(w)
                            if s:
                                spans[i] = merged([*map(tuple, spans[i]), *s])
                                items[i] = list({*items[i], *found})
                if last:
                    yield finish(b.column(0), texts, [len(w) for w in words], spans, items)
                else:
                    cols = [b.column(0), b.column(1), pa.array([list(map(list, s)) for s in spans], b.schema.field(2).type), pa.array(items, b.schema.field(3).type)]
                    yield pa.RecordBatch.from_arrays(cols, schema=b.schema)
            _forget()

        d = d.mapInArrow(run, made if last else d.schema)
        if not last:
            d = stored(d)
            if before is not None:
                drop_stored(before)
            before = d
        part = after
    return d


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document.

    Null or wordless text has no words and no hits; items_sha256 is then the digest of the empty string. Repeated rows
    stay repeated. An empty benchmark hits nothing. Item ids are sorted as strings; an item listed twice counts once.
    """
    made = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")])

    def finish(row: pa.Array, texts: list, words: list, spans: list, items: list) -> pa.RecordBatch:
        hit = [sum(y - x for x, y in s) for s in spans]
        named = [sorted(set(map(str, i))) for i in items]
        cols = [pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in named], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]
        return pa.RecordBatch.from_arrays([row.field(0), *cols], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return with_hits(ranged_scan(docs, "doc_id", "text"), benchmark, window, finish, made)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without the hit spans; documents of which more than max_coverage of the words are hit go as a whole.

    A removed span takes with it the text from its first word to the end of its last. All columns of docs come back;
    only `text` changes. A document without hits comes back unchanged.
    """
    names = [c for c in docs.columns if c != "text"]

    def finish(row: pa.Array, texts: list, words: list, spans: list, items: list) -> pa.RecordBatch:
        keep = [sum(y - x for x, y in s) <= max_coverage * n for n, s in zip(words, spans, strict=True)]
        out = pa.array([cut(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
        cols = [row.field(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*cols, out], [*names, "text"]).filter(pa.array(keep, pa.bool_()))

    made = StructType([*[docs.schema[c] for c in names], docs.schema["text"]])
    return with_hits(docs, benchmark, window, finish, made).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the word spans."""
    words = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : words[a][0]])
        last = words[b - 1][1]
    return "".join(out) + text[last:]
