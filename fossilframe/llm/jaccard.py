"""Exact Jaccard self-join of documents on word n-grams, as a join in the metric space of Jaccard distance.

With t the largest distance of a link, the join goes from points to pivots, to Voronoi regions, into the regions.

1. Points. Documents with one set of shingles are one point. Of each shingle it is asked whether another point holds it
   (`exchange`: hashes travel as sorted differences, answers as a byte a hash). Links need shared shingles, num / den of
   the set's size at least; points with fewer have no other point within t and are left. The others keep their shared
   shingles, the rarest first.
2. Pivots. The first n - ceil(num n / den) + 1 shingles of two linked sets in that order have one in common (n counts the
   shingles that nobody shares, which come before all). The smallest point that has a shingle there is its pivot. Every
   point measures its distance to the pivots of its first shingles; those within t are linked to it.
3. Voronoi regions. A point's home is the nearest of its pivots, once pivots close to a smaller one are passed over; a
   pivot's covering radius is the distance of the farthest point at home there.
4. Windows. If x and y are linked, they share a first shingle; so x learns of y's home q, among the homes of those that
   hold its first shingles. By the triangle inequality x is within t + radius(q) of q: the points for which this holds
   are replicated to q's region, so that x and y meet in it. Shingles all of whose holders are connected already ask for
   nothing.
5. Regions are joined recursively and exactly (`link_region`): pivots far from one another, cells, windows of 2 t around
   the cells, until a part is small or its windows no longer separate it; there pivot after pivot links its ball, whose
   window is compared with the ball. A region of more than REGION points is dealt as pairs of blocks to several tasks.

Links are given out as stars and spanning edges, never as all pairs. Shingles are 48-bit hashes: two different shingles of
a pair agree with odds of about n^2 / 2^48.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fossilframe.llm.common import drop_stored, gram_hashes, stored
from fossilframe.llm.components import connected_components
from fossilframe.llm.exchange import LAST, PACKED, Words, answers, group_of, grouped, meet, pack, parts, planes, runs, sizes, unplanes

#: Points of a region that one task joins; members of a part that are joined without further pivots; pivots of a part.
REGION, LEAF, FAN = 1024, 64, 8
ASKED = "b int, g int, keys binary, many binary"
#: Bits of the table of removed documents: 8 MB at any size of the input.
TABLE_BITS = 1 << 26


class Sets:
    """The distinct shingle hashes (48 bits) of a group's documents, document after document."""

    def __init__(self, w: Words, k: int):
        at = w.valid(k)
        g, doc = gram_hashes(w.h, k, 2)[at], w.doc[at]
        size = w.ends - w.starts
        few = np.flatnonzero((size > 0) & (size < k))
        if len(few):
            g = np.concatenate([g, *[gram_hashes(w.h[w.starts[i] : w.ends[i]], int(size[i]), 100) for i in few]])
            doc = np.concatenate([doc, few])
            order = np.argsort(doc, kind="stable")
            g, doc = g[order], doc[order]
        self.ids, n = w.ids, len(w.ids)
        found = []
        for low in range(0, max(1, n), 1 << 16):  # a document's place and 48 bits of a hash fit in 64
            a, b = np.searchsorted(doc, [low, low + (1 << 16)])
            key = np.sort(((doc[a:b] - low).astype(np.uint64) << np.uint64(48)) | (g[a:b] >> np.uint64(16)))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
            found.append(((key >> np.uint64(48)).astype(np.int64) + low, key & np.uint64(2**48 - 1)))
        #: The document, by its place in ids, of each shingle, and the shingles.
        self.doc, self.g = (np.concatenate(x) for x in zip(*found, strict=True))
        bounds = np.searchsorted(self.doc, np.arange(n + 1))
        self.starts, self.ends = bounds[:-1], bounds[1:]
        self.size = self.ends - self.starts

    def digests(self) -> list[bytes | None]:
        return [xxhash.xxh3_128_digest(self.g[s:e].tobytes()) if e > s else None for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


def _first_of(digests: list[bytes | None]) -> np.ndarray:
    """Whether each set isn't empty and no document before has the same."""
    seen: set[bytes | None] = {None}
    out = np.zeros(len(digests), bool)
    for i, d in enumerate(digests):
        if d not in seen:
            seen.add(d)
            out[i] = True
    return out


def _short(s: np.ndarray) -> bytes:
    """The low 48 bits of the hashes."""
    return np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _rising(keys: np.ndarray) -> bytes:
    """Sorted numbers as the first one and byte planes of the differences, in as few bytes as the largest needs."""
    d = np.diff(keys)
    width = (int(d.max()).bit_length() + 7) // 8 if len(d) else 0
    return keys[:1].tobytes() + d.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _risen(b: bytes, n: int) -> np.ndarray:
    d = np.zeros((n, 8), np.uint8)
    d[0] = np.frombuffer(b[:8], np.uint8)
    if n > 1 and len(b) > 8:
        width = (len(b) - 8) // (n - 1)
        d[1:, :width] = np.frombuffer(b, np.uint8, offset=8).reshape(width, n - 1).T
    return np.cumsum(d.view(np.uint64).ravel())


def least_overlap(n, num: int, den: int):
    """How many shingles a set of n shares at least with any set that it is linked to."""
    return -(-num * n // den)


def points(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """id, n, set, tokens of every document, stored: the size and digest of its set, and its shared shingles (rarest
    first) if it may have links; copies in one group have them once. A null id is LAST."""
    groups = sizes(docs)
    d = grouped(docs, groups)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    drop = np.uint64(max(0, 48 - int(total).bit_length() - 5))  # so few bits that a hundredth of the hashes agree by chance

    def distinct(t: pa.Table) -> tuple:
        sets = Sets(Words(t, True), k)
        digests = sets.digests()
        own = _first_of(digests)[sets.doc]
        keys, at, many = np.unique(sets.g[own] >> drop, return_inverse=True, return_counts=True)
        return sets, digests, own, keys, at, many

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        _, _, _, keys, _, many = distinct(t)
        bucket = ((keys << drop) >> np.uint64(16)) * np.uint64(groups) >> np.uint64(32)
        first, number = runs(bucket)
        cuts = [*first.tolist(), len(keys)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        many = np.minimum(many, 255).astype(np.uint8)
        return pa.table(
            {
                "b": pa.array(bucket[first].astype(np.int32), pa.int32()),
                "g": pa.array([key[0].as_py()] * len(first), pa.int32()),
                "keys": pa.array([_rising(keys[s:e]) for s, e in spans], pa.binary()),
                "many": pa.array([many[s:e].tobytes() for s, e in spans], pa.binary()),
            }
        )

    def count(t: pa.Table) -> pa.Table:
        """For each key of each row: 0 if no other point holds it, else a number that grows with its holders."""
        many = [np.frombuffer(x, np.uint8) for x in t.column("many").to_pylist()]
        keys = np.concatenate([_risen(x, len(m)) for x, m in zip(t.column("keys").to_pylist(), many, strict=True)])
        order = np.argsort(keys)
        first, number = runs(keys[order])
        holders = np.add.reduceat(np.concatenate(many)[order].astype(np.int64), first)
        rank = np.where(holders > 1, np.minimum(255, 4 * np.log2(np.maximum(holders, 1))), 0).astype(np.uint8)
        out = np.empty(len(keys), np.uint8)
        out[order] = rank[number]
        cuts = np.cumsum([len(m) for m in many])[:-1]
        return pa.table([t.column("b"), t.column("g"), pa.array([x.tobytes() for x in np.split(out, cuts)], pa.binary())], ["b", "g", "ranks"])

    def keep(key: tuple, t: pa.Table, known: pa.Table) -> pa.Table:
        sets, digests, own, keys, at, _ = distinct(t)
        known = known.sort_by("b")
        ranks = np.frombuffer(b"".join(known.column("ranks").to_pylist()), np.uint8)
        if len(ranks) != len(keys):
            raise RuntimeError(f"{len(ranks)} answers for {len(keys)} keys")
        rank = np.zeros(len(sets.g), np.uint8)
        rank[own] = ranks[at]
        shared = np.bincount(sets.doc[rank > 0], minlength=len(sets.ids))
        some = (shared >= np.maximum(1, least_overlap(sets.size, num, den)))
        use = (rank > 0) & some[sets.doc]
        doc, rank, g = sets.doc[use], rank[use], sets.g[use]
        order = np.lexsort((g, rank, doc))
        bounds = np.searchsorted(doc, np.arange(len(sets.ids) + 1)).tolist()
        g = g[order]
        tokens = [_short(g[a:b]) if b > a else None for a, b in zip(bounds, bounds[1:], strict=False)]
        return pa.table({"id": pa.array(sets.ids, pa.int64()), "n": pa.array(sets.size, pa.int64()), "set": pa.array(digests, pa.binary()), "tokens": pa.array(tokens, pa.binary())})

    known = d.groupBy("g").applyInArrow(ask, ASKED).groupBy("b").applyInArrow(count, "b int, g int, ranks binary")
    return stored(d.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(keep, "id long, n long, set binary, tokens binary"))


class Members:
    """The points of one group, by id."""

    def __init__(self, t: pa.Table, num: int, den: int):
        t = t.sort_by("id").combine_chunks()
        self.table = t
        self.ids, self.n = t.column("id").to_numpy(), t.column("n").to_numpy()
        self.tokens = [_long(x) for x in t.column("tokens").to_pylist()]
        first = [len(x) - int(least_overlap(n, num, den)) + 1 for x, n in zip(self.tokens, self.n, strict=True)]
        #: The first shingles, sorted, and the place of the point of each.
        keys = np.concatenate([np.empty(0, np.uint64), *[x[:p] for x, p in zip(self.tokens, first, strict=True)]]) << np.uint64(16)
        at = np.repeat(np.arange(len(first)), first)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]

    def overlaps(self, at: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """How many shingles each point at these places shares with a set."""
        tokens = np.sort(tokens)
        size = np.array([len(self.tokens[i]) for i in at], np.int64)
        if not len(tokens) or not size.sum():
            return np.zeros(len(at), np.int64)
        x = np.concatenate([self.tokens[i] for i in at])
        hit = tokens[np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)] == x
        return np.bincount(np.repeat(np.arange(len(at)), size)[hit], minlength=len(at))


WANTED = "p long, g int, xs binary"


def _wanted(g: int, pivot: np.ndarray, x: np.ndarray) -> pa.Table:
    """For each distinct pivot, the group and its points that want to measure their distance to it."""
    if not len(pivot):
        return pa.table({"p": pa.array([], pa.int64()), "g": pa.array([], pa.int32()), "xs": pa.array([], pa.binary())})
    pairs = np.unique(np.stack([pivot, x], 1), axis=0)
    first, _ = runs(pairs[:, 0])
    return pa.table({"p": pa.array(pairs[first, 0], pa.int64()), "g": pa.array([g] * len(first), pa.int32()), "xs": pa.array([planes(s) for s in np.split(pairs[:, 1], first[1:])], pa.binary())})


def pivot_distances(members: DataFrame, groups: int, num: int, den: int) -> DataFrame:
    """x, p, d, linked: the distance of each point to the pivots of its first shingles, those that others share; stored."""

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        m = Members(t, num, den)
        first, _ = runs(m.keys)  # ids ascend, so the first holder of a key is the smallest
        return pack(key[0].as_py(), groups, m.keys[first], m.ids[m.at[first]])

    def pivots(keys: np.ndarray, row: np.ndarray, ids: np.ndarray) -> tuple:
        if not len(keys):
            return np.zeros(0, bool), ids
        first, number = runs(keys)
        return np.diff(np.append(first, len(keys)))[number] > 1, np.minimum.reduceat(ids, first)[number]

    def want(key: tuple, t: pa.Table, known: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _wanted(0, np.empty(0), np.empty(0))
        m = Members(t, num, den)
        first, number = runs(m.keys)
        pivot = m.ids[m.at[first]]
        has = np.diff(np.append(first, len(m.keys))) > 1
        asked, theirs = answers(known)
        if len(asked) and len(first):
            place = np.minimum(np.searchsorted(asked, m.keys[first]), len(asked) - 1)
            elsewhere = asked[place] == m.keys[first]
            pivot = np.where(elsewhere, theirs[place], pivot)
            has |= elsewhere
        use = has[number]
        return _wanted(key[0].as_py(), pivot[number][use], m.ids[m.at[use]])

    def measure(key: tuple, t: pa.Table, to: pa.Table) -> pa.Table:
        m = Members(t, num, den)
        out: list[list] = [[], [], [], []]
        for p, xs, n, tokens in zip(*(to.column(c).to_pylist() for c in ("p", "xs", "pn", "ptokens")), strict=True):
            at = np.searchsorted(m.ids, unplanes(xs))
            inter = m.overlaps(at, _long(tokens))
            union = m.n[at] + n - inter
            for o, v in zip(out, (m.ids[at], np.full(len(at), p), 1 - inter / union, den * inter >= num * union), strict=True):
                o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        return pa.table([pa.array(np.concatenate(o) if o else [], k) for o, k in zip(out, kinds, strict=True)], ["x", "p", "d", "linked"])

    d = members.withColumn("g", group_of(F.col("id"), groups))
    known = meet(d.groupBy("g").applyInArrow(ask, PACKED), pivots)
    wanted = d.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(want, WANTED)
    sets = members.select(F.col("id").alias("p"), F.col("n").alias("pn"), F.col("tokens").alias("ptokens"))
    return stored(d.groupBy("g").cogroup(wanted.join(sets, "p").groupBy("g")).applyInArrow(measure, "x long, p long, d double, linked boolean"))


def nearest_pivots(near: DataFrame, t: float) -> DataFrame:
    """x, home, r: each point's home and its distance; stored.

    Pivots within 2 t of a smaller pivot would cut a dense neighbourhood into many regions with the same members in their
    windows. They are passed over where a pivot that stays is within 3 t; among those that are left the nearest counts.
    """
    close = stored(near.filter((F.col("x") != F.col("p")) & (F.col("d") <= 2 * t)).select(F.col("x").alias("close")).distinct())
    d = near.join(close, near["p"] == close["close"], "left")
    over = F.col("close").isNotNull() | (F.col("d") > 3 * t)
    out = stored(d.groupBy("x").agg(F.min(F.struct(over.alias("over"), "d", "p")).alias("h")).select("x", F.col("h.p").alias("home"), F.col("h.d").alias("r")))
    drop_stored(close)
    return out


def region_members(members: DataFrame, homes: DataFrame, roots: DataFrame, groups: int, num: int, den: int) -> DataFrame:
    """q, id, n, c, tokens: the points of each region, with the component that each is known to be in; stored.

    A region has the points of q's cell and those in its window that hold a first shingle of more than one component.
    """
    t_max = 1 - num / den

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        m = Members(t, num, den)
        rows = np.unique(np.stack([m.keys.view(np.int64), m.table.column("home").to_numpy()[m.at], m.table.column("c").to_numpy()[m.at]], 1), axis=0)
        keys = rows[:, 0].copy().view(np.uint64)
        bucket = ((keys >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        first, _ = runs(bucket[order])
        blocks = [rows[i] for i in np.split(order, first[1:])] if len(rows) else []
        return pa.table({"b": pa.array(bucket[order][first], pa.int32()), "g": pa.array([key[0].as_py()] * len(first), pa.int32()), "rows": pa.array([planes(x.ravel()) for x in blocks], pa.binary())})

    def mixed(t: pa.Table) -> pa.Table:
        """Of keys whose holders are in several components: each asking group gets the homes of all holders."""
        blocks = [unplanes(x).reshape(-1, 3) for x in t.column("rows").to_pylist()]
        rows = np.concatenate(blocks)
        asker = np.repeat(np.arange(len(blocks)), [len(x) for x in blocks])
        order = np.argsort(rows[:, 0], kind="stable")
        rows, asker = rows[order], asker[order]
        first, number = runs(rows[:, 0])
        several = np.minimum.reduceat(rows[:, 2], first) != np.maximum.reduceat(rows[:, 2], first)
        use = several[number]
        rows, asker = rows[use], asker[use]
        homes = np.unique(rows[:, :2], axis=0)
        begin, _ = runs(homes[:, 0])
        end = np.append(begin[1:], len(homes)).astype(np.int64)
        asked = np.unique(np.stack([asker, rows[:, 0]], 1), axis=0)
        at = np.searchsorted(homes[begin, 0], asked[:, 1])
        out = {"g": [], "keys": [], "aux": []}
        gs = t.column("g").to_pylist()
        first, _ = runs(asked[:, 0])
        for x in np.split(np.arange(len(asked)), first[1:]) if len(asked) else []:
            a, n = begin[at[x]], (end - begin)[at[x]]
            place = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            out["g"].append(gs[asked[x[0], 0]])
            out["keys"].append(planes(homes[place, 0]))
            out["aux"].append(planes(homes[place, 1]))
        return pa.table([pa.array(out["g"], pa.int32()), pa.array(out["keys"], pa.binary()), pa.array(out["aux"], pa.binary())], ["g", "keys", "aux"])

    def want(key: tuple, t: pa.Table, known: pa.Table) -> pa.Table:
        asked, home = answers(known)
        if not t.num_rows or not len(asked):
            return _wanted(0, np.empty(0), np.empty(0))
        m = Members(t, num, den)
        low, high = np.searchsorted(asked, m.keys), np.searchsorted(asked, m.keys, "right")
        n = high - low
        place = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return _wanted(key[0].as_py(), home[place], np.repeat(m.ids[m.at], n))

    def replicate(key: tuple, t: pa.Table, to: pa.Table) -> pa.Table:
        m = Members(t, num, den)
        pivot, place = [], []
        for p, xs, n, radius, tokens in zip(*(to.column(c).to_pylist() for c in ("p", "xs", "pn", "radius", "ptokens")), strict=True):
            at = np.searchsorted(m.ids, unplanes(xs))
            inter = m.overlaps(at, _long(tokens))
            near = 1 - inter / (m.n[at] + n - inter) <= t_max + radius + 1e-9
            pivot += [p] * int(near.sum())
            place += at[near].tolist()
        rows = m.table.select(["id", "n", "c", "tokens"]).take(pa.array(place, pa.int64()))
        return rows.add_column(0, "q", pa.array(pivot, pa.int64()))

    radius = homes.groupBy("home").agg(F.max("r").alias("radius"))
    d = members.join(homes, members["id"] == homes["x"]).join(roots, members["id"] == roots["node"], "left")
    d = d.select(group_of(F.col("id"), groups).alias("g"), "id", "n", "tokens", "home", F.coalesce("root", "id").alias("c"))
    known = d.groupBy("g").applyInArrow(ask, "b int, g int, rows binary").groupBy("b").applyInArrow(mixed, "g int, keys binary, aux binary")
    wanted = d.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(want, WANTED)
    sets = members.select(F.col("id").alias("p"), F.col("n").alias("pn"), F.col("tokens").alias("ptokens"))
    to = wanted.join(sets.join(radius, sets["p"] == radius["home"]), "p")
    return stored(d.groupBy("g").cogroup(to.groupBy("g")).applyInArrow(replicate, "q long, id long, n long, c long, tokens binary"))


def link_region(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int, n: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that span the components of the region's link graph, except those within the components that are known.

    sets are distinct; n gives their sizes where shingles that no other set holds were left out.
    """
    m, t = len(sets), 1 - num / den
    if m < 2:
        return []
    own = np.array([len(s) for s in sets], np.int64)
    size = own if n is None else n
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), own)
    order = np.argsort(values, kind="stable")
    holders = owner[order]
    first, number = runs(values[order])
    last = np.append(first[1:], len(holders))
    of = np.empty(len(values), np.int64)
    of[order] = number
    begin = np.concatenate([[0], np.cumsum(own)])
    parent = list(range(m))
    edges: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x: int, y: int, told: bool = True) -> None:
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            if told:
                edges.append((int(ids[x]), int(ids[y])))

    def shared(p: int) -> tuple[np.ndarray, np.ndarray]:
        """The overlap and the union of p with every member."""
        r = of[begin[p] : begin[p + 1]]
        a, k = first[r], last[r] - first[r]
        at = np.repeat(a - np.cumsum(k) + k, k) + np.arange(k.sum())
        inter = np.bincount(holders[at], minlength=m)
        return inter, size[p] + size - inter

    def balls(at: np.ndarray) -> None:
        """Pivot after pivot links its ball and takes it out, once the ball is compared with its window."""
        rest = at
        while len(rest) > 1:
            p = int(rest[0])
            inter, union = (x[rest] for x in shared(p))
            linked, d = den * inter >= num * union, 1 - inter / union
            ball, near = rest[linked], ~linked & (d <= 2 * t + 1e-9)
            for x in ball.tolist():
                join(x, p)
            window, far = rest[near], d[near]
            for x, dx in zip(ball.tolist(), d[linked].tolist(), strict=True):
                y = window[far <= dx + t + 1e-9]
                y = y[[root(v) != root(x) for v in y.tolist()]] if len(y) else y
                if len(y):
                    inter, union = (v[y] for v in shared(x))
                    for v in y[den * inter >= num * union].tolist():
                        join(x, v)
            rest = rest[~linked & (rest != p)]

    def split(at: np.ndarray) -> None:
        if len(at) < 2 or len({root(x) for x in at.tolist()}) == 1:
            return
        if len(at) <= LEAF:
            return balls(at)
        pivots, near = [], np.full(len(at), np.inf)
        far = 0
        while len(pivots) < FAN and near[far] > 0:
            inter, union = (x[at] for x in shared(int(at[far])))
            pivots.append(1 - inter / union)
            near = np.minimum(near, pivots[-1])
            far = int(near.argmax())
        home = np.argmin(pivots, axis=0)
        regions = [at[d <= near + 2 * t + 1e-9] for j, d in enumerate(pivots) if (home == j).any()]
        if sum(map(len, regions)) > 2 * len(at) or max(map(len, regions)) > 0.8 * len(at):
            return balls(at)  # the windows don't separate the cells
        for r in regions:
            split(r)

    if known is not None:
        _, same = np.unique(known, return_inverse=True)
        lead: dict[int, int] = {}
        for x, c in enumerate(same.tolist()):
            join(x, lead.setdefault(c, x), False)
    split(np.arange(m))
    return edges


def region_links(regions: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: edges that join the components within each region; large regions are dealt as pairs of blocks."""
    stats = regions.groupBy("q").agg(F.count("*").alias("rows"), F.min("c").alias("low"), F.max("c").alias("high"), F.sum(F.octet_length("tokens").cast("long")).alias("bytes")).filter("low <> high")
    stats = stored(stats.select("q", F.ceil(F.col("rows") / REGION).cast("int").alias("blocks"), "bytes"))
    tasks = parts(regions, 2 * (stats.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    d = regions.join(stats.select("q", "blocks"), "q").withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("q", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "id", "n", "c", "tokens")
    d = d.withColumn("task", F.pmod(F.xxhash64("q", "i", "j"), F.lit(tasks)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("q", "ascending"), ("i", "ascending"), ("j", "ascending"), ("id", "ascending")]).combine_chunks()
        q, i, j = (t.column(c).to_numpy() for c in "qij")
        ids, n, c = (t.column(x).to_numpy() for x in ("id", "n", "c"))
        new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        edges: list[tuple[int, int]] = []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(q)], strict=True):
            if c[a:b].min() != c[a:b].max():
                edges += link_region(ids[a:b], [_long(x) for x in t.column("tokens").slice(a, b - a).to_pylist()], num, den, n[a:b], c[a:b])
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return d.groupBy("task").applyInArrow(run, "a long, b long")


def _roots(members: DataFrame, num: int, den: int) -> DataFrame:
    """node, root of the link graph of the points."""
    groups = parts(members, 4 * (members.agg(F.sum(F.octet_length("tokens").cast("long"))).first()[0] or 0))
    near = pivot_distances(members, groups, num, den)
    roots = connected_components(near.filter("linked").select(F.col("x").alias("a"), F.col("p").alias("b")))
    homes = nearest_pivots(near, 1 - num / den)
    regions = region_members(members, homes, roots, groups, num, den)
    links = stored(region_links(regions, num, den))
    drop_stored(near, homes, regions)
    if links.isEmpty():
        return roots
    return connected_components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def duplicate_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; linked if den * |A and B| >= num * |A or B|.

    Null or wordless texts have no shingles, link with nothing and are their own component. Repeated rows stay repeated
    and share a component. A null id counts as larger than all others; its component is null unless it reaches an id.
    """
    all_ = points(docs, k, num, den)
    least = stored(all_.filter("n > 0").groupBy("set").agg(F.min("id").alias("own")))
    mine = least.select(F.col("set").alias("s"), "own")
    members = all_.filter("tokens IS NOT NULL").join(mine, (F.col("set") == F.col("s")) & (F.col("id") == F.col("own"))).select("id", "n", "tokens")
    members = stored(members.dropDuplicates(["id"]))
    roots = _roots(members, num, den)
    drop_stored(members)
    classes = stored(least.join(roots, F.col("own") == F.col("node"), "left").select("set", F.coalesce("root", "own").alias("c")))
    drop_stored(least)
    # classes are read from a table, so both sides are plain exchanges: Spark splits the task of a set with many copies
    out = all_.select("id", "n", "set").join(classes, "set", "left").select("id", "n", F.coalesce("c", "id").alias("c"))
    return out.select(F.nullif("id", F.lit(LAST)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("c", F.lit(LAST)).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component: the one with the smallest id (repeated rows of that id all stay).

    Documents without shingles link with nothing and stay. All columns of docs come back unchanged. A table of TABLE_BITS
    bits, of the same size for any input, tells most of the documents that stay; only the others are joined with the ids
    that go.
    """
    c = duplicate_components(docs, k, num, den)
    gone = stored(c.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id")).distinct())
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(TABLE_BITS))
    bits = gone.select(place("gone_id").alias("h")).select(F.shiftright("h", 15).cast("int").alias("bucket"), F.expr("h & 32767").alias("bit"))
    bits = stored(bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    named = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), F.col("`doc_id`").alias("look_id"))
    at = F.shiftright(place("look_id"), 15).cast("int")
    byte = F.expr(f"conv(hex(substring(bits, CAST((pmod(xxhash64(CAST(look_id AS BIGINT)), {TABLE_BITS}) & 32767) DIV 8 AS INT) + 1, 1)), 16, 10)").cast("int")
    d = named.join(F.broadcast(bits), at == F.col("bucket"), "left")
    bit = F.expr(f"CAST(pmod(xxhash64(CAST(look_id AS BIGINT)), {TABLE_BITS}) % 8 AS INT)")
    d = d.withColumn("maybe", F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit)) != 0, F.lit(False)))
    stay = d.filter(~F.col("maybe")).select("row.*")
    unsure = d.filter("maybe").select("row", "look_id")
    unsure = unsure.join(gone, F.col("look_id").eqNullSafe(F.col("gone_id")), "left_anti").select("row.*")
    return stay.unionAll(unsure)
