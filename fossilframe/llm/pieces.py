"""SentencePiece (BPE) encoding through a merge-type prefix table, and decoding.

A BPE encoding of a text is the one sequence of pieces in which every two neighbours are *compatible*: encoding just
the two of them gives the two back. So each prefix has exactly one possible last piece. The table holds that piece for
every prefix: an Aho-Corasick automaton of all pieces lists, at each position, the pieces that end there, and the
candidate that is compatible with the last piece of the prefix before it is the one. The ids are then recovered
backwards from the end. The work is linear in the text; no merge queue is kept.

Runs of the space mark are the one place where pieces have equal merge scores, so that order of place decides; such a
run is encoded by replaying its merges. Characters that no piece knows are written as their bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fossilframe.llm.common import batches_of, ranged_scan, release

SPACE = "▁"


def read_model(path: str) -> dict:
    """Pieces, scores, types and the normaliser of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    n = proto.normalizer_spec
    if proto.trainer_spec.model_type != 2:
        raise ValueError("only BPE models have a merge table")
    if len(n.precompiled_charsmap) or n.remove_extra_whitespaces or not n.escape_whitespaces:
        raise ValueError("only the identity normaliser is implemented")
    if any(p.type == 4 for p in proto.pieces):
        raise ValueError("user-defined pieces are not implemented")
    return {
        "pieces": [(p.piece, p.score, p.type) for p in proto.pieces],
        "dummy": n.add_dummy_prefix,
        "eos": proto.trainer_spec.eos_id,
        "unk": proto.trainer_spec.unk_id,
        "byte_fallback": proto.trainer_spec.byte_fallback,
        "unk_surface": proto.trainer_spec.unk_surface,
    }


class PieceCodec:
    """Encoder and decoder of one model. Caches of words and of piece pairs are bounded and change no result."""

    CACHE = 400_000

    def __init__(self, path: str):
        import ahocorasick

        model = read_model(path)
        self.dummy, self.eos, self.unk = model["dummy"], model["eos"], model["unk"]
        self.normal, self.score, self.byte_ids = {}, {}, {}
        self.surface: list[str | bytes] = []
        for i, (piece, score, kind) in enumerate(model["pieces"]):
            if kind == 1:
                self.normal[piece], self.score[i] = i, score
            if kind == 6:
                self.byte_ids[int(piece[3:5], 16)] = i
            self.surface.append(bytes([int(piece[3:5], 16)]) if kind == 6 else "" if kind == 3 else model["unk_surface"] if kind == 2 else piece.replace(SPACE, " "))
        self.fallback = model["byte_fallback"]
        self.piece = [p for p, _, _ in model["pieces"]]
        self.split = self._splits()
        # A piece that its own encoding doesn't give back can't appear in any encoding. Runs of space marks are replayed instead.
        self.auto = ahocorasick.Automaton()
        for p, i in self.normal.items():
            if len(p) == 1 or (i in self.split and p.strip(SPACE)):
                self.auto.add_word(p, (len(p), i))
        self.auto.make_automaton()
        inner = {a + b for p in self.normal for a, b in zip(p, p[1:], strict=False)}
        self.inner = inner
        if any(SPACE in p.lstrip(SPACE) or (p[0] == SPACE and p.strip(SPACE) and p[:2] == SPACE * 2) for p in self.normal):
            raise ValueError("space marks inside pieces are not implemented")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple] = {}
        self.parts: dict[str, tuple] = {}
        self.edge = re.compile(rf"{SPACE}?[^\W\d_{SPACE}]+|.", re.S)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def _splits(self) -> dict[int, tuple[int, int]]:
        """The two pieces that the last merge of each reachable piece joins."""
        out = {}
        for p, i in self.normal.items():
            if len(p) > 1 and p.strip(SPACE):
                got = self._replay(list(p))
                if got and len(got[0]) == 1:
                    out[i] = (self.normal[got[1][0]], self.normal[got[1][1]])
        return out

    def _replay(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """The merges in order of score, then place; and the last pair merged."""
        last = None
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.normal.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            last = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols, last

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay apart when side by side.

        Undo the merges that made a and b, the latest (lowest score) first. Each time, the pair that then faces the seam
        must not be a piece that would have been merged before the merge just undone; if it is, the seam closes.
        """
        pair = (a, b)
        known = self.pairs.get(pair)
        if known is not None:
            return known
        piece, normal, score, split = self.piece, self.normal, self.score, self.split
        left, right, ok = a, b, True
        limit = float("-inf")  # the score of the merge just undone: a seam merge with a higher one would have come before it
        on_left = False
        while True:
            m = normal.get(piece[left] + piece[right])
            if m is not None and (score[m] > limit or (score[m] == limit and not on_left)):
                ok = False  # of equal merges the left one comes first
                break
            sl, sr = split.get(left), split.get(right)
            if sl is None and sr is None:
                break
            # Undo the later of the two merges that made left and right; with equal scores the right one came later.
            if sr is None or (sl is not None and score[left] < score[right]):
                limit, left, on_left = score[left], sl[1], True
            else:
                limit, right, on_left = score[right], sr[0], False
        if len(self.pairs) >= 1_000_000:
            self.pairs.clear()
        self.pairs[pair] = ok
        return ok

    def _blanks(self, m: int) -> list[int]:
        """A run of m space marks, by its merges: highest score first, then leftmost."""
        run = self.normal.get(SPACE)
        if m == 0 or run is None:
            return self._unknown(SPACE) * m
        size, alive, nxt, prv = [1] * m, [True] * m, list(range(1, m + 1)), list(range(-1, m - 1))
        heap: list[tuple[float, int, int]] = []

        def push(a: int) -> None:
            if a >= 0 and nxt[a] < m and (i := self.normal.get(SPACE * (size[a] + size[nxt[a]]))) is not None:
                heapq.heappush(heap, (-self.score[i], a, size[a] + size[nxt[a]]))

        for a in range(m - 1):
            push(a)
        while heap:
            _, a, total = heapq.heappop(heap)
            if not alive[a] or nxt[a] >= m or size[a] + size[b := nxt[a]] != total:
                continue
            size[a], alive[b], nxt[a] = total, False, nxt[b]
            if nxt[a] < m:
                prv[nxt[a]] = a
            push(prv[a])
            push(a)
        return [self.normal[SPACE * size[a]] for a in range(m) if alive[a]]

    def _unknown(self, c: str) -> list[int]:
        return [self.byte_ids[x] for x in c.encode()] if self.fallback else [self.unk]

    def table(self, text: str) -> list[tuple[int, int] | None]:
        """For each prefix (by its last character) the length and id of its unique last piece; None after an unknown character."""
        last: list[tuple[int, int] | None] = [None] * len(text)
        pairs, compatible = self.pairs, self.compatible
        done = -1
        for end, found in self.auto.iter(text):
            if end == done:
                continue
            start = end - found[0]
            if start >= 0:
                before = last[start]
                if before is not None:
                    ok = pairs.get((before[1], found[1]))
                    if ok is None:
                        ok = compatible(before[1], found[1])
                    if not ok:
                        continue
            last[end] = found
            done = end
        return last

    def _part(self, text: str) -> tuple[int, ...]:
        last, out, at = self.table(text), [], len(text) - 1
        while at >= 0:
            if last[at] is None:
                out.extend(reversed(self._unknown(text[at])))
                at -= 1
            else:
                out.append(last[at][1])
                at -= last[at][0]
        return tuple(reversed(out))

    def _encode_chunk(self, chunk: str) -> list[int]:
        """Space marks, then a word. Pieces never span two characters that are neighbours in no piece, so the word is cut there."""
        word = chunk.lstrip(SPACE)
        marks = len(chunk) - len(word)
        if not word:
            return self._blanks(marks)
        text, parts = (SPACE if marks else "") + word, self.parts
        ids: list[int] = []
        begin, inner = 0, self.inner
        for m in self.edge.finditer(text):
            k = m.end()
            if k == len(text) or text[k - 1 : k + 1] not in inner:
                part = text[begin:k]
                got = parts.get(part)
                if got is None:
                    got = self._part(part)
                    if len(part) <= 64:
                        if len(parts) >= self.CACHE // 2:
                            parts.clear()
                        parts[part] = got
                ids.extend(got)
                begin = k
        if marks > 1:
            bare = ids[0] == self.normal.get(SPACE)
            return self._blanks(marks if bare else marks - 1) + (ids[1:] if bare else ids)
        return ids

    def _look(self, chunk: str) -> tuple[int, str, list[int]]:
        ids = self._encode_chunk(chunk)
        back = self._text_of(ids)
        got = (len(ids), " ".join(map(str, ids)), None if back == chunk.replace(SPACE, " ") else back)
        if len(chunk) <= 64:
            if len(self.words) >= self.CACHE:
                self.words.clear()
            self.words[chunk] = got
        return got

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return self.chunk.findall(((SPACE if self.dummy else "") + text).replace(" ", SPACE))

    def encode(self, text: str) -> list[int]:
        """The ids, end id included."""
        return [i for c in self.chunks(text) for i in self._encode_chunk(c)] + [self.eos]

    def _text_of(self, ids: list[int]) -> str:
        out: list[str] = []
        raw = b""
        for i in ids:
            s = self.surface[i]
            if isinstance(s, bytes):
                raw += s
                continue
            if raw:
                out.append(self._bytes(raw))
                raw = b""
            out.append(s)
        return "".join(out) + (self._bytes(raw) if raw else "")

    @staticmethod
    def _bytes(raw: bytes) -> str:
        """Bytes to text; each byte that is not part of a valid character becomes U+FFFD."""
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + n].decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                k += 1
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._text_of(ids)
        return text[1:] if self.dummy and text.startswith(" ") else text

    def forget(self) -> None:
        """Empties the caches: a worker that waits for other stages would hold on to them."""
        for cache in (self.pairs, self.words, self.parts):
            cache.clear()
        release()

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, hex digest of the ids joined by one space, hex digest of the decoded text."""
        words, look = self.words, self._look
        chunks = self.chunks(text or "")
        got = [words.get(c) or look(c) for c in chunks]
        joined = " ".join([g[1] for g in got] + [str(self.eos)])
        decoded = "".join([c.replace(SPACE, " ") if g[2] is None else g[2] for c, g in zip(chunks, got, strict=True)])
        if self.dummy and decoded.startswith(" "):
            decoded = decoded[1:]
        return sum(g[0] for g in got) + 1, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each model and process."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every text; null is taken as empty, which gives the end id alone."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches_of(it, 1 << 20):
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])
        c.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return ranged_scan(docs, id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; null text as empty. Repeated rows stay repeated."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches_of(it, 4 << 20):
            got = [c.digest(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ranged_scan(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
