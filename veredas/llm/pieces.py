"""N-best piece segmentation and its inverse, over a SentencePiece vocabulary.

Each text becomes a lattice of the vocabulary's pieces (spaces written as U+2581,
one put in front). Costs are integers, so that sums are exact: a piece of
rank *r* costs ``SCALE * (ln(r + 1) + ln H)`` (Zipf's law over the vocabulary's merge
ranks), a character without a piece costs ``UNKNOWN`` more than the dearest piece and is
spelled in byte pieces.

Forward Viterbi costs of all lattice nodes are exact heuristics for a backward A-star
search, which hence pops complete segmentations in order of their cost. No piece holds a
space mark after another character, nor a line feed (a vocabulary with such a piece is refused), so a lattice falls apart into
units between those places, and the N best of a text come from at most N - 1 units: those whose
second-best segmentation costs the least more. Only these are searched; all other
units take their best one.

A null or empty text has no pieces, one segmentation of score 0, and decodes to the
empty text. A text that itself holds U+2581 decodes with a space in its place
(``round_trip`` is false), as in the library. Copies get equal results; texts are encoded whole, however long; columns besides the
id and the text are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import weakref
import zlib
from array import array
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from .common import id_text, map_rows

MODEL = "piece_bpe_32k.model"
N_BEST = 4
SCALE = 1 << 16
UNKNOWN = 10 * SCALE
MEMO_UNITS = 150_000
_MARK = "▁"
_UNIT = re.compile(f"{_MARK}+[^{_MARK}\n]*|[^{_MARK}\n]+|\n")
#: Longer units are searched one by one.
ABREAST = 40
LOT = 1 << 14
NO_SECOND = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(44)


def units_of(text: str) -> list[str]:
    return _UNIT.findall(_MARK + text.replace(" ", _MARK)) if text else []


class Memory(dict):
    """Best segmentations of units."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        # Without a cycle a task's vocabulary and memory go when it ends.
        self.pieces = weakref.ref(pieces)

    def __missing__(self, unit: str) -> tuple[bytes, int, int]:
        found = self[unit] = self.pieces().whole(unit)
        return found


class Pieces:
    """Vocabulary, costs and the searches over the lattice of one unit."""

    def __init__(self, texts: list[str], ranks: list[int], ids: list[int], byte_ids: list[int]) -> None:
        h = math.log(sum(1 / (r + 1) for r in range(max(ranks) + 1)))
        self.cost = {t: round(SCALE * (math.log(r + 1) + h)) for t, r in zip(texts, ranks, strict=True)}
        self.id = dict(zip(texts, ids, strict=True))
        self.unknown = max(self.cost.values()) + UNKNOWN
        self.byte_ids = byte_ids
        self.longest = max(map(len, texts))
        size = max(ids + byte_ids) + 1
        if size > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.bytes_of = [b""] * size
        for t, i in self.id.items():
            self.bytes_of[i] = t.replace(_MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])
        self.memo = Memory(self)
        self.chars = {t for t in texts if len(t) == 1}
        hashes = np.array([self._hash(t) for t in texts], dtype=np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        self.costs = np.array([self.cost[t] for t in texts], dtype=np.int64)[order]
        self.ids = np.array(ids, dtype=np.int32)[order]
        self.maybe = np.zeros(1 << (64 - int(_SHIFT)), dtype=bool)
        self.maybe[(self.keys >> _SHIFT).astype(np.int64)] = True
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces share a hash")

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        texts, ranks, ids, byte_ids = [], [], [], [0] * 256
        for i in range(m.get_piece_size()):
            t = m.id_to_piece(i)
            if m.is_byte(i):
                byte_ids[int(t[3:-1], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                if _MARK in t.lstrip(_MARK) or "\n" in t:
                    raise ValueError(f"piece {i} holds a space after another character or a line feed: lattices would not fall apart into units")
                texts.append(t)
                ids.append(i)
                ranks.append(-int(m.get_score(i)))
        top = max(r for r in ranks if r < 1_000_000)
        return cls(texts, [min(r, top) for r in ranks], ids, byte_ids)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c)) * int(_FACTOR) & (1 << 64) - 1
        return h

    def edges(self, unit: str) -> list[list[tuple[int, int]]]:
        """For each end position, (start, cost) of the pieces that end there, longest first."""
        get, longest = self.cost.get, self.longest
        out: list[list[tuple[int, int]]] = [[]]
        for j in range(1, len(unit) + 1):
            here = [(i, c) for i in range(max(0, j - longest), j) if (c := get(unit[i:j])) is not None]
            if not here or here[-1][0] != j - 1:
                here.append((j - 1, self.unknown))
            out.append(here)
        return out

    def ids_of(self, unit: str, cuts: list[int]) -> bytes:
        out = array("H")
        for a, b in zip(cuts, cuts[1:], strict=False):
            i = self.id.get(unit[a:b])
            if i is None:
                out.extend(self.byte_ids[x] for x in unit[a:b].encode("utf-8", "surrogatepass"))
            else:
                out.append(i)
        return out.tobytes()

    def best(self, unit: str) -> tuple[bytes, int, int]:
        """Ids and cost of the best segmentation, and how much more the second best costs (NO_SECOND or more: there is none)."""
        return self.memo[unit]

    def learn(self, units: list[str]) -> None:
        """Viterbi over many units side by side: one numpy step for each start and length of a piece."""
        units = sorted((u for u in units if len(u) <= ABREAST and self.chars.issuperset(u)), key=len, reverse=True)
        for lo in range(0, len(units), LOT):
            self._learn_lot(units[lo : lo + LOT])

    def _learn_lot(self, units: list[str]) -> None:
        m = len(units)
        lens = np.fromiter(map(len, units), dtype=np.int64, count=m)
        width = int(lens[0])
        text = np.zeros((m, width), dtype=np.uint64)
        text[np.arange(width) < lens[:, None]] = np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4")
        first = np.full((width + 1, m), NO_SECOND)
        second = np.full((width + 1, m), NO_SECOND)
        first[0] = 0
        back, ids = np.zeros((width + 1, m), dtype=np.int8), np.zeros((width + 1, m), dtype=np.int32)
        reach = np.searchsorted(-lens, -np.arange(width + 1), side="right")  # units of so many characters or more
        for i in range(width):
            h = np.zeros(m, dtype=np.uint64)
            for j in range(i + 1, min(i + self.longest, width) + 1):
                n = reach[j]
                with np.errstate(over="ignore"):
                    h = (h[:n] + text[:n, j - 1]) * _FACTOR
                at = np.flatnonzero(self.maybe[(h >> _SHIFT).astype(np.int64)])
                piece = np.searchsorted(self.keys, h[at])
                sure = self.keys[np.minimum(piece, len(self.keys) - 1)] == h[at]
                at, piece = at[sure], piece[sure]
                if not len(at):
                    continue
                c = self.costs[piece]
                x, f = first[i, at] + c, first[j, at]
                better = x < f
                second[j, at] = np.where(better, np.minimum(f, second[i, at] + c), np.minimum(second[j, at], x))
                win = at[better]
                first[j, win], back[j, win], ids[j, win] = x[better], i, self.ids[piece[better]]
        row = np.arange(m)
        cost, gap = first[lens, row], second[lens, row] - first[lens, row]
        at, found = lens.copy(), []
        while (at > 0).any():
            found.append(np.where(at > 0, ids[at, row], -1))
            at = np.where(at > 0, back[at, row], 0)
        found = np.stack(found[::-1], axis=1)
        # Shorter segmentations are filled up in front.
        size = (2 * (found >= 0).sum(1)).tolist()
        width, body = 2 * found.shape[1], found.astype("<u2").tobytes()
        best = [body[(k + 1) * width - d : (k + 1) * width] for k, d in enumerate(size)]
        self.memo.update(zip(units, zip(best, cost.tolist(), gap.tolist(), strict=True), strict=True))

    def whole(self, unit: str) -> tuple[bytes, int, int]:
        """All Viterbi steps of a long unit at once."""
        n = len(unit)
        first, second, back = [0] + [NO_SECOND] * n, [NO_SECOND] * (n + 1), [0] * (n + 1)
        for j, here in enumerate(self.edges(unit)):
            for i, c in here:
                x = first[i] + c
                if x < first[j]:
                    second[j], first[j], back[j] = min(first[j], second[i] + c), x, i
                else:
                    second[j] = min(second[j], x)
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        return self.ids_of(unit, cuts[::-1]), first[n], second[n] - first[n]

    def n_best(self, unit: str, n: int) -> list[tuple[int, bytes]]:
        """(cost, ids) of the n best segmentations: backward A-star with forward Viterbi costs."""
        edges = self.edges(unit)
        forward = [0]
        for here in edges[1:]:
            forward.append(min(forward[i] + c for i, c in here))
        heap: list = [(forward[-1], 0, len(unit), 0, None)]
        out, pushed = [], 0
        while heap and len(out) < n:
            f, _, j, g, path = heapq.heappop(heap)
            path = (j, path)
            if not j:
                cuts = []
                while path:
                    cuts.append(path[0])
                    path = path[1]
                out.append((f, self.ids_of(unit, cuts)))
                continue
            for i, c in edges[j]:
                pushed += 1
                heapq.heappush(heap, (forward[i] + c + g, pushed, i, g + c, path))
        return out

    def encode(self, text: str, n: int = N_BEST) -> list[tuple[int, bytes]]:
        """(cost, ids as 16-bit little-endian bytes) of the n best segmentations, best first."""
        if not text:
            return [(0, b"")]
        units = units_of(text)
        ids, costs, gaps = zip(*map(self.memo.__getitem__, units), strict=True)
        total, parts = sum(costs), list(ids)
        out = [(total, b"".join(parts))]
        if n > 1:
            near = [k for _, k in heapq.nsmallest(n - 1, zip(gaps, range(len(gaps)), strict=True))]
            combos: list[tuple[int, tuple]] = [(0, ())]
            for k in near:
                if gaps[k] >= NO_SECOND >> 1:
                    continue
                ways = self.n_best(units[k], n)
                combos = heapq.nsmallest(n, ((d + c - costs[k], (*choice, (k, ids)) if w else choice) for d, choice in combos for w, (c, ids) in enumerate(ways)))
            for d, choice in combos[1:]:
                held = [(k, parts[k]) for k, _ in choice]
                for k, ids in choice:
                    parts[k] = ids
                out.append((total + d, b"".join(parts)))
                for k, ids in held:
                    parts[k] = ids
        return out

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        body = b"".join([table[i] for i in array("H", ids)])
        return (body[1:] if body[:1] == b" " else body).decode("utf-8", "replace")


def segment(docs: DataFrame, path: str | None = None, n: int = N_BEST) -> DataFrame:
    """Per document: doc_id, n_pieces, ids (best; 16-bit little-endian), n_best (score, n_pieces, ids_crc32) and round_trip.

    One narrow pass without a shuffle; a task remembers the units that a slice held twice or more (MEMO_UNITS, then afresh).
    """
    path = path or default_path()
    held: dict = {}

    def rows(ids: list, bodies: list) -> dict:
        if not held:
            held["pieces"] = Pieces.load(path)
        p = held["pieces"]
        out: dict = {"doc_id": ids, "n_pieces": [], "ids": [], "n_best": [], "round_trip": []}
        if len(p.memo) > MEMO_UNITS:
            p.memo.clear()
        texts = [b.decode("utf-8", "replace") for b in bodies]
        met = Counter(itertools.chain.from_iterable(map(units_of, texts)))
        p.learn([u for u in met if u not in p.memo])
        for text in texts:
            ways = p.encode(text, n)
            out["n_pieces"].append(len(ways[0][1]) // 2)
            out["ids"].append(ways[0][1])
            out["n_best"].append([{"score": -c / SCALE, "n_pieces": len(x) // 2, "ids_crc32": zlib.crc32(x)} for c, x in ways])
            out["round_trip"].append(p.decode(ways[0][1]) == text)
        # A unit that this slice held once is let go: most of them never come again.
        for u, k in met.items():
            if k == 1:
                p.memo.pop(u, None)
        return out

    return map_rows(id_text(docs), rows, "doc_id long, n_pieces long, ids binary, n_best array<struct<score: double, n_pieces: long, ids_crc32: long>>, round_trip boolean", slice_bytes=1 << 20)
