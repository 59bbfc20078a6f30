"""Packing of token pieces into sequences of bounded length by a linear grouping scheme.

1. *Pieces.* Texts are tokenised in one narrow pass; a document longer than a sequence is cut into
   full pieces behind a first one that may be shorter. Pieces are written with their ids and with their rank among the
   pieces of the same length in their task.
2. *Scheme.* All that a packing depends on is how many pieces have each length: a table no longer than a sequence,
   whatever the corpus. From it the driver makes the plan. Large lengths are dealt in falling order into groups of equal
   number and rounded up to the longest of their group; the configurations of these few sizes are optimised by
   column generation (the simplex method prices a knapsack over the sizes), whole
   multiples of them are taken, and the pieces put in place of the sizes. What is left over, and the small pieces, longest
   first, go where they leave the least room (best fit). Runs of sequences that are filled alike are handled as one, so that the
   plan's size depends on the lengths and groups and not on the number of pieces. ``GROUPS`` lists how many groups are
   tried; the plan of the fewest sequences is taken.
3. *Placing.* A piece's rank among all of its length follows from counts per task and length; the plan's table then gives its
   sequence and its place. Ids are not shuffled unless the table of counts is too large to broadcast (``BROADCAST_ROWS``).

A null or empty text is one piece of the end id. Rows are packed apart whether or not ids, texts or both repeat; equal
lengths are interchangeable. Texts are tokenised whole, however long; columns besides the id and the text are ignored; an
empty table gives no pieces.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import ByteBpe, default_path
from .common import arrow_schema, id_text, materialize, offsets_of, slices, trim

CAPACITY = 1024
END_ID = 2
#: Numbers of groups that are tried.
GROUPS = (96, 192)
#: Lengths above this share of a sequence are large.
LARGE = 1 / 8
#: Rows of (task, length, pieces before) that an executor holds without strain (some 40 MB).
BROADCAST_ROWS = 1_000_000
SLICE_BYTES = 2 << 20
RANKS = 1 << 44

_PIECES = "shard int, doc_id long, piece int, start long, length long, nth long, ids binary"
_PLACED = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"


@dataclass
class Run:
    """``n`` sequences from number ``first`` on that are filled alike up to ``used``."""

    first: int
    n: int
    used: int


@dataclass(frozen=True)
class Layout:
    """The plan: row i places ``count`` pieces of a length, ``each`` to a sequence, from rank ``rank`` on."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    each: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given their rank among all of their length."""
        row = np.searchsorted(self.length * RANKS + self.rank, length * RANKS + rank, side="right") - 1
        k, each = rank - self.rank[row], self.each[row]
        return self.first[row] + k // each, self.offset[row] + k % each * length


class Packer:
    """Sequences under construction, from counts by length."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, dict(counts)
        self.taken: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.open: dict[int, list[Run]] = defaultdict(list)
        self.rooms: list[int] = []
        self.n = 0

    def _place(self, length: int, count: int, each: int, run: Run) -> None:
        self.rows.append((length, self.taken[length], count, each, run.first, run.used))
        self.taken[length] += count
        self.left[length] -= count

    def _offer(self, run: Run) -> None:
        room = self.capacity - run.used
        if room and run.n:
            if not self.open[room]:
                heapq.heappush(self.rooms, room)
            self.open[room].append(run)

    def new(self, n: int) -> Run:
        self.n += n
        return Run(self.n - n, n, 0)

    def substitute(self, n: int, slots: list[list[int]]) -> None:
        """``n`` new sequences; each slot takes the longest pieces left of a group's lengths (given in falling order)."""
        runs = [self.new(n)]
        for lengths in slots:
            filled, supply = [], iter(lengths)
            length = next(supply, None)
            for run in runs:
                while run.n and length is not None:
                    if not self.left.get(length):
                        length = next(supply, None)
                        continue
                    m = min(run.n, self.left[length])
                    part = Run(run.first, m, run.used)
                    self._place(length, m, 1, part)
                    filled.append(Run(part.first, m, part.used + length))
                    run = Run(run.first + m, run.n - m, run.used)
                if run.n:
                    filled.append(run)
            runs = filled
        for run in runs:
            self._offer(run)

    def best_fit(self, length: int) -> None:
        """All pieces left of a length, each to the sequence that it leaves the least room in.

        A piece that leaves room for another like it leaves the least room again, so a sequence takes as many as it can before
        the next one's turn.
        """
        kept: list[int] = []
        while self.left[length]:
            while self.rooms and (self.rooms[0] < length or not self.open[self.rooms[0]]):
                room = heapq.heappop(self.rooms)
                if self.open[room]:
                    kept.append(room)
            if self.rooms:
                room = self.rooms[0]
                run = self.open[room].pop()
            else:
                each = self.capacity // length
                run = self.new(-(-self.left[length] // each))
                room = self.capacity
            each = room // length
            full, rest = divmod(min(self.left[length], run.n * each), each)
            if full:
                self._place(length, full * each, each, Run(run.first, full, run.used))
            if rest:
                self._place(length, rest, rest, Run(run.first + full, 1, run.used))
            self._offer(Run(run.first, full, run.used + each * length))
            if rest:
                self._offer(Run(run.first + full, 1, run.used + rest * length))
            after = full + (rest > 0)
            self._offer(Run(run.first + after, run.n - after, run.used))
        for room in kept:
            heapq.heappush(self.rooms, room)

    def layout(self) -> Layout:
        rows = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 6)
        return Layout(*rows.T.copy(), n_sequences=self.n)


def grouped(counts: dict[int, int], n_groups: int) -> list[list[int]]:
    """Lengths in falling order, dealt into groups of about equal number of pieces; a length is in one group."""
    total, seen, out = sum(counts.values()), 0, []
    for length in sorted(counts, reverse=True):
        if not out or seen * n_groups >= len(out) * total:
            out.append([])
        out[-1].append(length)
        seen += counts[length]
    return out


def _knapsack(sizes: list[int], gain: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest gain: value and how often it holds each size."""
    best = np.zeros(capacity + 1)
    states = []
    for s, g in zip(sizes, gain, strict=True):
        states.append(best)
        if g > 1e-12:
            new = best.copy()
            for m in range(1, capacity // s + 1):
                np.maximum(new[m * s :], best[: capacity + 1 - m * s] + m * g, out=new[m * s :])
            best = new
    room = int(np.argmax(best))
    value, config = float(best[room]), np.zeros(len(sizes), dtype=np.int64)
    for k in range(len(sizes) - 1, -1, -1):
        before, s, g = states[k], sizes[k], gain[k]
        target = best[room]
        m = 0
        if g > 1e-12:
            while m * s <= room and abs(before[room - m * s] + m * g - target) > 1e-9:
                m += 1
            if m * s > room:
                m = 0
        config[k], room, best = m, room - m * s, before
    return value, config


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 4000, tolerance: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """A fractional choice of configurations (how often each is used) that covers the demand, optimal up to ``tolerance``."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    need = np.array(demand, dtype=float)
    use = inverse @ need
    for turn in range(1, rounds + 1):
        value, config = _knapsack(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + tolerance:
            break
        change = inverse @ config
        ratio = np.full(k, np.inf)
        up = change > 1e-9
        ratio[up] = np.maximum(use[up], 0.0) / change[up]
        out = int(np.argmin(ratio))
        basis[:, out] = config
        if turn % 64:
            pivot = inverse[out] / change[out]
            inverse -= np.outer(change, pivot)
            inverse[out] = pivot
        else:  # anew, before errors add up
            inverse = np.linalg.inv(basis)
        use = inverse @ need
    use = np.maximum(np.linalg.inv(basis) @ need, 0.0)
    return [(basis[:, j].astype(np.int64), float(use[j])) for j in range(k) if use[j] > 1e-9]


def scheme(counts: dict[int, int], capacity: int, n_groups: int, large: float = LARGE) -> Packer:
    """The packing of one number of groups, on the counts of lengths alone."""
    packer = Packer(counts, capacity)
    smallest = min(counts, default=0)
    for length in sorted(counts, reverse=True):
        if length + smallest > capacity:  # alone in any packing
            packer.best_fit(length)
    rest = {s: n for s, n in packer.left.items() if n and s > large * capacity}
    if rest:
        groups = grouped(rest, n_groups)
        sizes = [g[0] for g in groups]
        for config, use in configurations(sizes, [sum(rest[s] for s in g) for g in groups], capacity):
            if int(use + 1e-6):
                packer.substitute(int(use + 1e-6), [groups[k] for k in np.flatnonzero(config) for _ in range(config[k])])
    for length in sorted(counts, reverse=True):
        packer.best_fit(length)
    return packer


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> Layout:
    """The layout of the fewest sequences among the numbers of groups; ``counts``: pieces by length."""
    counts = {int(s): int(n) for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in counts) or sum(counts.values()) >= RANKS:
        raise ValueError("lengths must lie between 1 and the capacity")
    return min((scheme(counts, capacity, g) for g in groups), key=lambda p: p.n).layout()


def pieces(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, written once: the task (``shard``), and ``nth`` among its pieces of the length."""
    path = path or default_path()
    arrow = arrow_schema(_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = ByteBpe(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        close = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for lo, hi in slices(batch.column("body"), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                ids = [np.concatenate([coder.encode(str(b, "utf-8", "replace")), close]) for b in part.column("body").to_pylist()]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                many = -(-n // capacity)
                doc = np.repeat(np.arange(len(ids)), many)
                piece = np.arange(len(doc)) - np.repeat(offsets_of(many)[:-1], many)
                # The first piece takes what full ones leave.
                first = n - (many - 1) * capacity
                start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[doc])
                order = np.argsort(length, kind="stable")
                sizes, at, found = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), dtype=np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(at, found) + seen[length[order]]
                seen[sizes] += found
                cut = [ids[d][a : a + m].astype("<u4").tobytes() for d, a, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), shard, np.int32)), part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(nth), pa.array(cut, type=pa.binary())], schema=arrow)
            trim()

    return materialize(id_text(docs).mapInArrow(run, _PIECES), "packing-pieces")


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, piece, start, length, sequence_id, offset and ids (little-endian unsigned 32-bit) of every piece."""
    made = pieces(docs, path, end_id, capacity)
    per = materialize(made.groupBy("shard", "length").agg(F.count("*").alias("n")), "packing-counts")
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a sequence's length of rows at most
    layout = plan(counts, capacity, groups)
    earlier = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("shard", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    side = F.broadcast(before) if per.count() <= broadcast_rows else before
    ranked = made.join(side, ["shard", "length"]).select("doc_id", "piece", "start", "length", (F.col("before") + F.col("nth")).alias("rank"), "ids")
    arrow = arrow_schema(_PLACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = layout.place(np.asarray(batch.column("length")), np.asarray(batch.column("rank")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length")), pa.array(sequence), pa.array(offset), batch.column("ids")], schema=arrow)

    return ranked.mapInArrow(run, _PLACED)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and the ids of every sequence; a group is no longer than a sequence."""
    each = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("x"))
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    return each.select("sequence_id", total.alias("n_tokens"), F.aggregate("x", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
