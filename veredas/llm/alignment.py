"""Alignment of two tokenizers over the same bytes, and how often their ids meet in a corpus.

A text with a space in front is encoded by tokenizer A (byte-level BPE; special tokens' strings are plain text) and by tokenizer B
(a SentencePiece model, which puts the space itself). Where the tokens of either, joined, are not the bytes of the text, B's normaliser
has changed it and the text counts as having no tokens; so do null and empty texts.

The tokens of B are a static interval index: as they lie end to end, their ends in order are all of it. For every token
of A two stabbing queries by bisection, at its first and its last byte, give the run of B tokens that it overlaps; each
overlap is a link. A gap between two B tokens that no A token spans is a bound of both tokenizers and closes a group. A
slice's texts are searched as one row of intervals, since each text's end is such a bound.

An id pair's count is the number of documents that hold it linked. Tasks count the distinct pairs of their documents;
the counts of all tasks are summed by pair in a shuffle, and a link is *best* where its count is the highest of its A id. The most
frequent pairs, up to ``HEAD_PAIRS``, go back to the tokens as a sorted table of that bounded size; the links of all other
pairs are joined with their counts by a shuffle. So nothing that grows with the corpus is broadcast, and no
link is left out.

Rows are judged apart whether or not ids or texts repeat, and a repeated row counts as a document of its own. Texts are encoded whole,
however long; columns besides the id and the text are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ByteBpe, default_path
from .common import arrow_schema, id_text, materialize, offsets_of, slices, trim

MODEL = "piece_bpe_32k.model"
SLICE_BYTES = 2 << 20
HEAD_PAIRS = 1 << 19
#: A ids with a highest count each: a vocabulary's length at most, checked before it is broadcast.
BROADCAST_IDS = 1_000_000
#: Pairs that a task keeps before it sums them up.
HELD_PAIRS = 1 << 22

_TOKENS = "row long, doc_id long, a binary, b binary, pairs binary, docs binary"
_JUDGED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, tail array<struct<pair: long, links: long>>"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


@dataclass
class Tokenizers:
    """Both encoders and the bytes of their ids; loaded where first used."""

    a_path: str
    b_path: str
    loaded: bool = field(default=False, repr=False)

    def load(self) -> Tokenizers:
        if not self.loaded:
            import sentencepiece

            self.a = ByteBpe(self.a_path, plain=True)
            self.b = sentencepiece.SentencePieceProcessor(model_file=self.b_path)
            pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
            b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
            self.bytes_of = [pa.array(x, type=pa.binary()) for x in (self.a.bytes_of, b_bytes)]
            self.sizes = [np.array([len(t) for t in x], dtype=np.int64) for x in (self.a.bytes_of, b_bytes)]
            # Decimal ids, followed by what closes them: inside a side, at the side's end.
            self.names = pa.array([f"{i}{c}" for n, marks in ((len(self.a.bytes_of), ",|"), (len(b_bytes), ",;")) for c in marks for i in range(n)], type=pa.string())
            self.n_b = len(b_bytes)
            self.loaded = True
        return self

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; empty where the text is, or where its bytes do not come back."""
        a = [self.a.encode(" " + t) if t else np.zeros(0, np.uint32) for t in texts]
        b = self.b.encode(texts, num_threads=1)
        lens = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
        flat = np.fromiter(itertools.chain.from_iterable(b), dtype=np.uint32, count=int(lens.sum()))
        b = np.split(flat, np.cumsum(lens)[:-1]) if len(b) else []
        for k, t in enumerate(texts):
            want = b" " + t.encode()
            if not t or any(self.joined(side, x[k]) != want for side, x in enumerate((a, b))):
                a[k] = b[k] = np.zeros(0, np.uint32)
        return a, b

    def joined(self, side: int, ids: np.ndarray) -> bytes:
        """The bytes of a row of tokens."""
        return _laid(pc.take(self.bytes_of[side], pa.array(ids)))


def _laid(x: pa.Array) -> bytes:
    """All values of a string or binary array end to end."""
    if not len(x):
        return b""
    at = np.frombuffer(x.buffers()[1], dtype=np.int32, count=len(x) + 1, offset=4 * x.offset)
    return x.buffers()[2][int(at[0]) : int(at[-1])].to_pybytes() if at[-1] > at[0] else b""


@dataclass
class Aligned:
    """Tokens of several texts end to end: ids, the number per text, links, and the groups that a token is in."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray

    @property
    def doc_of_a(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_a)), self.n_a)


def align_tokens(a: list[np.ndarray], b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Links and groups of texts whose two rows of tokens cover the same bytes."""
    n_a, n_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
    ids_a, ids_b = (np.concatenate(side).astype(np.int64) if side else np.zeros(0, np.int64) for side in (a, b))
    end_a, end_b = np.cumsum(a_sizes[ids_a]), np.cumsum(b_sizes[ids_b])
    # The index: B's ends. The token over byte x is the first that ends behind it.
    first = np.searchsorted(end_b, end_a - a_sizes[ids_a], side="right")
    last = np.searchsorted(end_b, end_a - 1, side="right")
    many = last - first + 1
    link_a = np.repeat(np.arange(len(ids_a)), many)
    link_b = np.repeat(first, many) + np.arange(len(link_a)) - np.repeat(np.cumsum(many) - many, many)
    # A token of A that overlaps B tokens k to m spans the gaps k to m - 1.
    spanned = np.zeros(len(ids_b) + 1, dtype=np.int64)
    np.add.at(spanned, first, 1)
    np.add.at(spanned, last, -1)
    open_gap = np.cumsum(spanned)[: len(ids_b)] > 0
    group_b = np.cumsum(np.concatenate([[0], ~open_gap[:-1]])) if len(ids_b) else np.zeros(0, np.int64)
    return Aligned(ids_a, ids_b, n_a, n_b, link_a, link_b, group_b[last] if len(ids_a) else np.zeros(0, np.int64), group_b.astype(np.int64))


def group_texts(x: Aligned, names: pa.Array, n_vocab_a: int, n_vocab_b: int) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``: decimal ids of A and B, in order."""
    def closing(group: np.ndarray) -> np.ndarray:
        return np.concatenate([group[1:] != group[:-1], [True]]) if len(group) else np.zeros(0, bool)

    code = np.concatenate([x.a + n_vocab_a * closing(x.group_a), 2 * n_vocab_a + x.b + n_vocab_b * closing(x.group_b)])
    order = np.argsort(np.concatenate([2 * x.group_a, 2 * x.group_b + 1]), kind="stable")
    laid = pc.take(names, pa.array(code[order]))
    at = np.frombuffer(laid.buffers()[1], dtype=np.int32, count=len(laid) + 1, offset=4 * laid.offset)
    ends = at[np.cumsum(x.n_a + x.n_b)]
    data = laid.buffers()[2]
    out, lo = [], int(at[0])
    for hi in ends.tolist():
        out.append(data[lo : hi - 1].to_pybytes() if hi > lo else b"")
        lo = hi
    return out


def pairs_of(x: Aligned, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, pair) of the links: text, pair (A id * B's vocabulary + B id), and how many links each has."""
    key = (x.doc_of_a[x.link_a] << 40) | (x.a[x.link_a] * n_b + x.b[x.link_b])
    key, links = np.unique(key, return_counts=True)
    return key >> 40, key & ((1 << 40) - 1), links


class PairCounts:
    """Documents by pair, summed up whenever many have come together."""

    def __init__(self) -> None:
        self.keys, self.counts, self.n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, pairs: np.ndarray) -> None:
        keys, counts = np.unique(pairs, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(keys)
        if self.n > HELD_PAIRS:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(at, np.concatenate(self.counts), minlength=len(keys)).astype(np.int64)
        self.keys, self.counts, self.n = [keys], [counts], 0
        return keys, counts


def tokens(docs: DataFrame, tools: Tokenizers) -> DataFrame:
    """Both rows of ids of every document, and, in rows of their own, the documents by pair of each task. Written once."""
    arrow = arrow_schema(_TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, row, seen = tools.load(), TaskContext.get().partitionId() << 33, PairCounts()
        for batch in batches:
            for lo, hi in slices(batch.column("body"), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                a, b = t.encode([str(x, "utf-8", "replace") for x in part.column("body").to_pylist()])
                seen.add(pairs_of(align_tokens(a, b, *t.sizes), t.n_b)[1])
                n = part.num_rows
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), part.column("doc_id"), *(pa.array([x.astype("<u2" if small else "<u4").tobytes() for x in side], type=pa.binary()) for side, small in zip((a, b), _narrow(t), strict=True)), none, none], schema=arrow)
                row += n
            trim()
        keys, counts = seen.total()
        for lo in range(0, len(keys), HELD_PAIRS >> 4):
            k, c = (x[lo : lo + (HELD_PAIRS >> 4)].astype("<i8").tobytes() for x in (keys, counts))
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((None, None, None, None, k, c), arrow, strict=True)], schema=arrow)

    return materialize(id_text(docs).mapInArrow(run, _TOKENS), "alignment-tokens")


def _narrow(t: Tokenizers) -> list[bool]:
    """Whether a side's ids fit in 16 bits."""
    return [len(x) <= 1 << 16 for x in t.sizes]


def pair_counts(made: DataFrame, n_b: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no pair of the same A id has more). Written once."""
    arrow = arrow_schema("pair long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("pairs"), batch.column("docs"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), dtype="<i8")) for x in (k, c)], schema=arrow)

    each = made.where("pairs is not null").select("pairs", "docs").mapInArrow(run, "pair long, n long")
    summed = materialize(each.groupBy("pair").agg(F.sum("n").alias("n")), "alignment-sums")
    a_id = F.expr(f"pair div {n_b}")
    top = summed.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    side = F.broadcast(top) if top.count() <= BROADCAST_IDS else top
    return materialize(summed.withColumn("a", a_id).join(side, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "alignment-pairs")


def head(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The pairs of at least so many documents that ``most`` are not exceeded (sorted; counts; best), and that bound."""
    classes = {r.c: r.k for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("c")).agg(F.count("*").alias("k")).collect()}  # 64 rows at most
    total, least = 0, 64
    for c in sorted(classes, reverse=True):
        total += classes[c]
        if total > most:
            break
        least = c
    found = pairs.where(F.col("n") >= (1 << min(least, 62))).toArrow()
    pair, n, best = (found.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return pair[order], n[order], best[order], 1 << min(min(classes, default=0) if total <= most else least, 62)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, digest: bool = False, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``.

    ``n_best``: links whose pair is a best one of its A id; ``count_sum``: the pairs' counts over all links. ``groups`` is the text of
    :func:`group_texts`; with ``digest`` its SHA-256 stands in its place (empty where there are no tokens), so that the text itself,
    longer than the document, does not leave the task.
    """
    tools = Tokenizers(a_path or default_path(), b_path or default_model())
    made = tokens(docs, tools)
    n_b = tools.load().n_b
    narrow, sizes, n_vocab = _narrow(tools), tools.sizes, [len(x) for x in tools.sizes]
    names = tools.names
    pairs = pair_counts(made, n_b)
    known, counts, best, least = head(pairs, head_pairs)
    tail = pairs.where(F.col("n") < least)
    arrow = arrow_schema(_JUDGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("a"), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                a, b = ([np.frombuffer(x, dtype="<u2" if small else "<u4") for x in part.column(c).to_pylist()] for c, small in zip("ab", narrow, strict=True))
                x = align_tokens(a, b, *sizes)
                doc, pair, links = pairs_of(x, n_b)
                n = part.num_rows
                at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
                hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                total = lambda of, w: np.bincount(of, w, minlength=n).astype(np.int64)  # noqa: E731, B023
                h = at[hit]
                out = _rows(doc[~hit], pair[~hit], links[~hit], n)
                # Integer sums: a float would lose low digits of large ones.
                count_sum = np.zeros(n, dtype=np.int64)
                np.add.at(count_sum, doc[hit], links[hit] * counts[h])
                ends_b = np.cumsum(x.n_b)
                groups = np.where(x.n_b > 0, x.group_b[np.maximum(ends_b - 1, 0)] - x.group_b[np.minimum(ends_b - x.n_b, max(len(x.group_b) - 1, 0))] + 1, 0) if len(x.group_b) else np.zeros(n, np.int64)
                texts = group_texts(x, names, *n_vocab)
                shown = [hashlib.sha256(t).hexdigest() if t else "" for t in texts] if digest else texts
                columns = [part.column("row"), part.column("doc_id"), pa.array(x.n_a), pa.array(x.n_b), pa.array(groups), pa.array(total(doc, links)), pa.array(total(doc[hit], links[hit] * best[h])), pa.array(count_sum), pa.array(shown, type=pa.string()), out]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            trim()

    judged = made.where("row is not null").select("row", "doc_id", "a", "b").mapInArrow(run, _JUDGED)
    if not tail.isEmpty():
        judged = materialize(judged, "alignment-judged")
        each = judged.select("row", F.explode("tail").alias("t")).select("row", "t.pair", "t.links").join(tail, "pair")
        more = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("best"), F.sum(F.col("links") * F.col("n")).alias("sum"))
        judged = judged.drop("tail").join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("sum", F.lit(0))})
    return judged.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def _rows(doc: np.ndarray, pair: np.ndarray, links: np.ndarray, n: int) -> pa.Array:
    """A list of (pair, links) for every document; ``doc`` is in order."""
    at = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(pair), pa.array(links.astype(np.int64))], names=["pair", "links"]))
