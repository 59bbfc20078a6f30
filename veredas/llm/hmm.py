"""Language-model scores by a hidden Markov model over words.

Tokens are white-space words (A-Z lower-cased) and one end token a text. Hidden
states emit classes: each of the ``TOP_WORDS`` most frequent training words is a class of
its own, the others share ``HASHED`` classes by hash, and inside a class a word has its
add-one share of the class's training count (one further share is kept for words that
training never saw). Class counts, word counts and the states' expected counts are gathered
from all training texts.

Work is cut into chunks of documents by hashed id (about ``CHUNK_BYTES`` of text):

1. every chunk lists its distinct words with their training counts, so that a word travels once
   a chunk however often it occurs;
2. words are dealt by hash, totals summed, and each chunk gets the totals of its own words back;
   no task and no broadcast ever holds the corpus's vocabulary;
3. Baum-Welch: chunks compute expected counts by scaled forward-backward over whole texts. Long
   ones are worked on in stretches of ``STRETCH`` tokens side by side, with the exact messages over the cuts (products of the
   stretches' steps), so that the counts are those of the uncut texts; the counts (states x classes, a fixed size) are summed across
   partitions in two levels and the driver re-estimates;
4. the scaled forward recursion over whole texts gives the exact likelihood.

A null or empty text has only the end token. Copies get equal scores; rows that
share an id stay apart, and columns besides the id and the text are ignored. An empty training set leaves a uniform model;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, id_text, materialize, n_parts, offsets_of, text_bytes

CHUNK_BYTES = 8 << 20
STATES = 8
ITERATIONS = 6
TOP_WORDS = 16_384
HASHED = 2_048
STRETCH = 256
BATCH_TOKENS = 1 << 17
PRIOR = 200.0
#: Steps between rescalings: eight probabilities of 1e-30 are still far from the least double.
RESCALE = 8
END = b"\n"
BLOCK = 1_024

_CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, lens array<int>, words array<binary>, counts array<int>, tokens binary"
_DEALT = "bucket long, chunk long, at array<int>, words array<binary>, counts array<int>"
_TOTALS = "bucket long, chunk long, at array<int>, counts array<long>, words array<binary>, mass array<long>, n long, v long"
_ENCODED = "doc_ids array<long>, held array<boolean>, lens array<int>, n_known array<int>, base array<double>, inner array<double>, classes binary"


def split_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, body, chunk, held (never trained on)."""
    texts = id_text(docs)
    n = n_parts(text_bytes(texts), CHUNK_BYTES)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return texts.select("doc_id", "body", F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("chunk"), held.alias("held"))


def _cell(value: object, kind: pa.DataType) -> pa.Array:
    """A column of one row; arrays become lists without a Python object for each element."""
    if pa.types.is_list(kind) and isinstance(value, np.ndarray | pa.Array):
        values = pa.array(value) if isinstance(value, np.ndarray) else value
        return pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), values.cast(kind.value_type))
    return pa.array([value], type=kind)


def _row(schema: pa.Schema, *values: object) -> pa.Table:
    return pa.Table.from_arrays([_cell(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def list_words(chunks: DataFrame) -> DataFrame:
    """One row a chunk: documents, distinct words with training counts, and token numbers into those words."""
    arrow = arrow_schema(_CHUNKS)

    def f(key: tuple, group: pa.Table) -> pa.Table:
        vocab: dict[bytes, int] = defaultdict(count(1).__next__)
        vocab[END] = 0
        lens, parts, held = [], [], group.column("held").to_pylist()
        for body in group.column("body").to_pylist():
            words = body.lower().split()
            ids = np.fromiter(map(vocab.__getitem__, words), dtype=np.int32, count=len(words))
            parts += [ids, np.zeros(1, np.int32)]
            lens.append(len(words) + 1)
        tokens = np.concatenate(parts)
        trained = np.repeat(~np.array(held, dtype=bool), lens)
        counts = np.bincount(tokens[trained], minlength=len(vocab))
        return _row(arrow, key[0].as_py(), group.column("doc_id").to_pylist(), held, lens, list(vocab), counts, tokens.astype("<i4").tobytes())

    return chunks.groupBy("chunk").applyInArrow(f, _CHUNKS)


def hashed_class(word: bytes) -> int:
    return zlib.crc32(word, 1) % HASHED


def total_counts(chunks: DataFrame, n_buckets: int) -> DataFrame:
    """Corpus totals of every chunk's words (rows with a chunk), and per bucket its statistics (chunk null)."""
    dealt_schema, total_schema = arrow_schema(_DEALT), arrow_schema(_TOTALS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values
                counts = np.asarray(batch.column("counts")[i].values)
                bucket = np.fromiter((zlib.crc32(w) for w in words.to_pylist()), dtype=np.int64, count=len(words)) % n_buckets
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                chunk = batch.column("chunk")[i].as_py()
                for b in range(n_buckets):
                    at = order[ends[b] : ends[b + 1]]
                    if len(at):
                        yield _row(dealt_schema, b, chunk, at, words.take(pa.array(at)), counts[at]).to_batches()[0]

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        lists = [(c, at, w, n) for c, at, w, n in zip(*(group.column(x).to_pylist() for x in ("chunk", "at", "words", "counts")), strict=True)]
        for _, _, words, counts in lists:
            for w, n in zip(words, counts, strict=True):
                total[w] = total.get(w, 0) + n
        b = key[0].as_py()
        out = [_row(total_schema, b, c, at, np.fromiter(map(total.__getitem__, words), dtype=np.int64, count=len(words)), [], [], 0, 0) for c, at, words, _ in lists]
        names, n = list(total), np.fromiter(total.values(), dtype=np.int64, count=len(total))
        kind = np.fromiter((zlib.crc32(w, 1) for w in names), dtype=np.int64, count=len(names)) % HASHED
        mass = np.bincount(kind[n > 0], weights=n[n > 0] + 1, minlength=HASHED).astype(np.int64)
        least = max(1, int(np.partition(n, -TOP_WORDS)[-TOP_WORDS])) if len(n) > TOP_WORDS else 1
        top = sorted(((int(n[i]), names[i]) for i in np.flatnonzero(n >= least)), key=lambda x: (-x[0], x[1]))[:TOP_WORDS]
        out.append(_row(total_schema, b, None, [], [n for n, _ in top], [w for _, w in top], mass, int(n.sum()), int((n > 0).sum())))
        return pa.concat_tables(out)

    return chunks.select("chunk", "words", "counts").mapInArrow(deal, _DEALT).groupBy("bucket").applyInArrow(add, _TOTALS)


@dataclass
class Words:
    """What the driver knows of the vocabulary; its size does not depend on the corpus."""

    n: int
    v: int
    top: dict[bytes, int]
    class_mass: np.ndarray

    @classmethod
    def gather(cls, totals: DataFrame) -> Words:
        stats = totals.where("chunk is null")
        n, v = stats.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        mass = np.zeros(HASHED, dtype=np.int64)
        for r in stats.select(F.posexplode("mass").alias("c", "m")).groupBy("c").agg(F.sum("m").alias("m")).collect():
            mass[r.c] = r.m
        each = stats.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts")
        # How many words there are by logarithm of the count (a few thousand rows at most) bounds what comes to the driver:
        # the wanted words, and those of about the count of the last one.
        step = F.floor(F.log2("counts") * 64)
        sizes = sorted(((r.s, r.n) for r in each.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
        least, held = None, 0
        for least, n_words in sizes:  # noqa: B007
            held += n_words
            if held >= TOP_WORDS:
                break
        found = each.where(step >= least).collect() if sizes else []
        best = sorted(found, key=lambda r: (-r["counts"], bytes(r["words"])))[:TOP_WORDS]
        top = {}
        own = np.zeros(len(best), dtype=np.int64)
        for i, r in enumerate(best):
            w = bytes(r["words"])
            top[w] = i
            own[i] = r["counts"] + 1
            mass[hashed_class(w)] -= r["counts"] + 1
        return cls(n, v, top, np.concatenate([own, mass + 1]))

    @property
    def share(self) -> np.ndarray:
        return self.class_mass / self.class_mass.sum()


def encode(chunks: DataFrame, totals: DataFrame, words: Words) -> DataFrame:
    """Per chunk: class numbers, and per document the part of the score that no state changes."""
    arrow = arrow_schema(_ENCODED)
    n_top, norm = len(words.top), words.n + words.v + 1

    def f(key: tuple, back: pa.Table, chunk: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return arrow.empty_table()
        row = {c: chunk.column(c)[0] for c in chunk.column_names}
        names = row["words"].values.to_pylist()
        c = np.zeros(len(names), dtype=np.int64)
        for at, counts in zip(back.column("at"), back.column("counts"), strict=True):
            c[np.asarray(at.values)] = np.asarray(counts.values)
        kind = np.fromiter((words.top.get(w, -1) for w in names), dtype=np.int64, count=len(names))
        rare = np.flatnonzero(kind < 0)
        kind[rare] = n_top + np.fromiter((zlib.crc32(names[i], 1) for i in rare), dtype=np.int64, count=len(rare)) % HASHED
        inner = np.log10((c + 1) / words.class_mass[kind])
        base = np.log10((c + 1) / norm)
        tokens = np.frombuffer(row["tokens"].as_py(), dtype="<i4")
        lens = np.asarray(row["lens"].values)
        at = offsets_of(lens)[:-1]
        sums = [np.add.reduceat(x[tokens], at) for x in ((c > 0).astype(np.int64), base, inner)]
        return _row(arrow, row["doc_ids"].values, row["held"].values, lens, *sums, kind[tokens].astype("<u2").tobytes())

    left = totals.where("chunk is not null").select("chunk", "at", "counts").groupBy("chunk")
    return left.cogroup(chunks.select("chunk", "doc_ids", "held", "lens", "words", "tokens").groupBy("chunk")).applyInArrow(f, _ENCODED)


@dataclass
class Model:
    """Initial, transition and emission probabilities (classes x states)."""

    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, share: np.ndarray, states: int, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        emit = share[:, None] * (0.5 + rng.random((len(share), states)))
        trans = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), trans, emit / emit.sum(0))

    def next(self, counts: list[np.ndarray], share: np.ndarray) -> Model:
        start, trans, emit = counts
        start, trans = start + 1.0, trans + 1.0
        emit = emit + PRIOR * share[:, None]
        return Model(start / start.sum(), trans / trans.sum(1, keepdims=True), emit / emit.sum(0))


def _steps(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by falling length, and how many are still running at each step."""
    order = np.argsort(-lens, kind="stable")
    running = np.searchsorted(-lens[order], -np.arange(int(lens.max(initial=0))), side="left")
    return order, running


@dataclass
class Stretches:
    """Sequences cut into stretches of at most STRETCH tokens, with the messages over the cuts.

    ``left``: the scaled forward message of the token before (zeros at a sequence's start); ``right``: the scaled
    backward message of the last token (ones at a sequence's end). With both, expected counts of stretches add up to
    those of the whole sequences.
    """

    at: np.ndarray
    lens: np.ndarray
    first: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def cut(cls, model: Model, tokens: np.ndarray, at: np.ndarray, lens: np.ndarray) -> Stretches:
        n = -(-lens // STRETCH)
        doc = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        at, lens = at[doc] + k * STRETCH, np.minimum(lens[doc] - k * STRETCH, STRETCH)
        states = len(model.start)
        left, right = np.zeros((len(doc), states)), np.ones((len(doc), states))
        parts = np.flatnonzero(n[doc] > 1)
        if len(parts):
            q = np.empty((len(parts), states, states))
            for lot in _batches(lens[parts]):
                q[lot] = products(model, tokens, at[parts[lot]], lens[parts[lot]])
            place = np.full(len(doc), -1)
            place[parts] = np.arange(len(parts))
            last = n[doc] - 1
            for step in range(1, int(n.max())):
                here = np.flatnonzero((k == step) & (n[doc] > 1))
                before = here - 1
                source = model.start if step == 1 else left[before] @ model.trans
                message = np.einsum("ns,nst->nt", np.broadcast_to(source, (len(here), states)), q[place[before]])
                left[here] = message / message.sum(1, keepdims=True)
                back = np.flatnonzero((last - k == step) & (n[doc] > 1))
                after = back + 1
                message = np.einsum("nst,nt->ns", q[place[after]], right[after]) @ model.trans.T
                right[back] = message / message.sum(1, keepdims=True)
        return cls(at, lens, k == 0, left, right)


def products(model: Model, tokens: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """What a stretch does to a message: emissions of its first token, then transition and emission of each other, up to a factor."""
    order, running = _steps(lens)
    at, states = at[order], len(model.start)
    out = np.empty((len(lens), states, states))
    q = np.zeros((0, 0, 0))
    for t, n in enumerate(running):
        e = model.emit.take(tokens.take(at[:n] + t), axis=0)[:, None, :]
        q = np.eye(states) * e if t == 0 else (q[:n].reshape(-1, states) @ model.trans).reshape(n, states, states) * e
        if t % RESCALE == RESCALE - 1:
            q /= q.sum((1, 2))[:, None, None]
        m = running[t + 1] if t + 1 < len(running) else 0
        if n > m:
            out[order[m:n]] = q[m:] / q[m:].sum((1, 2))[:, None, None]
    return out


def expected(model: Model, tokens: np.ndarray, s: Stretches, part: np.ndarray, out: list[np.ndarray]) -> None:
    """Adds the expected start, transition and emission counts of some stretches to ``out``."""
    order, running = _steps(s.lens[part])
    part = part[order]
    at, left, right, first = s.at[part], s.left[part], s.right[part], s.first[part]
    states, ones = len(model.start), np.ones(len(model.start))
    emit, trans, back = model.emit, model.trans, np.ascontiguousarray(model.trans.T)
    forward, weighted, seen = [], [], []
    for t, n in enumerate(running):
        o = tokens.take(at[:n] + t)
        e = emit.take(o, axis=0)
        a = (np.where(first[:, None], model.start, left @ trans) if t == 0 else forward[-1][:n] @ trans) * e
        if t % RESCALE == RESCALE - 1:
            x = 1.0 / (a @ ones)[:, None]
            a *= x
            e *= x
        forward.append(a)
        weighted.append(e)
        seen.append(o)
    xi = np.zeros_like(trans)
    beta = np.ones((0, states))
    for t in range(len(running) - 1, -1, -1):
        n, m, w = running[t], len(beta), weighted[t]
        if n > m:  # rows that end here
            last = right[m:n] / (forward[t][m:] * right[m:n]).sum(1, keepdims=True)
            beta = np.concatenate([beta, last])
        w *= beta
        xi += (forward[t - 1][:n] if t else left).T @ w
        # From here on the state's posterior takes the place of its forward value.
        forward[t] *= beta
        beta = w @ back
    out[0] += forward[0][first].sum(0)
    out[1] += xi * trans
    cell = np.concatenate(seen).astype(np.int64)[:, None] * states + np.arange(states)
    out[2] += np.bincount(cell.ravel(), weights=np.concatenate(forward).ravel(), minlength=out[2].size).reshape(out[2].shape)


def log10_likelihood(model: Model, tokens: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Scaled forward recursion over whole sequences."""
    order, running = _steps(lens)
    at = at[order]
    total, ones = np.zeros(len(lens)), np.ones(len(model.start))
    a = np.zeros((0, 0))
    for t, n in enumerate(running):
        a = (model.start if t == 0 else a[:n] @ model.trans) * model.emit.take(tokens.take(at[:n] + t), axis=0)
        if t % RESCALE == RESCALE - 1:
            s = a @ ones
            a /= s[:, None]
            total[:n] += np.log10(s)
        m = running[t + 1] if t + 1 < len(running) else 0
        if n > m:  # rows that end here
            total[m:n] += np.log10(a[m:] @ ones)
    out = np.empty(len(lens))
    out[order] = total
    return out


def _batches(lens: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers, long rows first, in lots of about BATCH_TOKENS tokens."""
    order = np.argsort(-lens, kind="stable")
    lot = (np.cumsum(lens[order]) - 1) // BATCH_TOKENS
    for part in np.split(order, np.flatnonzero(np.diff(lot)) + 1):
        if len(part):
            yield part


_PARTIAL = "lot long, block int, body binary"
_PARTIAL_ARROW = pa.schema([("lot", pa.int64()), ("block", pa.int32()), ("body", pa.binary())])


def _add_bodies(key: tuple, group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, dtype="<f8") for x in group.column("body").to_pylist())
    return _row(_PARTIAL_ARROW, key[0].as_py(), key[1].as_py(), total.tobytes())


def baum_welch(encoded: DataFrame, share: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    """Expected counts from all training texts, summed across partitions; the model is of a fixed size."""
    model = Model.first(share, states)
    texts = encoded.select("held", "lens", "classes")
    fan = max(1, round(texts.rdd.getNumPartitions() ** 0.5))
    for _ in range(iterations):

        def partial(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            out = [np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)]
            for batch in batches:
                for row in batch.to_pylist():
                    tokens = np.frombuffer(row["classes"], dtype="<u2")
                    lens = np.array(row["lens"], dtype=np.int64)
                    kept = ~np.array(row["held"], dtype=bool)
                    s = Stretches.cut(model, tokens, offsets_of(lens)[:-1][kept], lens[kept])
                    for part in _batches(s.lens):
                        expected(model, tokens, s, part, out)
            lot = TaskContext.get().partitionId() % fan
            blocks = [np.concatenate([out[0], out[1].ravel()])] + [out[2][i : i + BLOCK].ravel() for i in range(0, len(out[2]), BLOCK)]
            for i, b in enumerate(blocks):
                yield _row(_PARTIAL_ARROW, lot, i, b.astype("<f8").tobytes()).to_batches()[0]

        some = texts.mapInArrow(partial, _PARTIAL).groupBy("lot", "block").applyInArrow(_add_bodies, _PARTIAL)
        every = some.withColumn("lot", F.lit(0).cast("long")).groupBy("lot", "block").applyInArrow(_add_bodies, _PARTIAL)
        sums = {r.block: np.frombuffer(bytes(r.body), dtype="<f8") for r in every.collect()}
        if not sums:
            break
        small = sums.pop(0)
        emit = np.concatenate([sums[i] for i in sorted(sums)]).reshape(-1, states)
        model = model.next([small[:states], small[states:].reshape(states, states), emit], share)
    return model


def scores(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    chunks = materialize(list_words(split_chunks(docs)), "lm-chunks")
    n_chunks = chunks.select("chunk").count()
    totals = materialize(total_counts(chunks, max(1, -(-n_chunks // 2))), "lm-totals")
    words = Words.gather(totals)
    encoded = materialize(encode(chunks, totals, words), "lm-encoded")
    model = baum_welch(encoded, words.share)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    arrow = arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = np.frombuffer(row["classes"], dtype="<u2")
                lens = np.array(row["lens"], dtype=np.int64)
                at = offsets_of(lens)[:-1]
                found = np.array(row["inner"])
                for part in _batches(lens):
                    found[part] += log10_likelihood(model, tokens, at[part], lens[part])
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((row["doc_ids"], row["held"], lens, row["n_known"], row["base"], found), arrow, strict=True)], schema=arrow)

    return encoded.mapInArrow(score, schema).withColumn("train_tokens", F.lit(words.n).cast("long"))
