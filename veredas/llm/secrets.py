"""Secret scan: fixed patterns plus a linear-chain conditional random field.

Three patterns (``assign``, ``access``, ``hex``) always count. Beside them a
linear-chain CRF tags tokens as begin, inside or outside of a secret from the
token's shape, its neighbours and features of the whole text, decoded by
Viterbi; a tagged span that touches no pattern span is added as kind ``crf``.

Every token of a text can be tagged, with digits or without, and whole texts are decoded. A word's
part of the scores is looked up by its kind (shape, hint, symbol), so that a text costs a few array operations; Viterbi
runs over the stretches where some path with a tag could win, which is exact. Tagged spans of fewer than ``MIN_RUN`` characters are not given back: the
patterns ask as much of a value.

The weights are trained here, on the driver, from a bounded sample
(``SAMPLE_DOCS`` documents of up to ``SAMPLE_CHARS`` characters with a pattern
hit, those with the smallest hashed ids, and as many picked without regard to hits, so that
ordinary words are learnt as such; the scan itself has no such bound) whose labels are the pattern spans. Of a text with
a secret, ``TURNS`` further copies hide the neighbouring words and hold made-up
secrets of mixed letters and digits, of several lengths, in place of the real ones, so
that shape alone can carry a decision.

A null or empty text has no spans. Texts are judged alone and whole, however long: copies get equal
results. ``scan`` ignores columns besides the id and the text, ``redact`` keeps them. Without any pattern hit in the corpus there is nothing to learn from and the
CRF adds no span.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_rows, slices, trim

SAMPLE_DOCS = 200
SAMPLE_CHARS = 1 << 17
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]")
_PIECE = re.compile(r"[A-Za-z0-9]+|[\x20\x09-\x0D]+|[^\x20\x09-\x0DA-Za-z0-9]")
_TURN = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
_HINT = re.compile(r"(?:pass|secret|token|key|auth|cred|bearer|pwd)", re.I | re.A)
MIN_RUN = 8
B, I, O = 0, 1, 2  # noqa: E741
#: Copies of a training text with made-up secrets, and the secrets' lengths.
TURNS = 4
MADE_UP_SIZES = tuple(range(16, 49))
DIM = 1 << 12


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, by start and then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


@dataclass
class Tokens:
    """The tokens of a text: starts, ends and words."""

    starts: list[int]
    ends: list[int]
    words: list[str]


def tokens(text: str) -> Tokens:
    found = list(_TOKEN.finditer(text))
    return Tokens([m.start() for m in found], [m.end() for m in found], [m.group() for m in found])


def _slot(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % DIM


class Slots(dict):
    """Slots of features, remembered for as long as a training runs."""

    def __missing__(self, feature: str) -> int:
        found = self[feature] = _slot(feature)
        return found


def _shape(w: str) -> list[str]:
    if not w.isascii() or not w.isalnum():
        return [f"sym={w}"]
    digits = sum(c.isdigit() for c in w)
    upper = sum(c.isupper() for c in w)
    lower = len(w) - digits - upper
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(w, w[1:], strict=False))
    kinds = f"{'d' * (digits > 0)}{'u' * (upper > 0)}{'l' * (lower > 0)}"
    return [f"kind={kinds}", f"len={min(len(w) // 4, 10)}", f"kindlen={kinds}{min(len(w) // 4, 10)}", f"turns={min(turns, 8)}", f"hex={set(w) <= set('0123456789abcdef')}"]


_NEAR = (-3, -2, -1, 1, 2)
_EDGE = "<edge>"


def _beside(w: str, k: int) -> list[str]:
    """What a word gives to the token whose neighbour ``k`` it is."""
    return [f"hint{'<' if k < 0 else '>'}"] * bool(_HINT.search(w)) + [f"near{k}={w}"] * (not w.isalnum())


def _near(s: Tokens, i: int) -> list[str]:
    out = [f for k in _NEAR for f in _beside(s.words[i + k] if 0 <= i + k < len(s.words) else _EDGE, k)]
    if i and s.ends[i - 1] == s.starts[i]:
        out.append("glued")
    return out


def _file(text: str, n_digit: int) -> list[str]:
    """Features of the whole text; ``n_digit`` of its tokens hold a digit."""
    return [f"filesize={len(text).bit_length() // 3}", f"filedense={min(8, (1000 * n_digit // max(1, len(text))).bit_length())}", f"filehint={bool(_HINT.search(text))}"]


def _has_digit(w: str) -> bool:
    return w.isascii() and any(c.isdigit() for c in w)


def _made_up(w: str, turn: int = 0) -> str:
    """Letters and digits in place of a word's, a function of the word and the turn; after turn 0 of another length."""
    if not w.isalnum() or len(w) < MIN_RUN:
        return w
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    seed = hashlib.blake2b(f"{turn}:{w}".encode("utf-8", "surrogatepass")).digest()
    size = MADE_UP_SIZES[seed[-1] % len(MADE_UP_SIZES)] if turn else len(w)
    return "".join(chars[seed[i % len(seed)] % len(chars)] for i in range(size))


def _slotted(text: str, s: Tokens, slots: Slots) -> Iterator[list[int]]:
    whole = [slots[f] for f in _file(text, sum(map(_has_digit, s.words)))]
    return ([slots[f] for f in _shape(w) + _near(s, i)] + whole for i, w in enumerate(s.words))


def features(text: str, s: Tokens) -> list[np.ndarray]:
    """Feature slots of every token."""
    return [np.array(f) for f in _slotted(text, s, Slots())]


@dataclass
class Crf:
    """Weights: unary (feature slot x tag) and transitions (tag x tag); inside never follows outside."""

    unary: np.ndarray
    trans: np.ndarray
    lookup: Lookup | None = field(default=None, repr=False, compare=False)

    def scores(self, feats: list[np.ndarray | None]) -> np.ndarray:
        out = np.full((len(feats), 3), -1e9)
        for i, f in enumerate(feats):
            if f is None:
                out[i, O] = 0.0
            else:
                out[i] = self.unary[f].sum(0)
        out[0, I] = -1e9
        return out

    def viterbi(self, feats: list[np.ndarray | None]) -> list[int]:
        return self.best_path(self.scores(feats))

    def open_runs(self, u: np.ndarray) -> list[tuple[int, int]]:
        """Runs of tokens outside which every best path is ``outside``.

        Turning a stretch of other tags to ``outside`` changes a path by at most the sum of its tokens' gains, each with
        the best transition into it, and the best transition back. A token for which no stretch around it has a sum of 0 or more is
        outside in every best path, so that Viterbi has to run over the others only.
        """
        t = self.trans
        gain = np.maximum(u[:, B] - u[:, O] + t[:, B].max(), u[:, I] - u[:, O] + t[:2, I].max()) - t[O, O]
        back = max(t[B, O], t[I, O]) - t[O, O]
        # The borders of a text have one transition less.
        gain[0] = max(u[0, B], u[0, I]) - u[0, O] - min(0.0, t[O, O])
        gain[-1] += abs(t).clip(max=1e6)[:, O].max() - min(0.0, back)
        total = np.cumsum(gain)
        upto = total - np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
        after = np.maximum.accumulate(total[::-1])[::-1] - total
        at = np.flatnonzero(upto + after + back >= -1e-6)
        if not len(at):
            return []
        cut = np.flatnonzero(np.diff(at) > 1)
        return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + 1).tolist(), strict=True))

    def decode(self, u: np.ndarray) -> np.ndarray:
        """The best path, by Viterbi over the open runs; a run is closed by outside tokens on both sides."""
        out = np.full(len(u), O, dtype=np.int8)
        for lo, hi in self.open_runs(u):
            first, last = max(lo - 1, 0), min(hi + 1, len(u))
            part = u[first:last].copy()
            for k, inner in ((0, lo == 0), (-1, hi == len(u))):
                if not inner:
                    part[k, :O] = -1e9
            out[lo:hi] = self.best_path(part)[lo - first : hi - first]
        return out

    def best_path(self, u: np.ndarray) -> list[int]:
        """Viterbi over the scores of the tags; inside never follows outside."""
        (bb, bi, bo), (ib, ii, io), (ob, _, oo) = self.trans.tolist()
        rows = u.tolist()
        b, i, o = rows[0]
        back = []
        for ub, ui, uo in rows[1:]:
            fb, to_b = b + bb, B
            if i + ib > fb:
                fb, to_b = i + ib, I
            if o + ob > fb:
                fb, to_b = o + ob, O
            fo, to_o = o + oo, O
            if b + bo > fo:
                fo, to_o = b + bo, B
            if i + io > fo:
                fo, to_o = i + io, I
            if b + bi >= i + ii:
                fi, to_i = b + bi, B
            else:
                fi, to_i = i + ii, I
            back.append((to_b, to_i, to_o))
            b, i, o = fb + ub, fi + ui, fo + uo
        path = [max((b, B), (i, I), (o, O))[1]]
        for x in reversed(back):
            path.append(x[path[-1]])
        return path[::-1]


def _kind(w: str) -> tuple:
    """All that the features of a word depend on: a symbol itself, of other words the shape and whether a hint is in it."""
    if not w.isascii() or not w.isalnum():
        return (w,)
    if w.isalpha():
        kinds, turns = "u" * (not w.islower()) + "l" * (not w.isupper()), 0
    elif w.isdigit():
        kinds, turns = "d", 0
    else:
        kinds, turns = "d" + "u" * (w != w.lower()) + "l" * (w != w.upper()), min(len(_TURN.findall(w)), 8)
    return kinds, min(len(w) // 4, 10), turns, not w.strip("0123456789abcdef"), _HINT.search(w) is not None


class Lookup:
    """Scores of texts under a model: the parts that depend on one word are kept by the word's kind, and the kind by word."""

    MOST = 1 << 16

    def __init__(self, model: Crf) -> None:
        self.unary = model.unary
        self.glued = self.vector(["glued"])
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.table = np.zeros((1 << 10, 3 * (1 + len(_NEAR))))
        self.space, self.digit = np.zeros(1 << 10, dtype=bool), np.zeros(1 << 10, dtype=bool)
        self.add(_EDGE)
        self.add(" ")

    def vector(self, names: list[str]) -> np.ndarray:
        return self.unary[[_slot(f) for f in names]].sum(0) if names else np.zeros(3)

    def add(self, w: str) -> int:
        kind = (" ",) if w[0] in " \t\n\x0b\x0c\r" else _kind(w)
        k = self.kinds.get(kind)
        if k is None:
            k = self.kinds[kind] = len(self.kinds)
            if k == len(self.table):
                self.table, self.space, self.digit = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.space, self.digit))
            self.space[k] = kind == (" ",)
            if not self.space[k]:
                self.table[k] = np.concatenate([self.vector(_shape(w)), *(self.vector(_beside(w, j)) for j in _NEAR)])
                self.digit[k] = _has_digit(w)
        self.ids[w] = k
        return k

    def scores(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and tag scores of the tokens of a text."""
        pieces = _PIECE.findall(text)
        if len(self.ids) > self.MOST:
            self.clear()
        ids, add = self.ids, self.add
        w = np.array([ids[p] if p in ids else add(p) for p in pieces], dtype=np.int64)
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(lens)
        token = np.flatnonzero(~self.space[w])
        n = len(token)
        starts, ends = (ends - lens)[token], ends[token]
        edge = np.full(3, ids[_EDGE])
        rows = self.table[np.concatenate([edge, w[token], edge[:2]])]
        u = rows[3 : n + 3, :3].copy()
        for j, k in enumerate(_NEAR):
            u += rows[3 + k : 3 + k + n, 3 * (j + 1) : 3 * (j + 2)]
        u[1:][ends[:-1] == starts[1:]] += self.glued
        u += self.vector(_file(text, int(self.digit[w].sum())))
        u[:1, I] = -1e9
        return starts, ends, u


@dataclass(frozen=True)
class Sequence:
    """A training text: feature slots of its tokens end to end, how many each token has, and the tags. Kept small, as the driver holds all of them."""

    slots: np.ndarray
    sizes: np.ndarray
    tags: np.ndarray

    @classmethod
    def of(cls, feats: Iterable[list[int]], tags: list[int]) -> Sequence:
        flat, sizes = array("H"), array("B")
        for f in feats:
            flat.extend(f)
            sizes.append(len(f))
        return cls(np.frombuffer(flat, dtype=np.uint16) if len(flat) else np.zeros(0, np.uint16), np.frombuffer(sizes, dtype=np.uint8) if len(sizes) else np.zeros(0, np.uint8), np.array(tags, dtype=np.int8))


def train(sequences: list[Sequence], rounds: int = 5, rate: float = 0.3, decay: float = 1e-4) -> Crf:
    """Maximum likelihood by AdaGrad over exact forward-backward gradients."""
    m = Crf(np.zeros((DIM, 3)), np.zeros((3, 3)))
    m.trans[O, I] = -1e9
    gu, gt = np.full((DIM, 3), 1e-6), np.full((3, 3), 1e-6)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for k in order.permutation(len(sequences)):
            x = sequences[k]
            n = len(x.tags)
            slots, at, gold = x.slots.astype(np.int64), np.repeat(np.arange(n), x.sizes), np.eye(3)[x.tags]
            u = np.stack([np.bincount(at, m.unary[slots, t], minlength=n) for t in range(3)], axis=1)
            u[0, I] = -1e9
            p, pairs = _marginals(u, m.trans)
            dt = gold[:-1].T @ gold[1:] - pairs
            dt[O, I] = 0.0
            gt += dt**2
            m.trans += rate * dt / np.sqrt(gt)
            d = gold - p
            d[0, I] = 0.0
            used, place = np.unique(slots, return_inverse=True)
            g = np.stack([np.bincount(place, d[at, t], minlength=len(used)) for t in range(3)], axis=1) - decay * m.unary[used]
            gu[used] += g**2
            m.unary[used] += rate * g / np.sqrt(gu[used])
    return m


def _marginals(u: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact tag marginals of every token, and expected transitions: forward-backward, scaled at each step."""
    step = np.exp(trans)
    e = np.exp(u - u.max(1, keepdims=True))
    (bb, bi, bo), (ib, ii, io), (ob, oi, oo) = step.tolist()
    rows = e.tolist()
    x, y, z = rows[0]
    s = x + y + z
    x, y, z = x / s, y / s, z / s
    ahead = [(x, y, z)]
    for eb, ei, eo in rows[1:]:
        x, y, z = (x * bb + y * ib + z * ob) * eb, (x * bi + y * ii + z * oi) * ei, (x * bo + y * io + z * oo) * eo
        s = x + y + z
        x, y, z = x / s, y / s, z / s
        ahead.append((x, y, z))
    x = y = z = 1.0
    behind = [(x, y, z)]
    for eb, ei, eo in reversed(rows[1:]):
        x, y, z = x * eb, y * ei, z * eo
        x, y, z = bb * x + bi * y + bo * z, ib * x + ii * y + io * z, ob * x + oi * y + oo * z
        s = x + y + z
        x, y, z = x / s, y / s, z / s
        behind.append((x, y, z))
    f, b = np.array(ahead), np.array(behind[::-1])
    p = f * b
    p /= p.sum(1, keepdims=True)
    joint = f[:-1, :, None] * step * (e[1:] * b[1:])[:, None, :]
    return p, (joint / joint.sum((1, 2), keepdims=True)).sum(0)


def _secret_part(text: str, span: tuple[int, int, str]) -> tuple[int, int]:
    """Of an assignment, the value; the other kinds are secrets as a whole."""
    if span[2] != "assign":
        return span[0], span[1]
    m = _ASSIGN.match(text, span[0])
    return m.start(2), m.end(2)


def training_sequences(texts: list[str]) -> list[Sequence]:
    out, slots = [], Slots()
    for text in texts:
        gold = [_secret_part(text, s) for s in pattern_spans(text)]
        s = tokens(text)
        tags, before, k = [], None, 0
        gold.sort()
        for a, b in zip(s.starts, s.ends, strict=True):
            while k < len(gold) and gold[k][1] <= a:
                k += 1
            hit = next((g for g in itertools.takewhile(lambda g: g[0] <= a, gold[k:]) if b <= g[1]), None)  # noqa: B023
            tags.append(O if hit is None else I if hit == before else B)
            before = hit
        whole = [slots[f] for f in _file(text, sum(map(_has_digit, s.words)))]
        if not tags:
            continue
        out.append(Sequence.of(_slotted(text, s, slots), tags))
        for turn in range(1 if all(t == O for t in tags) else TURNS):
            words = (w if t == O else _made_up(w, turn) for w, t in zip(s.words, tags, strict=True))
            out.append(Sequence.of(([slots[f] for f in _shape(w)] + whole for w in words), tags))
    return out


def crf_spans(text: str, model: Crf) -> list[tuple[int, int]]:
    if model.lookup is None:
        model.lookup = Lookup(model)
    starts, ends, u = model.lookup.scores(text)
    if not len(u):
        return []
    tags = model.decode(u)
    out: list[tuple[int, int]] = []
    last = -2
    for i in np.flatnonzero(tags != O).tolist():
        if tags[i] == I and last == i - 1:
            out[-1] = (out[-1][0], int(ends[i]))
        else:
            out.append((int(starts[i]), int(ends[i])))
        last = i
    return [(a, b) for a, b in out if b - a >= MIN_RUN]


def all_spans(text: str, model: Crf | None) -> list[tuple[int, int, str]]:
    base = pattern_spans(text)
    if model is None:
        return base
    more = [(a, b, "crf") for a, b in crf_spans(text, model) if all(b <= s or e <= a for s, e, _ in base)]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


_HIT = r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}"
#: The sample is sought among this many documents for each one wanted first, then among more.
SOUGHT = 64


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Crf | None:
    """Trains on at most ``sample_docs`` documents with a pattern hit, and as many of any kind (smallest hashes of id and text first; a repeated row counts once).

    The hash is tested before the patterns and its bound raised until enough documents hit, so that
    the patterns do not run over the corpus unless hits are rare in it.
    """
    body, key = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    able = docs.select(F.xxhash64(key, body).alias("h"), key.alias("id"), body.alias("t")).where(F.col("id").isNotNull() & (F.length("t") <= SAMPLE_CHARS))
    hit = F.col("t").rlike(_HIT)
    total, share = max(1, docs.count()), SOUGHT
    while True:
        bound = (1 << 63) - 1 if share * sample_docs >= total else -(1 << 63) + (1 << 64) * share * sample_docs // total
        some = able.where(F.col("h") <= bound)
        # Only hashes come to the driver at first; the texts of the chosen rows follow.
        hits = [r.h for r in some.where(hit).select("h").distinct().orderBy("h").limit(sample_docs).collect()]
        if len(hits) == sample_docs or bound == (1 << 63) - 1:
            break
        share *= 16
    if not hits:
        return None
    every = [r.h for r in some.select("h").distinct().orderBy("h").limit(sample_docs).collect()]
    rows = [(r.h, r.id, r.t) for r in some.where((F.col("h") <= every[-1]) | ((F.col("h") <= hits[-1]) & hit)).distinct().collect()]
    pattern = re.compile(_HIT.replace("(?i:", "(?ai:"))
    found = sorted(rows)[:sample_docs] + sorted(r for r in rows if pattern.search(r[2]))[:sample_docs]
    sequences = training_sequences([t for _, _, t in sorted(set(found))])
    return train(sequences) if sequences else None


def scan(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id and ``spans``: array of (start, end, kind), code points, end exclusive."""
    return map_rows(
        id_text(docs),
        lambda ids, bodies: {"doc_id": ids, "spans": [[{"start": s, "end": e, "kind": k} for s, e, k in all_spans(b.decode("utf-8", "replace"), model)] for b in bodies]},
        "doc_id long, spans array<struct<start: long, end: long, kind: string>>",
    )


def redact_text(text: str, model: Crf | None, mark: str) -> str:
    out, at = [], 0
    for s, e, kind in all_spans(text, model):
        a, b = _secret_part(text, (s, e, kind))
        if b <= at:
            continue
        out += [text[at : max(a, at)], mark]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Crf | None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by ``mark``; all columns stay, null texts stay null.

    Of an assignment only the value goes. Runs beside the row, without a shuffle.
    """

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        done = []
        for lo, hi in slices(texts, 1 << 20):
            done.append(pa.array([t if t is None else redact_text(t, model, mark) for t in texts.slice(lo, hi - lo).to_pylist()], type=pa.string()))
        trim()
        return pa.concat_arrays(done) if done else pa.array([], type=pa.string())

    return docs.withColumn("text", masked(F.col("text")))
