"""Removal of passages that an earlier document holds: every 50-byte string counts.

A byte goes if a string of WINDOW bytes that covers it also starts in a document with a smaller id.

1. *Anchors.* Every window names one of its GRAM-byte grams, the one of least hash (leftmost of equals), so that
   equal windows name equal grams at equal places. Anchors that stand in one document alone
   are sorted out by the sharing step; nothing else of them travels.
2. *Shards.* Each shared anchor sends the bytes that its windows can reach (WINDOW - GRAM to either side) to the shard
   of its hash, equal ones of a chunk of documents only once, with the list of their places.
   All windows that can be equal thus meet in a shard, whatever the document.
3. *Suffix arrays.* A shard sorts the suffixes of all its distinct contexts by induced sorting and computes the permuted common
   prefixes. Windows between which no common prefix falls below WINDOW bytes are equal; the smallest id of such a
   group removes the window everywhere else.
4. Chunks turn removed windows into removed bytes.

Strings are judged on the input. Matches never cross documents. A null or empty text has nothing
to remove; an empty table gives an empty result; columns besides the id and the text are ignored. Documents that share an id never remove each other; a null id removes nothing and loses nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, id_text, materialize, mix64, n_parts, offsets_of, release, text_bytes
from .sharing import collect_slice, identity, shared
from .suffixarray import permuted_prefixes, suffix_array

WINDOW = 50
GRAM = 24
SIDE = WINDOW - GRAM
WIDTH = WINDOW + SIDE
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
SHARD_BYTES = 2 << 20
PIECE = 1 << 20
_IDENTITY = (1 << 55) - 1

_KEYS = "doc_id long, keys binary"
_CONTEXTS = "shard int, chunk long, contexts binary, low binary, counts binary, docs binary, rows binary, places binary"
_REMOVED = "chunk long, rows binary, places binary, masks binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_TABLE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(GRAM + 1)]


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place."""
    with np.errstate(over="ignore"):
        h = {1: _TABLE[b]}
        for k in (1, 2, 4, 8):
            h[2 * k] = h[k][:-k] * np.uint64(_BASE[k]) + h[k][k:]
        whole = h[16][: len(b) - GRAM + 1] * np.uint64(_BASE[8]) + h[8][16 : 16 + len(b) - GRAM + 1]
    return mix64(whole)


def _piece_anchors(b: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in some documents laid end to end, rising, and their hashes."""
    n = len(b)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(b)
    key = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    least, k = key, 1
    while 2 * k <= SIDE + 1:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    rest = SIDE + 1 - k
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    at = offsets_of(lens)
    inside = np.zeros(n + 1, dtype=np.int8)
    long = lens >= WINDOW
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - WINDOW + 1, -1)
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[np.cumsum(inside, dtype=np.int8)[: n - WINDOW + 1] > 0]
    if len(place):
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    return place, h[place]


def anchors(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the text and hash of all anchors, in order."""
    rows, places, hashes = [], [], []
    lo = 0
    while lo < len(bodies):
        hi, size = lo, 0
        while hi < len(bodies) and (hi == lo or size + len(bodies[hi]) <= PIECE):
            size += len(bodies[hi])
            hi += 1
        lens = np.array([len(x) for x in bodies[lo:hi]], dtype=np.int64)
        at = offsets_of(lens)
        p, h = _piece_anchors(np.frombuffer(b"".join(bodies[lo:hi]), dtype=np.uint8), lens)
        r = np.searchsorted(at, p, side="right") - 1
        rows.append(r + lo)
        places.append(p - at[r])
        hashes.append(h)
        lo = hi
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)


def fingerprints(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes per text."""
    row, _, h = anchors(bodies)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return h[new], np.bincount(row[new], minlength=len(bodies))


def _sorted_rows(group: pa.Table) -> tuple[list, list[bytes]]:
    """Documents of a chunk in an order that doesn't depend on how they came."""
    pairs = sorted(zip(group.column("doc_id").to_pylist(), group.column("body").to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return [p[0] for p in pairs], [p[1] for p in pairs]


def _same_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal rows (of 8-byte words) together, and where a new one starts in it."""
    w = x.view("<u8")
    with np.errstate(over="ignore"):
        h = np.zeros(len(w), dtype=np.uint64)
        for k in range(w.shape[1]):
            h = mix64(h * np.uint64(_BASE[1]) + w[:, k])
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = (w[order[1:]] != w[order[:-1]]).any(axis=1)
    return order, new


def contexts_of(bodies: list[bytes], row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """WIDTH bytes around each anchor, then how many of them lie in the text to its left and right; padded to 8-byte words."""
    out = np.zeros((len(row), -(-(WIDTH + 2) // 8) * 8), dtype=np.uint8)
    lens = np.array([len(x) for x in bodies], dtype=np.int64)
    text = np.concatenate([np.zeros(SIDE, np.uint8), np.frombuffer(b"".join(bodies), dtype=np.uint8), np.zeros(WINDOW, np.uint8)])
    at = offsets_of(lens)[:-1][row] + place
    view = np.lib.stride_tricks.sliding_window_view(text, WIDTH)
    left, right = np.minimum(place, SIDE), np.minimum(lens[row] - place, WINDOW)
    column = np.arange(WIDTH)
    for lo in range(0, len(row), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        inside = (column >= SIDE - left[s, None]) & (column < SIDE + right[s, None])
        out[s, :WIDTH] = view[at[s]] * inside
    out[:, WIDTH], out[:, WIDTH + 1] = left, right
    return out


_BITS = np.uint32(1) << np.arange(SIDE + 1, dtype=np.uint32)


def _windows(contexts: np.ndarray) -> np.ndarray:
    """Which of the SIDE + 1 starts leave a whole window in the text, per context."""
    left, right = contexts[:, WIDTH].astype(np.int64)[:, None], contexts[:, WIDTH + 1].astype(np.int64)[:, None]
    start = np.arange(SIDE + 1)
    return (start >= SIDE - left) & (start + WINDOW <= SIDE + right)


def window_bits(contexts: np.ndarray) -> np.ndarray:
    return (_windows(contexts) * _BITS).sum(1, dtype=np.uint32)


def duplicated(contexts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For distinct contexts with their smallest ids: per window of a context, the smallest id that holds it (columns: SIDE + 1 starts; a large number where there is no window)."""
    m = len(contexts)
    left, right = contexts[:, WIDTH].astype(np.int64), contexts[:, WIDTH + 1].astype(np.int64)
    column = np.arange(WIDTH + 1)
    inside = (column >= SIDE - left[:, None]) & (column < SIDE + right[:, None])
    kept = inside.copy()
    kept[:, WIDTH] = True
    t = np.zeros((m, WIDTH + 1), dtype=np.int16)
    t[:, :WIDTH] = contexts[:, :WIDTH].astype(np.int16) + 1
    t[~inside] = 0
    first = np.concatenate([[0], np.cumsum(kept.sum(1))])[:-1]
    text = t[kept]
    # A name stands for two characters at least, so that suffixes are in order by their first WINDOW characters.
    order = suffix_array(text, 257, depth=WINDOW // 2 + 1)
    # The windows among the suffixes: those that begin at one of the first SIDE + 1 columns and fit.
    owner, begin = np.nonzero(_windows(contexts))
    position = first[owner] + begin - (SIDE - left[owner])
    number = np.full(len(text), -1, dtype=np.int32)
    number[position] = np.arange(len(position))
    number = number[order]
    place = np.flatnonzero(number >= 0)
    windows = number[place]
    out = np.full((m, SIDE + 1), np.iinfo(np.int64).max)
    if len(windows):
        # Ends of contexts become 0xFF, which no UTF-8 text holds.
        shared = permuted_prefixes((text - 1).astype(np.uint8), order, WIDTH)[order]
        new = np.ones(len(windows), dtype=bool)
        if len(windows) > 1:
            new[1:] = np.minimum.reduceat(shared[: place[-1] + 1], place[:-1] + 1) < WINDOW
        ids = low[owner[windows]]
        least = np.minimum.reduceat(ids, np.flatnonzero(new))[np.cumsum(new) - 1]
        out[owner[windows], begin[windows]] = least
    return out


def _blob(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, dtype=kind).tobytes()


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def removals(texts: DataFrame, total: int) -> DataFrame:
    """Removed windows of all documents: chunk, rows of the chunk, places of the anchor, and bits of the window starts."""
    n_buckets = n_parts(total, BUCKET_BYTES)
    n_shards = n_parts(total, SHARD_BYTES)
    keys_schema, contexts_schema, removed_schema = arrow_schema(_KEYS), arrow_schema(_CONTEXTS), arrow_schema(_REMOVED)

    def keys_of(key: tuple, group: pa.Table) -> pa.Table:
        ids, known, _, token, found = collect_slice(group)
        at = offsets_of(found)
        return _table(keys_schema, [(int(ids[d]), _blob(token[at[d] : at[d + 1]] & _IDENTITY, "<i8")) for d in np.flatnonzero(known & (found > 0))])

    bodies = texts.select("doc_id", "body")
    found = shared(bodies, fingerprints, n_buckets).groupBy("slice").applyInArrow(keys_of, _KEYS)
    keys = materialize(found.withColumn("chunk", _chunk(total)), "shared-anchors")
    del found
    release(texts.sparkSession)

    def send(key: tuple, docs: pa.Table, keys: pa.Table) -> pa.Table:
        wanted: dict[int, list[bytes]] = {}
        for i, k in zip(keys.column("doc_id").to_pylist(), keys.column("keys").to_pylist(), strict=True):
            wanted.setdefault(i, []).append(k)
        ids, bodies = _sorted_rows(docs)
        picked = [d for d, i in enumerate(ids) if i in wanted]
        row, place, h = anchors([bodies[d] for d in picked])
        mine = identity(h, n_buckets).astype(np.int64)
        sets = [np.unique(np.frombuffer(b"".join(wanted[ids[d]]), dtype="<i8")) for d in picked]
        at = np.searchsorted(row, np.arange(len(picked) + 1))
        keep = np.concatenate([np.isin(mine[a:b], s) for a, b, s in zip(at, at[1:], sets, strict=False)]) if picked else np.zeros(0, bool)
        row, place, h = row[keep], place[keep], h[keep]
        chunk = key[0].as_py()
        docs_of = np.array([ids[d] for d in picked], dtype=np.int64)
        rows_of = np.array(picked, dtype=np.int64)
        shard = ((h >> np.uint64(7)) % np.uint64(n_shards)).astype(np.int64)
        out = []
        for lot in np.array_split(np.arange(n_shards), max(1, len(row) >> 17)):
            some = np.flatnonzero((shard >= lot[0]) & (shard <= lot[-1]))
            x = contexts_of([bodies[d] for d in picked], row[some], place[some])
            order, new = _same_rows(x)
            # Groups of equal contexts, by shard.
            group = np.cumsum(new) - 1
            lead = order[new]
            by_shard = np.argsort(shard[some][lead], kind="stable")
            rank = np.empty(len(lead), dtype=np.int64)
            rank[by_shard] = np.arange(len(lead))
            member = np.lexsort((order, rank[group]))
            order, group = order[member], rank[group[member]]
            lead = lead[by_shard]
            counts = np.bincount(group, minlength=len(lead))
            ends = offsets_of(counts)
            doc = docs_of[row[some][order]]
            low = np.minimum.reduceat(doc, ends[:-1]) if len(lead) else doc
            cut = np.searchsorted(shard[some][lead], np.arange(lot[0], lot[-1] + 2))
            for s, a, b in zip(lot, cut, cut[1:], strict=False):
                if b > a:
                    m = slice(ends[a], ends[b])
                    out.append((int(s), chunk, x[lead[a:b]].tobytes(), _blob(low[a:b], "<i8"), _blob(counts[a:b], "<u4"), _blob(doc[m], "<i8"), _blob(rows_of[row[some][order[m]]], "<u4"), _blob(place[some][order[m]], "<u4")))
        return _table(contexts_schema, out)

    def resolve(key: tuple, group: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(c, dtype=np.uint8) for c in group.column("contexts").to_pylist()]).reshape(-1, -(-(WIDTH + 2) // 8) * 8)
        low = np.concatenate([np.frombuffer(c, dtype="<i8") for c in group.column("low").to_pylist()])
        order, new = _same_rows(x)
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(low[order], starts)
        which = np.empty(len(x), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        distinct = x[order[starts]]
        held = duplicated(distinct, least)
        # A document with the context's smallest id loses the windows that an earlier one holds elsewhere; any later one loses all of them.
        full, part = window_bits(distinct), ((held < least[:, None]) * _BITS).sum(1, dtype=np.uint32)
        out, lo = [], 0
        for chunk, counts, docs, rows, places in zip(*(group.column(c).to_pylist() for c in ("chunk", "counts", "docs", "rows", "places")), strict=True):
            counts = np.frombuffer(counts, dtype="<u4")
            context = np.repeat(which[lo : lo + len(counts)], counts)
            lo += len(counts)
            mask = np.where(np.frombuffer(docs, dtype="<i8") > least[context], full[context], part[context])
            go = mask > 0
            if go.any():
                out.append((chunk, _blob(np.frombuffer(rows, dtype="<u4")[go], "<u4"), _blob(np.frombuffer(places, dtype="<u4")[go], "<u4"), _blob(mask[go], "<u4")))
        return _table(removed_schema, out)

    contexts = texts.groupBy("chunk").cogroup(keys.groupBy("chunk")).applyInArrow(send, _CONTEXTS)
    removed = materialize(contexts.groupBy("shard").applyInArrow(resolve, _REMOVED), "removed-windows")
    del contexts
    release(texts.sparkSession)
    return removed


def _chunk(total: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(n_parts(total, CHUNK_BYTES)))


def cover(lens: np.ndarray, row: np.ndarray, place: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which bytes of documents laid end to end the removed windows cover."""
    n = int(lens.sum())
    at = offsets_of(lens)[:-1][row] + place - SIDE
    last = np.full(n, -WINDOW, dtype=np.int64)
    for k in range(SIDE + 1):
        s = at[(mask >> np.uint32(k)) & np.uint32(1) > 0] + k
        last[s] = s
    np.maximum.accumulate(last, out=last)
    return np.arange(n) - last < WINDOW


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what stays."""
    texts = id_text(docs)
    total = text_bytes(texts)
    texts = texts.withColumn("chunk", _chunk(total))
    removed = removals(texts, total)
    schema = arrow_schema(_RESULT)

    def finish(key: tuple, docs: pa.Table, gone: pa.Table) -> pa.Table:
        ids, bodies = _sorted_rows(docs)
        lens = np.array([len(b) for b in bodies], dtype=np.int64)
        row, place, mask = (np.frombuffer(b"".join(gone.column(c).to_pylist()), dtype="<u4") for c in ("rows", "places", "masks"))
        covered = cover(lens, row.astype(np.int64), place.astype(np.int64), mask)
        at = offsets_of(lens)
        hit = np.unique(row)
        removed_, spans, digest = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), [None] * len(ids)
        for d in hit:
            c = covered[at[d] : at[d + 1]]
            removed_[d] = c.sum()
            spans[d] = int(c[0]) + int((c[1:] & ~c[:-1]).sum())
            digest[d] = hashlib.sha256(np.frombuffer(bodies[d], dtype=np.uint8)[~c].tobytes()).hexdigest()
        digest = [x or hashlib.sha256(b).hexdigest() for x, b in zip(digest, bodies, strict=True)]
        return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip((ids, lens, removed_, spans, digest), schema, strict=True)], schema=schema)

    return texts.groupBy("chunk").cogroup(removed.groupBy("chunk")).applyInArrow(finish, _RESULT)
