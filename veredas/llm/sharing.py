"""Which fingerprints of a document stand in other documents too.

A general step of the joins on content: slices of documents deal their fingerprints by hash
into buckets as packed arrays, a bucket counts the documents of each, and only those of two documents
or more travel back to their slice. Fingerprints that stand in one document alone, nearly all of a corpus,
are moved once, at six bytes each.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_schema, slices, trim

SLICE_BYTES = 4 << 20
LOW = np.uint64((1 << 48) - 1)
_DEALT = "bucket int, slice long, hashes binary, counts binary, doc_ids binary, sizes binary"
SHARED = "bucket int, slice long, tokens binary, counts binary, doc_ids binary, sizes binary"

#: texts -> (distinct 64-bit hashes, text after text; their number per text)
Fingerprints = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(body, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)


def identity(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """The 55 bits that stand for a hash below the frequency class of its token."""
    return ((bucket_of(h, n_buckets).astype(np.uint64) & np.uint64(127)) << np.uint64(48)) | (h & LOW)


def rarity(df: np.ndarray) -> np.ndarray:
    """Frequency class: eight steps a doubling, never falling with the frequency, below 256."""
    return np.minimum(np.floor(8 * np.log2(df)), 255).astype(np.uint64)


def record(schema: pa.Schema, *values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def shared(texts: DataFrame, fingerprints: Fingerprints, n_buckets: int) -> DataFrame:
    """Rows of (slice, bucket) with the tokens of shared fingerprints and their number per document of the slice.

    One row of every slice also holds the table of its documents: ids, and set sizes (as -1 - size
    where the id is null). A token is the frequency class above the 55 bits of :func:`identity`.
    """
    dealt_schema, shared_schema = arrow_schema(_DEALT), arrow_schema(SHARED)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in slices(batch.column("body"), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                h, sizes = fingerprints(part.column("body").to_pylist())
                bucket = bucket_of(h, n_buckets)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                doc = np.repeat(np.arange(len(sizes)), sizes)
                ids = part.column("doc_id")
                known = np.asarray(ids.is_valid())
                ids = np.asarray(ids.fill_null(0), dtype="<i8")
                home = zlib.crc32(str(number).encode()) % n_buckets
                for b in range(n_buckets):
                    at = order[ends[b] : ends[b + 1]]
                    if len(at) or b == home:
                        table = (ids.tobytes(), np.where(known, sizes, -1 - sizes).astype("<i8").tobytes()) if b == home else (None, None)
                        yield record(dealt_schema, b, number, pack48(h[at] & LOW), np.bincount(doc[at], minlength=len(sizes)).astype("<u4").tobytes(), *table)
                number += 1
            trim()

    def count(key: tuple, group: pa.Table) -> pa.Table:
        b = key[0].as_py()
        parts = [unpack48(x) for x in group.column("hashes").to_pylist()]
        h = np.concatenate(parts)
        _, back, df = np.unique(h, return_inverse=True, return_counts=True)
        df = df[back]
        token = ((rarity(df) << np.uint64(55)) | (np.uint64(b & 127) << np.uint64(48)) | h).astype("<i8") if len(h) else h.astype("<i8")
        out, lo = [], 0
        rows = zip(*(group.column(c).to_pylist() for c in ("slice", "counts", "doc_ids", "sizes")), strict=True)
        for (number, counts, ids, sizes), x in zip(rows, parts, strict=True):
            hi = lo + len(x)
            kept = df[lo:hi] > 1
            counts = np.frombuffer(counts, dtype="<u4")
            doc = np.repeat(np.arange(len(counts)), counts)
            if kept.any() or ids is not None:
                out.append(record(shared_schema, b, number, token[lo:hi][kept].tobytes(), np.bincount(doc[kept], minlength=len(counts)).astype("<u4").tobytes(), ids, sizes))
            lo = hi
        trim()
        return pa.Table.from_batches(out, schema=shared_schema)

    return texts.mapInArrow(deal, _DEALT).groupBy("bucket").applyInArrow(count, SHARED)


def collect_slice(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows of a slice: ids, whether they are known, set sizes, and sorted tokens with their number per document."""
    ids = sizes = None
    docs, tokens = [], []
    for t, c, i, s in zip(*(group.column(x).to_pylist() for x in ("tokens", "counts", "doc_ids", "sizes")), strict=True):
        c = np.frombuffer(c, dtype="<u4")
        docs.append(np.repeat(np.arange(len(c)), c))
        tokens.append(np.frombuffer(t, dtype="<i8"))
        if i is not None:
            ids, sizes = np.frombuffer(i, dtype="<i8"), np.frombuffer(s, dtype="<i8")
    known = sizes >= 0
    doc, token = np.concatenate(docs), np.concatenate(tokens)
    order = np.lexsort((token, doc))
    trim()
    return ids, known, np.where(known, sizes, -1 - sizes), token[order], np.bincount(doc, minlength=len(ids))
