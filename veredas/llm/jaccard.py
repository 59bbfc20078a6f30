"""Exact Jaccard join of documents on word shingles, and the groups of near copies.

A document's set is its distinct five-word shingles (64-bit hashes; with fewer words,
the whole sequence is one). Two documents link when the Jaccard similarity is at least
THRESHOLD percent.

1. *Frequencies.* Slices of documents deal their shingles by hash into buckets (packed
   arrays, a few bytes a shingle). A bucket counts in how many documents each shingle stands
   and sends back only those of two documents or more. What stands in one document alone can match
   nothing: such shingles lead the rare-first order and never travel again.
2. *Prefix filter.* A linked pair shares a shingle among the rarest ``n - ceil(t n) + 1`` of each. A
   document that shares less than ``t n`` shingles is alone; of the others, the shared part of
   the prefix is posted. Documents with equal sets are one class from here on.
3. *Candidates.* Postings meet by shingle under the length and the positional filter. First
   every list is compared with one member only, the most central; what links becomes one
   component. Then only pairs from different components of a list are compared, so a large group of
   copies costs about its size and not its square, and no link between components is lost.
4. *Verification.* A pair is verified once: suffix filter, then the intersection.

A shingle's 63-bit token is its frequency class (eight steps a doubling) above 55 bits of hash, so
that the order of tokens is the rare-first order everywhere.

Texts without words, empty and null ones have an empty set and link with nothing. Rows that share an
id count as one node; a row with a null id links with nothing. Of several smallest ids (repeated rows) all rows get the one id. Texts are
taken whole, however long; an empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, id_text, materialize, mix64, n_parts, named, offsets_of, text_bytes, with_row, without_rows
from .components import connected
from .sharing import collect_slice, shared

SHINGLE = 5
THRESHOLD = 75
BUCKET_BYTES = 4 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)

_SETS = "doc_id long, n long, tokens array<long>, same string"


def shingles(bodies: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of some texts, text after text and rising in each, and their number per text."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    memo: dict[bytes, int] = {}
    parts, lens = [], []
    for body in bodies:
        words = body.lower().split()
        for w in set(words).difference(memo):
            memo[w] = digest(w)
        parts.append(np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words)))
        lens.append(len(words))
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n = np.array(lens, dtype=np.int64)
    at = offsets_of(n)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(h), dtype=np.uint64)
        for j in range(k):
            rolled[: len(h) - j] += h[j:] * _FACTORS[j]
        rolled = mix64(rolled)
        short = np.flatnonzero((n > 0) & (n < k))
        for d in short:
            w = h[at[d] : at[d + 1]]
            rolled[at[d]] = mix64(np.array([(w * _FACTORS[: len(w)]).sum() + np.uint64(len(w))], dtype=np.uint64))[0]
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    pick = np.repeat(at[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    value = rolled[pick]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(doc[new], minlength=len(n))


def shingle_sets(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: its set's size, and where it may have a link the shared tokens, rarest first.

    ``same`` names the set where all of it is shared (equal sets have equal names).
    """
    texts = id_text(docs)
    n_buckets = n_parts(text_bytes(texts), BUCKET_BYTES)
    set_schema = arrow_schema(_SETS)

    def gather(key: tuple, group: pa.Table) -> pa.Table:
        ids, known, sizes, token, found = collect_slice(group)
        at = offsets_of(found)
        able = known & (sizes > 0) & (100 * found >= threshold * sizes)
        lists, same = [], []
        for d in range(len(ids)):
            mine = token[at[d] : at[d + 1]] if able[d] else None
            lists.append(mine)
            same.append(hashlib.blake2b(mine.tobytes(), digest_size=16).hexdigest() if able[d] and found[d] == sizes[d] else None)
        columns = (pa.array(ids, mask=~known), pa.array(sizes), pa.array(lists, type=pa.list_(pa.int64())), pa.array(same, type=pa.string()))
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, set_schema, strict=True)], schema=set_schema)

    return materialize(shared(texts, shingles, n_buckets).groupBy("slice").applyInArrow(gather, _SETS), "shingle-sets")


def postings(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The shared part of every prefix: token, doc, n, and the token's place in the rare-first order."""
    alone = F.col("n") - F.size("tokens")
    reach = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1 - alone
    part = F.slice("tokens", F.lit(1), F.greatest(reach, F.lit(0)).cast("int"))
    return sets.select("doc", "n", alone.alias("alone"), F.posexplode(part).alias("i", "token")).select("token", "doc", "n", (F.col("alone") + F.col("i")).alias("pos"))


def _may_link(threshold: int) -> Column:
    """Length filter and positional filter between sides a and b."""
    low, high = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    need = F.ceil((F.col("a.n") + F.col("b.n")) * threshold / (100 + threshold))
    most = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return (100 * low >= threshold * high) & (most >= need)


def suffix_bound(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> int:
    """A lower bound of the symmetric difference of two sorted arrays, refined while it is within ``most``."""
    gap = abs(len(x) - len(y))
    if not depth or not len(x) or not len(y) or gap > most:
        return gap
    w = y[len(y) // 2]
    i, j = int(np.searchsorted(x, w)), len(y) // 2
    hit = i < len(x) and x[i] == w
    right = abs((len(x) - i - hit) - (len(y) - j - 1)) + (not hit)
    left = suffix_bound(x[:i], y[:j], most - right, depth - 1)
    if left + right > most:
        return left + right
    rest = suffix_bound(x[i + hit :], y[j + 1 :], most - left - (not hit), depth - 1)
    return left + rest + (not hit)


def verify(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) that link: suffix filter, then the size of the intersection."""
    side = lambda s: sets.select(F.col("doc").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "t_a", "t_b")
    schema = arrow_schema("a long, b long")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b"))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("t_a"), batch.column("t_b"), strict=True)):
                x, y, total = np.asarray(x.values), np.asarray(y.values), int(n_a[i] + n_b[i])
                need = math.ceil(total * threshold / (100 + threshold))
                most = total - 2 * need - (total - len(x) - len(y))
                if suffix_bound(x, y, most) <= most:
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * inter >= threshold * (total - inter)
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], schema=schema)

    return both.mapInArrow(check, "a long, b long")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a.doc", "b.doc").alias("a"), F.greatest("a.doc", "b.doc").alias("b")).distinct()


def links(sets: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Edges between near documents (enough for the components), and edges between equal sets."""
    able = sets.where("tokens is not null and doc_id is not null")
    first = able.where("same is not null").groupBy("same").agg(F.min("doc_id").alias("first"))
    equal = materialize(able.where("same is not null").select("doc_id", "same").join(first, "same").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "equal-sets")
    picked = able.where("same is null").unionByName(able.join(first.select(F.col("first").alias("doc_id"), "same"), ["doc_id", "same"], "left_semi"))
    classes = materialize(picked.select(F.col("doc_id").alias("doc"), "n", "tokens"), "classes")
    post = materialize(postings(classes, threshold), "postings")
    centre = post.groupBy("token").agg(F.min(F.struct("pos", "doc", "n")).alias("c"), F.count("*").alias("k")).where("k > 1").select("token", "c.pos", "c.doc", "c.n")
    star = post.alias("a").join(centre.alias("b"), "token").where((F.col("a.doc") != F.col("b.doc")) & _may_link(threshold))
    near = materialize(verify(_pairs(star), classes, threshold), "star-links")
    found = connected(near)
    group = F.coalesce("component", "doc").alias("group")
    marked = post.join(found, post["doc"] == found["id"], "left").select("token", "doc", "n", "pos", group)
    mixed = marked.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("token")
    rest = materialize(marked.join(mixed, "token", "left_semi"), "mixed-postings")
    cross = rest.alias("a").join(rest.alias("b"), "token").where((F.col("a.group") < F.col("b.group")) & _may_link(threshold))
    more = materialize(verify(_pairs(cross), classes, threshold), "cross-links")
    return near.union(more), equal


def groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id (smallest id reachable by links)."""
    sets = shingle_sets(docs, threshold)
    near, equal = links(sets, threshold)
    found = connected(near.union(equal))
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, null ids last; all columns stay, whatever their names.

    Every row is a node of its own here, so that repeated ids and null ids are judged apart. Of rows with equal ids in a group
    the first in the order of the table as read stays. Rows with null, empty or blank texts all stay; texts are judged whole, however
    long; an empty table stays empty.
    """
    rows, row = with_row(docs)
    found = materialize(groups(rows.select(named(row).alias("doc_id"), "text"), threshold).select(F.col("doc_id").alias("node"), "component_id"), "row-groups")
    ids = rows.select(named(row).alias("node"), F.col("doc_id").cast("long").alias("id"))
    first = found.join(ids, "node").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("m")).select("m.node")
    return without_rows(rows, row, found.join(first, "node", "left_anti").select("node"), docs.columns)
