"""Alignment of tokenizers, packing and fill-in-the-middle against brute force, the libraries and round trips."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import prose
from veredas.llm import alignment, fim, packing
from veredas.llm.bytebpe import ByteBpe, default_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    both = [Tokenizer.from_file(default_path()) for _ in range(2)]
    both[True].encode_special_tokens = True

    def encode(text, plain=False):
        return both[plain].encode(text, add_special_tokens=False).ids

    return encode


def test_ids_equal_those_of_the_library(library, texts):
    odd = ["a<|endoftext|>b", "x" * 3000, " " * 60_000 + "a", "a   b\u0085c", "it's we'll 12½ ٣ é", "\x00\x1f\x7f"]
    wide = ["".join(chr(c) for c in range(k, k + 150)) for k in (*range(0x20, 0x3000, 150), 0xA000, 0x1F600, 0x2F800)]
    for plain in (False, True):
        ours = ByteBpe(default_path(), plain)
        for t in [t for _, t in texts if t] + odd + wide:
            assert ours.encode(t).tolist() == library(t, plain)
    assert b"".join(ours.bytes_of[i] for i in ours.encode(odd[4])) == odd[4].encode()


def brute_alignment(texts, library):
    """Token by token and byte by byte."""
    import sentencepiece

    b_model = sentencepiece.SentencePieceProcessor(model_file=alignment.default_model())
    a_bytes = ByteBpe(default_path()).bytes_of
    rows, docs_of = [], Counter()
    for i, t in texts:
        if not t:
            rows.append((i, [], [], []))
            continue
        a, b = library(" " + t, True), b_model.encode(t)
        b_bytes = [bytes([int(b_model.id_to_piece(x)[3:-1], 16)]) if b_model.is_byte(x) else b_model.id_to_piece(x).replace("▁", " ").encode() for x in b]
        over_a = [k for k, x in enumerate(a) for _ in a_bytes[x]]
        over_b = [k for k, x in enumerate(b_bytes) for _ in x]
        if b"".join(b_bytes) != b" " + t.encode():
            rows.append((i, [], [], []))
            continue
        links = sorted(set(zip(over_a, over_b, strict=True)))
        ends = [n for n in range(1, len(over_a) + 1) if n == len(over_a) or (over_a[n] != over_a[n - 1] and over_b[n] != over_b[n - 1])]
        groups, lo = [], 0
        for hi in ends:
            groups.append(([a[k] for k in sorted(set(over_a[lo:hi]))], [b[k] for k in sorted(set(over_b[lo:hi]))]))
            lo = hi
        pairs = [(a[x], b[y]) for x, y in links]
        docs_of.update(set(pairs))
        rows.append((i, a, b, (groups, pairs)))
    most = defaultdict(int)
    for (x, _), n in docs_of.items():
        most[x] = max(most[x], n)
    out = []
    for i, a, b, found in rows:
        groups, pairs = found or ([], [])
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(pairs), sum(docs_of[p] == most[p[0]] for p in pairs), sum(docs_of[p] for p in pairs), text))
    return sorted(out, key=str)


@pytest.mark.parametrize("head_pairs", [1 << 19, 50, 0])
def test_alignment(docs, no_docs, texts, library, head_pairs):
    got = sorted((tuple(r) for r in alignment.align(docs, head_pairs=head_pairs).collect()), key=str)
    assert got == brute_alignment(texts, library)
    assert alignment.align(no_docs).count() == 0


def test_alignment_digest(docs, texts, library):
    got = sorted(str((r.doc_id, r.groups)) for r in alignment.align(docs, digest=True).collect())
    assert got == sorted(str((r[0], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "")) for r in brute_alignment(texts, library))


def test_align_tokens_on_made_up_intervals():
    r = random.Random(5)
    for _ in range(200):
        total = r.randint(1, 30)
        sides = []
        for _side in "ab":
            cut = sorted({total, *(r.randint(1, total) for _ in range(r.randint(0, 8)))})
            sides.append(np.diff([0, *cut]))
        x = alignment.align_tokens([sides[0].astype(np.uint32)], [sides[1].astype(np.uint32)], np.arange(31), np.arange(31))
        a, b = (np.cumsum(s).tolist() for s in sides)
        over = {(i, j) for i in range(len(a)) for j in range(len(b)) if min(a[i], b[j]) > max(a[i] - sides[0][i], b[j] - sides[1][j])}
        assert set(zip(x.link_a.tolist(), x.link_b.tolist(), strict=True)) == over and len(x.link_a) == len(over)
        common = sorted(set(a) & set(b))
        assert x.group_a.tolist() == [sum(c < e for c in common) for e in a] and x.group_b.tolist() == [sum(c < e for c in common) for e in b]


def check_packing(rows, texts, library, capacity):
    want = []
    for i, t in texts:
        ids = (library(t) if t else []) + [2]
        first = (len(ids) - 1) % capacity + 1
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids))) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for found in by.values():
        found.sort()
        assert [o for o, _ in found] == [0, *itertools.accumulate(n for _, n in found)][:-1] and sum(n for _, n in found) <= capacity
    return len(by)


@pytest.mark.parametrize(("capacity", "broadcast_rows"), [(1024, 1_000_000), (64, 0)])
def test_packing(docs, no_docs, texts, library, capacity, broadcast_rows):
    packed = packing.pack(docs, capacity=capacity, broadcast_rows=broadcast_rows)
    rows = packed.collect()
    n = check_packing(rows, texts, library, capacity)
    least = -(-sum(r.length for r in rows) // capacity)
    assert n <= least + 1
    joined = {r.sequence_id: (r.n_tokens, r.ids) for r in packing.sequences(packed).collect()}
    assert len(joined) == n and sum(len(x) for _, x in joined.values()) == 4 * sum(r.length for r in rows)
    one = min(rows, key=lambda r: (r.sequence_id, r.offset))
    assert bytes(joined[one.sequence_id][1]).startswith(bytes(one.ids)) and all(4 * k == len(x) for k, x in joined.values())
    assert packing.pack(no_docs).count() == 0


def fewest(lengths, capacity):
    """The optimum by exhaustive search."""
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for room in set(bins):
            if room >= lengths[k]:
                go(k + 1, sorted([*(x for j, x in enumerate(bins) if j != bins.index(room)), room - lengths[k]]))
        go(k + 1, [*bins, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_layouts_are_whole_and_near_the_optimum():
    r = random.Random(9)
    worse = 0
    for trial in range(60):
        capacity = r.choice([10, 24, 50])
        counts = Counter(r.randint(1, capacity) for _ in range(r.randint(1, 9)))
        layout = packing.plan(counts, capacity)
        worse += layout.n_sequences - fewest(list(counts.elements()), capacity)
    assert worse <= 6
    for lo, hi, n in ((1, 1024, 5000), (300, 400, 5000), (1, 60, 3000), (1024, 1024, 7)):
        counts = Counter(r.randint(lo, hi) for _ in range(n))
        layout = packing.plan(counts)
        length = np.array(list(counts.elements()))
        rank = np.concatenate([np.arange(k) for k in counts.values()])
        sequence, offset = layout.place(length, rank)
        order = np.lexsort((offset, sequence))
        s, o, size = sequence[order], offset[order], length[order]
        new = np.append(True, s[1:] != s[:-1])
        assert len(np.unique(s)) == layout.n_sequences and (o[new] == 0).all() and (o + size <= 1024).all()
        assert (o[1:][~new[1:]] == (o + size)[:-1][~new[1:]]).all()
        assert layout.n_sequences <= 1.1 * max(-(-length.sum() // 1024), (length > 512).sum()) + 1


def test_bits():
    r = random.Random(2)
    for _ in range(200):
        body = bytes(r.choice(b"a\n\xc3\xa9") for _ in range(r.randint(0, 60)))
        starts = [k for k in range(len(body)) if k == 0 or body[k - 1] == 10]
        mask = fim.unit_starts(body)
        assert mask.bit_count() == len(starts)
        assert [fim.select(mask, len(body), k) for k in range(len(starts))] == starts
    with pytest.raises(ValueError, match="overlap"):
        fim.Plan(prefix="<P>", suffix="P>x")


def test_fill_in_middle(spark, docs, no_docs):
    extra = spark.createDataFrame([(60, "a<P>b\nc"), (61, "<S>"), (62, "\n"), (63, "\n\n\nx"), (64, "é\nß" * 40), (65, prose(3, 30_000).replace(" ", "\n"))], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").union(extra)
    found = fim.transform(all_docs).select("*", fim.restored(fim.F.col("output"), fim.F.col("form")).alias("text")).collect()
    texts = sorted(((r.doc_id, r.text or "") for r in all_docs.collect()), key=str)
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == texts
    assert {r.form for r in found} == {"plain", "psm", "spm"} and all(r.form == "plain" for r in found if r.doc_id in (6, 7, 60, 61))
    with duckdb.connect() as db:
        db.register("documents", all_docs.toArrow())
        want = db.sql(fim.ORACLE_SQL).fetchall()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), sha(r.text))) for r in found)
    assert fim.transform(no_docs).count() == 0
    assert {r.form for r in fim.transform(docs, fim.Plan(fim_percent=0)).collect()} == {"plain"}
