"""Language-model scores, piece segmentation and token files."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from veredas.llm import hmm, pieces, tokenfile


def tokens(t):
    return (t or "").encode().lower().split() + [hmm.END]


def test_hmm_scores(docs, no_docs, texts):
    train, held = Counter(), lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in texts:
        if not held(i):
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)

    def base(t):
        return round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)

    got = hmm.scores(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(
        (str(i), held(i), len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, base(t)) for i, t in texts
    )
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    same = [r.score for r in got if r.doc_id in (0, 1)]
    assert same[0] == pytest.approx(same[1])
    assert hmm.scores(no_docs).count() == 0


def test_scores_are_the_models_probability_of_the_words(docs, texts, monkeypatch):
    """The score of the query against the recursion by hand: classes, shares inside them, and a fixed model."""
    monkeypatch.setattr(hmm, "TOP_WORDS", 5)
    monkeypatch.setattr(hmm, "HASHED", 3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter(w for i, t in texts if not held(i) for w in tokens(t))
    top = [w for w, _ in sorted(train.items(), key=lambda x: (-x[1], x[0]))[:5]]
    kind = lambda w: top.index(w) if w in top else 5 + hmm.hashed_class(w)
    mass = [train[w] + 1 for w in top] + [1, 1, 1]
    for w, n in train.items():
        if w not in top:
            mass[kind(w)] += n + 1
    rng = np.random.default_rng(8)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = hmm.Model(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((8, 2)), 0))
    monkeypatch.setattr(hmm, "baum_welch", lambda *_: m)

    def score(t):
        a, total = None, 0.0
        for w in tokens(t):
            a = (m.start if a is None else a @ m.trans) * m.emit[kind(w)]
            total += math.log10(a.sum()) + math.log10((train[w] + 1) / mass[kind(w)])
            a = a / a.sum()
        return round(total, 5)

    got = sorted((str(r.doc_id), round(r.score, 5)) for r in hmm.scores(docs).collect())
    want = sorted((str(i), score(t)) for i, t in texts)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-4)


def test_every_document_held_out(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    docs = spark.createDataFrame([(i, "a b a") for i in held], "doc_id long, text string")
    for r in hmm.scores(docs).collect():
        assert r.held_out and (r.n_tokens, r.n_known, r.train_tokens) == (4, 0, 0) and math.isfinite(r.score)


def tiny(seed=0, classes=7, states=3):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def paths(m, seq):
    for p in itertools.product(range(len(m.start)), repeat=len(seq)):
        x = m.start[p[0]] * m.emit[seq[0], p[0]]
        for a, b, o in zip(p, p[1:], seq[1:]):
            x *= m.trans[a, b] * m.emit[o, b]
        yield p, x


def counts(m, flat, at, lens):
    out = [np.zeros_like(m.start), np.zeros_like(m.trans), np.zeros_like(m.emit)]
    s = hmm.Stretches.cut(m, flat, at, lens)
    for part in hmm._batches(s.lens):
        hmm.expected(m, flat, s, part, out)
    return out


def test_cuts_change_no_count(monkeypatch):
    m, rng = tiny(2, 11, 4), np.random.default_rng(6)
    lens = np.array([1, 700, 33, 5, 150])
    flat = rng.integers(0, 11, lens.sum())
    at = np.cumsum(lens) - lens
    monkeypatch.setattr(hmm, "STRETCH", 10_000)
    want = counts(m, flat, at, lens)
    monkeypatch.setattr(hmm, "STRETCH", 16)
    for g, w in zip(counts(m, flat, at, lens), want):
        assert g == pytest.approx(w)
    assert want[2].sum() == pytest.approx(lens.sum())


def test_forward_and_expected_counts_against_all_paths(monkeypatch):
    m, rng = tiny(), np.random.default_rng(5)
    seqs = [rng.integers(0, 7, k) for k in (1, 4, 3, 5)]
    flat, lens = np.concatenate(seqs), np.array([len(s) for s in seqs])
    at = np.cumsum(lens) - lens
    got = hmm.log10_likelihood(m, flat, at, lens)
    assert got == pytest.approx([math.log10(sum(x for _, x in paths(m, s))) for s in seqs])
    out = counts(m, flat, at, lens)
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))]
    for s in seqs:
        z = sum(x for _, x in paths(m, s))
        for p, x in paths(m, s):
            want[0][p[0]] += x / z
            for a, b in zip(p, p[1:]):
                want[1][a, b] += x / z
            for k, o in zip(p, s):
                want[2][o, k] += x / z
    for size in (hmm.STRETCH, 1, 2, 3):
        monkeypatch.setattr(hmm, "STRETCH", size)
        for g, w in zip(counts(m, flat, at, lens), want):
            assert g == pytest.approx(w), size


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(1)
    flat = np.concatenate([rng.integers(0, 3, 50) if k % 2 else rng.integers(3, 6, 50) for k in range(20)])
    lens = np.full(20, 50)
    at = np.cumsum(lens) - lens
    share = np.full(6, 1 / 6)
    m = hmm.Model.first(share, 2)
    before = hmm.log10_likelihood(m, flat, at, lens).sum()
    for _ in range(8):
        m = m.next(counts(m, flat, at, lens), share * 0.01)
    assert hmm.log10_likelihood(m, flat, at, lens).sum() > before + 100


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.load(pieces.default_path())


def all_ways(p, unit):
    edges, out = p.edges(unit), []

    def back(j, cost):
        if not j:
            out.append(cost)
        for i, c in edges[j] if j else ():
            back(i, cost + c)

    back(len(unit), 0)
    return sorted(out)


@pytest.mark.parametrize("unit", ["▁Anblewh", "▁the", "▁▁▁x", "ñadoco.", "▁日本x", "▁", "aaaaaaa"])
def test_unit_n_best(vocabulary, unit):
    want = all_ways(vocabulary, unit)
    assert [c for c, _ in vocabulary.n_best(unit, 6)] == want[:6]
    ids, cost, gap = vocabulary.best(unit)
    assert cost == want[0] and (gap == want[1] - want[0] if len(want) > 1 else gap > 1 << 50)
    assert len({x for _, x in vocabulary.n_best(unit, 6)}) == len(want[:6])


@pytest.mark.parametrize("text", ["Ana the  of\nx", "a b c", "  ", "日 a", "re re", "\n\n"])
def test_text_n_best(vocabulary, text):
    units = pieces._UNIT.findall("▁" + text.replace(" ", "▁"))
    want = sorted(sum(x) for x in itertools.product(*[all_ways(vocabulary, u) for u in units]))[:5]
    got = vocabulary.encode(text, 5)
    assert [c for c, _ in got] == want
    assert {vocabulary.decode(x) for _, x in got} == {text}


def test_segment(docs, no_docs, texts, vocabulary):
    got = pieces.segment(docs).collect()
    want = sorted((str(i), len(vocabulary.encode(t or "")[0][1]) // 2) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_pieces) for r in got) == want
    for r in got:
        assert r.round_trip == (r.doc_id != 16)
        assert [x.score for x in r.n_best] == sorted((x.score for x in r.n_best), reverse=True)
        assert r.n_best[0].ids_crc32 == zlib.crc32(r.ids) and r.n_best[0].n_pieces == r.n_pieces
    assert pieces.segment(no_docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_blocks_round_trip(n):
    v = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) >> np.random.default_rng(1).integers(0, 32, n).astype(np.uint32)
    assert (tokenfile.unpack(tokenfile.pack(v)) == v).all()
    with pytest.raises(ValueError):
        tokenfile.unpack(tokenfile.pack(v) + b"x")


def test_token_files(spark, docs, no_docs, texts, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 50_000)
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 3_000)
    t = Tokenizer.from_file(tokenfile.default_path())
    files = tokenfile.write(docs, f"file://{tmp_path}/all")
    got = sorted(tokenfile.read(spark, files).collect(), key=lambda r: r.start)
    start = 0
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    for r, (i, text) in zip(got, order, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, start, len(ids), ids)
        start += len(ids)
    assert {r.ids_crc32 for r in tokenfile.digest(tokenfile.read(spark, files)).where("doc_id = 7").collect()} == {tokenfile.crc([2])}
    assert tokenfile.read(spark, tokenfile.write(no_docs, f"file://{tmp_path}/none")).count() == 0


def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])


def test_every_distinct_unit_goes_through_the_library_once():
    e = tokenfile.Encoder(tokenfile.default_path())
    library, given = e.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            given.extend(texts)
            return library.encode_batch_fast(texts, **more)

    e.tokenizer = Counted()
    r = random.Random(1)
    words = sorted({"".join(r.choices("abcdefgh", k=7)) + r.choice(["", "é"]) for _ in range(3000)})
    for k in range(10):  # each word stands once in a slice, with another sign behind it
        r.shuffle(words)
        e.encode(*laid([" ".join(["x", *(w + "!?,;:()/#*"[k] for w in words), "x"]).encode()]), 2)
    assert sum(len(t.encode()) for t in given) < 1.1 * sum(1 + len(w.encode()) for w in words)


@pytest.mark.parametrize("seed", range(4))
def test_units_of_odd_texts(seed):
    from tokenizers import Tokenizer

    e, t, r = tokenfile.Encoder(tokenfile.default_path()), Tokenizer.from_file(tokenfile.default_path()), random.Random(seed)
    parts = ["a", "Z", "the", " of", "9", *[" "] * 4, *"\n\t\r\v\f\x1c\0\x7f'.,<|>", "'s", "'ll", "<|endoftext|>", *"é×÷ßЖ҂ɏ中१²½😀ª", "\xa0", "\u3000", "\u2003", "\x85", "\u0301"]
    parts = [x.encode() for x in parts] + [b"\xc3", b"\xd0", b"\xa9", b"\xe4\xb8"] * (seed % 2)
    for _ in range(40):
        some = r.sample(parts, r.choice([3, 6, len(parts)]))
        texts = [b"".join(r.choices(some, k=r.choice([0, 1, 2, 3, 5, 8, 20]))) for _ in range(100)]
        ids, ends = e.encode(*laid(texts), 2)
        for text, got in zip(texts, np.split(ids, ends[:-1]), strict=True):
            assert got.tolist() == [*t.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, 2], text


def test_ids_beyond_two_bytes(spark, tmp_path):
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    a, b = (sorted(tokenfile.read(spark, tokenfile.write(some, f"file://{tmp_path}/{i}", end_id=i)).collect()) for i in (2, 70_000))
    for x, y in zip(a, b, strict=True):
        assert x[:3] == y[:3] and np.frombuffer(y.ids, "<u4").tolist() == [*np.frombuffer(x.ids, "<u4").tolist()[:-1], 70_000]
