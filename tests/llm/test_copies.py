"""Jaccard groups, components, suffix arrays, repeated passages and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, changed, prose
from veredas.llm import jaccard, substrings
from veredas.llm.components import connected
from veredas.llm.suffixarray import permuted_prefixes, suffix_array


def union(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 230)] + [(5, 5), (3, 4), (4, 3)]
    table = spark.createDataFrame(edges + [(None, 1)], "a long, b long")
    want = {k: v for k, v in union(e for e in edges if e[0] != e[1]).items()}
    assert {x.id: x.component for x in connected(table).collect()} == want
    assert connected(table.limit(0)).count() == 0


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(texts):
    edges = [(i, i) for i, _ in texts if i is not None]
    sets = [(i, shingle_set(t)) for i, t in texts if i is not None]
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            n = len(x & y)
            if n and 100 * n >= 75 * (len(x) + len(y) - n):
                edges.append((i, j))
    found = union(edges)
    return sorted(str((i, len(shingle_set(t)), found.get(i))) for i, t in texts)


def test_groups(docs, no_docs, texts):
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.groups(docs).collect())
    assert got == brute_groups(texts)
    assert jaccard.groups(no_docs).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and not {1, 3} & set(ids) and {6, 7, 8} <= set(ids)


def test_groups_of_many_copies(spark):
    """Chains and stars around several bases: links between copies that the base doesn't reach count too."""
    texts, k = [], 0
    for g in range(6):
        base = prose(100 + g, 120)
        for c in range(25):
            texts.append((k, changed(base, 1000 + k, [0.0, 0.01, 0.02, 0.03, 0.05][c % 5])))
            k += 1
        step = base
        for _ in range(6):
            step = changed(step, 2000 + k, 0.025)
            texts.append((k, step))
            k += 1
    texts += [(k + j, prose(500, 30) + " " + prose(600 + j, 40)) for j in range(30)]
    random.Random(3).shuffle(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.groups(docs).collect()) == brute_groups(texts)


def test_suffix_bound_never_exceeds_the_difference():
    r = np.random.default_rng(2)
    for _ in range(300):
        x, y = (np.unique(r.integers(0, 40, r.integers(0, 30))) for _ in range(2))
        true = len(np.setxor1d(x, y))
        assert jaccard.suffix_bound(x, y, int(r.integers(0, 40))) <= true


def test_suffix_array():
    r = random.Random(1)
    for _ in range(150):
        t = [r.randint(0, r.randint(1, 4)) for _ in range(r.randint(0, 60))]
        assert suffix_array(np.array(t, dtype=np.int16), 5).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_permuted_prefixes():
    r = random.Random(3)
    for most in (5, 8, 50):
        for _ in range(60):
            t = np.array([r.randint(0, r.randint(1, 3)) for _ in range(r.randint(0, 90))], dtype=np.int16)
            order = np.array(sorted(range(len(t)), key=lambda i: t[i:].tolist()), dtype=np.int64)
            got = permuted_prefixes(t.astype(np.uint8), order, most)
            for a, b in zip(order, order[1:]):
                n = 0
                while n < most and max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                    n += 1
                assert got[b] == n
            assert not len(t) or got[order[0]] == 0


def brute_repeats(texts):
    first, out = {}, []
    for i, t in texts:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                first[w] = min(first.get(w, i), i)
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - 49):
                if first[b[p : p + 50]] < i:
                    gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append(str((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("size", [8 << 20, 20_000])
def test_repeats(docs, no_docs, texts, monkeypatch, size):
    for name in ("CHUNK_BYTES", "BUCKET_BYTES", "SHARD_BYTES", "PIECE"):
        monkeypatch.setattr(substrings, name, size)
    more = [(i, t) for i, t in texts]
    assert sorted(str(tuple(r)) for r in substrings.remove_repeats(docs).collect()) == brute_repeats(more)
    assert substrings.remove_repeats(no_docs).count() == 0


def test_repeats_of_odd_bytes(spark):
    r = random.Random(8)
    parts = ["".join(r.choice("ab\x00\xff") for _ in range(r.randint(30, 90))) for _ in range(8)] + ["\x00" * 70, "a" * 60, "é" * 40]
    texts = [(k, "".join(r.choice(parts)[r.randint(0, 20) :] for _ in range(r.randint(0, 5)))) for k in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert sorted(str(tuple(x)) for x in substrings.remove_repeats(docs).collect()) == brute_repeats(texts)


def test_anchors_of_equal_windows_agree():
    r = random.Random(5)
    body = "".join(r.choice("abcdef ") for _ in range(400)).encode()
    lone = defaultdict(set)
    for p in range(350):
        row, place, _ = substrings.anchors([body[p : p + 50]])
        assert len(place) == 1
        lone[p] = int(place[0]) + p
    _, places, _ = substrings.anchors([b"xyz", body])
    assert set(places.tolist()) == set(lone.values())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from veredas.llm import pieces, secrets
    from tests.llm.test_words import brute_base, brute_contamination, quality_fails

    base = [prose(300 + k, 80) for k in range(12)]
    texts = [(k, t) for k, t in enumerate(base)]
    texts += [(50 + k, changed(t, k, 0.01)) for k, t in enumerate(base[:5])]
    texts += [(70, "too short"), (71, None), (72, "#$% x " * 30), (73, base[11] + ' password = "abcdef123456" end'), (74, prose(400, 40) + " " + base[7][:300])]
    items = [(1, base[7][:200])]
    rows = [(i, t, "xx", "s", len(t) if t is not None else None) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "secret_scan", "piece_encoding"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = [(i, t) for i, t in texts if not quality_fails(t)]
    group = dict(eval(x)[::2] for x in brute_groups(good))  # noqa: S307 - our own strings
    good = [(i, t) for i, t in good if group[i] == i and not brute_contamination(t, items)[1]]
    assert set(got) == {i for i, _ in good} and 7 not in got and 73 not in got
    p = pieces.Pieces.load(pieces.default_path())
    for i, t in good:
        if not brute_base(t):
            assert p.decode(got[i].ids) == t
    docs = spark.createDataFrame([(1, 'password = "abcdef123456"', "x", "s", 25)], "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.secret_scan(spark, docs, str(tmp_path)).first()
    assert one.text == 'password = "[SECRET]"' and one.n_chars == len(one.text)
    assert secrets.redact(spark.createDataFrame([], SCHEMA), None).count() == 0
    assert Counter(n for n, _ in corpus_pipeline.STAGES).most_common(1)[0][1] == 1


def test_groups_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, prose(1, 60)), (None, prose(1, 60)), (None, None)], "doc_id long, text string")
    assert sorted((r.n_shingles, r.component_id) for r in jaccard.groups(docs).collect()) == [(0, None), (56, None), (56, None)]


def test_pipeline_of_nothing_and_of_more_columns(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int, _row long, component_id long, _gone string, _MEASURED int, `a.b` int, node long"
    spark.createDataFrame([(1, "w0 w1 w2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k, prose(500 + k, 80), "xx", "s", 1, 2, 77 + k, 4, f"g{k}", 5, 60 + k, 7) for k in (1, 2)]
    for name, some in (("none", []), ("some", rows)):
        folder = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES:
            docs = run(spark, docs, str(folder))
            assert docs.count() == len(some), stage
            if stage != "piece_encoding":
                assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
                kept = [tuple(r[c] for c in docs.columns if c not in ("text", "n_chars")) for r in docs.collect()]
                assert sorted(kept) == sorted((r[0], *r[2:4], *r[5:]) for r in some), stage


def test_pipeline_filters_judge_rows_apart(spark):
    from veredas.llm import decontaminate

    a, b, c = prose(301, 80), prose(302, 80), prose(303, 80)
    docs = spark.createDataFrame([(7, a), (7, a), (7, b), (None, c), (None, c), (9, b), (3, b), (8, ""), (8, "")], "doc_id long, text string").repartition(3)
    kept = sorted(((str(r.doc_id), r.text) for r in jaccard.keep_one(docs).collect()))
    assert kept == sorted([("7", a), ("None", c), ("3", b), ("8", ""), ("8", "")])
    bench = spark.createDataFrame([(1, " ".join(c.split()[10:30]))], "item_id long, text string")
    clean = decontaminate.decontaminate_rows(docs.union(spark.createDataFrame([(7, c)], docs.schema)), bench)
    assert clean.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in clean.collect()) == sorted([("7", a), ("7", a), ("7", b), ("9", b), ("3", b), ("8", ""), ("8", "")])


_ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
from veredas.session import local_session
import __spark_entry__ as entry, corpus_pipeline
spark = local_session(2, partitions=2, memory="3g")
for name, query in entry.queries().items():
    if name.startswith("op") and name[2:3].isdigit() or name == "pipeline":
        query(spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
        print("ran", name)
"""


def test_executors_need_no_copy_of_the_package(spark, tmp_path):
    """Every query from another folder: its workers cannot import the package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    import __spark_entry__ as entry

    texts = [(k, prose(700 + k, 60) + f" password = hunter{k}hunter{k}", "xx", "s", 1) for k in range(12)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w0 w1 w2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.net/de/8", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = str(Path(entry.__file__).parent)
    done = subprocess.run([sys.executable, "-c", _ELSEWHERE, repo, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == sum(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in entry.queries())
