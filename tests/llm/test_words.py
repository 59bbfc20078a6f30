"""Quality rules, decontamination, URL rules, token counts and secrets."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from veredas.llm import decontaminate, quality, secrets, tokencount, urlrules

SPACE = re.compile("[^\x20\x09-\x0d]+")


def words(t):
    return SPACE.findall(t or "")


def brute_quality(t):
    w = words(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines), len(lines) - len(set(lines)), len(hit), sum(a == b for a, b in zip(w, w[1:])))


def test_quality_measures(docs, texts):
    got = quality.judge(docs).collect()
    assert sorted((str(r.doc_id), *(r[m] for m in quality.MEASURES)) for r in got) == sorted((str(i), *brute_quality(t)) for i, t in texts)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed & quality.mask(quality.POLICIES["v2"]))
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].kept and by_id[12].kept and not by_id[25].kept and not by_id[22].kept


def test_quality_policy_keeps_rows_and_columns(docs, no_docs):
    kept = quality.apply_policy(docs)
    assert kept.columns == docs.columns
    want = Counter(r.text for r in docs.collect() if not quality_fails(r.text))
    assert Counter(r.text for r in kept.collect()) == want
    assert quality.apply_policy(no_docs).count() == 0


def quality_fails(t):
    values = dict(zip(quality.MEASURES, brute_quality(t)))
    return any(eval(p, {}, values) for p in quality.RULES.values())  # noqa: S307 - our own rules


def test_ablation_adds_up(docs, no_docs):
    ledger = quality.ledger(docs)
    rows = quality.ablation(ledger).collect()
    failed = [r.failed & quality.mask(quality.POLICIES["v2"]) for r in ledger.collect()]
    for r in rows:
        b = quality.bit(r.rule)
        assert (r.n_failed, r.only_this) == (sum(bool(f & b) for f in failed), sum(f == b for f in failed))
        assert (r.n_docs, r.n_kept) == (len(failed), failed.count(0))
    assert {r.n_failed for r in quality.ablation(quality.ledger(no_docs)).collect()} == {0}


NORMAL = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def norm(t):
    return NORMAL.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute_contamination(t, items):
    w, hit, found = norm(t), set(), set()
    for item, text in items:
        q = norm(text)
        n = min(10, len(q))
        for s in range(len(q) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == q[s : s + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination(spark, docs, texts, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    base = texts[0][1].split(" ")
    items = [(1, " ".join(base[20:45])), (2, "ONE, two"), (3, None), (4, ""), (5, " ".join(base[40:60])), (6, "nothing like it in here at all, not once ever"), (5, "repeated item id")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words long")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, bench).collect())
    want = sorted((str(i), *(lambda x: (x[0], x[1], tuple(x[2])))(brute_contamination(t, items))) for i, t in texts)
    assert got == want
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    gone = {i for i, t in texts if brute_contamination(t, items)[1] and i is not None}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in texts if i not in gone)


def test_contamination_of_nothing(spark, docs, no_docs, texts):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(docs, none).collect()} == {0}
    assert decontaminate.contamination(no_docs, none).count() == 0


def test_contamination_of_rows_without_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(None, text), (None, text), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, " ".join(f"w{k}" for k in range(5, 20)))], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit) for r in decontaminate.contamination(docs, bench).collect()) == [(0, 0), (30, 15), (30, 15)]


URLS = ["http://a.b.com/en/1", "http://example.com/en/7x?q=/de/", "https://www.Example.COM/en/71#x", "http://xexample.com/en/7", "http://net/de/", "http://example.net/de/81", "x", None, "http://org", "://org/es/a", "http://com:80/en/", "http://evil-com/en/", "http://a.org/es/http://b.com/en/", "http://a.com/EN/1", ""]


def brute_url(u):
    u = u or ""
    if "://" not in u:
        return "", "", None, "allow"
    rest = u.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = host.lower()
    fits = [r for r in urlrules.BASE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.action if best else "allow"


def test_url_rules(spark, monkeypatch):
    pages = spark.createDataFrame([(k // 2, u, "h") for k, u in enumerate(URLS + URLS)], "page_id long, url string, host string")
    want = sorted(map(str, [(k // 2, *brute_url(u)) for k, u in enumerate(URLS + URLS)]))
    assert sorted(str(tuple(r)) for r in urlrules.judge(pages).collect()) == want
    monkeypatch.setattr(urlrules, "BROADCAST_RULES", 0)
    assert sorted(str(tuple(r)) for r in urlrules.judge(pages).collect()) == want
    assert urlrules.judge(pages.limit(0)).count() == 0


def test_url_pattern_rules(spark):
    rules = (*urlrules.BASE_RULES, urlrules.Rule("", "", "block", r"/[a-z]+/\d{3,}\.exe$"), urlrules.Rule("b.org", "", "allow", r"/dl/.*"))
    pages = spark.createDataFrame([(1, "http://x.io/dl/1234.exe"), (2, "http://a.b.org/dl/1234.exe"), (3, "http://x.io/dl/12.exe")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urlrules.judge(pages, rules, more=()).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_url_line_ends(spark, monkeypatch):
    """An ending stands at the end of a path, not before a line's end; only a line feed ends a line."""
    paths = ("/a.exe", "/a.exe\n", "/a.exe\r", "/a.exe\u2028", "/a\rb.exe", "/a\u0085b.exe", "/a\nb.exe", "/a.exe\r\n?x", "/a.exe?\n")
    pages = spark.createDataFrame([(k, f"http://x.io{p}") for k, p in enumerate(paths)], "page_id long, url string")
    want = dict(enumerate(("block", "allow", "allow", "allow", "block", "block", "allow", "allow", "block")))
    assert {r.page_id: r.verdict for r in urlrules.judge(pages).collect()} == want
    monkeypatch.setattr(urlrules, "BROADCAST_RULES", 0)
    assert {r.page_id: r.verdict for r in urlrules.judge(pages).collect()} == want
    literal = spark.createDataFrame([(1, "http://x.io/a$"), (2, "http://x.io/a")], "page_id long, url string")
    for limit in (0, 50_000):
        monkeypatch.setattr(urlrules, "BROADCAST_RULES", limit)
        assert {r.page_id: r.verdict for r in urlrules.judge(literal, (urlrules.Rule("io", "/a$", "block"),), more=()).collect()} == {1: "block", 2: "allow"}


def test_url_method_rules(spark, monkeypatch):
    """The verdicts against every rule tried on every URL, by the index and by joins; names of columns clash on purpose."""
    paths = ["/", "/login/", "/login/x", "/xlogin/", "/a/b/login/c", "/help/login/", "/help/a/login/", "/login.php", "/login.phpx", "/a.zip", "/a.zip/b", "/a.ZIP", "/LOGIN/", "/en/login/", "/wp-admin/", "/docs/x.exe", "//ads//", "/a/ads"]
    urls = [f"https://{h}{p}?q=/login/" for h in ("x.com", "x.example.com", "x.zz", "com", "x.info") for p in paths] + URLS
    rows = [(k, u, "r", "t", ["a"]) for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, row string, token string, tokens array<string>")
    rules = urlrules.method_rules()
    assert len(rules) > 1_000 and len({r.text for r in rules}) == len(rules)

    def brute(u):
        host, path, rule, verdict = brute_url(u)
        fits = [r for r in rules if re.search(r.regex, host + path)]
        best = max(fits, key=lambda r: (len(r.text), r.text), default=None)
        return host, path, rule, verdict if rule or not best else best.action

    want = sorted(map(str, [(k, *brute(u)) for k, u in enumerate(urls)]))
    got = urlrules.judge(pages).collect()
    assert sorted(str(tuple(r)) for r in got) == want and {r.verdict for r in got if r.rule is None} == {"allow", "block"}
    monkeypatch.setattr(urlrules, "BROADCAST_RULES", 0)
    assert sorted(str(tuple(r)) for r in urlrules.judge(pages).collect()) == want


@pytest.mark.parametrize("pattern", ["/[a-z]+/\\d{3,}\\.exe$", "(/[^/]*)*/ads/", "/.*[.]zip$", "/ab*/cd/", "/x/y|/z/", "/a+b/c/", "/(x/)?y/"])
def test_tokens_of_a_pattern_are_in_every_match(pattern):
    rule = urlrules.Rule("", "", "block", pattern)
    for path in ("/abc/1234.exe", "/q/ads/", "/n/ads/x", "/k.zip", "/a/cd/", "/abbb/cd/", "/x/y", "/z/", "/aab/c/", "/y/", "/x/y/", "/q/xy/"):
        if re.search(rule.regex, "h" + path):
            assert set(rule.tokens) <= set(re.findall("[a-z0-9]+", "h/" + path)), path


def test_token_counts(docs, no_docs, texts):
    pieces = set(tokencount.load_pieces(tokencount.default_path()))
    longest = max(map(len, pieces))

    def greedy(word):
        n = at = 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces)
            n += 1
        return n

    def brute(t):
        w = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\x20\x09-\x0D]", (t or "").encode())
        return len(w), sum(greedy(b" " + x) for x in w)

    got = sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in tokencount.count_tokens(docs).collect())
    assert got == sorted((str(i), *brute(t)) for i, t in texts)
    assert tokencount.count_tokens(no_docs).count() == 0
    with pytest.raises(ValueError):
        tokencount.Automaton([b"ab"])


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def brute_base(t):
    t = t or ""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_secret_spans(docs, no_docs, texts):
    model = secrets.fit(docs)
    got = sorted((str(r.doc_id), [(s.start, s.end, s.kind) for s in r.spans if s.kind != "crf"]) for r in secrets.scan(docs, model).collect())
    assert got == sorted((str(i), brute_base(t)) for i, t in texts)
    assert secrets.fit(no_docs) is None
    assert secrets.scan(no_docs, None).count() == 0
    masked = secrets.redact(docs, model)
    assert masked.columns == docs.columns
    for r in masked.where("doc_id in (23, 24, 6, 12)").collect():
        assert not brute_base(r.text) or r.doc_id not in (23, 24)
        assert r.doc_id != 6 or r.text is None
    assert masked.where("doc_id = 12").first().text == docs.where("doc_id = 12").first().text


def test_crf_finds_what_patterns_miss():
    texts = [f"some words and password={'b7d1aa4f5fcc' + str(k):s} or token = \"0cab398dc11d1a2a11dc6572c8df{k}bd2\" in 2024-01-0{k % 9} at 10.0.0.{k} mail a{k}@b{k}.org" for k in range(40)]
    model = secrets.train(secrets.training_sequences(texts))
    spans = secrets.all_spans("deploy with ghp_16C7e42F292c6912E7710c838347Ae178B4a now", model)
    assert [k for _, _, k in spans] == ["crf"]
    assert not secrets.all_spans("call 171-5551234 on 2023-10-12, room 12b", model)


def test_crf_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    m = secrets.Crf(rng.normal(size=(secrets.DIM, 3)), rng.normal(size=(3, 3)))
    m.trans[secrets.O, secrets.I] = -1e9
    feats = [rng.integers(0, secrets.DIM, 4) if k % 3 else None for k in range(6)]
    u = m.scores(feats)
    score = lambda p: sum(u[i, t] for i, t in enumerate(p)) + sum(m.trans[a, b] for a, b in zip(p, p[1:]))
    assert tuple(m.viterbi(feats)) == max(itertools.product(range(3), repeat=6), key=score)


def test_drop_ids_both_ways(docs, monkeypatch):
    from veredas.llm import common

    ids = docs.select("doc_id").where("doc_id in (0, 20)")
    want = Counter(r.doc_id for r in docs.where("doc_id is null or doc_id not in (0, 20)").collect())
    assert Counter(r.doc_id for r in common.drop_ids(docs, ids).collect()) == want
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert Counter(r.doc_id for r in common.drop_ids(docs, ids).select(F.col("doc_id")).collect()) == want


def test_crf_finds_secrets_without_digits():
    made = ["qWcRtYuLmPasDf", "ZxKvBnMqWeRtYu", "plOkMijNuhBygV", "tFcRdXesZwAqLk", "hGfDsAqPzoWixE"]
    texts = [f"some words and then password={made[k % 5][k % 3 :]}{'XyQz'[k % 4]} in the deployment configuration of everybody, authentication notwithstanding" for k in range(40)]
    sequences = secrets.training_sequences(texts)
    assert all(secrets.B in x.tags for x in sequences)
    model = secrets.train(sequences)
    text = "the header says password is: gHjKlQwErTyUzX thanks"
    assert [(text[s:e], k) for s, e, k in secrets.all_spans(text, model)] == [("gHjKlQwErTyUzX", "crf")]
    assert "gHjKlQwErTyUzX" not in secrets.redact_text(text, model, "[SECRET]")
    assert not secrets.all_spans("everybody reads the configuration documentation, notwithstanding", model)


def test_crf_scores_by_word_are_the_scores_of_the_features():
    import numpy as np

    rng = np.random.default_rng(5)
    m = secrets.Crf(rng.normal(size=(secrets.DIM, 3)), rng.normal(size=(3, 3)))
    text = "Authorization: Bearer abcDEFghi é\t\n(key=12ab) x"
    s = secrets.tokens(text)
    starts, ends, u = secrets.Lookup(m).scores(text)
    assert (starts.tolist(), ends.tolist()) == (s.starts, s.ends)
    assert np.allclose(u, m.scores(secrets.features(text, s)))


def random_model(r):
    import numpy as np

    m = secrets.Crf(np.zeros((1, 3)), r.normal(0, 2, (3, 3)))
    m.trans[secrets.O, secrets.I] = -1e9
    return m


def test_decoding_where_a_tag_can_win_is_viterbi():
    import numpy as np

    r = np.random.default_rng(11)
    for _ in range(400):
        m, n = random_model(r), int(r.integers(1, 40))
        u = r.normal(0, 3, (n, 3))
        u[:, secrets.O] += r.choice([0.0, 2.0, 6.0])
        u[0, secrets.I] = -1e9
        worth = lambda path: sum(u[i, t] for i, t in enumerate(path)) + sum(m.trans[a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        assert worth(m.decode(u).tolist()) == pytest.approx(worth(m.best_path(u)))


def test_secrets_that_no_pattern_finds():
    """Trained on hex tokens behind a keyword; held-out texts hold values of letters and digits behind other words, or none."""
    import random

    r = random.Random(8)
    value = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    train = [f'{prose(900 + k, 60)} token = "{value(hexes, 40)}" {prose(1900 + k, 60)}' for k in range(60)] + [prose(3000 + k, 120) for k in range(60)]
    model = secrets.train(secrets.training_sequences(train))
    found = 0
    for k in range(60):
        v = value(mixed, r.choice((24, 32, 40)))
        text = f"{prose(4000 + k, 50)} {('auth key ', 'Authorization: Bearer ', '')[k % 3]}{v} {prose(5000 + k, 50)}"
        at = text.index(v)
        assert not secrets.pattern_spans(text)
        found += any(a < at + len(v) and at < b for a, b in secrets.crf_spans(text, model))
    assert found >= 54
    clean = [prose(6000 + k, 200) for k in range(60)]
    assert sum(len(secrets.crf_spans(t, model)) for t in clean) <= 1
