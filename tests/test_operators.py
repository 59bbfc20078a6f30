"""Operators on literal frames whose results are known by hand."""

import hashlib
import math
import re
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from veredas.functions import domain
from veredas.functions.dialect import Duck, Spark
from veredas.operators import conditional, encode, finalize, generate, privacy, profilestats, reports, twosample, validate
from veredas.plans import queries, registry  # noqa: F401

D = Spark()


def sql(spark, build, rows, names):
    frame = spark.createDataFrame(rows, names)
    return spark.sql(build, t=frame).collect()


def test_tvd_by_hand(spark):
    rows = [("ref", "A"), ("ref", "A"), ("ref", "B"), ("syn", "A"), ("syn", "C"), ("syn", "C")]
    r = sql(spark, twosample.tvd(D, "{t}", "c"), rows, "side string, c string")[0]
    assert (r.tvd, r.n_missing, r.n_unexpected, r.coverage) == (pytest.approx(2 / 3, abs=1e-6), 1, 1, 0.5)


def test_wasserstein_and_ks(spark):
    rows = [("ref", float(x), 1) for x in (1, 2, 3, 4)] + [("syn", float(x), 1) for x in (2, 3, 4, 5)] + [("ref", 3.0, 2), ("syn", 3.0, 2), ("syn", float("nan"), 2)]
    got = {r.grp: r for r in sql(spark, twosample.distances(D, "{t}", "g", "x"), rows, "side string, x double, g int")}
    assert got[1].wasserstein == 1.0 and got[1].ks == 0.25
    assert got[2].wasserstein == 0.0 and got[2].normalized is None


@pytest.mark.parametrize(("value", "ok"), [("529.982.247-25", True), ("111.111.111-11", False), ("529.982.247-24", False), ("5", False), (None, False)])
def test_cpf(spark, value, ok):
    assert sql(spark, f"SELECT {validate.cpf_valid(D, 'x')} AS ok FROM {{t}}", [(value,)], "x string")[0].ok is ok


def test_duplicates_by_hand(spark):
    rows = [(30, "A")] * 3 + [(40, "B")] * 2 + [(50, "C")]
    r = sql(spark, privacy.duplicate_rows(D, "{t}", privacy.row_key(D, ("a", "g"))), rows, "a int, g string")[0]
    assert (r.total, r.unique_rows, r.duplicated_occurrences, r.duplicated_groups, r.rows_in_groups, r.largest) == (6, 3, 3, 2, 5, 3)


def test_bands_differ():
    con = duckdb.connect()
    got = con.execute(f"SELECT {twosample.income_band('a')}, {twosample.cut_band('a')} FROM (VALUES (24), (59), (60), (17), (86)) AS v(a)").fetchall()
    assert got == [("18-24", "18-24"), ("45-59", "55-64"), ("60+", "55-64"), ("18-24", None), ("60+", None)]


def test_columns():
    assert profilestats.resolve_columns(preset="minimo") == ["Nome", "Idade", "Estado", "CPF"]
    assert profilestats.resolve_columns([" CPF ", "Nome"]) == ["CPF", "Nome"]
    for bad in ([], ["cpf"], ["CPF", "CPF"], [1]):
        with pytest.raises(ValueError):
            profilestats.resolve_columns(bad)


def test_generated_profiles_are_valid_and_do_not_depend_on_partitions(spark):
    ids = spark.range(300).withColumnRenamed("id", "row_id")
    rows = generate.generate_final_profiles(ids).collect()
    again = generate.generate_final_profiles(ids.repartition(5)).collect()
    assert sorted(rows) == sorted(again) and len({r.CPF for r in rows}) == 300
    spark.createDataFrame(rows).createOrReplaceTempView("made_profiles")
    for name, p in (validate.rules(D) | validate.final_rules(D)).items():
        if name != "marital_age":
            assert spark.sql(f"SELECT coalesce(sum(CASE WHEN {p} THEN 0 ELSE 1 END), 0) AS n FROM made_profiles").first().n == 0, name


def test_domain_sizes():
    assert len(domain.STATES) == 27 and len(domain.OCCUPATIONS) == len(domain.ALIASES) == 37
    assert sum(len(v[1]) * len(v[2]) for v in domain.STATES.values()) == 201


def test_every_query_has_a_twin():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert "parquet.`" not in "".join(registry.oracle_sql().values()) and Duck().table("x") == "x"


def test_tail_events_cut_by_all_four_keys(spark):
    row = lambda side, k, age, region, x: (k, side, "A", "E", age, region, float(x))
    rows = [row("ref", k, 30, "N", 100 + k) for k in range(40)] + [row("ref", k, 30, "S", 9000 + k) for k in range(40)] + [row("ref", k, 70, None, 50 + k) for k in range(30)]
    rows += [row("ref", k, 20, "N", 10) for k in range(29)]
    rows += [row("syn", 1, 30, "N", 500), row("syn", 2, 30, "S", 8000), row("syn", 3, 70, None, 200), row("syn", 4, 20, "N", 99999), row("syn", 5, 30, "S", 9500)]
    build = conditional.tail_events(D, "{t}")
    got = sql(spark, build, rows, "row_id long, side string, Ocupacao string, Escolaridade string, Idade int, Regiao string, Renda double")
    assert [(r.row_id, r.Regiao) for r in got] == [(1, "N"), (5, "S"), (3, None)]


def test_kept_relations_and_spread(spark, tmp_path):
    """A kept relation is written once, with the session's settings left as they were; parts are dealt out by number."""
    from veredas.functions.dialect import METHOD_LIMIT, Duck, Spark

    d, before = Spark("", spark), spark.conf.get(METHOD_LIMIT)
    rel = "(SELECT id, rand() AS x FROM range(100))"
    a, b = (sorted(map(tuple, spark.sql(f"SELECT * FROM {d.kept(rel, 'test')} AS t").collect())) for _ in range(2))
    assert a == b and len(a) == 100 and spark.conf.get(METHOD_LIMIT) == before
    assert spark.sql(f"SELECT * FROM {d.spread('range(100)')} AS t").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert Duck().kept(rel, "test") == Spark().kept(rel, "test") == rel


def test_evidence_checks_of_a_hot_metric(spark):
    """The values are counted before they move: no shuffle of rows by metric, and the bounds are the broadcast side."""
    from veredas.functions.dialect import Spark
    from veredas.operators import experiments

    rel = "(SELECT 'a' AS metric_name, CAST(id AS DOUBLE) AS value FROM range(10) UNION ALL SELECT 'b', NULL UNION ALL SELECT 'c', 0.5e0)"
    found = spark.sql(experiments.evidence_checks(Spark(), rel, {"a": (0.0, 4.0), "b": (0.0, 1.0), "c": (0.0, 1.0), "none": (0.0, 1.0)}))
    assert {tuple(r) for r in found.collect()} == {("a", 10, 5, False), ("b", 0, 0, False), ("c", 1, 1, True), ("none", 0, 0, False)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftOuter") < plan.index("Inner")


def test_rows_are_made_by_projections(spark):
    """What a generated row holds is made by a projection below it: a generator that isn't compiled interprets its expressions (F6 to F22)."""
    import re

    plan = spark.sql(f"SELECT row_id, a, b FROM {D.fixed('(SELECT id AS row_id FROM range(3)) AS i', {'a': D.uniform(1, 'row_id', 'x'), 'b': D.draw(1, 'row_id', 'x')})} AS f WHERE a < 2")._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if re.search(r"Generate inline", line)]
    assert made and all("md5" not in line for line in made) and "md5" in plan


def test_draws_compare_like_their_numbers(spark):
    """Digits stand below a share where the number does, whatever the share; a missing row id draws as before."""
    shares = (0.0, 0.001, 0.005, 0.02, 1 / 3, 0.5, 0.97, 1.0, 1.5)
    cells = ", ".join(f"({D.under(D.draw(3, 'id', 'k'), p)}) = ({D.uniform(3, 'id', 'k')} < {p!r}e0) AS ok{i}" for i, p in enumerate(shares))
    rows = spark.sql(f"SELECT {cells} FROM (SELECT id FROM range(2000) UNION ALL SELECT NULL)").collect()
    assert len(rows) == 2001 and all(all(r) for r in rows)
    duck = [r[0] for r in duckdb.connect().execute(f"SELECT {Duck().uniform(3, 'id', 'k')} FROM (SELECT range AS id FROM range(100) UNION ALL SELECT NULL) AS t ORDER BY id NULLS LAST").fetchall()]
    assert [r.u for r in spark.sql(f"SELECT {D.uniform(3, 'id', 'k')} AS u FROM (SELECT id FROM range(100) UNION ALL SELECT NULL) ORDER BY id NULLS LAST").collect()] == duck
    edge = spark.sql(f"SELECT {D.under('x', 0.5)} AS below FROM VALUES ('7fffffffffffffff'), ('80000000000000') AS v(x)").collect()
    assert [r.below for r in edge] == [True, False]


def test_short_ways_equal_the_long_ones(spark):
    """Texts, birth dates and check digits by their short ways give what composing, parsing and cases gave."""
    texts = ["Tecnico", "Técnico", "Técnico", "Sao Paulo", "São Paulo", "São Paulo", "x", "", None, "Å", "각", "é"]
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    r = spark.sql(f"SELECT {D.composed_and_spelled('x', domain.ALIASES)} AS a, {D.spelled(D.nfc('x'), domain.ALIASES)} AS b FROM {{t}}", t=frame).collect()
    assert [x.a for x in r] == [x.b for x in r] and r[2].a == "Técnico" and r[3].a == r[4].a == "São Paulo"
    dates = {"2000-07-26": 26, "2000-07-27": 25, "2000-02-29": 26, "2001-02-29": None, "26/07/2000": 26, "27/07/2000": 25, "1901-02-03": 125, "2030-01-01": -4, "2000-7-26": None, "2000-07-26\n": None, "2000-07-26 ": None, " 2000-07-26": None, "0001-01-01": 2025, "2000-13-01": None, "x": None, "": None}
    frame = spark.createDataFrame(list(dates.items()), "x string, age int")
    assert [(x.x, x.a) for x in spark.sql(f"SELECT x, age, {D.age_at('x', '2026-07-26')} AS a FROM {{t}}", t=frame).collect() if x.a != x.age] == []
    both = spark.sql(f"SELECT {D.check_low('id')} AS a, {Duck().check_low('id')} AS b, {D.check_ten('id')} AS c, {Duck().check_ten('id')} AS e FROM range(500)").collect()
    assert all(x.a == x.b and x.c == x.e for x in both)


def test_comparison_counts_its_values_once(spark):
    """The five groupings are counted once and read from there by quantiles and distances (F2, F17)."""
    d = Spark("", spark)
    rows = "(SELECT CASE WHEN id % 2 = 0 THEN 'ref' ELSE 'syn' END AS side, 'A' AS Ocupacao, 'E' AS Escolaridade, 30 AS Idade, 'N' AS Regiao, CAST(1000 + id AS DOUBLE) AS Renda FROM range(200))"
    plain, kept = conditional.compare(D, rows), conditional.compare(d, rows)
    assert "GROUPING SETS" in plain and "GROUPING SETS" not in kept
    assert sorted(map(tuple, spark.sql(plain).collect())) == sorted(map(tuple, spark.sql(kept).collect()))


def kept_names(spark, build):
    """The relations that a query over the ids writes, and their SQL."""
    d, found = Spark("/root/testdata/sf0.001", spark), {}
    kept = d.kept
    d.kept = lambda rel, name, *a, **k: found.setdefault(name, []).append(rel) or kept(rel, name, *a, **k)
    spark.sql(build(d)).collect()
    return found


def test_people_of_all_income_versions_are_made_once(spark):
    found = kept_names(spark, lambda d: f"SELECT version, count(*) AS n FROM {queries._versions(d)} AS v GROUP BY version")
    assert sum(map(len, found.values())) == 1


def test_stages_make_no_identifiers(spark):
    found = kept_names(spark, lambda d: f"SELECT stage, count(*) AS n FROM {queries._stages(d)} AS s GROUP BY stage")
    assert not any("n_cpf" in rel for rels in found.values() for rel in rels)


def test_keys_of_validation_are_numbers(spark):
    found = kept_names(spark, lambda d: validate.validation_report(d, queries._broken(d)))
    assert not any("sha2" in rel for rel in found["judged"])


def test_check_digits_on_numbers_and_on_texts_agree(spark):
    texts = ["529.982.247-25", "52998224725", " 52998224725", "52998224725\n", "5-2998224725", "+5299822472", "529.982.247-24", "00000000000", "11111111111", "12345678900", "00000000191", "12345", "", None,
             "529 982 247 25", "５2998224725", "000000000191", "004356870906", "00435687090.", "0043568709-06", "102385010671", "1e10000000000", "2998224725a"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id int, t string").selectExpr("row_id", "t AS CPF", "t AS CNH", "t AS Titulo_Eleitor")
    frame.createOrReplaceTempView("odd_texts")
    plain, staged = validate.final_rules(D, validate.NUMBERED), validate.final_rules(D, validate.NUMBERED, True)
    rel = D.with_numbers("odd_texts", validate.NUMBERED)
    rows = spark.sql(f"SELECT row_id, {', '.join(f'{plain[c]} AS p_{c}, {staged[c]} AS s_{c}' for c in validate.NUMBERED)} FROM {rel} AS x ORDER BY row_id").collect()
    assert all(r[f"p_{c}"] == r[f"s_{c}"] for r in rows for c in validate.NUMBERED)
    assert rows[0].s_CPF and rows[1].s_CPF and rows[2].s_CPF and not rows[6].s_CPF and not rows[7].s_CPF


def test_later_rows_by_hand(spark):
    rows = [(1, "a", "x"), (2, "b", None), (3, "a", "y"), (4, "c", None), (5, "a", "x")]
    keys = {"k": "k", "row": "concat(k, coalesce(v, '-'))", "v": "coalesce(v, '-')"}
    flags = ", ".join(f"{e} AS {c}" for c, e in D.key_flags(keys).items())
    frame = spark.createDataFrame(rows, "row_id int, k string, v string")
    got = spark.sql(f"SELECT * FROM {D.later(f'(SELECT row_id, {flags} FROM {{t}} AS g)', keys)} AS l", t=frame).collect()
    assert {(r.later_id, r.m_k, r.m_row, r.m_v) for r in got} == {(3, 1, 0, 0), (5, 1, 1, 1), (4, 0, 0, 1)}


ODD_RECORDS = [
    '{"model": "CTGAN", "rate": 0.92, "list": ["Idade", "x"], "m": {"a": 1, "b": -0.0, "c d": "7", "e.f": 2, "g": null, "h": [1]}}', '{"model": "CT\\u0047AN", "rate": 1e-1, "list": ["Geo_Key"], "m": {"a": true}}', '{"model" : "ctgan" ,\n"rate":"0.93","list":[["Geo_Key"]]}',
    '{"a": "\\u00010", "b": 5, "rate": 12345678901234567}', '{"a": 1, "a": 2}', '{1: true}', '{"a": "x"5}', '{"a": 01}', '{"a": "x 5', "[1, \x01]", '{"rate": NaN, "list": "Geo_Key", "s": "NaN \\" 5"}', "", "7", "[]", None,
]


def plain_nodes(spark, frame):
    """The nodes of every record by a walk of its own."""
    from veredas.operators import nested

    return nested._walked(frame.selectExpr("k AS record", "t").select("record", nested.standard_json(F.col("t")).alias("text")).where("text IS NOT NULL"))


def odd_records(spark):
    """Odd texts, with keys that repeat and a key that is missing."""
    rows = [(None if i == 1 else i % 5, t) for i, t in enumerate(ODD_RECORDS)] + [(9 + i, t) for i, t in enumerate(ODD_RECORDS)] + [(0, ODD_RECORDS[0].replace("1,", "4,")), (None, ODD_RECORDS[0])]
    return spark.createDataFrame(rows, "k long, t string")


def same_rows(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_records_of_one_shape_are_walked_once(spark, monkeypatch):
    """Nodes are those of every record's own walk, but each distinct shape alone is walked (F3); a long text has no depth of calls."""
    from veredas.operators import nested

    frame = odd_records(spark)
    same_rows(nested.nodes(frame, "k", "t"), plain_nodes(spark, frame))
    walked, walk = [], nested._walked
    monkeypatch.setattr(nested, "_walked", lambda base: walked.append(base.count()) or walk(base))
    many = spark.range(500).selectExpr("id AS k", "concat('{\"a\": ', id, ', \"b\": [\"', id, '\"', CASE WHEN id % 2 = 0 THEN ', -1.5' ELSE '' END, ']}') AS t")
    rows = nested.nodes(many, "k", "t").collect()
    assert walked == [2] and len(rows) == 1750 and {r.number for r in rows if r.path == "$.a"} == set(range(500)) and {r.value for r in rows if r.path == "$.b[0]"} == set(map(str, range(500)))
    long = spark.createDataFrame([(1, '{"a": "' + "y" * 100_000 + '", "b": "' + "\\\\" * 50_000 + '"}')], "k long, t string")
    assert {r.path: len(r.value) for r in nested.nodes(long, "k", "t").collect()} == {"$.a": 100_000, "$.b": 50_000}


def test_metrics_of_shapes_are_those_of_nodes(spark):
    """Metrics found by shape are what the SQL gives of the nodes, also where records share a key; without shared keys no row is shuffled for them (F1)."""
    from veredas.operators import nested

    frame = odd_records(spark)
    metrics = (nested.Metric("g", "rate", "$.rate", "$.m.a", "$.m.b"), nested.Metric("g", "*", "$.m.*"), nested.Metric("g", "mean", "$.m.*", of="mean", column="m"), nested.Metric("g", "two", "$.*.*", of="mean"), nested.Metric("g", "size", "$.list", of="size"))
    plain_nodes(spark, frame).createOrReplaceTempView("odd_nodes")
    same_rows(nested.run_metrics(frame, "k", "t", metrics), spark.sql(nested.metrics_sql(Spark(), "odd_nodes", metrics)))
    plan = nested.run_metrics(frame.where("k > 8"), "k", "t", metrics)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate explode" in plan


def test_checks_of_shapes_are_those_of_nodes(spark):
    """Checks judged by shape are what the SQL gives of the nodes, for every row, also where records share a key or have none; no grouping where none is shared (F4)."""
    from veredas.operators import nested

    frame = odd_records(spark)
    checks = (nested.Check("model", "$.model", text="ctgan"), nested.Check("rate", "$.rate", low=0.1, high=0.95), nested.Check("hidden", "$.list", absent="Geo_Key"), nested.Check("other", "$.list", absent="x"), nested.Check("none", "$.none", text="x"))
    plain_nodes(spark, frame).createOrReplaceTempView("odd_nodes")
    frame.selectExpr("k AS record").createOrReplaceTempView("odd_keys")
    got = nested.run_checks(frame, "k", "t", checks)
    same_rows(got, spark.sql(nested.checks_sql(Spark(), "odd_nodes", "odd_keys", checks)))
    assert got.count() == frame.count() * len(checks) and got.where("passed").count() > 5
    plan = nested.run_checks(frame.where("k > 8"), "k", "t", checks)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate explode" in plan


def test_all_tail_events_of_stages_are_counted(spark):
    """The report of stages counts every tail event, where 500 were the most (F5); groups of fewer than 30 reference rows have none, by definition."""
    row = lambda side, k, job, x: (k, side, job, "E", 30, "N", float(x))
    rows = [row("ref", k, "A", 100 + k) for k in range(40)] + [row("ref", k, "B", 100 + k) for k in range(29)] + [row("syn", k, "A", 1000 + k) for k in range(700)] + [row("syn", k, "B", 1000) for k in range(50)]
    names = "row_id long, side string, Ocupacao string, Escolaridade string, Idade int, Regiao string, Renda double"
    raw = [r if r[1] == "ref" or r[0] < 600 else (*r[:6], 1.0) for r in rows]
    for name, held in (("final_t", rows), ("raw_t", raw)):
        spark.createDataFrame(held, names).createOrReplaceTempView(name)
    want = {("final", 700), ("raw", 600)}
    assert {(r.stage, r.n_events) for r in spark.sql(reports.conditional_report(D, "final_t", "raw_t")).collect()} == want
    assert "LIMIT" not in registry.oracle_sql()["conditional_stages"] and "LIMIT 500" in registry.oracle_sql()["plausibility"]


def test_stages_are_compared_from_one_count(spark):
    """Both stages' summaries come from one count of the incomes and one order of every group's bins, and are those of each stage by itself (F2)."""
    import random

    r = random.Random(5)
    job = lambda: r.choice(["A", "B", "C", None])
    income = lambda stage: r.choice([None, float("nan"), -5.0, 0.0, *(round(r.lognormvariate(8 + (stage == "raw") / 9, 0.5), r.choice([0, 2])) for _ in range(40))])
    rows = [(stage, k, job(), r.choice("EF"), r.choice([20, 40, 70, None]), r.choice(["N", None]), income(stage)) for stage in ("holdout", "raw", "final") for k in range(3000)]
    rows += [(s, k, "few", "E", 30, "N", float(100 + k)) for s, n in (("holdout", 31), ("raw", 29), ("final", 40)) for k in range(n)] + [("final", 1, "new", "E", 30, "N", 1.0), ("other", 1, "A", "E", 30, "N", 1e9)]
    spark.createDataFrame(rows, "stage string, row_id long, Ocupacao string, Escolaridade string, Idade int, Regiao string, Renda double").createOrReplaceTempView("staged_rows")
    against = lambda stage: f"(SELECT *, CASE WHEN stage = 'holdout' THEN 'ref' ELSE 'syn' END AS side FROM staged_rows AS r WHERE stage IN ('holdout', '{stage}'))"
    got = spark.sql(conditional.staged(Spark("", spark), "(SELECT * FROM staged_rows AS s WHERE stage <> 'other')", "holdout", ("final", "raw"))).collect()
    want = spark.sql(reports.conditional_report(D, against("final"), against("raw"))).collect()
    assert [list(map(str, x)) for x in got] == [list(map(str, x)) for x in want] and all(x.n_groups > 20 and x.n_events > 20 for x in got)
    found = kept_names(spark, lambda d: conditional.staged(d, queries._stages(d, queries._INCOME_COLUMNS), "holdout", ("final", "raw")))
    assert len(found["incomes"]) == 1 and "counted" not in found
    assert not any("Municipio" in rel.split(" FROM ")[0] for name in ("holdout", "raw", "repaired") for rel in found[name])


def test_wanted_columns_are_those_of_the_whole(spark):
    """Rows that are made or repaired for some columns alone hold there what whole rows hold (F2)."""
    from veredas.operators import finalize

    ids, some = "(SELECT id AS row_id FROM range(400))", ("Idade", "Estado", "Regiao", "Escolaridade", "Ocupacao", "Renda")
    shown = lambda rel: sorted(map(repr, spark.sql(f"SELECT row_id, {', '.join(some)} FROM {rel} AS t").collect()))
    for build in (lambda **k: generate.profiles_sql(D, ids, 7, **k), lambda **k: generate.broken_profiles_sql(D, ids, **k), lambda **k: finalize.repaired_sql(D, generate.broken_profiles_sql(D, ids, **k), **k)):
        few, whole = build(columns=some), build(columns=tuple(domain.MODEL_COLUMNS))
        assert shown(few) == shown(whole) and "Municipio" not in spark.sql(f"SELECT * FROM {few} AS t").columns


def test_ranks_are_counted_once_a_column(spark):
    """Rank correlations of rows with gaps, copies, zeros of both signs and one value in a fifth of the rows; a column's values are counted for all of its pairs, not exploded for each (F1)."""
    odd = {1: None, 2: float("nan"), 3: float("inf"), 4: -0.0, 5: 0.0}
    value = lambda i, k: odd.get((i * 7 + k) % 17, 5.0 if i % 5 == 0 else float(i * (k + 3) * 31 % (11 + 90 * k) - 20))
    rows = [(("ref", "syn", None, "other")[0 if i < 60 else i % 4], *(value(i, k) for k in range(3))) for i in range(150)]
    rows += rows[:9]
    columns = ("a", "b", "c")
    fits = lambda x: x is not None and math.isfinite(x)

    def correlation(side, i, j):
        pairs = [(r[i + 1], r[j + 1]) for r in rows if r[0] == side and fits(r[i + 1]) and fits(r[j + 1])]
        rank = lambda v: [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]
        return statistics.correlation(*map(rank, zip(*pairs, strict=True)))

    made = spark.createDataFrame(rows, "side string, a double, b double, c double")
    found = spark.sql(twosample.spearman_difference(D, "{t}", columns), t=made)
    got = {(r.a, r.b): (r.ref, r.syn) for r in found.collect()}
    assert got == {(columns[i], columns[j]): tuple(pytest.approx(correlation(s, i, j), abs=2e-6) for s in ("ref", "syn")) for i in range(3) for j in range(i + 1, 3)}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in spark.sql(twosample.correlation_summary(D, "{t}", columns), t=made.where("side IS NULL")).collect()] == [("pearson", 0.0, 0.0), ("spearman", 0.0, 0.0)]


def test_numbers_follow_the_digests_of_rows(spark, monkeypatch):
    """Rows are numbered in the order of their contents' digests, nulls, bars, empty texts and copies beyond a lot included; rows with blocks' starts meet without another shuffle (F2)."""
    monkeypatch.setattr(finalize, "LOT", 4)
    rows = [("x", 1.5)] * 11 + [(None, None)] * 2 + [("", 0.0), ("a|b", None), ("a||b", 2.0), ("\u00e3", float("nan"))] + [(f"t{i % 40}", float(i)) for i in range(200)]
    text = lambda x: chr(2) if x is None else ("NaN" if x != x else str(x)).replace("|", "||")
    digests = sorted(hashlib.sha256("|".join(map(text, r)).encode()).hexdigest() for r in rows)
    found = spark.sql(f"SELECT * FROM {finalize.numbered_sql(D, '{t}', ('a', 'b'), 7)} AS n", t=spark.createDataFrame(rows, "a string, b double").repartition(3))
    got = {r.row_id: hashlib.sha256("|".join(map(text, (r.a, r.b))).encode()).hexdigest() for r in found.collect()}
    assert [got[k] for k in sorted(got)] == digests and sorted(got) == list(range(7, 7 + len(rows)))
    steps = [line.lstrip(" :+-") for line in spark.sql(f"EXPLAIN SELECT * FROM {finalize.numbered_sql(D, '(SELECT CAST(id AS STRING) AS a FROM range(100000000))', ('a',))} AS n").first()[0].splitlines()]
    joined = next(i for i, line in enumerate(steps) if "Join" in line)
    assert not any(line.startswith("Exchange") for line in steps[joined : next(i for i, line in enumerate(steps) if i > joined and line.startswith("Window"))])


def test_cells_of_a_vector_are_looked_up(spark, tmp_path):
    """A category's cells are those of a comparison with each of its values, for nulls, unknown texts and area codes of any type, and going there and back makes no method that the JVM only interprets (F3)."""
    shown = {c: [*v, None, "", "x", v[0].lower() + " "] for c, v in encode.CATEGORIES.items() if c != "DDD"}
    codes = [*encode.CATEGORIES["DDD"], None, 0, -11]
    rows = [(i, None if i % 4 == 0 else 10 + i, None if i % 5 == 0 else 750.25 * i, i % 9 - 1, codes[i % len(codes)], *(v[i % len(v)] for v in shown.values())) for i in range(90)]
    names = f"row_id long, Idade int, Renda double, Dependentes int, DDD int, {', '.join(f'{c} string' for c in shown)}"
    frame = spark.createDataFrame(rows, names)
    plain = ", ".join(f"CASE WHEN {c} = {repr(x)} THEN 1e0 ELSE 0e0 END" for c, v in encode.CATEGORIES.items() for x in v)
    want = {r.row_id: r.v for r in spark.sql(f"SELECT row_id, array({plain}) AS v FROM {{t}}", t=frame).collect()}
    for kind in ("int", "bigint", "double", "string"):
        got = spark.sql(f"SELECT row_id, v FROM {encode.encode_sql(D, '{t}')} AS e", t=frame.withColumn("DDD", F.col("DDD").cast(kind))).collect()
        assert len(got) == len(rows) and all(len(r.v) == encode.width() and r.v[3:] == want[r.row_id] for r in got)
    frame.write.parquet(f"{tmp_path}/rows")
    code = spark.sql(f"EXPLAIN CODEGEN {encode.decode_sql(D, encode.encode_sql(D, f'parquet.`{tmp_path}/rows`'))}").first()[0]
    assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
