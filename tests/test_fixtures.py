"""Small frames with results that are known by hand; Spark and DuckDB must both give them."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veredas.functions import canonical, domain
from veredas.functions.dialect import Duck, Spark
from veredas.operators import conditional, encode, experiments, finalize, frames, gates, generate, kstest, neighbours, nested, privacy, probes, profilestats, reports, synthesizer, twosample, validate

MODEL = "row_id long, Idade int, Genero string, Regiao string, Estado string, Municipio string, Escolaridade string, Estado_Civil string, Ocupacao string, Renda double, Dependentes int, DDD int"
SP = (0, 40, "Feminino", "Sudeste", "SP", "São Paulo", "Superior Completo", "Casado", "Médico", 9000.0, 1, 11)
BROKEN = (1, 40, "Feminino", "Norte", "SP", "Manaus", "Fundamental", "Casado", "Médico", 700.0, 7, 92)
YOUNG = (2, 22, "Masculino", "Sudeste", "SP", "Campinas", "Superior Completo", "Viúvo", "Engenheiro", 5000.0, 0, 19)


@pytest.fixture
def ask(spark):
    """Runs a query over named frames in both engines; the rows as dicts, in one order."""

    def run(build, **frames):
        con = duckdb.connect()
        for name, (schema, rows) in frames.items():
            df = spark.createDataFrame(rows, schema)
            df.createOrReplaceTempView(name)
            con.register(f"{name}_pd", df.toPandas())
            cols = ", ".join(f"CAST({f.name} AS {({'string': 'VARCHAR', 'bigint': 'BIGINT', 'int': 'INT', 'double': 'DOUBLE', 'boolean': 'BOOLEAN'})[f.dataType.simpleString()]}) AS {f.name}" for f in df.schema)
            con.execute(f"CREATE TABLE {name} AS SELECT {cols} FROM {name}_pd")
            for f in df.schema:  # pandas has no null for numbers but NaN
                if f.dataType.simpleString() in ("double", "int", "bigint"):
                    at = [i for i, r in enumerate(rows) if r[df.schema.names.index(f.name)] is None]
                    if at:
                        con.execute(f"UPDATE {name} SET {f.name} = NULL WHERE rowid IN ({', '.join(map(str, at))})")
        one = [r.asDict() for r in spark.sql(build(Spark())).collect()]
        cur = con.execute(build(Duck()))
        names = [x[0] for x in cur.description]
        two = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
        key = lambda r: repr(sorted((k, str(v)) for k, v in r.items()))
        one, two = sorted(one, key=key), sorted(two, key=key)
        assert [{k: str(v) for k, v in r.items()} for r in one] == [{k: str(v) for k, v in r.items()} for r in two]
        return one

    return run


def sided(ref, syn):
    return [("ref", x) for x in ref] + [("syn", x) for x in syn]


def test_numeric(ask):
    t = ("side string, x double", sided([1.0, 2.0, 3.0, 4.0], [2.0, 3.0, 4.0, 5.0]))
    (r,) = ask(lambda d: twosample.distances(d, "(SELECT *, 1 AS g FROM t)", "g", "x"), t=t)
    assert (r["wasserstein"], r["ks"], r["normalized"]) == (1.0, 0.25, round(1 / 1.5, 6)) and 0 < r["ks_pvalue"] <= 1
    rows = {r["side"]: r for r in ask(lambda d: twosample.moments(d, "t", "x"), t=t)}
    assert (rows["ref"]["mean"], rows["ref"]["q25"], rows["ref"]["q50"], rows["ref"]["std"]) == (2.5, 1.75, 2.5, round(math.sqrt(5 / 3), 6))


def test_p_value_of_a_large_distance_is_the_series(ask):
    (r,) = ask(lambda d: f"SELECT {twosample.ks_p_value('ks', 'n', 'm')} AS p FROM t", t=("ks double, n double, m double", [(0.1, 500.0, 500.0)]))
    z = 0.1 * math.sqrt(250)
    assert r["p"] == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 50)), abs=1e-12)


def test_degenerate(ask):
    t = ("side string, x double", sided([3.0, 3.0, 3.0], [3.0, float("nan"), float("inf")]))
    (r,) = ask(lambda d: twosample.distances(d, "(SELECT *, 1 AS g FROM t)", "g", "x"), t=t)
    assert r["normalized"] is None and (r["n_ref"], r["n_syn"]) == (3, 1)
    (r,) = ask(lambda d: twosample.tvd(d, "c", "v"), c=("side string, v string", sided(["A", None], ["A", "B"])))
    assert (r["n_missing"], r["n_unexpected"], r["tvd"]) == (1, 1, 0.5)


def test_quantiles_against_numpy(ask):
    import numpy as np

    values = [float(x) for x in np.random.default_rng(3).normal(0, 500, 301).round(2)] + [0.0, -0.01, 7.0, 7.0, 7.0]
    from veredas.operators.ranks import group_quantiles

    (r,) = ask(lambda d: f"SELECT * FROM {group_quantiles('t', {'g': 'g'}, 'x', {'a': 0.05, 'b': 0.5, 'c': 0.99, 'lo': 0.0, 'hi': 1.0})} AS q", t=("g string, x double", [(None, v) for v in values]))
    assert [r[k] for k in ("a", "b", "c", "lo", "hi")] == pytest.approx(list(np.quantile(values, [0.05, 0.5, 0.99, 0, 1])))


@pytest.mark.parametrize(("valid", "batch", "n", "want"), [
    ([1, 1, 0, 1, 1, 0], None, 3, {"accepted": 4, "selected": 3, "surplus": 1, "rejected": 2}),
    ([1, 0, 1], [1, 1, 1], 2, {"accepted": 2, "accepted_batch": 3, "selected": 2, "rejected": 1, "disagreeing": 1}),
])
def test_accounting(ask, valid, batch, n, want):
    t = ("row_id long, batch long, batch_valid boolean, valid boolean", [(i, 0, bool((batch or valid)[i]), bool(v)) for i, v in enumerate(valid)])
    (r,) = ask(lambda d: generate.accounting_sql(d, "t", n), t=t)
    assert {k: r[k] for k in want} == want and r["total"] == r["accepted"] + r["rejected"] and r["accepted"] == r["selected"] + r["surplus"]
    rows = ask(lambda d: f"SELECT * FROM {generate.select_first_sql('t', n)} AS s", t=t)
    assert [x["row_id"] for x in rows] == [i for i, v in enumerate(valid) if v][:n]


def test_duplicates(ask):
    rows = [(i, a, g, r) for i, (a, g, r) in enumerate([(30, "A", 1000.0)] * 3 + [(40, "B", 2000.0)] * 2 + [(50, "C", 3000.0)])]
    t = ("row_id long, Idade int, Genero string, Renda double", rows)
    key = lambda d: canonical.row_key(d, ("Idade", "Genero", "Renda"))
    (r,) = ask(lambda d: privacy.duplicate_rows(d, "t", key(d)), t=t)
    assert [r[k] for k in ("total", "unique_rows", "duplicated_occurrences", "duplicated_groups", "rows_in_groups", "largest")] == [6, 3, 3, 2, 5, 3]
    assert {x["size"]: x["n_groups"] for x in ask(lambda d: privacy.duplicate_histogram(d, "t", key(d)), t=t)} == {2: 1, 3: 1}
    assert sorted(x["row_id"] for x in ask(lambda d: privacy.largest_groups(d, "t", key(d), 1), t=t)) == [0, 1, 2]


def test_exact_matches_over_spellings(ask):
    rows = [("syn", "Ensino Medio", 1000.004, 30.0), ("syn", "Superior Completo", 2000.0, 40.0), ("syn", "Pós-graduação", 3000.0, 50.0), ("ref", "Ensino Médio", 1000.0, 30.0), ("ref", "Ensino Médio", 1000.0, 30.0), ("ref", "Superior Completo", 2000.0, 40.0)]
    t = ("side string, Escolaridade string, Renda double, Idade double", rows)
    columns = ("Escolaridade", "Renda", "Idade")
    (r,) = ask(lambda d: privacy.exact_matches(d, "t", canonical.row_key(d, columns)), t=t)
    assert (r["matches"], r["distinct_matched"], r["distinct_ref"]) == (2, 2, 2)
    import hashlib

    want = sorted(hashlib.sha256(x.encode()).hexdigest() for x in ('["Ensino Médio",1000.0,30]', '["Superior Completo",2000.0,40]'))
    assert [x["row_hash"] for x in ask(lambda d: privacy.matched_hashes(d, "t", canonical.row_key(d, columns)), t=t)] == want


def test_row_keys_keep_bars_quotes_and_nulls_apart(ask):
    rows = [("a|b", "c"), ("a", "b|c"), ('a"', "c"), ("a", '"c'), (None, "c"), ("<NA>", "c"), ("\\", "c")]
    keys = [x["k"] for x in ask(lambda d: f"SELECT {canonical.row_key(d, ('a', 'b'))} AS k FROM t", t=("a string, b string", rows))]
    assert len(set(keys)) == 6  # only null and its own sign agree


GATE_ROWS = "invalid_rows double, duplicated_identifier double, null_required_fields double, exact_train_match_rate double, total_variation_distance double, correlation_difference double, duplicate_base_row_rate double, synthetic_rows double"
CLEAN = (0.0, 0.0, 0.0, 0.0, 0.1, 0.1, 0.0, 500.0)


@pytest.mark.parametrize(("place", "value", "status"), [
    (0, 0.0, "approved"), (0, 1.0, "rejected"), (4, 0.9, "quarantined"), (3, None, "rejected"), (3, float("nan"), "rejected"), (6, 0.02, "quarantined"), (6, None, "approved"), (7, 50.0, "quarantined"),
])
def test_gates(spark, place, value, status):
    spark.createDataFrame([CLEAN[:place] + (value,) + CLEAN[place + 1 :]], GATE_ROWS).createOrReplaceTempView("g")
    assert spark.sql(gates.statuses(Spark(), "g")).first().status == status


def test_gates_from_a_configuration(spark):
    spark.createDataFrame([CLEAN[:7] + (50.0,)], GATE_ROWS).createOrReplaceTempView("g")
    assert spark.sql(gates.statuses(Spark(), "g", {"assessment_mode": "approval"})).first().status == "rejected"
    loose = {"total_variation_distance_max": {"value": 0.05, "mandatory": True}, "min_evaluation_rows": 10}
    assert spark.sql(gates.statuses(Spark(), "g", loose)).first().failed == "total_variation_distance"
    for bad in ({"other_max": 1}, {"assessment_mode": "x"}, {"invalid_rows_max": "1"}):
        with pytest.raises(ValueError):
            gates.configured(bad)


def test_conditional_income(ask):
    rows = [(k, side, o, 35, "Sudeste", "Superior Completo", base + k) for side in ("ref", "syn") for o, base in (("Mecânico", 3000.0), ("Médico", 10000.0)) for k in range(40)]
    rows[80] = (0, "syn", "Mecânico", 35, "Sudeste", "Superior Completo", 12000.0)
    t = ("row_id long, side string, Ocupacao string, Idade int, Regiao string, Escolaridade string, Renda double", rows)
    got = ask(lambda d: conditional.compare(d, "t"), t=t)
    assert len(got) == 10
    one = next(r for r in got if r["grouping_name"] == "ocupacao" and r["Ocupacao"] == "Mecânico")
    assert one["wasserstein"] == round((12000 - 3039 + 39) / 40, 6) and one["high_tail_excess"] == round(3 / 40 - 0.05, 6)
    s = next(r for r in ask(lambda d: conditional.summary(d, "t"), t=t) if r["side"] == "ref" and r["grouping_name"] == "ocupacao" and r["Ocupacao"] == "Médico")
    assert (s["n"], s["median"], s["p05"], s["p95"], s["iqr"], s["upper_rate"], s["lower_rate"]) == (40, 10019.5, 10001.95, 10037.05, 19.5, 0.05, 0.05)
    assert not ask(lambda d: conditional.compare(d, "t", 41), t=t)


def test_rule_masks_and_what_fails_together(ask):
    t = (MODEL, [SP, BROKEN, YOUNG])
    r = validate.rules(Spark())
    counts = {x["rule"]: x["total"] - x["invalid"] for x in ask(lambda d: validate.rule_counts(d, "t", validate.rules(d)), t=t)}
    assert (counts["geographic_joint"], counts["professional_joint"], counts["non_relational_joint"], counts["structural_global"]) == (2, 1, 2, 1)
    failed = {x["row_id"]: x["failed"].split(",") for x in ask(lambda d: f"SELECT * FROM {validate.failed_sql(d, 't', validate.rules(d))} AS f", t=t)}
    assert "occupation_education" in failed[1] and "marital_age" in failed[2] and failed[0] == [""] and len(r) == 14
    pairs = {(x["rule_a"], x["rule_b"]): x["n"] for x in ask(lambda d: validate.co_occurrence(d, "t", {k: validate.rules(d)[k] for k in ("region_state", "state_ddd", "occupation_age")}), t=t)}
    assert pairs == {("region_state", "state_ddd"): 1}
    top = {(x["rule"], x["combination"]) for x in ask(lambda d: validate.invalid_combinations(d, "t"), t=t)}
    assert {("occupation_education", "Fundamental | Médico"), ("income_domain", "Renda=abaixo_do_mínimo"), ("dependents_domain", "Dependentes=acima_do_máximo"), ("marital_age", "22 | Viúvo")} <= top


def test_what_a_repair_changed(ask):
    final = [SP, BROKEN[:3] + ("Sudeste", "SP", "São Paulo") + BROKEN[6:-1] + (11,), (2, 25) + YOUNG[2:]]
    frames = {"a": (MODEL, [SP, BROKEN, YOUNG]), "b": (MODEL, final), "s": ("row_id long", [(0,), (1,)])}
    (r,) = ask(lambda d: profilestats.stage_outcomes(d, "a", "b", "s", judged=False), **frames)
    assert {k: r[k] for k in ("repaired", "replaced", "rejected", "unchanged", "multiple_fields", "selected")} == {"repaired": 1, "replaced": 0, "rejected": 1, "unchanged": 1, "multiple_fields": 1, "selected": 2}
    changed = {x["field"]: x["changed"] for x in ask(lambda d: profilestats.field_changes(d, "a", "b"), a=frames["a"], b=frames["b"])}
    assert (changed["Regiao"], changed["Municipio"], changed["DDD"], changed["Idade"], changed["Renda"], changed["multi"]) == (1, 1, 1, 1, 0, 1)


def test_places_after_a_repair(ask):
    at = lambda k, city, ddd, state="SP": (k, *SP[1:4], state, city, *SP[6:-1], ddd)
    raw = [at(0, "São Paulo", 11), at(1, "Campinas", 21), at(2, "Niterói", 21)]
    final = [raw[0], at(1, "Campinas", 11), at(2, "Niterói", 21, "RJ")]
    (r,) = ask(lambda d: profilestats.geography_outcomes(d, "a", "b"), a=(MODEL, raw), b=(MODEL, final))
    assert {k: r[k] for k in ("unchanged", "repaired", "replaced", "rejected_reasons")} == {"unchanged": 1, "repaired": 1, "replaced": 1, "rejected_reasons": 3}


def test_income_distance_of_stages(ask):
    rows = [("holdout", float(x)) for x in (1000, 2000, 3000, 4000)] + [("raw", float(x)) for x in (1000, 2000, 5000, 6000)] + [("final", float(x)) for x in (1000, 2000, 3000, 4500)]
    (r,) = ask(lambda d: reports.income_stages(d, "t"), t=("stage string, Renda double", rows))
    assert (r["raw_wasserstein"], r["final_wasserstein"], r["scale"]) == (1000.0, 125.0, 1500.0)


def test_occupation_populations(ask):
    rows = [("train", "Médico"), ("train", "Atendente"), ("selected", "Atendente"), ("other", "Médico"), ("other", "Médico")]
    got = {(x["population"], x["n"], x["total"]) for x in ask(lambda d: reports.occupation_populations(d, "t", ("Médico",)), t=("population string, Ocupacao string", rows))}
    assert got == {("train", 1, 2), ("selected", 0, 1), ("other", 2, 2)}


def test_uniqueness_and_keep_first_with_nulls(ask):
    t = ("row_id long, CPF string", [(0, "a"), (1, "a"), (2, "b"), (3, None), (4, None)])
    assert ask(lambda d: validate.duplicated_ids(d, "t", ("CPF",)), t=t) == [{"identifier": "CPF", "extra": 2, "n_values": 2}]
    later = {x["row_id"]: x["later"] for x in ask(lambda d: f"SELECT * FROM {validate.keep_first_sql('t', 'CPF')} AS k", t=t)}
    assert later == {0: False, 1: True, 2: False, 3: False, 4: True}


@pytest.mark.parametrize("age", [18, 19, 40, 65, 85])
def test_birth_dates_give_the_age_back_on_a_leap_day(ask, age):
    got = ask(lambda d: f"SELECT {d.age_at('born', '2024-02-29')} AS age FROM (SELECT {d.born(str(age), 'u', '2024-02-29')} AS born FROM t) AS b", t=("u double", [(0.0,), (0.5,), (0.999999,)]))
    assert [x["age"] for x in got] == [age] * 3


def test_aliases_and_composed_characters(ask):
    rows = [(old,) for old in domain.ALIASES] + [("São Paulo",), ("Sao Paulo",), ("unknown",), (None,)]
    got = [x["v"] for x in ask(lambda d: f"SELECT {canonical.text(d, 'v')} AS v FROM t", t=("v string", rows))]
    assert sorted(map(str, got)) == sorted(map(str, [*domain.ALIASES.values(), "São Paulo", "São Paulo", "unknown", None]))


def test_typed_columns(ask):
    rows = [("29.5", "1e3", "x"), ("30.5", "nan", None), (None, "abc", "Tecnico")]
    got = ask(lambda d: f"SELECT {canonical.typed(d, 'Idade')} AS a, {canonical.typed(d, 'Renda')} AS r, {canonical.typed(d, 'Ocupacao')} AS o FROM t", t=("Idade string, Renda string, Ocupacao string", rows))
    assert sorted(str(x["a"]) for x in got) == ["30", "30", "None"] and {x["o"] for x in got} == {"x", None, "Técnico"}


def test_split_by_fraction_and_size(ask):
    t = ("row_id long", [(i,) for i in range(20)])
    one = lambda **how: ask(lambda d: f"SELECT * FROM {generate.split_sql(d, 't', seed=41, **how)} AS s", t=t)
    held = [x["row_id"] for x in one(fraction=0.25) if x["side"] == "holdout"]
    assert len(held) == 5 and held == [x["row_id"] for x in one(fraction=0.25) if x["side"] == "holdout"]
    for n in (1, 7, 20):
        assert sum(x["side"] == "holdout" for x in one(holdout=n)) == n
    assert sum(x["side"] == "holdout" for x in one(fraction=0.001)) == 1


def test_unknown_geography_key(ask):
    got = ask(lambda d: profilestats.decode_geography(d, "t"), t=("row_id long, Geo_Key string", [(i, "GEO_999999") for i in range(3)]))
    assert {(x["Regiao"], x["DDD"]) for x in got} == {("__UNKNOWN__", 0)}


def test_offending_pair(ask):
    rows = [(i, *SP[1:]) for i in range(9)] + [(9, *SP[1:6], "Fundamental", *SP[7:])]
    (r,) = ask(lambda d: profilestats.relational_validity(d, "t"), t=(MODEL, rows))
    assert r["bad_occupation_education"] == 1
    assert ask(lambda d: profilestats.offending_pairs(d, "t"), t=(MODEL, rows)) == [{"Escolaridade": "Fundamental", "Ocupacao": "Médico", "n": 1}]


def test_vocabulary_of_final_profiles(spark):
    ids = spark.range(30).withColumnRenamed("id", "row_id")
    spark.createDataFrame(generate.generate_final_profiles(ids).collect()).createOrReplaceTempView("final_rows")
    got = {r.gate: r.passed for r in spark.sql(reports.vocabulary_gates(Spark(), "final_rows", "(SELECT 30 AS asked)")).collect()}
    assert len(got) == 10 and all(v for v in got.values() if v is not None) and sum(v is None for v in got.values()) == 3
    assert spark.sql(reports.vocabulary_gates(Spark(), "final_rows", "(SELECT 31 AS asked)")).where("gate = 'final_rows_exact'").first().passed is False
    report = {r.reason: r.n for r in spark.sql(validate.validation_report(Spark(), "final_rows")).collect()}
    assert report == {"n_rows": 30, "valid_rows": 30, "invalid_rows": 0}


def test_validation_report_counts_every_reason(ask):
    rows = [SP, BROKEN, YOUNG, (3, *SP[1:]), (4, None, *SP[2:]), (5, *SP[1:4], "RJ", *SP[5:])]
    got = {r["reason"]: r["n"] for r in ask(lambda d: validate.validation_report(d, "t", final=False), t=(MODEL, rows))}
    assert got == {
        "n_rows": 6, "valid_rows": 1, "invalid_rows": 5, "null_required_fields": 1, "invalid_numeric_values": 1, "Renda_below_min": 1, "Dependentes_above_max": 1,
        "estado_regiao_incompativel": 1, "municipio_estado_incompativel": 2, "ddd_estado_incompativel": 2, "ocupacao_escolaridade_idade_incompativel": 3, "duplicated_rows": 1,
    }
    assert validate.missing_columns(["Idade"], final=False) == list(domain.MODEL_COLUMNS[1:])


def test_income_versions_of_one_person(ask):
    person = "(SELECT row_id, 48 AS Idade, 'Sudeste' AS Regiao, 'Ensino Médio' AS Escolaridade, 'Mecânico' AS Ocupacao FROM t) AS p"
    t = ("row_id long", [(i,) for i in range(1200)])
    income = {}
    for name, version, variant in generate.INCOME_VERSIONS:
        rows = ask(lambda d: generate.select_steps(person, generate.income_steps(d, 41, "row_id", version, variant), ("Renda",))[1:-1], t=t)  # noqa: B023
        income[name] = pd.Series([x["Renda"] for x in rows])
    assert income["v3_selected"].quantile(0.99) < income["v1"].quantile(0.99)
    assert income["v3_selected"].std() > income["v2"].std()
    assert (income["v3_selected"] > 10_000).mean() < 0.05 < 10_000 < income["v3_selected"].max()
    assert all(x.between(800, 50_000).all() for x in income.values())


def test_occupation_weights_follow_age():
    con = duckdb.connect()
    rows = con.execute(f"SELECT * FROM {generate.occupation_weights_sql(Duck())} AS w").fetchall()
    share = {(r[0], r[1], r[2]): r[5] for r in rows}
    assert share[3, 22, "Estagiário"] > share[3, 34, "Estagiário"] and share[3, 22, "Estudante"] > share[3, 34, "Estudante"]
    assert share[1, 65, "Aposentado"] > share[1, 50, "Aposentado"]


def test_batches_until_enough_are_valid_together(spark):
    made = []

    def make(first, rows):
        made.append(first)
        return spark.createDataFrame([(i, f"cpf{0 if i == 2 else i}", 30) for i in range(first, first + rows)], "row_id long, CPF string, Idade int")

    judged = []

    def judge(batch):
        judged.append(batch.count())
        return batch.selectExpr("row_id", "Idade = 30 AS valid")

    got = generate.accept_in_batches(make, judge, n=3, batch_rows=2, max_batches=3, identifiers=["CPF"])
    assert [r.row_id for r in got.rows.collect()] == [0, 1, 3] and (got.batches, got.accepted, got.candidates, got.surplus) == (2, 3, 4, 0)
    assert made == [0, 2] and judged == [2, 2]
    with pytest.raises(ValueError):
        generate.accept_in_batches(make, judge, n=9, batch_rows=2, max_batches=2, identifiers=["CPF"])


def test_identifiers_that_were_used_are_drawn_again(spark, monkeypatch):
    """A core row repeated, a stream of CPFs with one repeat, three rows wanted from batches of two: four are accepted, none twice."""
    stream = iter(["291.417.776-38", "398.259.791-94", "291.417.776-38", "341.672.110-17"])
    person = (30, "Feminino", "Sudeste", "SP", "São Paulo", "Ensino Médio", "Solteiro", "Atendente", 2500.0, 0, 11)
    names = MODEL.split(", ", 1)[1]

    def make(first, rows):
        given = finalize.finalize(spark.createDataFrame([person] * rows, names), first=first)
        cpf = spark.createDataFrame([(first + i, next(stream)) for i in range(rows)], "row_id long, CPF string")
        return given.drop("CPF").join(cpf, "row_id").select("row_id", *domain.FINAL_COLUMNS)

    def redraw(rows, attempt):
        return rows.withColumn("CPF", F.lit("011.524.493-03"))

    def judge(batch):
        batch.createOrReplaceTempView("judged_batch")
        return spark.sql(f"SELECT row_id, valid FROM {validate.validation_sql(Spark(), 'judged_batch')} AS v")

    for limit in (generate.BROADCAST_CELLS, 0):
        monkeypatch.setattr(generate, "BROADCAST_CELLS", limit)
        stream = iter(["291.417.776-38", "398.259.791-94", "291.417.776-38", "341.672.110-17"])
        got = generate.accept_in_batches(make, judge, n=3, batch_rows=2, max_batches=3, redraw=redraw)
        rows = got.rows.collect()
        assert (len(rows), got.accepted, got.candidates, got.batches) == (3, 4, 4, 2)
        assert all(len({r[c] for r in rows}) == 3 for c in domain.IDENTIFIERS)
    assert [r.CPF for r in rows] == ["291.417.776-38", "398.259.791-94", "011.524.493-03"]


def test_redrawn_identifiers_are_valid(spark):
    ids = spark.range(5).withColumnRenamed("id", "row_id")
    rows = generate.generate_final_profiles(ids)
    again = generate.redraw_identifiers(rows, 1).collect()
    before = {r.row_id: r for r in rows.collect()}
    for r in again:
        assert all(r[c] != before[r.row_id][c] for c in domain.IDENTIFIERS) and r.Nome == before[r.row_id].Nome
    spark.createDataFrame(again, rows.schema).createOrReplaceTempView("redrawn")
    good = spark.sql(f"SELECT valid FROM {validate.validation_sql(Spark(), 'redrawn')} AS v").collect()
    assert all(r.valid for r in good)


def test_cross_batch_duplicates(ask):
    t = ("batch long, CPF string, RG string", [(0, "a", "x"), (0, "a", "y"), (1, "a", None), (1, "b", "z"), (1, "b", None)])
    assert ask(lambda d: generate.cross_batch_duplicates(d, "t", ("CPF", "RG")), t=t) == [{"n_duplicates": 2, "n_values": 1}]


def test_events_keep_only_allowed_fields(ask):
    got = ask(lambda d: experiments.sanitized(d, "t", "k", {"CPF": "cpf", "dataset": "cpf", "traceback": "cpf", "model": "m", "rows": "k"}), t=("k long, cpf string, m string", [(1, "x", "ctgan")]))
    assert got == [{"k": 1, "field": "model", "value": "ctgan"}]


def test_quality_gains(ask):
    rows = [("m", 1000, 0.8, 0.6, 10.0, 100.0), ("m", 5000, 0.5, 0.3, 40.0, 100.0), ("m", 20000, 0.5, 0.3, 41.0, 90.0)]
    t = ("model string, train_size long, renda_wasserstein_normalized double, renda_ks double, training_seconds double, peak_memory_mb double", rows)
    got = {(x["from_size"], x["to_size"]): x for x in ask(lambda d: experiments.quality_gains(d, "(SELECT *, NULL + 0e0 AS genero_tvd, NULL + 0e0 AS correlation_difference, 1e0 AS model_size_mb FROM t)", [(1000, 5000), (5000, 20000)]), t=t)}
    assert got[1000, 5000]["quality_gain"] == pytest.approx(0.3) and got[1000, 5000]["gain_per_second"] == pytest.approx(0.01) and got[1000, 5000]["gain_per_memory_mb"] is None
    assert got[5000, 20000]["quality_gain"] == pytest.approx(0)


def test_aggregate_and_limits(ask):
    (r,) = [x for x in ask(lambda d: experiments.aggregate(d, "t", ("model",), ("ks",)), t=("model string, ks double", [("m", 0.1), ("m", 0.3)]))]
    assert r["mean"] == pytest.approx(0.2) and r["n"] == 2
    assert (r["median"], r["std"], r["lo"], r["hi"], r["ci95"]) == (0.2, 0.14142, 0.1, 0.3, 0.196)
    both = ask(lambda d: experiments.aggregate(d, "t", ("model", "train_size"), ("ks", "w")), t=("model string, train_size long, ks double, w string", [("m", 1, 0.4, "x"), ("m", 1, None, "2"), ("m", None, float("nan"), None), ("k", 2, 1.0, None)]))
    assert {(x["model"], x["train_size"], x["metric"]): (x["n"], x["mean"], x["std"], x["ci95"]) for x in both} == {("m", 1, "ks"): (1, 0.4, 0.0, None), ("m", 1, "w"): (1, 2.0, 0.0, None), ("k", 2, "ks"): (1, 1.0, 0.0, None)}


def test_status_counts(ask):
    runs = ("model string, status string", [("p", "approved"), ("p", "quarantined"), ("k", "rejected")])
    failures = ("model string, status string", [("p", "failed"), ("z", "resource_limited")])
    got = {x["model"]: (x["completed_runs"], x["approved"], x["quarantined"], x["rejected"], x["failed"]) for x in ask(lambda d: experiments.status_counts("t", "f", ("model",)), t=runs, f=failures)}
    assert got == {"p": (2, 1, 1, 0, 1), "k": (1, 0, 0, 1, 0), "z": (0, 0, 0, 0, 1)}


def test_marginal_gains_are_shares(ask):
    rows = [("c", 1000, 0.4, 0.8, 10.0, 100.0), ("c", 5000, 0.2, 0.5, 30.0, 160.0), ("c", 20000, 0.1, 0.4, 90.0, None), ("d", 1000, 0.0, None, 1.0, 1.0), ("d", 5000, 0.5, 1.0, 1.0, 1.0)]
    t = ("model string, train_size long, renda_ks double, renda_wasserstein_normalized double, training_seconds double, peak_memory_mb double", rows)
    got = ask(lambda d: experiments.marginal_gains(d, "t", [(1000, 5000), (5000, 20000)], ("renda_ks", "renda_wasserstein_normalized", "training_seconds", "peak_memory_mb")), t=t)
    by = {(x["model"], x["comparison"], x["metric"]): (x["change"], x["percent_change"]) for x in got}
    assert by["c", "1000_to_5000", "renda_wasserstein_normalized"] == (-0.3, -0.375) and by["c", "1000_to_5000", "training_seconds"] == (20.0, 2.0)
    assert ("c", "5000_to_20000", "peak_memory_mb") not in by and by["d", "1000_to_5000", "renda_ks"] == (0.5, None) and ("d", "1000_to_5000", "renda_wasserstein_normalized") not in by


def test_capacity_limits(ask):
    rows = [("ctgan", 50000, "completed", None), ("ctgan", 100000, "resource_limited", None), ("ctgan", 200000, "skipped_after_failure", None), ("p", 400000, "completed", None), ("p", 800000, "quality_quarantined", None), ("p", 1600000, "quality_rejected", None),
            ("both", 10, "failed", "MemoryError"), ("both", 10, "completed", None), ("both", 999, "failed", None), ("none", 7, "backend_unavailable", ""), ("none", None, "failed", None)]
    got = {x["model"]: x for x in ask(lambda d: experiments.capacity_limits(d, "t"), t=("model string, train_size long, status string, failure_type string", rows))}
    c, p, b, n = (got[k] for k in ("ctgan", "p", "both", "none"))
    assert (c["completed_train_sizes"], c["largest_tested_successful_size"], c["first_failed_size"], c["first_failure_status"], c["first_failure_type"], c["skipped_train_sizes"], c["observed_interval_lower"], c["observed_interval_upper"]) == ("50000", 50000, 100000, "resource_limited", "resource_limited", "200000", 50000, 100000)
    assert "primeira falha" in c["conclusion"] and "até 50.000 registros" in c["conclusion"] and c["tested_train_sizes"] == "50000,100000"
    assert (p["completed_train_sizes"], p["first_failed_size"], p["observed_interval_upper"]) == ("400000,800000,1600000", None, None) and "pelo menos 1.600.000" in p["conclusion"]
    # The first failure may be of a size that was carried out as well.
    assert (b["first_failed_size"], b["first_failure_type"], b["largest_tested_successful_size"]) == (10, "MemoryError", 10)
    assert (n["largest_tested_successful_size"], n["first_failure_type"]) == (None, "backend_unavailable") and n["conclusion"].startswith("Nenhum")


def test_scalability_limits(ask):
    runs = ("model string, train_size long, resource_limited boolean", [("s", 1000, False), ("s", 5000, None), ("s", 9000, True), ("u", 20000, False), ("ok", 1234567, False)])
    failures = ("model string, train_size long, status string", [("s", 20000, "failed"), ("s", 5000, "failed"), ("u", 500, "resource_limited"), ("none", 10, "failed")])
    got = {x["model"]: x for x in ask(lambda d: experiments.scalability_limits(d, "t", "f"), t=runs, f=failures)}
    assert (got["s"]["successful_train_sizes"], got["s"]["first_failed_size"], got["s"]["resource_limited"]) == ("1000,5000", 20000, False) and "entre 5.000 e 20.000" in got["s"]["conclusion"]
    assert "instabilidade" in got["u"]["conclusion"] and got["u"]["resource_limited"] and got["ok"]["conclusion"] == "Executado com sucesso com até 1.234.567 registros neste ambiente."
    assert got["none"]["largest_tested_successful_size"] is None


def test_vectors_there_and_back(ask):
    got = ask(lambda d: encode.decode_sql(d, encode.encode_sql(d, "t")), t=(MODEL, [SP, YOUNG]))
    back = {x["row_id"]: x for x in got}
    names = MODEL.replace(",", "").split()[::2]
    for row in (SP, YOUNG):
        want = dict(zip(names, row, strict=True))
        assert all(back[row[0]][c] == pytest.approx(want[c]) if c == "Renda" else back[row[0]][c] == want[c] for c in encode.NUMBERS.keys() | encode.CATEGORIES.keys())
    assert encode.width() == 3 + 3 + 5 + 27 + 81 + 5 + 5 + 37 + 67


def test_nearest_profiles_by_hand(ask):
    t = (f"side string, {MODEL}", [("ref", *SP), ("ref", *YOUNG), ("syn", 5, *SP[1:])])
    (r,) = ask(lambda d: privacy.nearest_profiles(d, "t"), t=t)
    assert (r["dcr_min"], r["nndr_mean"]) == (0.0, 0.0)


def test_generators_by_name(spark, tmp_path):
    g = synthesizer.create("Rules", seed=5)
    a, b = g.fit(None).sample(spark, 20).collect(), g.sample(spark, 20).collect()
    assert len(a) == 20 and a != b
    g.save(spark, f"{tmp_path}/g")
    again = synthesizer.Programmatic.load(spark, f"{tmp_path}/g")
    assert again == g and again.sample(spark, 5).count() == 5
    with pytest.raises(ValueError):
        synthesizer.create("other")


def decomposed(text):
    import unicodedata

    return unicodedata.normalize("NFD", text)


NFC_ROWS = [
    "São Paulo", decomposed("São Paulo"), decomposed("Việt Nam ệ ǭ"), "a\u0327\u031b\u0323x", "a\u0323\u0307\u0327", "\u1112\u1161\u11ab\u1100\u1173\u11af", "\uac00\u11a8\u0301", "\u212b\u2126\u0340\u0344",
    "\u0958\u095c", "\u0301abc", "e\u0315\u0301", "\U0001d15e \U000110a5", "\ufb1d\u2adc", "q\u0307\u0323", "", None, "\x00~", "a\u05ae\u0300\u0315b",
]


def test_composed_form(ask, spark):
    import unicodedata

    got = ask(lambda d: f"SELECT k, {d.nfc('x')} AS y FROM t", t=("k long, x string", list(enumerate(NFC_ROWS))))
    assert {r["k"]: r["y"] for r in got} == {k: x and unicodedata.normalize("NFC", x) for k, x in enumerate(NFC_ROWS)}
    every = [(c, chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.normalize("NFC", chr(c)) != chr(c) or unicodedata.combining(chr(c)) or c % 97 == 0)]
    frame = spark.createDataFrame([(c, f"a{x}", f"{x}\u0323\u0301") for c, x in every], "c int, x string, y string")
    rows = spark.sql(f"SELECT c, x, y, {Spark().nfc('x')} AS nx, {Spark().nfc('y')} AS ny FROM {{f}}", f=frame).collect()
    assert all((r.nx, r.ny) == tuple(unicodedata.normalize("NFC", z) for z in (r.x, r.y)) for r in rows)


def brute_p_value(n, m, d):
    """All merged orders of n and m values."""
    import itertools

    hit = total = 0
    for places in itertools.combinations(range(n + m), n):
        i, most = 0, 0.0
        for k in range(n + m):
            i += k in places
            most = max(most, abs(i * m - (k + 1 - i) * n))
        hit += most >= round(d * n * m)
        total += 1
    return hit / total


def test_exact_p_values():
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 6), (7, 2)):
        for h in range(0, n * m + 1, math.gcd(n, m)):
            assert kstest.exact_p_value(n, m, h / (n * m)) == pytest.approx(brute_p_value(n, m, h / (n * m)), abs=1e-12), (n, m, h)
    assert kstest.exact_p_value(4, 4, 1.0) == pytest.approx(2 / 70) and kstest.exact_p_value(1, 1, 1.0) == pytest.approx(1.0)
    # Beyond some hundred values the exact distribution meets the series.
    assert kstest.exact_p_value(2000, 3000, 0.04) == pytest.approx(duckdb.execute(f"SELECT {twosample.ks_p_value('0.04e0', '2000', '3000')}").fetchone()[0], abs=5e-3)


def test_exact_p_values_of_groups(spark):
    # Ties: ref 1 1 2 3, syn 2 2 4 4; the distance is 1/2.
    rows = [("g", s, float(x)) for s, x in sided([1, 1, 2, 3], [2, 2, 4, 4])] + [("h", s, float(x)) for s, x in sided(range(30), range(10, 40))] + [("one", "ref", 1.0), (None, "ref", 1.0), (None, "syn", 1.0)]
    frame = spark.createDataFrame(rows, "g string, side string, x double")
    frame.createOrReplaceTempView("ks_t")
    for most in (kstest.EXACT_N, 10):
        got = {r.grp: (r.n_ref, r.n_syn, r.ks, r.p_value, r.exact) for r in kstest.p_values(spark, "ks_t", "g", "x", most).collect()}
        with duckdb.connect() as con:
            con.register("pd_t", frame.toPandas())
            con.execute("CREATE TABLE ks_t AS SELECT * FROM pd_t")
            twin = {r[0]: r[1:] for r in con.execute(kstest.duck_sql(Duck(), "ks_t", "g", "x", most)).fetchall()}
        assert got == twin
        assert set(got) == {"g", "h", None} and got["g"] == (4, 4, 0.5, round(brute_p_value(4, 4, 0.5), 6), True) and got[None][3] == 1.0
        assert got["h"][4] is (most > 10)


def test_repair_of_text_columns(ask):
    """Old spellings in every column, numbers as text, texts that are no numbers, an unknown state, nulls."""
    schema = "row_id long, " + ", ".join(f"{c} string" for c in domain.MODEL_COLUMNS)
    row = lambda k, age, gender, region, state, city, edu, marital, work, income, deps, code: (k, age, gender, region, state, city, edu, marital, work, income, deps, code)
    rows = [
        row(0, "40", "Feminino", "Norte", "SP", "Sao Paulo", "Ensino Medio", "Uniao Estavel", "Tecnico", "2500.5", "1", "11"),
        row(1, "abc", "Masculino", "Sul", "RJ", decomposed("Niterói"), "Pos-graduacao", "Viuvo", "Autonomo", "x", "2.5", "21.0"),
        row(2, "17.6", "Outro", "Sul", "ZZ", "Nowhere", "Fundamental", "Casado", "Servicos Gerais", "99999", "-3", "77"),
        row(3, None, None, None, None, None, None, None, None, None, None, None),
        row(4, "90", "Feminino", "Sudeste", "MG", "Santos", "Fundamental", "Solteiro", "Vendedor", "NaN", "3.5", "junk"),
    ]
    got = {r["row_id"]: r for r in ask(lambda d: f"SELECT * FROM {finalize.repaired_sql(d, 't')} AS r", t=(schema, rows))}
    a, b, c, e, f = (got[k] for k in range(5))
    assert (a["Regiao"], a["Municipio"], a["Escolaridade"], a["Estado_Civil"], a["Ocupacao"], a["DDD"], a["Renda"]) == ("Sudeste", "São Paulo", "Ensino Médio", "União Estável", "Técnico", 11, 2500.5)
    assert (b["Idade"], b["Renda"], b["Dependentes"], b["Municipio"], b["Escolaridade"], b["Estado_Civil"], b["Ocupacao"], b["DDD"], b["Regiao"]) == (18, 800.0, 2, "Niterói", "Pós-graduação", "Viúvo", "Autônomo", 21, "Sudeste")
    assert (c["Idade"], c["Renda"], c["Dependentes"], c["Regiao"], c["Municipio"], c["DDD"], c["Ocupacao"]) == (18, 50000.0, 0, "Sul", "Nowhere", 77, "Serviços Gerais")
    assert (e["Idade"], e["Renda"], e["Dependentes"], e["Regiao"], e["DDD"]) == (18, 800.0, 0, None, None)
    assert f["Idade"] == 85 and f["Renda"] == 800.0 and f["Dependentes"] == 4 and f["Municipio"] in domain.STATES["MG"][1] and f["DDD"] in domain.STATES["MG"][2]


def test_finalized_frames(spark):
    person = ("40", "Feminino", "Norte", "SP", "Sao Paulo", "Ensino Medio", "Casado", "Tecnico", "2500.555", "1", "92")
    names = ", ".join(f"{c} string" for c in domain.MODEL_COLUMNS)
    given = spark.createDataFrame([person] * 25 + [(str(20 + k), *person[1:]) for k in range(30)] + [(None,) * 11], names)
    rows = finalize.finalize(given.repartition(3), first=100).collect()
    again = finalize.finalize(given.repartition(7).orderBy("Idade"), first=100).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert sorted(r.row_id for r in rows) == list(range(100, 156)) and all(len({r[c] for r in rows}) == 56 for c in domain.IDENTIFIERS)
    whole = [r for r in rows if r.Estado == "SP"]
    assert len(whole) == 55 and all(r.Renda in (2500.55, 2500.56) and r.Municipio == "São Paulo" and r.DDD in domain.STATES["SP"][2] for r in whole)
    spark.createDataFrame(whole).createOrReplaceTempView("finalized")
    judged = spark.sql(f"SELECT valid FROM {validate.validation_sql(Spark(), 'finalized')} AS v").collect()
    assert sum(r.valid for r in judged) == sum(int(r.Idade) >= 18 for r in whole)


def test_copies_are_dealt_out_in_lots(ask, monkeypatch):
    monkeypatch.setattr(finalize, "LOT", 3)
    got = ask(lambda d: f"SELECT * FROM {finalize.numbered_sql(d, 't', ('a', 'b'), 5)} AS n", t=("a string, b double", [("x", 1.0)] * 10 + [("y", None)] * 3 + [(None, 2.0)]))
    assert sorted(r["row_id"] for r in got) == list(range(5, 19)) and sum(r["a"] == "x" for r in got) == 10


def test_absent_columns_are_drawn(spark):
    given = spark.createDataFrame([(0.2, "30"), (1.0, "31"), (None, "x"), (0.2, "30")], "Sexo double, Idade string")
    rows = finalize.finalize(given).collect()
    assert len(rows) == 4 and len({r.CPF for r in rows}) == 4
    assert sorted(((r.Genero, r.Idade) for r in rows), key=str) == sorted([("Feminino", 30), ("Masculino", 31), (None, 18), ("Feminino", 30)], key=str)
    assert all(r.Municipio in domain.STATES[r.Estado][1] and r.Ocupacao in domain.OCCUPATIONS for r in rows)
    with pytest.raises(ValueError, match="none of the columns"):
        finalize.completed(spark.range(3))


def test_masks_of_text_columns(ask):
    """Columns as text with values that are no numbers: rows fail, the job does not."""
    schema = "row_id long, " + ", ".join(f"{c} string" for c in domain.MODEL_COLUMNS)
    good = tuple(str(x) for x in SP[1:])
    bad = tuple("abc" if c in ("Idade", "Renda", "Dependentes", "DDD") else v for c, v in zip(domain.MODEL_COLUMNS, good, strict=True))
    got = {r["row_id"]: r for r in ask(lambda d: f"SELECT * FROM {validate.masks_sql(d, 't', validate.rules(d))} AS m", t=(schema, [(0, *good), (1, *bad)]))}
    assert all(v for k, v in got[0].items() if k.startswith("ok_"))
    assert not any(got[1][f"ok_{n}"] for n in ("age_domain", "income_domain", "dependents_domain", "state_ddd", "occupation_age", "marital_age", "structural_global"))
    assert got[1]["ok_occupation_education"] and got[1]["ok_region_state"]


def test_reports_on_frames_with_absent_and_text_columns(spark):
    rows = [r.asDict() for r in generate.generate_final_profiles(spark.range(6).withColumnRenamed("id", "row_id")).collect()]
    text = spark.createDataFrame([{c: str(r[c]) for c in domain.FINAL_COLUMNS} for r in rows])
    whole = {r.reason: r.n for r in frames.report(text).collect()}
    assert whole == {"n_rows": 6, "valid_rows": 6, "invalid_rows": 0}
    no_age = {r.reason: r.n for r in frames.report(text.drop("Idade").replace(rows[0]["Data_Nascimento"], "x", "Data_Nascimento")).collect()}
    assert no_age == {"n_rows": 6, "valid_rows": 0, "invalid_rows": 6, "missing_required_columns": 1, "data_nascimento_invalida": 1}
    no_cpf = {r.reason: r.n for r in frames.report(text.drop("CPF", "Estado").union(text.drop("CPF", "Estado").limit(1)).replace("11", "abc", "DDD")).collect()}
    assert no_cpf["missing_required_columns"] == 2 and no_cpf["duplicated_rows"] == 1 and no_cpf["Telefone_duplicado"] == 1 and "CPF_invalido" not in no_cpf and "ddd_estado_incompativel" not in no_cpf
    core = {r.reason: r.n for r in frames.report(spark.createDataFrame([("abc",), (None,), ("17.5",), ("40",)], "Idade string"), final=False).collect()}
    assert core == {"n_rows": 4, "valid_rows": 0, "invalid_rows": 4, "missing_required_columns": 10, "null_required_fields": 1, "invalid_numeric_values": 2, "Idade_below_min": 1, "Idade_non_integer": 1}
    assert {r.rule for r in frames.rule_counts(text.drop("Idade")).collect()} >= {"region_state", "CPF", "telefone_ddd"}
    assert not {r.rule for r in frames.rule_counts(text.drop("Idade")).collect()} & {"age_domain", "structural_global", "Data_Nascimento_idade"}


def test_rules_of_the_caller_reach_every_report(spark):
    frame = generate.generate_final_profiles(spark.range(40).withColumnRenamed("id", "row_id")).withColumn("Altura", F.when(F.col("row_id") < 3, -1).when(F.col("row_id") > 5, 170))
    validate.add_rule("height", lambda d: "Altura > 0", ["Altura"])
    validate.add_rule("even", lambda d: "row_id % 2 = 0", ["row_id"])
    try:
        with pytest.raises(ValueError, match="free name"):
            validate.add_rule("height", lambda d: "TRUE")
        report = {r.reason: r.n for r in frames.report(frame).collect()}
        assert report["height"] == 6 and report["valid_rows"] == 34 and "even" not in report
        assert "height" not in {r.reason for r in frames.report(frame.drop("Altura")).collect()}
        counts = {r.rule: r.invalid for r in frames.rule_counts(frame).collect()}
        assert counts["height"] == 6
        frame.createOrReplaceTempView("with_height")
        both = {(r.rule_a, r.rule_b): r.n for r in spark.sql(validate.co_occurrence(Spark(), "with_height", validate.rules(Spark()))).collect()}
        assert both["height", "even"] == 3
        failed = {r.row_id: r.failed for r in spark.sql(f"SELECT * FROM {validate.failed_sql(Spark(), 'with_height', validate.rules(Spark()))}").collect()}
        assert failed[1].split(",")[-2:] == ["height", "even"]
        # One scan serves all rules.
        plan = frames.rule_counts(frame)._jdf.queryExecution().toString().split("Optimized Logical Plan")[1].split("Physical Plan")[0]
        assert plan.count("Range (0, 40") == 1
    finally:
        validate.remove_rule("height")
        validate.remove_rule("even")


def test_two_nearest_of_all_rows(spark):
    """5,000 rows, some of them repeated, some with nulls: equal to all pairs, at a part of the distances."""
    made = generate.generate_profiles(spark.range(5000).withColumnRenamed("id", "row_id"))
    odd = made.withColumn("side", F.expr("CASE WHEN row_id % 2 = 0 THEN 'ref' ELSE 'syn' END")).withColumn("Renda", F.expr("CASE WHEN row_id % 101 = 0 THEN NULL ELSE Renda END")).withColumn("Estado", F.expr("CASE WHEN row_id % 97 = 0 THEN NULL ELSE Estado END"))
    copies = odd.where("row_id % 40 = 0").withColumn("row_id", F.col("row_id") + 10_001).withColumn("side", F.expr("CASE WHEN row_id % 80 = 1 THEN 'syn' ELSE 'ref' END"))
    rows = odd.unionByName(copies).toPandas()
    spark.createDataFrame(rows).createOrReplaceTempView("near_rows")
    with duckdb.connect() as con:
        con.register("near_rows", rows)
        z = con.execute(f"SELECT * FROM {neighbours.scaled_sql(Duck(), 'near_rows')} AS z").df()
    import numpy as np

    side = {s: z[z.side == s] for s in ("ref", "syn")}
    cells = lambda f: (f[[f"z_{c}" for c in neighbours.NUMBERS]].to_numpy(), np.column_stack([pd.factorize(z[f"c_{c}"])[0][f.index] for c in neighbours.CATEGORIES]))
    want = np.sort(neighbours._distances(*cells(side["syn"]), *cells(side["ref"])), axis=1)[:, :2]
    for block in (neighbours.BLOCK, 7):
        got = {r.id: r for r in neighbours.two_nearest(spark, "near_rows", block).collect()}
        assert len(got) == len(side["syn"])
        for i, (a, b) in zip(side["syn"].id, want, strict=True):
            assert got[i].d1 == pytest.approx(a, abs=1e-9) and got[i].d2 == pytest.approx(b, abs=1e-9)
        assert sum(r.tested for r in got.values()) < 0.35 * len(side["syn"]) * len(side["ref"])


def test_two_nearest_of_few_rows(spark):
    one = (f"side string, {MODEL}", [("ref", *SP), ("syn", 5, *SP[1:]), ("syn", *YOUNG)])
    spark.createDataFrame(one[1], one[0]).createOrReplaceTempView("few_rows")
    got = {r.id: (r.d1, r.d2) for r in neighbours.two_nearest(spark, "few_rows").collect()}
    assert got[5] == (0.0, None) and got[2][1] is None and got[2][0] > 1
    spark.createDataFrame(one[1] + [("ref", 9, *SP[1:])], one[0]).createOrReplaceTempView("few_rows")
    assert {r.id: r.d2 for r in neighbours.two_nearest(spark, "few_rows").collect()}[5] == 0.0
    spark.createDataFrame([], one[0]).createOrReplaceTempView("few_rows")
    assert neighbours.two_nearest(spark, "few_rows").count() == 0


def evaluation_record(nan=False):
    """A record as an evaluation writes it, by hand."""
    numeric = {"synthetic": {"mean": 40.5, "median": 40, "std": 2.0}, "reference": {"mean": 39.5, "median": 41, "std": 2.5}, "absolute_mean_diff": 1.0, "median_diff": 1, "std_diff": 0.5, "relative_mean_diff": float("nan") if nan else None, "ks_statistic": 0.2}
    return {
        "evaluation": {
            "against_holdout": {
                "numeric": {"Idade": numeric},
                "categorical": {"Genero": {"total_variation_distance": 0.1, "missing_categories": ["Outro"], "unexpected_categories": []}},
                "correlations": {"summary": {"mean_abs_difference": 0.05, "max_abs_difference": 0.1}, "pearson": {"absolute_difference": {"Idade": {"Idade": 0.0, "Renda": 0.1}, "Renda": {"Idade": None}}}},
                "categorical_relationships": {"Regiao__Estado": {"total_variation_distance": 0.1, "max_cell_difference": 0.05}},
                "grouped_income": {"Regiao": {"absolute_difference": {"Sudeste": 100.0, "Sul": 50.0}}},
            },
            "privacy": {"columns_used": ["Idade", "Genero", "Renda"], "duplicate_row_rate": 0.0, "nearest_neighbor_train": {"distance_to_closest_record": {"mean": 0.3, "min": 0.1}}, "category_coverage_holdout": {"Genero": 1.0}},
        },
        "validation": {"reason_counts": {"CPF_invalido": 2}},
        "text with NaN, [brackets] and {more}": [[], {}, "NaN \" Infinity", -1e300, True, None],
    }


def test_nested_records_as_long_rows(spark):
    import json

    texts = [(0, json.dumps(evaluation_record())), (1, json.dumps(evaluation_record(nan=True))), (2, None), (3, "no JSON {"), (4, "[]"), (5, "7"), (6, '{"a": [NaN, -Infinity, {"b": Infinity}]}')]
    frame = spark.createDataFrame(texts, "k long, t string")
    got = nested.nodes(frame, "k", "t").collect()

    def walk(x, path):
        pairs = x.items() if isinstance(x, dict) else enumerate(x)
        for k, v in pairs:
            at = f"{path}[{k}]" if isinstance(k, int) else f"{path}.{k}" if k.replace("_", "a").isalnum() else f'{path}."{k}"'
            yield at, v
            if isinstance(v, (dict, list)):
                yield from walk(v, at)

    want = {at: v for at, v in walk(evaluation_record(), "$")}
    for k in (0, 1):
        mine = {r.path: r for r in got if r.record == k}
        assert set(mine) == set(want)
        for at, v in want.items():
            r = mine[at]
            kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "text" if isinstance(v, str) else "flag" if isinstance(v, bool) else "null" if v is None else "number"
            assert (r.kind, r.size, r.number, r.value) == (kind, len(v) if kind in ("object", "array") else None, v if kind == "number" else None, v if kind == "text" else "true" if kind == "flag" else None), at
    assert {r.record for r in got} == {0, 1, 6} and {(r.path, r.kind) for r in got if r.record == 6} == {("$.a", "array"), ("$.a[0]", "null"), ("$.a[1]", "null"), ("$.a[2]", "object"), ("$.a[2].b", "null")}
    rows = {(r.metric_group, r.metric_name, r.column_name): (r.value, r.reference, r.difference) for r in nested.run_metrics(frame, "k", "t").where("record = 0").collect()}
    assert rows["numeric", "mean", "Idade"] == (40.5, 39.5, 1.0) and rows["numeric", "std", "Idade"] == (2.0, 2.5, 0.5) and rows["numeric", "relative_mean_diff", "Idade"] == (None, None, None)
    assert rows["categorical", "missing_categories_count", "Genero"][0] == 1 and rows["categorical", "unexpected_categories_count", "Genero"][0] == 0 and rows["categorical", "category_coverage_holdout", "Genero"][0] == 1
    assert rows["relationships", "pearson_mean_abs_difference", None][0] == pytest.approx(0.05) and rows["relationships", "grouped_income_mean_abs_difference", "Regiao"][0] == 75
    assert rows["relationships", "categorical_relationship_tvd", "Regiao__Estado"][0] == 0.1 and rows["privacy", "columns_used", None][0] == 3 and rows["privacy", "dcr_train_min", None][0] == 0.1
    assert rows["validation", "reason_count", "CPF_invalido"][0] == 2 and ("privacy", "nndr_train_mean", None) not in rows
    assert nested.nodes(frame.limit(0), "k", "t").count() == 0


def test_checks_of_manifests(ask):
    checks = (nested.Check("model", "$.model", text="ctgan"), nested.Check("purpose", "$.p", text="recommended_candidate"), nested.Check("rate", "$.rate", low=0.915, high=0.969), nested.Check("hidden", "$.columns", absent="Geo_Key"))
    nodes = [(1, "$.model", "text", None, None, "CTGAN"), (1, "$.p", "text", None, None, "Recommended Candidate"), (1, "$.rate", "number", None, 0.915, None), (1, "$.columns", "array", 1, None, None), (1, "$.columns[0]", "text", None, None, "Idade"),
             (2, "$.model", "text", None, None, "other"), (2, "$.rate", "number", None, 0.97, None), (2, "$.columns", "array", 1, None, None), (2, "$.columns[0]", "text", None, None, "Geo_Key")]
    frames_ = {"t": ("record long, path string, kind string, size long, number double, value string", nodes), "r": ("record long", [(1,), (2,), (3,)])}
    got = {(x["record"], x["check_name"]): x["passed"] for x in ask(lambda d: nested.checks_sql(d, "t", "r", checks), **frames_)}
    assert [got[1, c.name] for c in checks] == [True] * 4 and not any(got[k, c.name] for k in (2, 3) for c in checks) and len(got) == 12


def test_no_nan_at_any_depth(spark):
    from pyspark.sql import Row

    frame = spark.createDataFrame([(1, Row(a=float("nan"), b=[1.0, float("inf")]), {"k": float("nan")}), (2, None, None)], "k long, s struct<a: double, b: array<double>>, m map<string, double>")
    from veredas.sources import files

    first, second = files.without_nan(frame).orderBy("k").collect()
    assert (first.s.a, first.s.b, first.m) == (None, [1.0, None], {"k": None}) and second.s is None and second.m is None


def test_profiles_from_a_data_source(spark):
    from veredas.sources import profiles

    want = sorted(generate.generate_profiles(spark.range(50).withColumnRenamed("id", "row_id"), 7).collect())
    for n in (1, 3, 64):
        got = profiles.read(spark, 50, seed=7, partitions=n)
        assert sorted(got.collect()) == want and spark.read.format(profiles.NAME).options(rows=50, partitions=n).load().rdd.getNumPartitions() == min(n, 50)
    tail = profiles.read(spark, 20, seed=7, first=30, partitions=2).collect()
    assert sorted(tail) == want[30:]
    assert profiles.read(spark, 0).count() == 0 and set(profiles.read(spark, 3, final=True).columns) == {"row_id", *domain.FINAL_COLUMNS}
    for bad in ({}, {"rows": "x"}, {"rows": 5, "partitions": 0}, {"rows": -1}):
        with pytest.raises(Exception, match="whole number"):
            spark.read.format(profiles.NAME).options(**bad).load().count()


def test_probes_of_stages(spark, tmp_path):
    told, memory = [], iter([1.0, 5.0, 6.0, 7.0])
    p = probes.Probes(resource=lambda: next(memory), on_stage=lambda r: told.append(r["stage"]))
    rows = spark.range(100).selectExpr("id", "id % 4 = 0 AS valid")
    p.run("written", rows, lambda df: df.write.parquet(f"{tmp_path}/x"), valid=probes.valid_rows(), largest=F.max("id"))
    with pytest.raises(ZeroDivisionError):
        p.run("broken", rows, lambda df: 1 / 0)
    with pytest.raises(ValueError, match="run before"):
        p.run("written", rows, lambda df: df.count())
    got = {(r.stage, r.metric): r for r in p.table(spark).collect()}
    assert (got["written", "rows"].value, got["written", "valid"].value, got["written", "largest"].value) == (100, 25, 99) and got["broken", "rows"].value is None
    assert told == ["written", "broken"] and (got["written", "rows"].resource_before, got["written", "rows"].resource_after) == (1, 5) and got["written", "rows"].seconds > 0


def test_rank_correlation_leaves_out_pairs_that_lack_a_value(ask):
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(s, *(None if r.random() < 0.2 else float(r.integers(0, 6) + (k % 3) * (c == 1)) for c in range(3))) for s in ("ref", "syn") for k in range(60)]
    t = ("side string, a double, b double, c double", [*rows, ("ref", None, None, None), ("ref", float("nan"), 1.0, 2.0)])
    frame = pd.DataFrame(t[1], columns=["side", "a", "b", "c"])
    for method, build in (("pearson", twosample.pearson_difference), ("spearman", twosample.spearman_difference)):
        got = {(x["a"], x["b"]): x for x in ask(lambda d: build(d, "t", ("a", "b", "c")), t=t)}  # noqa: B023
        assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
        for side, name in (("ref", "ref"), ("syn", "syn")):
            want = frame[frame.side == side][["a", "b", "c"]].corr(method=method)
            for (x, y), row in got.items():
                assert row[name] == pytest.approx(want.loc[x, y], abs=2e-6), (method, side, x, y)
