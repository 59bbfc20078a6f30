"""The library's operators applied to the test tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veredas.functions import canonical, domain
from veredas.functions.dialect import Duck, Spark
from veredas.operators import conditional, encode, experiments, finalize, gates, generate, kstest, neighbours, nested, privacy, profilestats, ranks, reports, twosample, validate

from .registry import register


def _add(name: str, build: Callable[[Spark], str]) -> None:
    register(name, lambda spark, sf_dir: spark.sql(build(Spark(sf_dir, spark))), build(Duck()))


def _items(d: Spark) -> str:
    return f"(SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN 'ref' ELSE 'syn' END AS side FROM {d.table('lineitem')} AS l0)"


def _orders(d: Spark) -> str:
    return f"(SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'ref' ELSE 'syn' END AS side FROM {d.table('orders')} AS o0)"


def _ids(d: Spark) -> str:
    return f"(SELECT o_orderkey AS row_id FROM {d.table('orders')} AS o)"


def _sided(rel: str) -> str:
    return f"(SELECT *, CASE WHEN row_id % 2 = 0 THEN 'ref' ELSE 'syn' END AS side FROM {rel} AS s0)"


def _profiles(d: Spark) -> str:
    return _sided(d.kept(generate.profiles_sql(d, _ids(d)), "profiles"))


def _broken(d: Spark) -> str:
    return _sided(d.kept(generate.broken_profiles_sql(d, _ids(d)), "broken"))


def _raw(d: Spark, columns: tuple[str, ...] = domain.MODEL_COLUMNS) -> str:
    """The model columns (or some) of the broken profiles, for what reads no others; identifiers are not made then."""
    if d.session is None:
        return _broken(d)
    return _sided(d.kept(generate.broken_profiles_sql(d, _ids(d), columns=columns), "raw"))


def _repaired(d: Spark, columns: tuple[str, ...] = domain.MODEL_COLUMNS) -> str:
    return d.kept(finalize.repaired_sql(d, _raw(d, columns), columns=columns), "repaired")


def _versions(d: Spark) -> str:
    if d.session is not None:
        made = d.kept(generate.incomes_sql(d, _ids(d)), "incomes")
        return conditional.versions_sql(d, {name: f"(SELECT Ocupacao, Renda_{name} AS Renda FROM {made} AS m)" for name, _, _ in generate.INCOME_VERSIONS})
    return conditional.versions_sql(d, {name: d.kept(generate.profiles_sql(d, _ids(d), 41, v, variant), "version") for name, v, variant in generate.INCOME_VERSIONS})


def _runs(d: Spark) -> str:
    """Lines as runs of an experiment: a model per return flag, a size per line number."""
    return f"(SELECT l_returnflag AS model, l_linenumber AS train_size, CAST(l_partkey % 3 AS INT) AS seed, l_discount AS renda_ks, l_tax AS renda_w1, l_quantity AS seconds, CASE WHEN l_linenumber > 4 AND l_returnflag <> 'N' THEN 'failed' WHEN l_linenumber = 7 THEN 'skipped_after_failure' WHEN l_linenumber = 4 AND l_quantity > 25 THEN 'resource_limited' ELSE 'completed' END AS status FROM {d.table('lineitem')} AS l0)"


def _all(name: str, sql: str) -> str:
    return f"SELECT * FROM {sql} AS {name}"


# Two-sample statistics.
_add("cat_tvd", lambda d: twosample.tvd(d, _items(d), "l_returnflag"))
_add("cat_shares", lambda d: twosample.category_shares(d, _items(d), "l_shipdate"))
_add("num_moments", lambda d: twosample.moments(d, _items(d), "l_extendedprice"))
_add("mean_difference", lambda d: twosample.mean_difference(d, _items(d), "l_quantity"))
_add("wasserstein_ks", lambda d: twosample.distances(d, _items(d), "l_returnflag", "l_extendedprice"))
register("ks_exact", lambda spark, sf_dir: kstest.p_values(spark, _items(Spark(sf_dir)), "l_suppkey", "l_extendedprice"), kstest.duck_sql(Duck(), _items(Duck()), "l_suppkey", "l_extendedprice"))
_add("pearson", lambda d: twosample.pearson_difference(d, _items(d), ("l_quantity", "l_extendedprice", "l_discount")))
_add("spearman", lambda d: twosample.spearman_difference(d, _items(d), ("l_quantity", "l_discount", "l_tax")))
_add("correlation_summary", lambda d: twosample.correlation_summary(d, _items(d), ("l_quantity", "l_extendedprice", "l_discount")))
_add("crosstabs", lambda d: twosample.crosstabs(d, _profiles(d)))
_add("crosstab_tvd", lambda d: twosample.crosstab(d, _items(d), "l_returnflag", "l_linestatus"))
_add("grouped_mean", lambda d: twosample.grouped_means(d, _orders(d), "o_orderpriority", "o_totalprice"))
_add("age_bands", lambda d: f"SELECT {twosample.income_band('Idade')} AS income_band, {twosample.cut_band('Idade')} AS cut_band, count(*) AS n FROM {_broken(d)} GROUP BY 1, 2")
_add("grouped_income_bands", lambda d: twosample.grouped_means(d, f"(SELECT *, {twosample.cut_band('Idade')} AS band FROM {_profiles(d)})", "band", "Renda"))
_add("histogram_overlap", lambda d: twosample.overlap(d, _orders(d), "o_totalprice"))
_add("quantile_overlap", lambda d: twosample.quantile_overlap(d, _orders(d), "o_totalprice"))
# Generators.
_add("calibration", lambda d: _all("p", generate.profiles_sql(d, _ids(d))))
_add("final_profiles", lambda d: _all("p", generate.final_profiles_sql(d, _ids(d))))
_add("broken_profiles", lambda d: _all("p", generate.broken_profiles_sql(d, _ids(d))))
_add("occupation_weights", lambda d: f"SELECT level, age, occupation, round(share, 9) AS share FROM {generate.occupation_weights_sql(d)} AS w")
_add("split", lambda d: f"SELECT side, count(*) AS n, sum(row_id) AS id_sum FROM {generate.split_sql(d, _ids(d), 1000)} AS s GROUP BY side")
_add("split_fraction", lambda d: f"SELECT side, count(*) AS n, sum(row_id) AS id_sum FROM {generate.split_sql(d, _ids(d), seed=7, fraction=0.25)} AS s GROUP BY side")
_add("conditional_sample", lambda d: f"SELECT * FROM {generate.conditional_sample_sql(d, _ids(d), 'Mecânico')} AS c UNION ALL SELECT * FROM {generate.conditional_sample_sql(d, _ids(d), 'Médico', version=2)} AS c2")
_add("legacy_income", lambda d: _all("l", generate.legacy_income_sql(d, _ids(d))))
_add("encoded_profiles", lambda d: f"SELECT row_id, v[{d.index(1)}] AS age, v[{d.index(2)}] AS income, {d.list_total('v')} AS vector_sum FROM {d.kept(encode.encode_sql(d, _broken(d)), 'vectors')} AS e")
_add("decoded_profiles", lambda d: encode.decode_sql(d, encode.encode_sql(d, _profiles(d))))
_add("geography_catalog", lambda d: profilestats.geography_catalog(d))
_add("geography_encode", lambda d: profilestats.encode_geography(d, _broken(d)))
_add("geography_decode", lambda d: profilestats.decode_geography(d, f"(SELECT row_id, CASE WHEN row_id % 50 = 0 THEN 'GEO_999999' ELSE Geo_Key END AS Geo_Key FROM ({profilestats.encode_geography(d, _profiles(d))}) AS e)"))


def _masks(d: Spark, batch_rows: int = 500) -> str:
    """Candidates in batches, with the verdict of the final rules of the whole table and of the model rules alone."""
    judged = validate.validation_sql(d, _broken(d), carry={"batch_valid": validate.rules(d)["structural_global"]})
    return f"(SELECT row_id, CAST(floor(row_id / {batch_rows}e0) AS BIGINT) AS batch, batch_valid, valid FROM {judged} AS v)"


_add("select_valid", lambda d: _all("s", generate.select_first_sql(_masks(d), 1000)))
_add("generation_accounting", lambda d: generate.accounting_sql(d, _masks(d), 1000))
_add("cross_batch_duplicates", lambda d: generate.cross_batch_duplicates(d, f"(SELECT *, row_id % 4 AS batch FROM {_broken(d)} AS x)"))
_add("presets", profilestats.presets)
# Validation.
_add("rule_counts", lambda d: validate.rule_counts(d, _broken(d), validate.rules(d)))
_add("final_rule_counts", lambda d: validate.rule_counts(d, _broken(d), validate.final_rules(d)))
_add("rule_masks", lambda d: _all("m", validate.masks_sql(d, _broken(d), validate.rules(d) | validate.final_rules(d))))
_add("failed_rules", lambda d: _all("f", validate.failed_sql(d, _broken(d), validate.rules(d))))
_add("failure_distribution", lambda d: validate.failure_distribution(d, _broken(d), validate.rules(d)))
_add("failure_combinations", lambda d: validate.failure_combinations(d, _broken(d), validate.rules(d)))
_add("rule_cooccurrence", lambda d: validate.co_occurrence(d, _broken(d), validate.rules(d)))
_add("duplicated_identifiers", lambda d: validate.duplicated_ids(d, _broken(d)))
_add("keep_first", lambda d: f"SELECT row_id, CPF, later FROM {validate.keep_first_sql(_broken(d), 'CPF')} AS k")
_add("null_counts", lambda d: validate.null_counts(d, _broken(d), domain.MODEL_COLUMNS))
_add("validation_report", lambda d: validate.validation_report(d, _broken(d)))
_add("validation_reasons", lambda d: validate.validation_reasons(d, _broken(d)))
_PART = tuple(c for c in domain.FINAL_COLUMNS if c not in ("Idade", "CPF", "Municipio"))
_RULES = {"children_of_students": validate.UserRule(lambda d: "NOT (Ocupacao = 'Estudante' AND Dependentes > 2)", ("Ocupacao", "Dependentes")), "rich_pupils": validate.UserRule(lambda d: "NOT (Escolaridade = 'Fundamental' AND Renda > 4000)", ("Escolaridade", "Renda")), "absent_column": validate.UserRule(lambda d: "Altura > 0", ("Altura",))}


def _text_frame(d: Spark) -> str:
    """Final rows as text without age, CPF and municipality, and with an income that is no number now and then."""
    return f"(SELECT row_id, {', '.join(f'CASE WHEN row_id % 37 = 0 THEN {chr(39)}abc{chr(39)} ELSE CAST({c} AS VARCHAR(60)) END AS {c}' if c == 'Renda' else f'CAST({c} AS VARCHAR(60)) AS {c}' for c in _PART)} FROM {_broken(d)} AS x)"


_add("validation_of_part", lambda d: validate.validation_report(d, _text_frame(d), columns=_PART))
_add("reasons_of_part", lambda d: validate.validation_reasons(d, _text_frame(d), columns=_PART))
_add("rule_counts_of_part", lambda d: validate.rule_counts(d, _text_frame(d), validate.rules(d, _PART) | validate.final_rules(d, _PART)))
_add("validation_with_rules", lambda d: validate.validation_report(d, _broken(d), named=_RULES))
_add("core_validation", lambda d: validate.validation_report(d, _broken(d), final=False))
_add("validation_checklist", lambda d: validate.checklist(d, _broken(d)))
_add("invalid_combinations", lambda d: validate.invalid_combinations(d, _broken(d)))
_add("dominant_rule", lambda d: validate.dominant_rule(d, _broken(d)))
_add("legacy_raw_summary", lambda d: validate.legacy_raw_summary(d, f"(SELECT *, row_id % 4 - 1 AS Sexo FROM {_broken(d)} AS x)", "Sexo"))
_add("typed_columns", lambda d: f"SELECT row_id, {', '.join(f'{canonical.typed(d, c)} AS {c}' for c in domain.MODEL_COLUMNS)} FROM {_broken(d)}")
_add("gender_codes", lambda d: f"SELECT row_id, {canonical.gender_of('(row_id % 5 - 1) / 2e0')} AS Genero FROM {_ids(d)} AS i")
_add("legacy_summary", lambda d: validate.legacy_summary(d, _broken(d)))
# Privacy.
_KEY = ("Idade", "Genero", "Regiao", "Escolaridade", "Dependentes")
_add("duplicate_rows", lambda d: privacy.duplicate_rows(d, _profiles(d), privacy.row_key(d, _KEY)))
_add("duplicate_histogram", lambda d: privacy.duplicate_histogram(d, _profiles(d), privacy.row_key(d, _KEY)))
_add("exact_matches", lambda d: privacy.exact_matches(d, _profiles(d), privacy.row_key(d, _KEY)))
_add("partial_matches", lambda d: privacy.partial_matches(d, _profiles(d)))
_add("coverage", lambda d: privacy.coverage(d, _profiles(d), ("Estado", "Municipio", "Ocupacao", "DDD")))
_add("row_hashes", lambda d: f"SELECT row_id, {privacy.row_key(d, domain.MODEL_COLUMNS)} AS row_hash FROM {_profiles(d)}")
_add("matched_hashes", lambda d: privacy.matched_hashes(d, _profiles(d), privacy.row_key(d, _KEY)))
_add("largest_groups", lambda d: privacy.largest_groups(d, _profiles(d), privacy.row_key(d, _KEY)))
_add("privacy_report", lambda d: privacy.report(d, _profiles(d)))
_add("nearest_profiles", lambda d: privacy.nearest_profiles(d, _profiles(d)))
_add("named_row_hashes", lambda d: f"SELECT row_id, {canonical.named_row_key(d, ('Genero', 'Idade', 'Ocupacao'))} AS row_hash FROM {_profiles(d)}")
_add("documents_duplicates", lambda d: privacy.duplicate_rows(d, f"{d.table('documents')}", d.sha256("coalesce(text, '')")))


def _customers(d: Spark) -> str:
    return _sided(generate.profiles_sql(d, f"(SELECT c_custkey AS row_id FROM {d.table('customer')} AS c)"))


register("nearest_all", lambda spark, sf_dir: neighbours.summary(spark, _customers(Spark(sf_dir))), neighbours.brute_sql(Duck(), _customers(Duck())))
# Conditional income.
_add("conditional_summary", lambda d: conditional.summary(d, _profiles(d)))
_add("tail_rates", lambda d: conditional.tail_rates(d, _profiles(d), "Ocupacao"))
_add("conditional_compare", lambda d: conditional.compare(d, _profiles(d)))
_add("plausibility", lambda d: conditional.plausibility(d, _profiles(d)))
_add("tail_events", lambda d: conditional.tail_events(d, _profiles(d)))
_add("rank_correlation", lambda d: conditional.rank_correlation(d, _profiles(d)))
_add("income_by_occupation", lambda d: conditional.income_by_occupation(d, _profiles(d)))
_add("income_pairs", lambda d: conditional.income_pairs(d, _profiles(d)))
_add("income_by_gender", lambda d: f"SELECT Genero, count(*) AS n, round(avg(Renda), 4) AS mean, round(max(m.m), 4) AS median FROM {_profiles(d)} AS p JOIN {ranks.group_quantiles(_profiles(d), {'g': 'Genero'}, 'Renda', {'m': 0.5})} AS m ON p.Genero = m.g GROUP BY Genero")
_add("income_versions", lambda d: conditional.version_summary(d, _versions(d)))
_add("income_compression", lambda d: conditional.compression(d, _versions(d)))
_add("income_candidates", lambda d: conditional.candidate_scores(d, _versions(d)))
_add("income_rank_inversions", lambda d: conditional.rank_inversions(d, _versions(d)))
# Geography, vocabulary, relations, stages.
_add("geography_validity", lambda d: profilestats.geography_validity(d, _broken(d)))
_add("invalid_places", lambda d: profilestats.invalid_places(d, _broken(d)))
_add("geography_tvd", lambda d: " UNION ALL ".join(f"SELECT '{c}' AS column_name, * FROM ({twosample.tvd(d, _profiles(d), c)}) AS t" for c in ("Regiao", "Estado", "Municipio", "DDD")))
_add("rare_occupations", lambda d: profilestats.rare_values(d, _profiles(d), "Ocupacao"))
_add("relational_validity", lambda d: profilestats.relational_validity(d, _broken(d)))
_add("offending_pairs", lambda d: profilestats.offending_pairs(d, _broken(d)))
_add("occupation_entropy", lambda d: profilestats.occupation_entropy(d, _broken(d)))
_add("unexpected_values", lambda d: profilestats.unexpected_values(d, _broken(d)))
#: Combining marks after a text: two below and above a letter in the wrong order, three for one letter, jamo, Devanagari, a sign that stands for a letter.
_MARKED = ("a\u0301\u0323", "e\u0302\u0301 ", "o\u031b\u0323\u0304", "\u1112\u1161\u11ab", "\uac00\u11a8", "\u0928\u093c\u0958", "\u212b\u2126", "s\u0307\u0323x")


def _with_marks(d: Spark) -> str:
    """The broken profiles, with marks in every script behind some names."""
    marked = " ".join(f"WHEN {i} THEN concat(Municipio, '{m}')" for i, m in enumerate(_MARKED))
    return f"(SELECT row_id, Escolaridade, CASE row_id % 11 {marked} ELSE Municipio END AS Municipio FROM {_broken(d)} AS w)"


_add("normalized_text", lambda d: f"SELECT row_id, Escolaridade_norm, Municipio_norm FROM {profilestats.normalize_sql(d, _with_marks(d), ('Escolaridade', 'Municipio'))} AS n")
_add("vocabulary_gates", lambda d: reports.vocabulary_gates(d, _broken(d), f"(SELECT count(*) AS asked FROM {d.table('orders')} AS o)"))
_add("repaired", lambda d: _all("r", finalize.repaired_sql(d, _broken(d))))


def _given(d: Spark) -> str:
    """A frame without row ids whose columns are text, with texts that are no numbers and a third of it one and the same row."""
    same = lambda c: f"CASE WHEN row_id % 3 = 0 THEN '{dict(zip(domain.MODEL_COLUMNS, ('40', 'Feminino', 'Norte', 'SP', 'Sao Paulo', 'Ensino Medio', 'Uniao Estavel', 'Tecnico', '2500.5', '1', '92'), strict=True))[c]}'"
    odd = {"Idade": "WHEN row_id % 53 = 0 THEN 'abc'", "Renda": "WHEN row_id % 59 = 0 THEN '1.5x'", "DDD": "WHEN row_id % 61 = 0 THEN '11.0'"}
    plain = {"Renda": "CAST(CAST(floor(Renda) AS BIGINT) AS VARCHAR(20))"}
    return f"(SELECT {', '.join(f'{same(c)} {odd.get(c, str())} ELSE {plain.get(c, f'CAST({c} AS VARCHAR(60))')} END AS {c}' for c in domain.MODEL_COLUMNS)} FROM {_broken(d)} AS g)"


_add("repaired_text", lambda d: _all("r", finalize.repaired_sql(d, f"(SELECT * FROM {finalize.numbered_sql(d, _given(d), domain.MODEL_COLUMNS)} AS n)")))
_add("final_from_given", lambda d: _all("f", finalize.final_sql(d, _given(d))))
_add("field_changes", lambda d: profilestats.field_changes(d, _raw(d), _repaired(d)))
_add("transitions", lambda d: profilestats.transitions(d, _raw(d), _repaired(d)))
_add("stage_outcomes", lambda d: profilestats.stage_outcomes(d, _raw(d), _repaired(d)))


def _stages(d: Spark, columns: tuple[str, ...] = domain.MODEL_COLUMNS) -> str:
    """The same people as holdout, raw and repaired rows: all model columns, or some with the state, on which repair rests."""
    holdout = f"(SELECT * FROM {d.kept(generate.profiles_sql(d, _ids(d), 7, columns=columns), 'holdout')} AS h0)"
    cols = ", ".join(columns)
    return f"(SELECT 'holdout' AS stage, row_id, {cols} FROM {holdout} AS h UNION ALL SELECT 'raw', row_id, {cols} FROM {_raw(d, columns)} AS r UNION ALL SELECT 'final', row_id, {cols} FROM {_repaired(d, columns)} AS f)"


def _against(d: Spark, stage: str) -> str:
    """The holdout as reference and a stage as the synthetic side."""
    return f"(SELECT *, CASE WHEN stage = 'holdout' THEN 'ref' ELSE 'syn' END AS side FROM {_stages(d)} AS st WHERE stage IN ('holdout', '{stage}'))"


#: What the conditional reports read, and the state.
_INCOME_COLUMNS = ("Idade", "Estado", "Regiao", "Escolaridade", "Ocupacao", "Renda")
_add("evaluation", lambda d: reports.evaluation(d, _profiles(d)))
_add("conditional_stages", lambda d: reports.conditional_report(d, _against(d, "final"), _against(d, "raw")) if d.session is None else conditional.staged(d, _stages(d, tuple(c for c in domain.MODEL_COLUMNS if c in _INCOME_COLUMNS)), "holdout", ("final", "raw")))
_add("geography_diversity", lambda d: reports.geography_diversity(d, _profiles(d)))
_add("rare_geography_keys", lambda d: reports.rare_geography_keys(d, f"(SELECT * FROM {_profiles(d)} AS g WHERE side = 'ref' OR row_id % 16 = 1)"))
_add("raw_final_comparison", lambda d: reports.raw_final_comparison(d, _against(d, "raw"), _against(d, "final")))
_add("occupation_populations", lambda d: reports.occupation_populations(d, f"(SELECT stage AS population, Ocupacao FROM {_stages(d)} AS s)", ("Diretor", "Médico")))
_add("income_stages", lambda d: reports.income_stages(d, _stages(d)))
_add("diversity", lambda d: reports.diversity(d, _stages(d)))
_add("locale_report", lambda d: reports.locale(d, f"(SELECT stage, {', '.join(domain.CATEGORIES.keys() - {'Municipio'})}, CASE WHEN row_id % 9 = 0 THEN replace(Municipio, 'ã', 'a{chr(771)}') ELSE Municipio END AS Municipio FROM {_stages(d)} AS s)"))
_add("coherence", lambda d: reports.coherence(d, _stages(d)))
_add("rare_occupations_stages", lambda d: reports.rare_occupations(d, _stages(d)))
_add("geography_outcomes", lambda d: profilestats.geography_outcomes(d, _raw(d), _repaired(d)))
_add("catalog_check", profilestats.catalog_check)
_add("dependency_class", lambda d: reports.dependency(d, f"(SELECT o_totalprice / 6e5 AS raw_rate, 0.1e0 AS rejection_rate, o_custkey AS repaired, 1500 AS selected FROM {d.table('orders')} AS o)"))
_add("gate_statuses", lambda d: gates.statuses(d, f"(SELECT o_orderkey AS run, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS invalid_rows, 0 AS duplicated_identifier, 0 AS null_required_fields, o_totalprice / 5e7 AS exact_train_match_rate, o_totalprice / 2e6 AS total_variation_distance, 0.1e0 AS correlation_difference, 0e0 AS duplicate_base_row_rate, 500 AS synthetic_rows FROM {d.table('orders')} AS o)"))
# Experiments, history.
_add("agg_by_model", lambda d: experiments.aggregate(d, _runs(d), ("model",), ("renda_ks", "renda_w1", "seconds")))
_add("agg_by_model_size", lambda d: experiments.aggregate(d, _runs(d), ("model", "train_size"), ("renda_ks", "renda_w1", "seconds")))
_add("marginal_gains", lambda d: experiments.marginal_gains(d, _runs(d), [(1, 3), (3, 5), (5, 6)], ("renda_ks", "renda_w1", "seconds")))


def _failures(d: Spark) -> str:
    return f"(SELECT model, train_size, status FROM {_runs(d)} AS x WHERE status IN ('failed', 'resource_limited') AND train_size <> 2)"


def _summary(d: Spark) -> str:
    """The runs that were carried out, with the verdict on their rows."""
    return f"(SELECT model, train_size, status = 'resource_limited' AS resource_limited, CASE seed WHEN 0 THEN 'approved' WHEN 1 THEN 'quarantined' ELSE 'rejected' END AS status FROM {_runs(d)} AS x WHERE status <> 'failed')"


_add("status_counts", lambda d: experiments.status_counts(_summary(d), _failures(d), ("model",)))
_add("status_counts_by_size", lambda d: experiments.status_counts(_summary(d), _failures(d), ("model", "train_size")))
_add("capacity_limits", lambda d: experiments.capacity_limits(d, f"(SELECT model, train_size * 250000 AS train_size, status, CASE WHEN status = 'failed' AND seed = 1 THEN 'MemoryError' END AS failure_type FROM {_runs(d)} AS x)"))
_add("scalability_limits", lambda d: experiments.scalability_limits(d, _summary(d), _failures(d)))
_add("pivot_income", lambda d: experiments.pivot(d, f"(SELECT o_custkey, o_orderpriority, o_totalprice FROM {d.table('orders')} AS o)", "o_custkey", "substr(o_orderpriority, 1, 1)", "o_totalprice", ("1", "2", "3", "4", "5")))
_add("status_histogram", lambda d: experiments.status_histogram(d, _runs(d)))


def _metrics(d: Spark) -> str:
    return experiments.long_metrics(d, _runs(d), ("model", "train_size", "seed"), {"income": ("renda_ks", "renda_w1"), "cost": ("seconds",)})


def _history(d: Spark) -> str:
    """Orders as records of runs."""
    return f"(SELECT concat('run-', CAST(o_orderkey AS VARCHAR(20))) AS identifier, CASE WHEN o_orderkey % 3 = 0 THEN 'model' ELSE 'pipeline_run' END AS kind, CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'ctgan' ELSE 'simple_gan' END AS model, CAST(o_custkey % 4 AS INT) AS seed, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'quality_quarantined' END AS status, o_custkey AS row_count, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS train_rows, CAST(o_orderdate AS VARCHAR(10)) AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN 0.25e0 END AS exact_train_match_rate FROM {d.table('orders')} AS o)"


def _artifacts(d: Spark) -> str:
    return f"(SELECT identifier AS artifact_id, coalesce(model, 'programmatic') AS model, status, CASE WHEN seed = 1 THEN 'candidate' WHEN seed = 2 THEN 'smoke' END AS purpose, seed = 3 AS is_legacy, row_count % 3 = 0 AS recommended, created_at, seed AS vocabulary_version, 'pt-BR' AS locale, 'NFC' AS normalization FROM {_history(d)} AS h)"


_SIZES = [(1, 3), (3, 5), (1, 5)]
_add("quality_gains", lambda d: experiments.quality_gains(d, f"(SELECT model, train_size, renda_w1 AS renda_wasserstein_normalized, renda_ks, NULL + 0e0 AS genero_tvd, renda_ks * 2 AS correlation_difference, seconds AS training_seconds, seconds * 3 AS peak_memory_mb, 1e0 AS model_size_mb FROM {_runs(d)} AS x)", _SIZES))
_add("long_metrics", _metrics)
_add("metric_group_means", lambda d: experiments.group_means(d, _metrics(d)))
_add("income_metrics", lambda d: _all("g", experiments.by_metric_group(f"({_metrics(d)})", "income")))
_add("ordered_runs", lambda d: experiments.placed(d, f"(SELECT DISTINCT CASE WHEN train_size = 7 THEN NULL ELSE train_size END AS train_size, model, seed FROM {_runs(d)} AS x)", experiments.SUMMARY_ORDER))
_add("model_rotation", lambda d: experiments.rotated(d, ["programmatic", "simple_gan", "ctgan"], [41, 42, 43]))
_add("history_filter", lambda d: f"SELECT identifier, created_at FROM {experiments.history_filter(_history(d), kind='model', model='ctgan', seed=2)} AS f")
_add("history_rows", lambda d: experiments.history_rows(d, _history(d)))
_add("history_counts", lambda d: experiments.history_counts(d, _history(d)))
_add("latest_records", lambda d: experiments.latest_records(d, _history(d), 25))
_add("ranked_artifacts", lambda d: experiments.ranked_artifacts(d, _artifacts(d)))
_add("generation_ready", lambda d: experiments.generation_ready(d, _artifacts(d)))
_add("evidence_checks", lambda d: experiments.evidence_checks(d, f"({_metrics(d)})", {"renda_ks": (0.0, 0.1), "seconds": (0.0, 25.0), "absent": (0.0, 1.0)}))
_add("sanitized_events", lambda d: experiments.sanitized(d, d.table("events"), "event_id", {"event": "event_type", "rows": "user_id", "user": "user_id", "duration_seconds": "round(value, 3)", "other": "1"}))
_add("history_summary", lambda d: experiments.history_summary(d, d.table("events")))
_add("latest_per_user", lambda d: experiments.latest_per_user(d, d.table("events")))
_add("events_windowed", lambda d: experiments.windowed(d, d.table("events")))
def _flat_runs(d: Spark) -> str:
    """Orders as runs with a few metrics."""
    return f"(SELECT o_orderkey AS run, CASE WHEN o_custkey % 2 = 0 THEN 'ctgan' ELSE 'simple_gan' END AS model, o_custkey / 1e4 AS ks, o_totalprice / 1e6 AS w1, o_totalprice / 1e4 AS seconds FROM {d.table('orders')} AS o)"


def _over_records(run: Callable[[DataFrame], DataFrame], build: Callable[[Duck, str], str]) -> tuple[Callable, str]:
    """A query over the runs' nested records, and its twin over their nodes."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = Spark(sf_dir, spark)
        return run(spark.sql(f"SELECT * FROM {nested.example_records_sql(d, d.spread(_flat_runs(d)))} AS e"))

    return query, build(Duck(), nested.duck(Duck(), _flat_runs(Duck())))


_CHECKS = (nested.Check("model_is_ctgan", "$.model", text="ctgan"), nested.Check("purpose", "$.purpose", text="recommended_candidate"), nested.Check("few_duplicates", "$.evaluation.privacy.duplicate_row_rate", low=0.0, high=0.2), nested.Check("key_not_used", "$.evaluation.privacy.columns_used", absent="Geo_Key"), nested.Check("other_kept", "$.evaluation.against_holdout.categorical.Genero.missing_categories", absent="Outro"), nested.Check("checksum", "$.checksum", text="x"))
register("nested_nodes", *_over_records(lambda r: nested.nodes(r, "record", "text"), lambda d, n: f"SELECT record, path, kind, size, number, value FROM {n} AS n"))
register("nested_metrics", *_over_records(lambda r: nested.run_metrics(r, "record", "text"), lambda d, n: nested.metrics_sql(d, n)))
register("nested_checks", *_over_records(lambda r: nested.run_checks(r, "record", "text", _CHECKS), lambda d, n: nested.checks_sql(d, n, f"(SELECT run AS record FROM {_flat_runs(d)} AS u)", _CHECKS)))
_add("audit_props", lambda d: f"SELECT event_id, {d.json_text('props', 'k')} AS k FROM {d.table('events')} AS e")
