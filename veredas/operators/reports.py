"""Composed reports: what the single statistics say together, as long or one-row tables.

Columns of one kind are put under each other first (name and value), so that a report over many columns
reads the rows once a kind.
"""

from __future__ import annotations

from veredas.functions import domain
from veredas.functions.dialect import Spark, any_of, literal

from . import conditional, privacy, profilestats, twosample, validate
from .ranks import counted, quantile, ranked, settled, stats

NUMBERS = ("Idade", "Renda", "Dependentes")
CATEGORIES = (*domain.CATEGORIES, "DDD")
_SEP = chr(1)


def _long(d: Spark, rel: str, columns: tuple[str, ...]) -> str:
    """side, name and value (text; null is ``<NA>``) of some columns."""
    cells = [f"concat('{c}{_SEP}', coalesce(CAST({c} AS VARCHAR(200)), '<NA>'))" for c in columns]
    return f"(SELECT side, split_part(cell, '{_SEP}', 1) AS name, split_part(cell, '{_SEP}', 2) AS v FROM (SELECT side, {d.explode(cells, 'cell')} FROM {rel} AS z) AS l)"


def numeric_sql(d: Spark, rel: str, columns: tuple[str, ...] = NUMBERS) -> str:
    """Distances of every number: name (grp), wasserstein, ks, normalized, ks_pvalue."""
    return twosample.distances(d, f"(SELECT side, name, TRY_CAST(v AS DOUBLE) AS x FROM {_long(d, rel, columns)} AS n)", "name", "x")


def tvd_sql(d: Spark, rel: str, columns: tuple[str, ...] = CATEGORIES) -> str:
    """Total variation and coverage of every category column (name)."""
    side = lambda s: f"CAST(sum(CASE WHEN side = '{s}' THEN 1 ELSE 0 END) AS DOUBLE)"
    counts = f"(SELECT name, v, {side('ref')} AS r, {side('syn')} AS s FROM {_long(d, rel, columns)} AS l GROUP BY name, v)"
    return f"""SELECT c.name, sum(abs(r / nullif(r_all, 0) - s / nullif(s_all, 0))) / 2e0 AS tvd, sum(CASE WHEN r > 0 AND s > 0 THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN r > 0 THEN 1e0 END) AS coverage
      FROM {counts} AS c JOIN (SELECT name, sum(r) AS r_all, sum(s) AS s_all FROM {counts} AS e GROUP BY name) AS t ON c.name = t.name GROUP BY c.name"""


def evaluation(d: Spark, rel: str) -> str:
    """Everything that compares the synthetic side with the reference, as (metric_group, name, metric, value)."""
    row = lambda group, name, metric, value, source: f"SELECT '{group}' AS metric_group, {name} AS name, '{metric}' AS metric, {value} AS value FROM {source}"
    numeric, tvd, cross = f"({numeric_sql(d, rel)}) AS t", f"({tvd_sql(d, rel)}) AS t", f"({twosample.crosstabs(d, rel)}) AS t"
    each = lambda group, name, metrics, source: f"SELECT '{group}' AS metric_group, name, split_part(cell, ':', 1) AS metric, CAST(nullif(split_part(cell, ':', 2), '') AS DOUBLE) AS value FROM (SELECT {name} AS name, {d.explode([f'''concat('{m}:', coalesce(CAST({m} AS VARCHAR(40)), ''))''' for m in metrics], 'cell')} FROM {source}) AS c"
    parts = [
        each("numeric", "grp", ("wasserstein", "ks", "normalized", "ks_pvalue"), numeric),
        f"SELECT metric_group, name, metric, {settled('value')} AS value FROM ({each('categorical', 'name', ('tvd', 'coverage'), tvd)}) AS t",
        each("categorical_relationships", "pair", ("tvd", "largest_cell"), cross),
        row("correlations", "method", "largest", "largest", f"({twosample.correlation_summary(d, rel, NUMBERS)}) AS t"),
    ]
    parts += [row("grouped_income", f"concat('{g}=', grp)", "difference", "difference", f"({twosample.grouped_means(d, source, column, 'Renda')}) AS t") for g, column, source in (
        ("Regiao", "Regiao", rel), ("Escolaridade", "Escolaridade", rel), ("Ocupacao", "Ocupacao", rel), ("Faixa", "band", f"(SELECT *, {twosample.cut_band('Idade')} AS band FROM {rel} AS b)"))]
    return " UNION ALL ".join(parts)


def conditional_report(d: Spark, final: str, raw: str) -> str:
    """The plausibility summaries of the raw and the final stage against the same reference, under each other; all tail events are counted."""
    one = lambda stage, rel: f"SELECT '{stage}' AS stage, * FROM ({conditional.plausibility(d, rel, limit=None)}) AS {stage}_t"
    return f"{one('final', final)} UNION ALL {one('raw', raw)}"


def geography_diversity(d: Spark, rel: str) -> str:
    """Coverage and total variation of the composite key, how many keys there are, how often they repeat, and how much of the reference's rare keys (below 1%) is reached."""
    keyed = f"(SELECT p.side, g.Geo_Key FROM {rel} AS p JOIN ({profilestats.geography_catalog(d)}) AS g ON p.Regiao = g.Regiao AND p.Estado = g.Estado AND p.Municipio = g.Municipio AND p.DDD = g.DDD)"
    side = lambda s: f"CAST(sum(CASE WHEN side = '{s}' THEN 1 ELSE 0 END) AS DOUBLE)"
    counts = f"(SELECT Geo_Key, {side('ref')} AS r, {side('syn')} AS s FROM {keyed} AS k GROUP BY Geo_Key)"
    one = lambda p: f"CAST(coalesce(sum(CASE WHEN {p} THEN 1 ELSE 0 END), 0) AS BIGINT)"
    rare = "r > 0 AND r / r_all < 0.01e0"
    totals = f"(SELECT sum(r) AS r_all, sum(s) AS s_all FROM {counts} AS e)"
    return f"""SELECT n_ref, n_syn, n_rare, n_rare_reached, CASE WHEN n_ref = 0 THEN 1e0 ELSE round(n_both / CAST(n_ref AS DOUBLE), 6) END AS coverage, CASE WHEN s_all > 0 THEN round((s_all - n_syn) / s_all, 6) ELSE 0e0 END AS duplicate_rate,
      CASE WHEN r_all > 0 AND s_all > 0 THEN {settled('gap')} ELSE 0e0 END AS tvd, CASE WHEN n_rare = 0 THEN 1e0 ELSE round(n_rare_reached / CAST(n_rare AS DOUBLE), 6) END AS rare_coverage
      FROM (SELECT {one('r > 0')} AS n_ref, {one('s > 0')} AS n_syn, {one('r > 0 AND s > 0')} AS n_both, {one(rare)} AS n_rare, {one(f'{rare} AND s > 0')} AS n_rare_reached, max(r_all) AS r_all, max(s_all) AS s_all, 0.5e0 * sum(abs(r / nullif(r_all, 0) - s / nullif(s_all, 0))) AS gap FROM {counts} AS c CROSS JOIN {totals} AS t) AS u"""


def rare_geography_keys(d: Spark, rel: str, k: int = 100) -> str:
    """The first ``k`` rare keys of the reference, in order, that the synthetic side lacks."""
    keyed = f"(SELECT p.side, g.Geo_Key FROM {rel} AS p JOIN ({profilestats.geography_catalog(d)}) AS g ON p.Regiao = g.Regiao AND p.Estado = g.Estado AND p.Municipio = g.Municipio AND p.DDD = g.DDD)"
    return f"SELECT v AS Geo_Key, n_ref FROM ({profilestats.rare_values(d, keyed, 'Geo_Key')}) AS r WHERE NOT reproduced ORDER BY v LIMIT {k}"


def raw_final_comparison(d: Spark, raw: str, final: str) -> str:
    """One row: validity rates of both stages, the net gain, the rejection rate, and how far the largest category distance moved.

    ``raw`` and ``final`` have a ``side``; candidates are the synthetic rows. The gain is never below 0.
    """
    syn = lambda rel: f"(SELECT * FROM {rel} AS a WHERE side = 'syn')"
    names = ("structural_global", "geographic_joint", "professional_joint", "non_relational_joint", "region_state", "state_municipality", "state_ddd")
    r = validate.rules(d)
    rate = lambda rel, s: f"(SELECT count(*) AS n, {', '.join(f'avg(CASE WHEN ok_{n} THEN 1e0 ELSE 0e0 END) AS {s}_{n}' for n in names)} FROM {validate.masks_sql(d, syn(rel), {n: r[n] for n in names})} AS m)"
    largest = lambda rel, s: f"(SELECT max(tvd) AS {s}_tvd FROM ({tvd_sql(d, rel)}) AS t)"
    shown = ", ".join(f"{settled(f'{s}_{n}')} AS {s}_{n}" for s in ("raw", "final") for n in names)
    return f"""SELECT a.n AS total_candidates, {shown}, {settled('greatest(final_structural_global - raw_structural_global, 0e0)')} AS repair_rate, {settled('1e0 - final_structural_global')} AS rejection_rate,
      {settled('raw_tvd')} AS raw_tvd, {settled('final_tvd')} AS final_tvd, {settled('abs(final_tvd - raw_tvd)')} AS distribution_shift
      FROM {rate(raw, 'raw')} AS a CROSS JOIN {rate(final, 'final')} AS b CROSS JOIN {largest(raw, 'raw')} AS c CROSS JOIN {largest(final, 'final')} AS e"""


def occupation_populations(d: Spark, rel: str, occupations: tuple[str, ...]) -> str:
    """Per occupation and population its count and share; ``rel`` has a ``population`` and an ``Ocupacao``."""
    held = f"(SELECT population, {', '.join(f'sum(CASE WHEN Ocupacao = {literal(o)} THEN 1 ELSE 0 END) AS x{i}' for i, o in enumerate(occupations))}, count(*) AS total FROM {rel} AS p GROUP BY population)"
    cells = [f"concat({literal(o + _SEP)}, CAST(x{i} AS VARCHAR(20)))" for i, o in enumerate(occupations)]
    return f"SELECT population, split_part(cell, '{_SEP}', 1) AS occupation, CAST(split_part(cell, '{_SEP}', 2) AS BIGINT) AS n, total, round(CAST(split_part(cell, '{_SEP}', 2) AS DOUBLE) / total, 6) AS frequency FROM (SELECT population, total, {d.explode(cells, 'cell')} FROM {held} AS h) AS c"


def income_stages(d: Spark, rel: str) -> str:
    """Wasserstein distance of the raw and the final incomes to the holdout's, plain and over the holdout's interquartile range (else its deviation); ``rel`` has a ``stage``: holdout, raw or final."""
    count = {s: f"CASE WHEN stage = '{s}' THEN 1 ELSE 0 END" for s in ("holdout", "raw", "final")}
    one = ranked(counted(f"(SELECT 1 AS k, * FROM {rel} AS i)", {"k": "k"}, "Renda", count), ["k"], list(count))
    gap = lambda s: f"sum(abs((holdout_before + holdout) / nullif(holdout_all, 0) - ({s}_before + {s}) / nullif({s}_all, 0)) * coalesce(nx - x, 0))"
    held = ranked(counted(f"(SELECT 1 AS k, * FROM {rel} AS j WHERE stage = 'holdout')", {"k": "k"}, "Renda", {"n": "1"}), ["k"], ["n"])
    scale = f"(SELECT CASE WHEN iqr > 0 THEN iqr WHEN std > 0 THEN std END AS scale FROM (SELECT {quantile('n', 0.75)} - {quantile('n', 0.25)} AS iqr, {stats()['std']} AS std FROM {held} AS h) AS s)"
    return f"SELECT {settled('raw_w')} AS raw_wasserstein, {settled('final_w')} AS final_wasserstein, {settled('raw_w / scale')} AS raw_normalized, {settled('final_w / scale')} AS final_normalized, {settled('scale')} AS scale FROM (SELECT {gap('raw')} AS raw_w, {gap('final')} AS final_w FROM {one} AS o) AS w CROSS JOIN {scale} AS s"


# The limits that class how much a generator depends on what comes after it.
def dependency_class(raw_rate: str, rejection: str, repair: str) -> str:
    """baixa, moderada, alta or crítica, from the largest raw validity and the mean rejection and repair rates."""
    return f"CASE WHEN {rejection} >= 0.20e0 THEN 'crítica' WHEN {raw_rate} < 0.50e0 OR {repair} >= 0.50e0 THEN 'alta' WHEN {raw_rate} < 0.80e0 OR {repair} >= 0.20e0 THEN 'moderada' ELSE 'baixa' END"


def dependency(d: Spark, rel: str) -> str:
    """The class over all runs of a table with raw_rate, rejection_rate, repaired and selected (no run: indeterminada)."""
    one = f"(SELECT count(*) AS n, max(raw_rate) AS raw_rate, avg(rejection_rate) AS rejection, avg(repaired / greatest(CAST(selected AS DOUBLE), 1e0)) AS repair FROM {rel} AS r)"
    return f"SELECT n, {settled('raw_rate')} AS max_raw_rate, {settled('rejection')} AS mean_rejection, {settled('repair')} AS mean_repair, CASE WHEN n = 0 THEN 'indeterminada' ELSE {dependency_class('raw_rate', 'rejection', 'repair')} END AS dependency_class FROM {one} AS o"


def diversity(d: Spark, rel: str, low: int = 10) -> str:
    """Per stage: distinct rows and the rate of repeated ones, occupations of fewer than ``low`` rows, and distinct pairs of education or region with occupation."""
    base = privacy.row_key(d, domain.MODEL_COLUMNS)
    cells = {"row": base, "Ocupacao": "coalesce(Ocupacao, '<NA>')", "education": "concat(coalesce(Escolaridade, '<NA>'), '|', coalesce(Ocupacao, '<NA>'))", "region": "concat(coalesce(Regiao, '<NA>'), '|', coalesce(Ocupacao, '<NA>'))"}
    long = f"(SELECT stage, {d.explode([f'concat({literal(n + _SEP)}, {e})' for n, e in cells.items()], 'cell')} FROM {rel} AS z)"
    counts = f"(SELECT stage, split_part(cell, '{_SEP}', 1) AS name, cell, count(*) AS n FROM {long} AS l GROUP BY stage, cell)"
    one = lambda name, e="1": f"CAST(sum(CASE WHEN name = '{name}' THEN {e} ELSE 0 END) AS BIGINT)"
    return f"SELECT stage, {one('row')} AS distinct_rows, round({one('row', 'n - 1')} / CAST({one('row', 'n')} AS DOUBLE), 6) AS duplicate_rate, {one('Ocupacao', f'CASE WHEN n < {low} THEN 1 ELSE 0 END')} AS low_count_occupations, {one('education')} AS education_pairs, {one('region')} AS region_pairs FROM {counts} AS c GROUP BY stage"


def locale(d: Spark, rel: str) -> str:
    """Per stage: rows whose texts are not in composed form, distinct old spellings, and distinct unexpected values."""
    columns = tuple(domain.CATEGORIES)
    bad = " OR ".join(f"coalesce({c} <> {d.nfc(c)}, FALSE)" for c in columns)
    cells = [f"CASE WHEN {c} IS NULL OR {any_of(c, v)} THEN NULL ELSE concat('{c}{_SEP}', {c}) END" for c, v in domain.CATEGORIES.items()]
    values = f"(SELECT stage, cell, count(*) AS n FROM (SELECT stage, {d.explode(cells, 'cell')} FROM {rel} AS u) AS x WHERE cell IS NOT NULL GROUP BY stage, cell)"
    odd = f"(SELECT stage AS s, count(*) AS n_unexpected, CAST(sum(CASE WHEN {any_of(f'''split_part(cell, '{_SEP}', 2)''', tuple(domain.ALIASES))} THEN 1 ELSE 0 END) AS BIGINT) AS n_legacy FROM {values} AS v GROUP BY stage)"
    return f"SELECT stage, not_composed, not_composed = 0 AS nfc_valid, coalesce(n_legacy, 0) AS n_legacy, coalesce(n_unexpected, 0) AS n_unexpected FROM (SELECT stage, CAST(sum(CASE WHEN is_other THEN 1 ELSE 0 END) AS BIGINT) AS not_composed FROM {d.fixed(f'{rel} AS given', {'is_other': bad})} AS r GROUP BY stage) AS a LEFT JOIN {odd} AS o ON a.stage = o.s"


def coherence(d: Spark, rel: str, k: int = 20) -> str:
    """Per stage and pair of columns: rows that fit, invalid rows of the ``k`` most frequent offending pairs (on which the reported rate rests), and of all.

    ``rel`` has a ``stage``.
    """
    r = validate.rules(d)
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR(60)), 'nan')"
    cells = [f"CASE WHEN {r[rule]} THEN 'ok{_SEP}{name}' ELSE concat('bad{_SEP}{name}{_SEP}', {text(a)}, '|', {text('Ocupacao')}) END" for name, rule, a in (("education", "occupation_education", "Escolaridade"), ("age", "occupation_age", "Idade"))]
    counts = f"(SELECT stage, split_part(cell, '{_SEP}', 2) AS pair, split_part(cell, '{_SEP}', 1) AS kind, cell, count(*) AS n FROM (SELECT stage, {d.explode(cells, 'cell')} FROM {rel} AS z) AS l GROUP BY stage, cell)"
    placed = f"(SELECT *, row_number() OVER (PARTITION BY stage, pair, kind ORDER BY n DESC, cell) AS place FROM {counts} AS c)"
    return f"""SELECT stage, pair, total, top_invalid, all_invalid, round((total - top_invalid) / CAST(total AS DOUBLE), 6) AS valid_rate FROM (SELECT stage, pair, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN kind = 'bad' AND place <= {k} THEN n ELSE 0 END) AS BIGINT) AS top_invalid, CAST(sum(CASE WHEN kind = 'bad' THEN n ELSE 0 END) AS BIGINT) AS all_invalid
      FROM {placed} AS p GROUP BY stage, pair) AS t"""


def rare_occupations(d: Spark, rel: str, share: float = 0.01) -> str:
    """Occupations below ``share`` in the holdout: counts and shares in holdout, raw and final rows, and whether they come again."""
    stages = ("holdout", "raw", "final")
    counts = f"(SELECT Ocupacao, {', '.join(f'''CAST(sum(CASE WHEN stage = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s}''' for s in stages)} FROM {rel} AS r WHERE {any_of('Ocupacao', tuple(domain.OCCUPATIONS))} GROUP BY Ocupacao)"
    totals = f"(SELECT {', '.join(f'sum(n_{s}) AS t_{s}' for s in stages)} FROM {counts} AS e)"
    return f"SELECT Ocupacao, {', '.join(f'n_{s}, round(n_{s} / greatest(CAST(t_{s} AS DOUBLE), 1e0), 6) AS share_{s}' for s in stages)}, n_raw > 0 AS reproduced_raw, n_final > 0 AS reproduced_final FROM {counts} AS c CROSS JOIN {totals} AS t WHERE n_holdout > 0 AND n_holdout / CAST(t_holdout AS DOUBLE) < {share!r}e0"


def vocabulary_gates(d: Spark, rel: str, requested: str) -> str:
    """The seven blocking checks of final profiles (value: what failed, or the rows) and the three diagnostic ones (passed is null); ``requested``: a query of the rows asked for."""
    r = validate.rules(d)
    legacy = " OR ".join(f"coalesce({any_of(c, tuple(domain.ALIASES))}, FALSE)" for c in domain.CATEGORIES)
    known = " AND ".join(f"coalesce({any_of(c, v)}, TRUE)" for c, v in domain.CATEGORIES.items())
    composed = " AND ".join(f"coalesce({c} = {d.nfc(c)}, TRUE)" for c in (*domain.CATEGORIES, "Nome"))
    checks = {"final_categories_canonical": known, "final_structural_compatibility": f"{r['occupation_education']} AND {r['occupation_age']}", "no_legacy_categories_final": f"NOT ({legacy})", "income_within_limits_final": r["income_domain"], "unicode_nfc_final": "is_composed"}
    sums = ", ".join(f"CAST(coalesce(sum(CASE WHEN {p} THEN 0 ELSE 1 END), 0) AS DOUBLE) AS {n}" for n, p in checks.items())
    valid = f"(SELECT max(CASE WHEN reason = 'invalid_rows' THEN n END) AS bad FROM ({validate.validation_report(d, rel)}) AS v)"
    one = f"(SELECT n, {', '.join(checks)}, CAST(bad AS DOUBLE) AS schema_final_valid, CAST(asked AS DOUBLE) AS asked, coverage, entropy, top_share FROM (SELECT CAST(count(*) AS DOUBLE) AS n, {sums} FROM {d.fixed(f'{rel} AS given', {'is_composed': composed})} AS r) AS a CROSS JOIN {valid} AS b CROSS JOIN {requested} AS q CROSS JOIN ({profilestats.occupation_entropy(d, rel)}) AS e)"
    shown = {"final_rows_exact": ("n", "n = asked"), "schema_final_valid": ("schema_final_valid", "schema_final_valid = 0"), **{n: (n, f"{n} = 0" + (" AND n > 0" if n.startswith("income") else "")) for n in checks}}
    cells = [f"concat('{n}:', CAST({v} AS VARCHAR(40)), ':', CASE WHEN {p} THEN '1' ELSE '0' END)" for n, (v, p) in shown.items()]
    cells += [f"concat('{n}:', CAST({v} AS VARCHAR(40)), ':')" for n, v in (("occupation_final_coverage", "coverage"), ("occupation_entropy_final", "entropy"), ("occupation_top_share_final", "top_share"))]
    return f"SELECT split_part(cell, ':', 1) AS gate, CAST(split_part(cell, ':', 2) AS DOUBLE) AS value, CASE WHEN split_part(cell, ':', 3) <> '' THEN split_part(cell, ':', 3) = '1' END AS passed FROM (SELECT {d.explode(cells, 'cell')} FROM {one} AS o) AS c"
