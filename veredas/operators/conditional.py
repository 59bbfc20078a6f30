"""Income conditioned on occupation, education, age band and region."""

from __future__ import annotations

from veredas.functions.dialect import Spark

from .ranks import STEPS, counted, finite, group_quantiles, quantile, ranked, settled, share_above, share_below, stats
from .twosample import income_band

# The groupings of the conditional reports.
GROUPINGS = {
    "ocupacao": ("Ocupacao",),
    "ocupacao_escolaridade": ("Ocupacao", "Escolaridade"),
    "ocupacao_faixa_etaria": ("Ocupacao", "Faixa_Etaria"),
    "ocupacao_regiao": ("Ocupacao", "Regiao"),
    "ocupacao_escolaridade_faixa_etaria": ("Ocupacao", "Escolaridade", "Faixa_Etaria"),
}
KEYS = ("Ocupacao", "Escolaridade", "Faixa_Etaria", "Regiao")
#: The quantiles of the summary.
STATS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
_SIDES = {"r": "CASE WHEN side = 'ref' THEN 1 ELSE 0 END", "s": "CASE WHEN side = 'syn' THEN 1 ELSE 0 END"}


def banded_sql(rel: str) -> str:
    """Rows with a finite income, with their age band."""
    return f"(SELECT *, {income_band('Idade')} AS Faixa_Etaria FROM {rel} AS banded WHERE {finite('CAST(Renda AS DOUBLE)')})"


def _grouping_name() -> str:
    return "CASE " + " ".join(f"WHEN {' AND '.join(f'grouping({k}) = {int(k not in g)}' for k in KEYS)} THEN '{n}'" for n, g in GROUPINGS.items()) + " END"


def _grouped(rel: str, extra: dict[str, str], counts: dict[str, str]) -> str:
    """Ranked incomes of every group of all five groupings, by grouping sets: the rows are read once."""
    lead = "".join(f"{e}, " for e in extra.values())
    sets = ", ".join(f"({lead}{', '.join(g)}, CAST(Renda AS DOUBLE))" for g in GROUPINGS.values())
    keys = {**extra, "grouping_name": _grouping_name(), **{k: k for k in KEYS}}
    return ranked(counted(banded_sql(rel), keys, "Renda", counts, f"GROUPING SETS ({sets})"), keys, counts)


def summary(d: Spark, rel: str, least: int = 30) -> str:
    """Seventeen statistics per side and group of all five groupings with enough rows. Tails are strict."""
    t = stats()
    cells = [f"{t['n']} AS n", f"{settled(t['mean'])} AS mean", f"{settled(t['std'])} AS std", "min(x) AS lo", "max(x) AS hi"]
    cells += [f"{settled(quantile('n', q))} AS {name}" for name, q in STATS.items()]
    cells += [f"round({quantile('n', 0.75)} - {quantile('n', 0.25)}, 6) AS iqr", f"round({quantile('n', 0.95)}, 6) AS upper_threshold", f"round({quantile('n', 0.05)}, 6) AS lower_threshold"]
    cells += [f"{settled(share_above('n', 0.95))} AS upper_rate", f"{settled(share_below('n', 0.05))} AS lower_rate"]
    return f"SELECT side, grouping_name, {', '.join(KEYS)}, {', '.join(cells)} FROM {_grouped(rel, {'side': 'side'}, {'n': '1'})} AS g GROUP BY side, grouping_name, {', '.join(KEYS)} HAVING sum(n) >= {least}"


def tail_rates(d: Spark, rel: str, group: str, least: int = 30) -> str:
    """Shares of a group's rows beyond its own 95th and 5th percentile."""
    r = ranked(counted(rel, {"side": "side", "grp": group}, "Renda", {"n": "1"}), ["side", "grp"], ["n"])
    return f"SELECT side, grp, CAST(sum(n) AS BIGINT) AS n, {settled(share_above('n', 0.95))} AS high_tail, {settled(share_below('n', 0.05))} AS low_tail FROM {r} AS r GROUP BY side, grp HAVING sum(n) >= {least}"


def comparison_sql(d: Spark, rel: str, least: int = 30) -> str:
    """Per group of all five groupings with enough rows on both sides: Wasserstein, quantile differences, and the synthetic excess over the reference's 95th percentile (unrounded)."""
    names = ("grouping_name", *KEYS)
    sets = ", ".join(f"(side, {', '.join(g)}, CAST(Renda AS DOUBLE))" for g in GROUPINGS.values())
    vals = counted(banded_sql(rel), {"side": "side", "grouping_name": _grouping_name(), **{k: k for k in KEYS}}, "Renda", {"n": "1"}, f"GROUPING SETS ({sets})")
    # Counted once: a common table that is read twice is worked out twice.
    kept = d.kept(vals, "counted", wide=False)
    vals = vals if kept == vals else f"(SELECT * FROM {kept} AS kept)"
    cells = ", ".join(f"{quantile('n', q)} AS {name}" for name, q in STATS.items())
    sums = f"(SELECT side, {', '.join(names)}, CAST(sum(n) AS BIGINT) AS n, {cells} FROM {ranked('vals', ['side', *names], ['n'])} AS g GROUP BY side, {', '.join(names)} HAVING sum(n) >= {least})"
    one = lambda c, s: f"max(CASE WHEN side = '{s}' THEN {c} END)"
    cut = f"(SELECT {', '.join(names)}, {', '.join(f'{one(c, s)} AS {s}_{c}' for s in ('ref', 'syn') for c in ('n', 'median', 'p95', 'p99'))} FROM {sums} AS q GROUP BY {', '.join(names)} HAVING count(*) = 2)"
    sided = f"(SELECT {', '.join(names)}, x, sum(CASE WHEN side = 'ref' THEN n ELSE 0e0 END) AS r, sum(CASE WHEN side = 'syn' THEN n ELSE 0e0 END) AS s FROM vals AS v GROUP BY {', '.join(names)}, x)"
    gap = "abs((r_before + r) / nullif(r_all, 0) - (s_before + s) / nullif(s_all, 0))"
    on = " AND ".join(f"w.{k} IS NOT DISTINCT FROM c.{k}" for k in names)
    cols = ", ".join(f"c.{k}" for k in names)
    fixed = ", ".join(f"max(c.{s}_{c}) AS {s}_{c}" for s in ("ref", "syn") for c in ("n", "median", "p95", "p99"))
    return f"(WITH vals AS {vals} SELECT {cols}, {fixed}, sum({gap} * coalesce(nx - x, 0)) AS wasserstein, max({gap}) AS ks, sum(CASE WHEN x > c.ref_p95 THEN s ELSE 0 END) / max(s_all) - 0.05e0 AS excess FROM {ranked(sided, names, ['r', 's'])} AS w JOIN {cut} AS c ON {on} GROUP BY {cols})"


def compare(d: Spark, rel: str, least: int = 30) -> str:
    return f"""SELECT grouping_name, {', '.join(KEYS)}, ref_n, syn_n, {settled('wasserstein')} AS wasserstein, {settled('ks')} AS ks, {settled('syn_median - ref_median')} AS median_diff, {settled('syn_p95 - ref_p95')} AS p95_diff, {settled('syn_p99 - ref_p99')} AS p99_diff, {settled('excess')} AS high_tail_excess
      FROM {comparison_sql(d, rel, least)} AS t"""


def rank_sql(rel: str) -> str:
    """The Spearman correlation of the occupations' median incomes on both sides (null below two common ones), and the share of the reference's occupations that both have."""
    q = group_quantiles(rel, {"side": "side", "Ocupacao": "Ocupacao"}, "Renda", {"m": 0.5})
    med = f"(SELECT Ocupacao, max(CASE WHEN side = 'ref' THEN m END) AS r, max(CASE WHEN side = 'syn' THEN m END) AS s FROM {q} AS q WHERE Ocupacao IS NOT NULL GROUP BY Ocupacao)"
    return _medians_compared(med)


def _medians_compared(med: str) -> str:
    """:func:`rank_sql` of the occupations' medians r and s."""
    # One row an occupation: the windows over them are small.
    rank = lambda x: f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2e0)"
    common = f"(SELECT {rank('r')} AS a, {rank('s')} AS b FROM {med} AS m WHERE r IS NOT NULL AND s IS NOT NULL)"
    return f"(SELECT n_common, n_ref, CASE WHEN n_common > 1 THEN spearman END AS spearman, n_common / CAST(greatest(n_ref, 1) AS DOUBLE) AS coverage FROM (SELECT count(*) AS n_common, corr(a, b) AS spearman FROM {common} AS c) AS c CROSS JOIN (SELECT count(r) AS n_ref FROM {med} AS m) AS n)"


def plausibility(d: Spark, rel: str, least: int = 30, limit: int | None = 500) -> str:
    """The summary of the comparisons of all groups, with the rank correlation and the number of tail events (up to a limit, or of all)."""
    events = above_sql(rel, least) if limit is None else tail_events(d, rel, limit, least)
    return f"""SELECT n_groups, max_wasserstein, mean_wasserstein, max_p95_diff, max_p99_diff, n_excess, round(k.spearman, 6) AS rank_correlation, e.n_events FROM (
      SELECT count(*) AS n_groups, round(max(wasserstein), 4) AS max_wasserstein, round(avg(wasserstein), 4) AS mean_wasserstein, round(max(abs(syn_p95 - ref_p95)), 4) AS max_p95_diff, round(max(abs(syn_p99 - ref_p99)), 4) AS max_p99_diff, CAST(sum(CASE WHEN excess > 0.1e0 THEN 1 ELSE 0 END) AS BIGINT) AS n_excess FROM {comparison_sql(d, rel, least)} AS t) AS t
      CROSS JOIN {rank_sql(rel)} AS k CROSS JOIN (SELECT count(*) AS n_events FROM ({events}) AS t) AS e"""


def staged(d: Spark, rel: str, base: str, stages: tuple[str, ...], least: int = 30) -> str:
    """What :func:`plausibility` gives of each stage against the base, all tail events counted, from one pass over the incomes; ``rel`` has a ``stage`` with these values. For a session only.

    Incomes are counted by cell (all four keys) and value for all stages together. Bins of the cells add up to the bins of every group, so that values are put in order
    once, inside the bins of a group. The synthetic excess and the events, which need the base's quantiles, are summed by cell and add up to those of the groups.
    """
    keys, names = ", ".join(KEYS), {base: "b", **{s: f"s{i}" for i, s in enumerate(stages)}}
    sides, others = tuple(names.values()), tuple(names[s] for s in stages)
    sets = [*GROUPINGS.values(), KEYS]
    rows = banded_sql(rel)
    same = lambda a, b, of=KEYS: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in of)
    # Numbers for cells and groups: they are as many as there are combinations of keys.
    cells = d.kept(f"(SELECT *, monotonically_increasing_id() AS cell FROM (SELECT DISTINCT {keys} FROM {rows} AS r) AS u)", "cells", wide=False)
    masked = lambda g: ", ".join(k if k in g else f"CAST(NULL AS STRING) AS {k}" for k in KEYS)
    groups = d.kept(f"(SELECT *, monotonically_increasing_id() AS grp FROM ({' UNION '.join(f'SELECT {i} AS grouping_no, {masked(g)} FROM {cells} AS c' for i, g in enumerate(sets))}) AS u)", "groups", wide=False)
    member = d.kept("(" + " UNION ALL ".join(f"SELECT c.cell, g.grp, g.grouping_no FROM {cells} AS c JOIN {groups} AS g ON g.grouping_no = {i} AND {same('c', 'g', g)}" for i, g in enumerate(sets)) + ")", "member", wide=False)
    bin_of = f"CAST(floor(log2(abs(x) + 1e0) * {STEPS}e0) AS INT) * CASE WHEN x < 0 THEN -1 ELSE 1 END"
    picked = ", ".join(f"CAST(sum(CASE WHEN stage = '{s}' THEN 1 ELSE 0 END) AS DOUBLE) AS {c}" for s, c in names.items())
    placed = f"(SELECT c.cell, CAST(Renda AS DOUBLE) AS x, stage FROM {rows} AS r JOIN {cells} AS c ON {same('r', 'c')})"
    incomes = d.kept(f"(SELECT *, {bin_of} AS bin FROM (SELECT cell, x, {picked} FROM {placed} AS p GROUP BY cell, x) AS v)", "incomes", wide=False)
    # How many values of each side stand before a group's bin, and the first value of the next one.
    by_cell = d.kept(f"(SELECT cell, bin, min(x) AS x0, {', '.join(f'sum({c}) AS {c}' for c in sides)} FROM {incomes} AS i GROUP BY cell, bin)", "bins", wide=False)
    by_group = f"(SELECT m.grp, m.grouping_no, b.bin, min(b.x0) AS x0, {', '.join(f'sum(b.{c}) AS {c}' for c in sides)} FROM {by_cell} AS b JOIN {member} AS m ON b.cell = m.cell GROUP BY m.grp, m.grouping_no, b.bin)"
    lows = ", ".join(f"sum({c}) OVER (PARTITION BY grp ORDER BY bin ROWS UNBOUNDED PRECEDING) - {c} AS {c}_low, sum({c}) OVER (PARTITION BY grp) AS {c}_all" for c in sides)
    places = d.kept(f"(SELECT grp, grouping_no, bin, {lows}, lead(x0) OVER (PARTITION BY grp ORDER BY bin) AS x1 FROM {by_group} AS b)", "places", wide=False)
    # The cells themselves count as groups for the base's values only.
    lists = f"(SELECT cell, collect_list(named_struct('grp', grp, 'own', grouping_no = {len(GROUPINGS)})) AS groups FROM {member} AS m GROUP BY cell)"
    each = f"(SELECT g.grp, bin, x, {', '.join(sides)} FROM (SELECT i.*, explode(l.groups) AS g FROM {incomes} AS i JOIN {lists} AS l ON i.cell = l.cell) AS e WHERE NOT g.own OR b > 0)"
    inside = "OVER (PARTITION BY grp, bin ORDER BY x"
    running = f"(SELECT *, lead(x) {inside}) AS x2, {', '.join(f'sum({c}) {inside} ROWS UNBOUNDED PRECEDING) AS {c}_sum' for c in sides)} FROM {each} AS e)"
    ordered = f"(SELECT w.grp, w.x, {', '.join(f'w.{c}, p.{c}_low + w.{c}_sum - w.{c} AS {c}_before, p.{c}_all' for c in sides)}, coalesce(w.x2, p.x1) AS nx FROM {running} AS w JOIN {places} AS p ON w.grp = p.grp AND w.bin = p.bin)"
    # Values of other sides stand between those of one: both ends of a quantile are found by their ranks.
    ends = {f"{c}_{q}": (c, p) for c in sides for q, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))}
    rank = lambda c, p: f"{p!r}e0 * ({c}_all - 1)"
    at = lambda c, r: f"max(CASE WHEN {c}_before <= {r} AND {r} < {c}_before + {c} THEN x END)"
    found = ", ".join(f"{at(c, f'floor({rank(c, p)})')} AS {n}_lo, {at(c, f'(floor({rank(c, p)}) + 1)')} AS {n}_hi" for n, (c, p) in ends.items())
    gap = lambda c: f"abs((b_before + b) / nullif(b_all, 0) - ({c}_before + {c}) / nullif({c}_all, 0))"
    totals = f"(SELECT grp, {', '.join(f'max({c}_all) AS {c}_n' for c in sides)}, {', '.join(f'sum({gap(c)} * coalesce(nx - x, 0)) AS {c}_w' for c in others)}, {found} FROM {ordered} AS o GROUP BY grp)"
    value = lambda n, c, p: f"{n}_lo + (coalesce({n}_hi, {n}_lo) - {n}_lo) * ({rank(c, p)} - floor({rank(c, p)}))".replace(f"{c}_all", f"{c}_n")
    summed = d.kept(f"(SELECT g.*, {', '.join(f'{c}_n' for c in sides)}, {', '.join(f'{c}_w' for c in others)}, {', '.join(f'{value(n, c, p)} AS {n}' for n, (c, p) in ends.items())} FROM {totals} AS t JOIN {groups} AS g ON t.grp = g.grp)", "summed", wide=False)
    # Incomes above the base's quantiles of their groups, by cell.
    limits = ", ".join(f"max(CASE WHEN m.grouping_no = {i} THEN s.b_p95 END) AS limit{i}" for i in range(len(GROUPINGS)))
    limited = f"(SELECT m.cell, {limits}, max(CASE WHEN m.grouping_no = {len(GROUPINGS)} AND s.b_n >= {least} THEN s.b_p99 END) AS top FROM {member} AS m JOIN {summed} AS s ON m.grp = s.grp GROUP BY m.cell)"
    above = ", ".join(f"sum(CASE WHEN x > limit{i} THEN {c} ELSE 0 END) AS {c}_{i}" for c in others for i in range(len(GROUPINGS)))
    passed = d.kept(f"(SELECT i.cell, {above}, {', '.join(f'sum(CASE WHEN x > top THEN {c} ELSE 0 END) AS {c}_events' for c in others)} FROM {incomes} AS i JOIN {limited} AS l ON i.cell = l.cell GROUP BY i.cell)", "passed", wide=False)
    each_limit = lambda c: "CASE m.grouping_no " + " ".join(f"WHEN {i} THEN {c}_{i}" for i in range(len(GROUPINGS))) + " END"
    excess = f"(SELECT m.grp, {', '.join(f'sum({each_limit(c)}) AS {c}_above' for c in others)} FROM {member} AS m JOIN {passed} AS p ON m.cell = p.cell GROUP BY m.grp)"
    events = f"(SELECT {', '.join(f'CAST(coalesce(sum({c}_events), 0) AS BIGINT) AS {c}_events' for c in others)} FROM {passed} AS p)"
    parts = []
    for stage, c in ((s, names[s]) for s in stages):
        judged = f"(SELECT s.{c}_w AS wasserstein, s.{c}_p95 - s.b_p95 AS p95, s.{c}_p99 - s.b_p99 AS p99, e.{c}_above / s.{c}_n - 0.05e0 AS excess FROM {summed} AS s JOIN {excess} AS e ON s.grp = e.grp WHERE s.grouping_no < {len(GROUPINGS)} AND s.b_n >= {least} AND s.{c}_n >= {least})"
        of_jobs = f"(SELECT Ocupacao, b_median AS r, {c}_median AS s FROM {summed} AS s WHERE grouping_no = 0 AND Ocupacao IS NOT NULL)"
        parts.append(f"""SELECT '{stage}' AS stage, n_groups, max_wasserstein, mean_wasserstein, max_p95_diff, max_p99_diff, n_excess, round(k.spearman, 6) AS rank_correlation, e.{c}_events AS n_events FROM (
          SELECT count(*) AS n_groups, round(max(wasserstein), 4) AS max_wasserstein, round(avg(wasserstein), 4) AS mean_wasserstein, round(max(abs(p95)), 4) AS max_p95_diff, round(max(abs(p99)), 4) AS max_p99_diff, CAST(sum(CASE WHEN excess > 0.1e0 THEN 1 ELSE 0 END) AS BIGINT) AS n_excess FROM {judged} AS j) AS t
          CROSS JOIN {_medians_compared(of_jobs)} AS k CROSS JOIN {events} AS e""")
    return " UNION ALL ".join(parts)


def above_sql(rel: str, least: int = 30) -> str:
    """Synthetic rows above the reference's 99th percentile of their occupation, education, age band and region, for groups of ``least`` reference rows."""
    known = f"(SELECT * FROM {banded_sql(rel)} AS b WHERE side = 'ref')"
    cut = f"(SELECT {', '.join(f'{k} AS k{i}' for i, k in enumerate(KEYS))}, p99 FROM {group_quantiles(known, {k: k for k in KEYS}, 'Renda', {'p99': 0.99})} AS q WHERE n >= {least})"
    on = " AND ".join(f"{k} IS NOT DISTINCT FROM k{i}" for i, k in enumerate(KEYS))
    return f"SELECT row_id, {', '.join(KEYS)}, Renda, round(p99, 4) AS p99 FROM {banded_sql(rel)} AS r JOIN {cut} AS c ON {on} WHERE side = 'syn' AND Renda > p99"


def tail_events(d: Spark, rel: str, limit: int = 500, least: int = 30) -> str:
    """The rows of :func:`above_sql`: a report of at most ``limit`` rows, groups in order."""
    return f"{above_sql(rel, least)} ORDER BY {', '.join(f'{k} NULLS LAST' for k in KEYS)}, row_id LIMIT {limit}"


def rank_correlation(d: Spark, rel: str) -> str:
    return f"SELECT n_common, round(coverage, 6) AS coverage, round(spearman, 6) AS spearman FROM {rank_sql(rel)} AS r"


# Occupations whose incomes are compared in pairs.
PAIRS = (("Médico", "Atendente"), ("Engenheiro", "Serviços Gerais"), ("Gerente", "Auxiliar Administrativo"), ("Analista de Dados", "Operador de Caixa"))


def income_by_occupation(d: Spark, rel: str, enough: int = 20) -> str:
    """Per occupation; this report's deviation is of the population."""
    r = ranked(counted(rel, {"Ocupacao": "Ocupacao"}, "Renda", {"n": "1"}), ["Ocupacao"], ["n"])
    std = "sqrt(greatest(sum(x * x * n) / sum(n) - (sum(x * n) / sum(n)) * (sum(x * n) / sum(n)), 0e0))"
    return f"SELECT Ocupacao, CAST(sum(n) AS BIGINT) AS n, {settled('sum(x * n) / sum(n)')} AS mean, {settled(quantile('n', 0.5))} AS median, {settled(std, 5)} AS std, min(x) AS lo, max(x) AS hi, sum(n) >= {enough} AS sufficient FROM {r} AS r GROUP BY Ocupacao"


def income_pairs(d: Spark, rel: str) -> str:
    """Difference of the means of fixed pairs of occupations, and whether their ranges overlap."""
    g = f"(SELECT Ocupacao, avg(Renda) AS mean, min(Renda) AS lo, max(Renda) AS hi FROM {rel} AS r WHERE Renda IS NOT NULL GROUP BY Ocupacao)"
    return f"SELECT p.a, p.b, {settled('x.mean - y.mean', 5)} AS mean_difference, x.lo <= y.hi AND y.lo <= x.hi AS overlap FROM {d.values(list(PAIRS), 'a, b')} AS p LEFT JOIN {g} AS x ON p.a = x.Ocupacao LEFT JOIN {g} AS y ON p.b = y.Ocupacao"


def versions_sql(d: Spark, parts: dict[str, str]) -> str:
    """version, Ocupacao, Renda and a seed of some relations with an income each."""
    return "(" + " UNION ALL ".join(f"SELECT '{v}' AS version, Ocupacao, Renda FROM {rel} AS v{i}" for i, (v, rel) in enumerate(parts.items())) + ")"


def _valued(rel: str) -> str:
    return counted(rel, {"version": "version", "Ocupacao": "Ocupacao"}, "Renda", {"n": "1"})


def _versions_from(vals: str) -> str:
    """Per income version and occupation of counted incomes: count, moments, quantiles, variation, and the share above the 95th percentile of all versions of the occupation (unrounded)."""
    keys = ["version", "Ocupacao"]
    qs = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    base = f"(SELECT version, Ocupacao, {', '.join(f'{e} AS {c}' for c, e in stats().items())}, {', '.join(f'{quantile("n", q)} AS {c}' for c, q in qs.items())} FROM {ranked(vals, keys, ['n'])} AS r GROUP BY version, Ocupacao)"
    pooled = f"(SELECT Ocupacao, x, sum(n) AS n FROM {vals} AS v GROUP BY Ocupacao, x)"
    top = f"(SELECT Ocupacao, {quantile('n', 0.95)} AS cut FROM {ranked(pooled, ['Ocupacao'], ['n'])} AS r GROUP BY Ocupacao)"
    tail = f"(SELECT v.version, v.Ocupacao, sum(CASE WHEN x > cut THEN n ELSE 0 END) / sum(n) AS high_tail FROM {vals} AS v JOIN {top} AS t ON v.Ocupacao = t.Ocupacao GROUP BY v.version, v.Ocupacao)"
    return f"(SELECT b.*, p75 - p25 AS iqr, CASE WHEN mean = 0 THEN 0e0 ELSE std / abs(mean) END AS cv, high_tail FROM {base} AS b JOIN {tail} AS t ON b.version = t.version AND b.Ocupacao = t.Ocupacao)"


def _with_versions(d: Spark, rel: str) -> str:
    """The common tables ``vals`` (counted incomes) and ``s`` (their summary), each made once."""
    if d.session is not None:
        vals = d.kept(_valued(rel), "incomes", wide=False)
        s = d.kept(_versions_from(vals), "summaries", wide=False)
        return f"WITH vals AS (SELECT * FROM {vals} AS v), s AS (SELECT * FROM {s} AS s)"
    return f"WITH vals AS {_valued(rel)}, s AS {_versions_from('vals')}"


def version_summary(d: Spark, rel: str) -> str:
    cells = ", ".join(f"{settled(c)} AS {c}" for c in ("mean", "std", "p25", "p50", "p75", "p90", "p95", "p99", "lo", "hi", "iqr", "cv", "high_tail"))
    return f"{_with_versions(d, rel)} SELECT version, Ocupacao, n, {cells} FROM s"


# What is compared between versions, the least base of a ratio, and the targets of the candidates' score.
COMPRESSED = ("p50", "p95", "p99", "std", "iqr", "high_tail")


def _compressed(base: str) -> str:
    """Relative change of every later version's statistics against ``base``, per occupation (null where that is about 0)."""
    based = lambda c: f"max(CASE WHEN version = '{base}' THEN {c} END) OVER (PARTITION BY Ocupacao)"
    change = ", ".join(f"CASE WHEN abs(b_{c}) >= 1e-9 THEN ({c} - b_{c}) / b_{c} END AS {c}_change" for c in COMPRESSED)
    # One row a version and occupation: the windows are small.
    return f"(SELECT version, '{base}' AS baseline, Ocupacao, high_tail, {change} FROM (SELECT *, {', '.join(f'{based(c)} AS b_{c}' for c in COMPRESSED)} FROM s) AS w WHERE version > '{base}')"


def compression(d: Spark, rel: str, bases: tuple[str, ...] = ("v1", "v2")) -> str:
    """Against version 1, and against version 2 for those after it."""
    cells = ", ".join(f"{settled(f'{c}_change')} AS {c}_change" for c in COMPRESSED)
    return f"{_with_versions(d, rel)} " + " UNION ALL ".join(f"SELECT version, baseline, Ocupacao, {cells} FROM {_compressed(b)} AS c" for b in bases)


def overlap_sql(base: str, bins: int = 80) -> str:
    """Per version and occupation of ``vals`` the histogram overlap with ``base`` over equal bins of the joint range."""
    edges = "(SELECT version, Ocupacao, min(x) AS a, max(x) AS b FROM vals AS e GROUP BY version, Ocupacao)"
    pairs = f"(SELECT c.version, c.Ocupacao, least(c.a, o.a) AS lo, greatest(c.b, o.b) AS hi FROM {edges} AS c JOIN {edges} AS o ON c.Ocupacao = o.Ocupacao AND o.version = '{base}' WHERE c.version <> '{base}')"
    cell = f"CASE WHEN hi > lo THEN least(CAST(floor((x - lo) / ((hi - lo) / {bins}e0)) AS INT), {bins - 1}) ELSE 0 END"
    held = f"(SELECT p.version, p.Ocupacao, {cell} AS bin, sum(CASE WHEN v.version = p.version THEN n ELSE 0e0 END) AS r, sum(CASE WHEN v.version = p.version THEN 0e0 ELSE n END) AS s FROM vals AS v JOIN {pairs} AS p ON v.Ocupacao = p.Ocupacao AND (v.version = p.version OR v.version = '{base}') GROUP BY 1, 2, 3)"
    return f"(SELECT version, Ocupacao, sum(least(p, q)) AS overlap FROM (SELECT version, Ocupacao, r / sum(r) OVER (PARTITION BY version, Ocupacao) AS p, s / sum(s) OVER (PARTITION BY version, Ocupacao) AS q FROM {held} AS h) AS t GROUP BY version, Ocupacao)"


def candidate_scores(d: Spark, rel: str, candidates: tuple[str, ...] = ("v3_candidate_a", "v3_selected")) -> str:
    """The score of every candidate version, and which of them is the best."""
    named = f"version IN ({', '.join(f'{chr(39)}{c}{chr(39)}' for c in candidates)})"
    shrink = f"(SELECT version, avg(abs(coalesce(p95_change, 0e0))) AS p95, avg(abs(coalesce(p99_change, 0e0))) AS p99, avg(high_tail) AS tail FROM {_compressed('v1')} AS c WHERE {named} GROUP BY version)"
    same = f"(SELECT version, avg(overlap) AS overlap FROM {overlap_sql('v2')} AS o WHERE {named} GROUP BY version)"
    score = "(1e0 - abs(p95 - 0.28e0)) + (1e0 - abs(p99 - 0.30e0)) + overlap - abs(tail - 0.04e0)"
    return f"""{_with_versions(d, rel)}, scores AS (SELECT s.version, {score} AS score, tail, overlap FROM {shrink} AS s JOIN {same} AS o ON s.version = o.version)
      SELECT s.version, {settled('score')} AS score, {settled('tail')} AS mean_high_tail, {settled('overlap')} AS mean_overlap_v2, score = best AS is_selected FROM scores AS s CROSS JOIN (SELECT max(score) AS best FROM scores AS m) AS m"""


def rank_inversions(d: Spark, rel: str, base: str = "v1") -> str:
    """Per version: pairs of occupations whose medians it orders unlike version 1, the rank correlation, and the ratio of the mean deviations; over one row an occupation."""
    return f"""{_with_versions(d, rel)}, med AS (SELECT version, Ocupacao, std, row_number() OVER (PARTITION BY version ORDER BY p50, Ocupacao) AS rk FROM s),
      both_ranks AS (SELECT c.version, c.Ocupacao, b.rk AS expected, c.rk AS current_rank, c.std, b.std AS base_std FROM med AS c JOIN med AS b ON c.Ocupacao = b.Ocupacao AND b.version = '{base}'),
      inv AS (SELECT p.version, count(*) AS n FROM both_ranks AS p JOIN both_ranks AS q ON p.version = q.version AND p.expected < q.expected AND p.current_rank > q.current_rank GROUP BY p.version)
      SELECT b.version, {settled('CASE WHEN count(*) > 1 THEN corr(b.expected, b.current_rank) END')} AS spearman, max(coalesce(i.n, 0)) AS inversions, {settled('avg(b.std) / greatest(avg(b.base_std), 1e-9)')} AS dispersion_ratio FROM both_ranks AS b LEFT JOIN inv AS i ON b.version = i.version GROUP BY b.version"""
