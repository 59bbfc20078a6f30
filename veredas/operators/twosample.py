"""Two-sample statistics of a relation with a ``side`` column ('ref' or 'syn').

Every operator takes a dialect and a relation and returns SQL for a tidy table. One pass with a
side flag replaces the outer join of two grouped results; distributions are first
aggregated to distinct values, so that windows run over values per group and not over rows.
"""

from __future__ import annotations

from veredas.functions.dialect import Spark
from veredas.functions.dialect import literal as literal_text

from .ranks import counted, finite, group_quantiles, quantile, ranked, settled, stats

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
_SIDES = {"r": "CASE WHEN side = 'ref' THEN 1 ELSE 0 END", "s": "CASE WHEN side = 'syn' THEN 1 ELSE 0 END"}


def moments(d: Spark, rel: str, x: str) -> str:
    """Count, mean, median (q50), standard deviation, extremes and quantiles of both sides."""
    r = ranked(counted(rel, {"side": "side"}, x, {"n": "1"}), ["side"], ["n"])
    t = stats()
    cells = [f"{t['n']} AS n", f"{settled(t['mean'])} AS mean", f"{settled(t['std'])} AS std", f"{t['lo']} AS lo", f"{t['hi']} AS hi"]
    return f"SELECT side, {', '.join(cells)}, {', '.join(f'round({quantile("n", q)}, 6) AS q{int(100 * q):02d}' for q in QUANTILES)} FROM {r} AS r GROUP BY side"


def mean_difference(d: Spark, rel: str, x: str) -> str:
    """Absolute and relative difference of the means, and differences of medians and deviations; relative is null for a mean of 0."""
    one = lambda c, s: f"max(CASE WHEN side = '{s}' THEN {c} END)"
    return f"""SELECT round(abs(ms - mr), 6) AS mean_abs_diff, round(CASE WHEN mr <> 0 THEN abs(ms - mr) / abs(mr) END, 6) AS mean_rel_diff, round(abs(ds - dr), 6) AS median_diff, round(abs(ss - sr), 4) AS std_diff
      FROM (SELECT {one('mean', 'ref')} AS mr, {one('mean', 'syn')} AS ms, {one('q50', 'ref')} AS dr, {one('q50', 'syn')} AS ds, {one('std', 'ref')} AS sr, {one('std', 'syn')} AS ss FROM ({moments(d, rel, x)}) AS t) AS m"""


def distances_sql(d: Spark, rel: str, group: str, x: str) -> str:
    """grp, n_ref, n_syn, wasserstein and ks, unrounded; groups without a side have nulls."""
    r = ranked(counted(rel, {"grp": group}, x, _SIDES), ["grp"], ["r", "s"])
    gap = "abs((r_before + r) / nullif(r_all, 0) - (s_before + s) / nullif(s_all, 0))"
    return f"(SELECT grp, max(r_all) AS n_ref, max(s_all) AS n_syn, sum({gap} * coalesce(nx - x, 0)) AS wasserstein, max({gap}) AS ks FROM {r} AS w GROUP BY grp)"


def ks_p_value(ks: str, n_ref: str, n_syn: str) -> str:
    """The asymptotic two-sided p-value: Kolmogorov's series, 20 terms (1 where the argument is so small that the series has not set in)."""
    z = f"({ks} * sqrt({n_ref} * {n_syn} / ({n_ref} + {n_syn})))"
    terms = " + ".join(f"({'-' if k % 2 == 0 else ''}2e0) * exp(-{2 * k * k}e0 * {z} * {z})" for k in range(1, 21))
    return f"CASE WHEN {z} < 0.2e0 THEN 1e0 ELSE least(1e0, greatest(0e0, {terms})) END"


def distances(d: Spark, rel: str, group: str, x: str) -> str:
    """Wasserstein-1 and Kolmogorov-Smirnov distances per group, also normalised by the reference's interquartile range (else its deviation), and the asymptotic KS p-value."""
    r = ranked(counted(f"(SELECT * FROM {rel} AS f WHERE side = 'ref')", {"grp": group}, x, {"n": "1"}), ["grp"], ["n"])
    scale = f"(SELECT grp, {quantile('n', 0.75)} - {quantile('n', 0.25)} AS iqr, {stats()['std']} AS std FROM {r} AS r GROUP BY grp)"
    return f"""SELECT w.grp, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_syn AS BIGINT) AS n_syn, round(wasserstein, 6) AS wasserstein, round(ks, 6) AS ks,
      round(wasserstein / CASE WHEN iqr > 0 THEN iqr WHEN std > 0 THEN std END, 6) AS normalized, round({ks_p_value('ks', 'n_ref', 'n_syn')}, 6) AS ks_pvalue
      FROM {distances_sql(d, rel, group, x)} AS w LEFT JOIN {scale} AS s ON w.grp IS NOT DISTINCT FROM s.grp"""


def shares_sql(rel: str, column: str) -> str:
    """cat, p, q: shares of a category on both sides; null is a category of its own."""
    c = f"coalesce(CAST({column} AS VARCHAR(200)), '<NA>')"
    both = f"(SELECT {c} AS cat, CAST(sum({_SIDES['r']}) AS DOUBLE) AS r, CAST(sum({_SIDES['s']}) AS DOUBLE) AS s FROM {rel} AS z GROUP BY {c})"
    return f"(SELECT cat, r / nullif(r_all, 0) AS p, s / nullif(s_all, 0) AS q FROM {both} AS c CROSS JOIN (SELECT sum(r) AS r_all, sum(s) AS s_all FROM {both} AS e) AS t)"


def category_shares(d: Spark, rel: str, column: str) -> str:
    return f"SELECT cat, round(coalesce(p, 0), 6) AS ref_share, round(coalesce(q, 0), 6) AS syn_share, round(coalesce(q, 0) - coalesce(p, 0), 6) AS difference FROM {shares_sql(rel, column)} AS s"


def tvd(d: Spark, rel: str, column: str) -> str:
    """Total variation distance, coverage, and the categories that one side lacks."""
    return f"""SELECT round(0.5e0 * sum(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS tvd, CAST(sum(CASE WHEN p > 0 AND coalesce(q, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
      CAST(sum(CASE WHEN q > 0 AND coalesce(p, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_unexpected, round(sum(CASE WHEN p > 0 AND q > 0 THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN p > 0 THEN 1e0 END), 6) AS coverage FROM {shares_sql(rel, column)} AS s"""


def _correlations(d: Spark, rel: str, pairs: list[tuple[str, str, str, str]]) -> str:
    """Per pair (two names, two expressions) the correlations of both sides (null: 0) and their difference, from one aggregation, which is then dealt out to a row a pair."""
    cor = lambda a, b, s: f"coalesce(corr(CASE WHEN side = '{s}' AND {b} IS NOT NULL THEN {a} END, CASE WHEN side = '{s}' AND {a} IS NOT NULL THEN {b} END), 0e0)"
    sums = ", ".join(f"{cor(a, b, 'ref')} AS r{i}, {cor(a, b, 'syn')} AS s{i}" for i, (_, _, a, b) in enumerate(pairs))
    names = d.values([(i, a, b) for i, (a, b, _, _) in enumerate(pairs)], "i, a, b")
    of = lambda c: f"CASE p.i {' '.join(f'WHEN {i} THEN {c}{i}' for i in range(len(pairs)))} END"
    return f"SELECT a, b, round(r, 6) AS ref, round(s, 6) AS syn, round(abs(r - s), 6) AS difference FROM (SELECT p.a, p.b, {of('r')} AS r, {of('s')} AS s FROM (SELECT {sums} FROM {rel}) AS t CROSS JOIN {names} AS p) AS c"


def _number(column: str) -> str:
    return f"CASE WHEN {finite(f'CAST({column} AS DOUBLE)')} THEN CAST({column} AS DOUBLE) END"


def pearson_difference(d: Spark, rel: str, columns: tuple[str, ...]) -> str:
    """Per pair of columns the correlations of both sides over the rows that have both values; one pass over the rows."""
    pairs = [(a, b, _number(a), _number(b)) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return _correlations(d, f"{rel} AS given", pairs)


def _ranks_by_column(d: Spark, rel: str, group: str, columns: tuple[str, ...], ordered: list[tuple[int, int]]) -> str:
    """:func:`ranked_sql` with a table of ranks for each column: its values are counted once for all of its pairs, and a row meets them only.

    So few values can be broadcast. Ranks travel as plain columns and become lists after the last join; the value comes first in the
    joins, since a group tells few rows apart when they are sorted.
    """
    number = [f"CAST({c} AS DOUBLE)" for c in columns]
    joins = []
    for i, c in enumerate(columns):
        others = [j for j in range(len(columns)) if j != i]
        both = {f"n{j}": f"CASE WHEN {finite(number[j])} THEN 1 ELSE 0 END" for j in others}
        r = ranked(counted(rel, {"g": group}, c, both), ["g"], both, known=True)
        ranks = ", ".join(f"CASE WHEN n{j} > 0 THEN n{j}_before + (n{j} + 1) / 2e0 END AS rank_{i}_{j}" for j in others)
        joins.append(f"LEFT JOIN (SELECT g, x, {ranks} FROM {r} AS q{i}) AS r{i} ON CAST(base.{c} AS DOUBLE) = r{i}.x AND base.{group} = r{i}.g")
    lists = ", ".join(f"{d.listed([f'rank_{i}_{j}' if i == k else 'NULL' for i, j in ordered])} AS ranks_{k}" for k in range(len(columns)))
    return f"(SELECT base.*, {lists} FROM {rel} AS base {' '.join(joins)})"


def ranked_sql(d: Spark, rel: str, group: str, columns: tuple[str, ...]) -> str:
    """Average ranks within a group, for every ordered pair of columns among the rows that have both values.

    ``ranks_<i>`` is a list: the row's rank in column i for each ordered pair, empty where i is not the pair's first. DuckDB counts and ranks the
    values of all pairs together, from one pass over the rows; the ranks of a value are one row of a table that is joined once a column.
    """
    n = len(columns)
    ordered = [(i, j) for i in range(n) for j in range(n) if i != j]
    if d.staged:
        return _ranks_by_column(d, rel, group, columns, ordered)
    value = " ".join(f"WHEN {k} THEN CASE WHEN {finite(f'CAST({columns[j]} AS DOUBLE)')} THEN CAST({columns[i]} AS DOUBLE) END" for k, (i, j) in enumerate(ordered))
    long = f"(SELECT {group} AS g, k, CASE k {value} END AS x FROM (SELECT *, {d.explode(list(map(str, range(len(ordered)))), 'k')} FROM {rel} AS wide) AS e)"
    # The next value adds nothing; naming it keeps both uses of the counted values alike, so that they are counted once.
    ranks = f"(SELECT g, k, x, n_before + (n + 1) / 2e0 + 0e0 * coalesce(nx, 0e0) AS rk FROM {ranked(counted(long, {'g': 'g', 'k': 'k'}, 'x', {'n': '1'}), ['g', 'k'], ['n'])} AS q)"
    listed = d.listed([f"max(CASE WHEN k = {k} THEN rk END)" for k in range(len(ordered))])
    table = f"(SELECT g, x, {listed} AS rks FROM {ranks} AS z GROUP BY g, x)"
    joins = " ".join(f"LEFT JOIN {table} AS r{i} ON base.{group} = r{i}.g AND CAST(base.{c} AS DOUBLE) = r{i}.x" for i, c in enumerate(columns))
    return f"(SELECT base.*, {', '.join(f'r{i}.rks AS ranks_{i}' for i in range(n))} FROM {rel} AS base {joins})"


def spearman_difference(d: Spark, rel: str, columns: tuple[str, ...]) -> str:
    """Per pair of columns the rank correlations of both sides over the rows that have both values."""
    n = len(columns)
    place = {pair: k + 1 for k, pair in enumerate((i, j) for i in range(n) for j in range(n) if i != j)}
    pairs = [(f"{columns[i]}", f"{columns[j]}", f"ranks_{i}[{d.index(place[i, j])}]", f"ranks_{j}[{d.index(place[j, i])}]") for i in range(n) for j in range(i + 1, n)]
    return _correlations(d, f"{ranked_sql(d, rel, 'side', columns)} AS ranked", pairs)


def correlation_summary(d: Spark, rel: str, columns: tuple[str, ...]) -> str:
    """Largest and mean difference over the whole matrix (its zero diagonal counts), of both methods."""
    n = len(columns)
    one = lambda name, sql: f"SELECT '{name}' AS method, round(max(difference), 6) AS largest, round(2 * sum(difference) / {n * n}, 6) AS mean FROM ({sql}) AS t"
    return one("pearson", pearson_difference(d, rel, columns)) + " UNION ALL " + one("spearman", spearman_difference(d, rel, columns))


def crosstab(d: Spark, rel: str, a: str, b: str) -> str:
    """Total variation and largest cell difference of a pair of columns; rows with a null are left out."""
    cells = f"(SELECT {a} AS a, {b} AS b, CAST(sum({_SIDES['r']}) AS DOUBLE) AS r, CAST(sum({_SIDES['s']}) AS DOUBLE) AS s FROM {rel} AS z WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b})"
    return f"""SELECT round(0.5e0 * sum(abs(p - q)), 6) AS tvd, round(max(abs(p - q)), 6) AS largest_cell, count(*) AS n_cells FROM (
      SELECT r / r_all AS p, s / s_all AS q FROM {cells} AS c CROSS JOIN (SELECT sum(r) AS r_all, sum(s) AS s_all FROM {cells} AS e) AS t) AS t"""


# The pairs of columns whose joint distribution is compared.
CROSSED = (("Regiao", "Estado"), ("Estado", "Municipio"), ("Estado", "DDD"), ("Escolaridade", "Ocupacao"), ("Idade", "Estado_Civil"))


def crosstabs(d: Spark, rel: str, pairs: tuple[tuple[str, str], ...] = CROSSED) -> str:
    """The comparison of every pair, from one pass over the rows."""
    cells = [f"concat({', '.join([literal_text(f'{a}|{b}'), literal_text(chr(1)), f'CAST({a} AS VARCHAR(60))', literal_text(chr(1)), f'CAST({b} AS VARCHAR(60))'])})" for a, b in pairs]
    long = f"(SELECT side, {d.explode(cells, 'cell')} FROM {rel} AS z)"
    counts = f"(SELECT split_part(cell, {literal_text(chr(1))}, 1) AS pair, cell, CAST(sum({_SIDES['r']}) AS DOUBLE) AS r, CAST(sum({_SIDES['s']}) AS DOUBLE) AS s FROM {long} AS l WHERE cell IS NOT NULL GROUP BY cell)"
    return f"""SELECT c.pair, round(0.5e0 * sum(abs(r / r_all - s / s_all)), 6) AS tvd, round(max(abs(r / r_all - s / s_all)), 6) AS largest_cell, count(*) AS n_cells
      FROM {counts} AS c JOIN (SELECT pair, sum(r) AS r_all, sum(s) AS s_all FROM {counts} AS e GROUP BY pair) AS t ON c.pair = t.pair GROUP BY c.pair"""


def grouped_means(d: Spark, rel: str, group: str, x: str) -> str:
    return f"SELECT {group} AS grp, {settled(f"avg(CASE WHEN side = 'ref' THEN {x} END)")} AS ref_mean, {settled(f"avg(CASE WHEN side = 'syn' THEN {x} END)")} AS syn_mean, {settled(f"abs(avg(CASE WHEN side = 'ref' THEN {x} END) - avg(CASE WHEN side = 'syn' THEN {x} END))")} AS difference FROM {rel} WHERE {group} IS NOT NULL GROUP BY {group}"


def income_band(age: str) -> str:
    """Bands of the conditional-income reports: below 25, 35, 45, 60, then 60 and over."""
    return f"CASE WHEN {age} IS NULL THEN '<NA>' WHEN {age} < 25 THEN '18-24' WHEN {age} < 35 THEN '25-34' WHEN {age} < 45 THEN '35-44' WHEN {age} < 60 THEN '45-59' ELSE '60+' END"


def cut_band(age: str) -> str:
    """Right-closed bands of the grouped means; null outside (17, 85]."""
    return f"CASE WHEN {age} > 17 AND {age} <= 24 THEN '18-24' WHEN {age} > 24 AND {age} <= 34 THEN '25-34' WHEN {age} > 34 AND {age} <= 44 THEN '35-44' WHEN {age} > 44 AND {age} <= 54 THEN '45-54' WHEN {age} > 54 AND {age} <= 64 THEN '55-64' WHEN {age} > 64 AND {age} <= 85 THEN '65+' END"


def overlap(d: Spark, rel: str, x: str, bins: int = 80) -> str:
    """Histogram overlap of both sides over equal bins of the joint range (1 where the range is a point)."""
    b = f"CASE WHEN hi > lo THEN least(CAST(floor(({x} - lo) / ((hi - lo) / {bins}e0)) AS INT), {bins - 1}) ELSE 0 END"
    held = f"(SELECT {b} AS bin, max(lo) AS lo, max(hi) AS hi, CAST(sum({_SIDES['r']}) AS DOUBLE) AS r, CAST(sum({_SIDES['s']}) AS DOUBLE) AS s FROM {rel} AS v CROSS JOIN (SELECT min({x}) AS lo, max({x}) AS hi FROM {rel} AS u) AS e GROUP BY 1)"
    # One row a bin: the window over them is small.
    return f"SELECT round(CASE WHEN max(hi) = max(lo) THEN 1e0 ELSE sum(least(p, q)) END, 6) AS overlap FROM (SELECT lo, hi, r / sum(r) OVER () AS p, s / sum(s) OVER () AS q FROM {held} AS c) AS t"


def quantile_overlap(d: Spark, rel: str, x: str) -> str:
    """Intersection over union of the interquartile ranges."""
    q = group_quantiles(rel, {"side": "side"}, x, {"a": 0.25, "b": 0.75})
    one = lambda c, s: f"max(CASE WHEN side = '{s}' THEN {c} END)"
    return f"SELECT round(greatest(least(rb, sb) - greatest(ra, sa), 0e0) / greatest(greatest(rb, sb) - least(ra, sa), 1e-9), 6) AS iqr_overlap FROM (SELECT {one('a', 'ref')} AS ra, {one('b', 'ref')} AS rb, {one('a', 'syn')} AS sa, {one('b', 'syn')} AS sb FROM {q} AS q) AS t"
