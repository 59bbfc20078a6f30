"""Duplicates, exact matches, coverage and nearest neighbours between a reference and a synthetic side."""

from __future__ import annotations

from veredas.functions import domain
from veredas.functions.canonical import row_key
from veredas.functions.dialect import Spark, literal

from .ranks import settled

# The column sets of the partial matches.
PARTIAL = {
    "demografia_localizacao": ("Genero", "Idade", "Regiao", "Estado", "Municipio"),
    "perfil_socioeconomico": ("Escolaridade", "Ocupacao", "Renda", "Dependentes"),
    "quase_identificadores_categoricos": ("Genero", "Regiao", "Estado", "Municipio", "Escolaridade", "Estado_Civil", "Ocupacao", "DDD"),
}


def duplicate_rows(d: Spark, rel: str, key: str) -> str:
    """Totals of a two-level aggregation: rows per key, then keys."""
    return f"""SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS unique_rows, CAST(sum(n - 1) AS BIGINT) AS duplicated_occurrences, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicated_groups,
      CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_in_groups, max(n) AS largest, round(sum(n - 1) / CAST(sum(n) AS DOUBLE), 6) AS duplicate_rate FROM (SELECT {key} AS k, count(*) AS n FROM {rel} GROUP BY {key}) AS g"""


def duplicate_histogram(d: Spark, rel: str, key: str) -> str:
    return f"SELECT n AS size, count(*) AS n_groups FROM (SELECT {key} AS k, count(*) AS n FROM {rel} GROUP BY {key}) AS g WHERE n > 1 GROUP BY n"


def exact_matches(d: Spark, rel: str, key: str) -> str:
    """Synthetic rows whose canonical row is in the reference, and the distinct rows concerned: one aggregation by key, no join."""
    return _both(f"(SELECT {key} AS k, sum(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN side = 'syn' THEN 1 ELSE 0 END) AS s FROM {rel} AS m GROUP BY {key}) AS g")


def matched_hashes(d: Spark, rel: str, key: str, k: int = 100) -> str:
    """The first ``k`` hashes, in order, of rows that both sides have."""
    return f"SELECT row_hash FROM (SELECT {key} AS row_hash, sum(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN side = 'syn' THEN 1 ELSE 0 END) AS s FROM {rel} AS m GROUP BY {key}) AS g WHERE r > 0 AND s > 0 ORDER BY row_hash LIMIT {k}"


def largest_groups(d: Spark, rel: str, key: str, k: int = 20) -> str:
    """The ``k`` largest groups of equal rows (ties: the smaller hash), a line for each of their rows: nothing is collected."""
    top = f"(SELECT {key} AS row_hash, count(*) AS occurrences FROM {rel} AS t GROUP BY {key} HAVING count(*) > 1 ORDER BY occurrences DESC, row_hash LIMIT {k})"
    return f"SELECT t.row_hash, t.occurrences, r.row_id FROM (SELECT row_id, {key} AS h FROM {rel} AS u) AS r JOIN {top} AS t ON r.h = t.row_hash"


def _both(keys: str, extra: str = "") -> str:
    """Counts of matches from one row a key with its rows on either side."""
    return f"""SELECT {extra}CAST(coalesce(sum(CASE WHEN r > 0 THEN s END), 0) AS BIGINT) AS matches, round(coalesce(sum(CASE WHEN r > 0 THEN s END), 0) / nullif(CAST(sum(s) AS DOUBLE), 0), 6) AS match_rate,
      CAST(sum(CASE WHEN r > 0 AND s > 0 THEN 1 ELSE 0 END) AS BIGINT) AS distinct_matched, CAST(sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS BIGINT) AS distinct_syn, CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS distinct_ref FROM {keys}"""


def _sided_cells(d: Spark, rel: str, cells: dict[str, str]) -> str:
    """name, value and the rows of both sides of every distinct named value; one pass over the rows."""
    long = f"(SELECT side, {d.explode([f'concat({literal(n + chr(1))}, {e})' for n, e in cells.items()], 'cell')} FROM {rel} AS z)"
    return f"(SELECT split_part(cell, '{chr(1)}', 1) AS name, cell, sum(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN side = 'syn' THEN 1 ELSE 0 END) AS s FROM {long} AS l GROUP BY cell)"


def partial_matches(d: Spark, rel: str, sets: dict[str, tuple[str, ...]] = PARTIAL) -> str:
    """Matches of every column set."""
    return _both(f"{_sided_cells(d, rel, {n: row_key(d, c) for n, c in sets.items()})} AS g GROUP BY name", "name AS column_set, ")


def coverage(d: Spark, rel: str, columns: tuple[str, ...]) -> str:
    """Share of the reference's categories that the synthetic side has, per column."""
    cells = {c: f"coalesce(CAST({c} AS VARCHAR(200)), '<NA>')" for c in columns}
    return f"SELECT name AS column_name, CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_ref, round(sum(CASE WHEN r > 0 AND s > 0 THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN r > 0 THEN 1e0 END), 6) AS coverage FROM {_sided_cells(d, rel, cells)} AS g GROUP BY name"


def report(d: Spark, rel: str) -> str:
    """Duplicates, matches, least coverage and the flags of a collapsed generator, of the synthetic side against the reference: one row.

    Fixed value: below a unique rate of 0.8 the generator is flagged.
    """
    key = row_key(d, domain.MODEL_COLUMNS)
    syn = f"(SELECT * FROM {rel} AS a WHERE side = 'syn')"
    categories = (*domain.CATEGORIES, "DDD")
    return f"""SELECT q.total, q.unique_rows, q.duplicate_rate, round(q.unique_rows / CAST(q.total AS DOUBLE), 6) AS unique_rate, m.matches, m.match_rate, c.least_coverage, q.unique_rows / CAST(q.total AS DOUBLE) < 0.8e0 AS low_unique_rate
      FROM ({duplicate_rows(d, syn, key)}) AS q CROSS JOIN ({exact_matches(d, rel, key)}) AS m CROSS JOIN (SELECT min(coverage) AS least_coverage FROM ({coverage(d, rel, categories)}) AS k) AS c"""


def encoded_sample(d: Spark, rel: str, n_rows: int = 1000) -> str:
    """The first ``n_rows`` of either side with numbers scaled by the bounds of both samples together; a missing number is their median.

    The samples are of a fixed size, so that bounds, medians and pairs are too.
    """
    numbers, categories = ("Idade", "Renda", "Dependentes"), (*domain.CATEGORIES, "DDD")
    first = lambda s: f"(SELECT * FROM {rel} AS p WHERE side = '{s}' ORDER BY row_id LIMIT {n_rows})"
    both = f"(SELECT * FROM {first('ref')} AS a UNION ALL SELECT * FROM {first('syn')} AS b)"
    good = lambda c: f"CASE WHEN {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE)) AND abs({c}) < 1e308 THEN CAST({c} AS DOUBLE) END"
    bounds = ", ".join(f"min({good(c)}) AS lo_{c}, max({good(c)}) AS hi_{c}, {d.median(good(c))} AS mid_{c}" for c in numbers)
    scaled = ", ".join(f"(coalesce({good(c)}, mid_{c}, 0e0) - coalesce(lo_{c}, 0e0)) / CASE WHEN hi_{c} > lo_{c} THEN hi_{c} - lo_{c} ELSE 1e0 END AS z_{c}" for c in numbers)
    named = ", ".join(f"coalesce(CAST({c} AS VARCHAR(60)), '<NA>') AS c_{c}" for c in categories)
    return f"(SELECT row_id AS id, side, {scaled}, {named} FROM {both} AS s CROSS JOIN (SELECT {bounds} FROM {both} AS t) AS u)"


def profile_distance() -> str:
    """Euclidean over scaled numbers and one-hot categories (two cells differ where a category does), between ``a`` and ``b``."""
    numbers = " + ".join(f"(a.z_{c} - b.z_{c}) * (a.z_{c} - b.z_{c})" for c in ("Idade", "Renda", "Dependentes"))
    return f"sqrt({numbers} + {' + '.join(f'CASE WHEN a.c_{c} <> b.c_{c} THEN 2e0 ELSE 0e0 END' for c in (*domain.CATEGORIES, 'DDD'))})"


def nearest_profiles(d: Spark, rel: str, n_rows: int = 1000) -> str:
    """Distance to the closest reference profile and its ratio to the second closest."""
    side = lambda s: f"(SELECT * FROM {encoded_sample(d, rel, n_rows)} AS e WHERE side = '{s}')"
    return nearest(d, side("ref"), side("syn"), profile_distance(), n_rows)


def nearest(d: Spark, ref: str, syn: str, distance: str, max_rows: int = 1000) -> str:
    """Distance to the closest record and its ratio to the second closest, of the first ``max_rows`` rows of either side by id.

    The bound is the operator's definition (both sides are samples of a fixed size), which also bounds the pairs.
    """
    first = lambda rel, s: f"(SELECT * FROM {rel} AS {s}0 ORDER BY id LIMIT {max_rows})"
    pairs = f"(SELECT a.id AS id, b.id AS other, {distance} AS dist FROM {first(syn, 's')} AS a CROSS JOIN {first(ref, 'r')} AS b)"
    two = f"(SELECT id, max(CASE WHEN k = 1 THEN dist END) AS d1, max(CASE WHEN k = 2 THEN dist END) AS d2 FROM (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS k FROM {pairs} AS p) AS w WHERE k <= 2 GROUP BY id)"
    ratio = "CASE WHEN d2 IS NULL THEN NULL WHEN d2 = 0 THEN 1e0 ELSE d1 / d2 END"
    return f"SELECT count(*) AS n, {settled('min(d1)')} AS dcr_min, {settled('avg(d1)')} AS dcr_mean, {settled(d.median('d1'))} AS dcr_median, {settled(f'avg({ratio})')} AS nndr_mean, {settled(d.median(ratio))} AS nndr_median FROM {two} AS t"
