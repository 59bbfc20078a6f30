"""Geography, vocabulary and relational reports of profiles, and what changed between two stages."""

from __future__ import annotations

from veredas.functions import canonical, domain
from veredas.functions.dialect import Spark, any_of

from . import validate


def geography_catalog(d: Spark) -> str:
    """The composite keys: one per municipality and area code of a state, numbered in the domain's order."""
    tuples = [(region, s, c, x) for s, (region, cities, codes) in domain.STATES.items() for c in cities for x in codes]
    states = [(i, s, v[0], ",".join(v[1]), len(v[2]), ",".join(map(str, v[2]))) for i, (s, v) in enumerate(domain.STATES.items())]
    base = f"(SELECT s.*, c.k AS ck, x.k AS xk FROM {d.values(states, 'i, Estado, Regiao, cities, n_codes, codes')} AS s CROSS JOIN {d.numbers(1, 3, 'k')} AS c JOIN {d.numbers(1, 9, 'k')} AS x ON x.k <= s.n_codes)"
    assert len(tuples) < 10**6
    return f"SELECT concat('GEO_', lpad(CAST(row_number() OVER (ORDER BY i, ck, xk) AS VARCHAR(6)), 6, '0')) AS Geo_Key, Regiao, Estado, split_part(cities, ',', ck) AS Municipio, CAST(split_part(codes, ',', xk) AS INT) AS DDD FROM {base} AS b"


def encode_geography(d: Spark, rel: str) -> str:
    """The four places as one key; null where they don't belong together."""
    return f"SELECT p.row_id, g.Geo_Key FROM {rel} AS p LEFT JOIN ({geography_catalog(d)}) AS g ON p.Regiao = g.Regiao AND p.Estado = g.Estado AND p.Municipio = g.Municipio AND p.DDD = g.DDD"


def decode_geography(d: Spark, keys: str) -> str:
    """Keys back to places; an unknown key gives a sentinel text and code 0."""
    known = lambda c: f"coalesce(g.{c}, '__UNKNOWN__') AS {c}"
    return f"SELECT k.row_id, {known('Regiao')}, {known('Estado')}, {known('Municipio')}, coalesce(g.DDD, 0) AS DDD FROM {keys} AS k LEFT JOIN ({geography_catalog(d)}) AS g ON k.Geo_Key = g.Geo_Key"


def geography_validity(d: Spark, rel: str) -> str:
    r = validate.rules(d)
    names = ("region_state", "state_municipality", "state_ddd", "geographic_joint")
    return f"SELECT count(*) AS n, {', '.join(f'round(avg(CASE WHEN {r[k]} THEN 1e0 ELSE 0e0 END), 6) AS {k}' for k in names)} FROM {rel} AS p"


def invalid_places(d: Spark, rel: str, k: int = 20) -> str:
    """The most frequent combinations that break the joint rule (a report's top-k)."""
    t = [f"coalesce(CAST({c} AS VARCHAR(60)), '<NA>')" for c in ("Regiao", "Estado", "Municipio", "DDD")]
    return f"SELECT concat_ws('|', {', '.join(t)}) AS place, CAST(sum(CASE WHEN {validate.rules(d)['geographic_joint']} THEN 0 ELSE 1 END) AS BIGINT) AS n FROM {rel} AS p GROUP BY 1 HAVING sum(CASE WHEN {validate.rules(d)['geographic_joint']} THEN 0 ELSE 1 END) > 0 ORDER BY n DESC, place LIMIT {k}"


def rare_values(d: Spark, rel: str, column: str, share: float = 0.01) -> str:
    """Values rarer than ``share`` in the reference: counts on both sides, and whether the synthetic side has them."""
    counts = f"(SELECT {column} AS v, sum(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN side = 'syn' THEN 1 ELSE 0 END) AS s FROM {rel} AS p WHERE {column} IS NOT NULL GROUP BY {column})"
    return f"SELECT v, r AS n_ref, s AS n_syn, s > 0 AS reproduced FROM {counts} AS g CROSS JOIN (SELECT sum(r) AS total FROM {counts} AS e) AS t WHERE r > 0 AND r < {share!r}e0 * total"


def relational_validity(d: Spark, rel: str) -> str:
    r = validate.rules(d)
    pair = f"({r['occupation_education']} AND {r['occupation_age']})"
    invalid = {k: r[k] for k in ("known_categories", "age_domain", "income_domain", "dependents_domain", "occupation_education", "occupation_age")} | {"occupation_pair": pair, "joint": r["professional_joint"]}
    return f"SELECT count(*) AS n, {', '.join(f'CAST(sum(CASE WHEN {p} THEN 0 ELSE 1 END) AS BIGINT) AS bad_{k}' for k, p in invalid.items())} FROM {rel} AS p"


def offending_pairs(d: Spark, rel: str, k: int = 10) -> str:
    return f"SELECT Escolaridade, Ocupacao, count(*) AS n FROM {rel} AS p GROUP BY Escolaridade, Ocupacao HAVING NOT {validate.rules(d)['occupation_education']} ORDER BY n DESC, Escolaridade, Ocupacao LIMIT {k}"


def occupation_entropy(d: Spark, rel: str) -> str:
    """Coverage of the closed domain, Shannon entropy and the top share; other values are left out of the shares."""
    g = f"(SELECT Ocupacao, CAST(count(*) AS DOUBLE) AS n FROM {rel} AS p WHERE {any_of('Ocupacao', tuple(domain.OCCUPATIONS))} GROUP BY Ocupacao)"
    return f"SELECT count(*) AS n_present, round(count(*) / {len(domain.OCCUPATIONS)}e0, 6) AS coverage, round(-sum(s * ln(s)), 6) AS entropy, round(max(s), 6) AS top_share FROM (SELECT n / sum(n) OVER () AS s FROM {g} AS g) AS t"


def unexpected_values(d: Spark, rel: str) -> str:
    """Values outside their column's domain, and which of them are known old spellings; one pass over the rows."""
    cells = [f"CASE WHEN {c} IS NULL OR {any_of(c, v)} THEN NULL ELSE concat('{c}{chr(1)}', {c}) END" for c, v in domain.CATEGORIES.items()]
    value = f"split_part(cell, '{chr(1)}', 2)"
    return f"SELECT split_part(cell, '{chr(1)}', 1) AS column_name, {value} AS value, n, {any_of(value, tuple(domain.ALIASES))} AS legacy FROM (SELECT cell, count(*) AS n FROM (SELECT {d.explode(cells, 'cell')} FROM {rel} AS p) AS l WHERE cell IS NOT NULL GROUP BY cell) AS c"


def normalize_sql(d: Spark, rel: str, columns: tuple[str, ...]) -> str:
    """Adds ``<column>_norm``: composed characters and today's spelling."""
    return f"(SELECT *, {', '.join(f'{canonical.text(d, c)} AS {c}_norm' for c in columns)} FROM {rel})"


#: Fields that a repair may change, and those of them whose change replaces the person.
CHANGED = ("Idade", "Genero", "Regiao", "Estado", "Municipio", "Escolaridade", "Estado_Civil", "Ocupacao", "Renda", "Dependentes", "DDD")
REPLACING = ("Idade", "Estado", "Escolaridade", "Ocupacao", "Estado_Civil", "Dependentes")


def changes_sql(d: Spark, raw: str, final: str, fields: tuple[str, ...] = CHANGED) -> str:
    """row_id, and per field the canonical values before and after; both stages joined by row id once."""
    cells = ", ".join(f"{canonical.compared(d, f'a.{c}', c)} AS before_{c}, {canonical.compared(d, f'b.{c}', c)} AS after_{c}" for c in fields)
    return f"(SELECT a.row_id, {cells} FROM {raw} AS a JOIN {final} AS b ON a.row_id = b.row_id)"


def field_changes(d: Spark, raw: str, final: str) -> str:
    """Per field the rows whose canonical values differ between the stages, and (multi) those with several such fields."""
    differ = lambda c: f"CASE WHEN before_{c} <> after_{c} THEN 1 ELSE 0 END"
    one = f"(SELECT count(*) AS n, {', '.join(f'sum({differ(c)}) AS x_{c}' for c in CHANGED)}, sum(CASE WHEN {' + '.join(map(differ, CHANGED))} > 1 THEN 1 ELSE 0 END) AS x_multi FROM {changes_sql(d, raw, final)} AS j)"
    cells = [f"concat('{c}', ':', CAST(x_{c} AS VARCHAR(20)))" for c in (*CHANGED, "multi")]
    return f"SELECT split_part(cell, ':', 1) AS field, n AS total, CAST(split_part(cell, ':', 2) AS BIGINT) AS changed FROM (SELECT n, {d.explode(cells, 'cell')} FROM {one} AS o) AS c"


def transitions(d: Spark, raw: str, final: str, fields: tuple[str, ...] = CHANGED, k: int = 20) -> str:
    """The k most frequent (before, after) pairs of every field."""
    m = chr(1)
    cells = [f"CASE WHEN before_{c} <> after_{c} THEN concat('{c}{m}', before_{c}, '{m}', after_{c}) END" for c in fields]
    counts = f"(SELECT split_part(cell, '{m}', 1) AS field, cell, count(*) AS n FROM (SELECT {d.explode(cells, 'cell')} FROM {changes_sql(d, raw, final, fields)} AS j) AS l WHERE cell IS NOT NULL GROUP BY cell)"
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, cell) AS place FROM {counts} AS c)"
    return f"SELECT field, split_part(cell, '{m}', 2) AS before_value, split_part(cell, '{m}', 3) AS after_value, n FROM {ranked} AS r WHERE place <= {k}"


def stage_outcomes(d: Spark, raw: str, final: str, selected: str | None = None, judged: bool = True) -> str:
    """One row: selected rows that are unchanged, repaired (no core field changed), replaced or changed in several fields; invalid rows are rejected, valid ones that are not selected are surplus.

    ``selected``: a relation of the chosen row ids; without it every valid row is. Unless ``judged``, rows that are not
    selected are rejected, whatever the rules say.
    """
    ok = f"(SELECT row_id AS k, ok_structural_global AS ok FROM {validate.masks_sql(d, final, {'structural_global': validate.rules(d)['structural_global']})} AS m)"
    differ = lambda c: f"CASE WHEN before_{c} <> after_{c} THEN 1 ELSE 0 END"
    rows = f"(SELECT row_id, {' + '.join(map(differ, CHANGED))} AS n_changed, {' + '.join(map(differ, REPLACING))} AS n_core FROM {changes_sql(d, raw, final)} AS j)"
    chosen = f"LEFT JOIN (SELECT row_id AS s_id FROM {selected} AS c) AS s ON r.row_id = s.s_id" if selected else ""
    picked = "s_id IS NOT NULL" if selected else "ok"
    one = lambda p: f"CAST(coalesce(sum(CASE WHEN {p} THEN 1 ELSE 0 END), 0) AS BIGINT)"
    good = "ok" if judged else picked
    return f"""SELECT count(*) AS total, {one(picked)} AS selected, {one(f'{picked} AND n_changed = 0')} AS unchanged, {one(f'{picked} AND n_changed > 0 AND n_core = 0')} AS repaired, {one(f'{picked} AND n_core > 0')} AS replaced,
      {one(f'{picked} AND n_changed > 1')} AS multiple_fields, {one(f'NOT ({good})')} AS rejected, {one(f'{good} AND NOT ({picked})')} AS surplus FROM {rows} AS r JOIN {ok} AS v ON r.row_id = v.k {chosen}"""


def geography_outcomes(d: Spark, raw: str, final: str) -> str:
    """One row: places unchanged, repaired (the state kept) or replaced, several place fields or only others changed, and the raw rows' reasons to reject a place."""
    places = ("Regiao", "Estado", "Municipio", "DDD")
    others = tuple(c for c in CHANGED if c not in places)
    differ = lambda c: f"CASE WHEN before_{c} <> after_{c} THEN 1 ELSE 0 END"
    rows = f"(SELECT {' + '.join(map(differ, places))} AS n_place, {differ('Estado')} AS n_state, {' + '.join(map(differ, others))} AS n_other FROM {changes_sql(d, raw, final)} AS j)"
    one = lambda p: f"CAST(coalesce(sum(CASE WHEN {p} THEN 1 ELSE 0 END), 0) AS BIGINT)"
    r = validate.rules(d)
    why = f"(SELECT CAST(coalesce(sum({' + '.join(f'CASE WHEN {r[n]} THEN 0 ELSE 1 END' for n in ('region_state', 'state_municipality', 'state_ddd'))}), 0) AS BIGINT) AS rejected_reasons FROM {raw} AS w)"
    return f"SELECT selected, unchanged, repaired, replaced, multiple_fields, other_modified, rejected_reasons FROM (SELECT count(*) AS selected, {one('n_place = 0')} AS unchanged, {one('n_place > 0 AND n_state = 0')} AS repaired, {one('n_state > 0')} AS replaced, {one('n_place > 1')} AS multiple_fields, {one('n_place = 0 AND n_other > 0')} AS other_modified FROM {rows} AS r) AS a CROSS JOIN {why} AS b"


def catalog_check(d: Spark) -> str:
    """One row: entries, distinct keys and tuples of the catalog, entries that break the tables, and a checksum of it in order."""
    c = f"({geography_catalog(d)}) AS g"
    r = validate.rules(d)
    bad = " OR ".join(f"NOT {r[n]}" for n in ("region_state", "state_municipality", "state_ddd"))
    line = "concat_ws('|', Geo_Key, Regiao, Estado, Municipio, CAST(DDD AS VARCHAR(3)))"
    return f"SELECT count(*) AS entries, count(DISTINCT Geo_Key) AS unique_keys, count(DISTINCT concat_ws('|', Regiao, Estado, Municipio, CAST(DDD AS VARCHAR(3)))) AS unique_tuples, CAST(sum(CASE WHEN {bad} THEN 1 ELSE 0 END) AS BIGINT) AS invalid_entries, {d.sha256(d.joined(line))} AS checksum FROM {c}"


def presets(d: Spark) -> str:
    rows = [(n, i + 1, c) for n, cols in domain.PRESETS.items() for i, c in enumerate(cols)]
    return f"SELECT preset, CAST(place AS INT) AS place, column_name FROM {d.values(rows, 'preset, place, column_name')} AS v"


def resolve_columns(explicit: list[str] | None = None, preset: str | None = None) -> list[str]:
    """The chosen columns in order: explicit, of a preset, or all; unknown, repeated or empty names raise."""
    if explicit is not None and preset is not None:
        raise ValueError("give columns or a preset, not both")
    if preset is not None:
        if preset not in domain.PRESETS:
            raise ValueError(f"unknown preset {preset!r}")
        return list(domain.PRESETS[preset])
    if explicit is None:
        return list(domain.FINAL_COLUMNS)
    names = [c.strip() if isinstance(c, str) else c for c in explicit]
    bad = [c for c in names if not isinstance(c, str) or c not in domain.FINAL_COLUMNS]
    if bad or not names or len(set(names)) < len(names):
        raise ValueError(f"columns must be known, distinct and at least one: {bad or names}")
    return names
