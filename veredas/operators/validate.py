"""Structural rules of profiles: a registry of predicates, from which masks, counts, reasons and co-occurrence all derive."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from veredas.functions import canonical, domain
from veredas.functions.dialect import Spark, any_of, literal, lookup


def _ok(predicate: str) -> str:
    """Unknown counts as broken."""
    return f"coalesce({predicate}, FALSE)"


def _digit(s: str, i: int) -> str:
    return f"CAST(substr({s}, {i + 1}, 1) AS INT)"


def cpf_valid(d: Spark, x: str) -> str:
    """Eleven digits, not all equal, two check digits."""
    s = d.digits(x)
    first = " + ".join(f"{10 - i} * {_digit(s, i)}" for i in range(9))
    second = " + ".join(f"{11 - i} * {_digit(s, i)}" for i in range(10))
    return _ok(f"CASE WHEN length({s}) <> 11 OR {s} = repeat(substr({s}, 1, 1), 11) THEN FALSE ELSE {_digit(s, 9)} = {d.check_low(first)} AND {_digit(s, 10)} = {d.check_low(second)} END")


def cnh_valid(d: Spark, x: str) -> str:
    s = d.digits(x)
    c1 = " + ".join(f"{9 - i} * {_digit(s, i)}" for i in range(9))
    c2 = " + ".join(f"{i + 1} * {_digit(s, i)}" for i in range(9))
    return _ok(f"CASE WHEN length({s}) <> 11 THEN FALSE ELSE {_digit(s, 9)} = {d.check_ten(c1)} AND {_digit(s, 10)} = {d.check_ten(c2)} END")


def vote_valid(d: Spark, x: str) -> str:
    c1 = " + ".join(f"{9 - i} * {_digit(x, i)}" for i in range(8))
    uf = f"CAST(substr({x}, 9, 2) AS INT)"
    c2 = " + ".join(f"{8 - i} * {_digit(x, i)}" for i in range(8)) + f" + 9 * {_digit(x, 10)} + 10 * {uf}"
    return _ok(f"CASE WHEN NOT {d.matches(x, "^[0-9]{12}$")} THEN FALSE ELSE {_digit(x, 10)} = {d.check_ten(c1)} AND {_digit(x, 11)} = {d.check_ten(c2)} END")


def _by_number(d: Spark, column: str, as_text: str) -> str:
    """The rule of an identifier on its number, and on its text where it has none."""
    n = f"num_{column}"
    x = d.digits_of(n, NUMBERED[column])
    total = lambda weights: " + ".join(f"{w} * {y}" for w, y in zip(weights, x, strict=False))
    if column == "CPF":
        right = f"{n} % 11111111111 <> 0 AND {x[9]} = {d.check_low(total(range(10, 1, -1)))} AND {x[10]} = {d.check_low(total(range(11, 1, -1)))}"
    elif column == "CNH":
        right = f"{x[9]} = {d.check_ten(total(range(9, 0, -1)))} AND {x[10]} = {d.check_ten(total(range(1, 10)))}"
    else:
        # Stops and hyphens don't stand in this one.
        state = f"(({n} div 100) % 100)"
        right = f"octet_length({column}) = 12 AND {x[10]} = {d.check_ten(total(range(9, 1, -1)))} AND {x[11]} = {d.check_ten(f'{total(range(8, 0, -1))} + 9 * {x[10]} + 10 * {state}')}"
    return f"CASE WHEN {n} IS NOT NULL THEN {right} ELSE {as_text} END"


def region_of(state: str) -> str:
    return lookup(state, {s: v[0] for s, v in domain.STATES.items()})


def city_in_state(state: str, city: str) -> str:
    return _ok("CASE " + state + " " + " ".join(f"WHEN {literal(s)} THEN {any_of(city, v[1])}" for s, v in domain.STATES.items()) + " ELSE FALSE END")


def ddd_in_state(state: str, ddd: str) -> str:
    return _ok("CASE " + state + " " + " ".join(f"WHEN {literal(s)} THEN {any_of(ddd, v[2])}" for s, v in domain.STATES.items()) + " ELSE FALSE END")


def level_of(education: str) -> str:
    return lookup(education, {e: i + 1 for i, e in enumerate(domain.EDUCATION)})


def _of_occupation(occupation: str, key: str) -> str:
    return lookup(occupation, {n: int(o[key]) for n, o in domain.OCCUPATIONS.items()})


def _whole(column: str, bounds: tuple) -> str:
    """A whole number within bounds."""
    n = canonical.number(column)
    return _ok(f"{n} BETWEEN {float(bounds[0])!r}e0 AND {float(bounds[1])!r}e0 AND {n} % 1 = 0")


def elementary(d: Spark) -> dict[str, str]:
    """name -> predicate that a valid row fulfils, each of one thing; ``known_<column>``: a value of the column's domain."""
    known, age = {f"known_{c}": _ok(any_of(c, v)) for c, v in domain.CATEGORIES.items()}, canonical.number("Idade")
    return known | {
        "known_DDD": _ok(any_of(canonical.number("DDD"), tuple(x for v in domain.STATES.values() for x in v[2]))),
        "age_domain": _whole("Idade", domain.AGE),
        "income_domain": _ok(f"{canonical.number('Renda')} BETWEEN {domain.INCOME[0]!r}e0 AND {domain.INCOME[1]!r}e0"),
        "dependents_domain": _whole("Dependentes", domain.DEPENDENTS),
        "region_state": _ok(f"{region_of('Estado')} = Regiao"),
        "state_municipality": city_in_state("Estado", "Municipio"),
        "state_ddd": ddd_in_state("Estado", canonical.number("DDD")),
        "occupation_education": _ok(f"{level_of('Escolaridade')} >= {_of_occupation('Ocupacao', 'level')}"),
        "occupation_age": _ok(f"{age} BETWEEN {_of_occupation('Ocupacao', 'min')} AND {_of_occupation('Ocupacao', 'max')}"),
        "marital_age": _ok(f"{age} IS NOT NULL AND NOT (coalesce(Estado_Civil, '') = 'Viúvo' AND {age} < 25)"),
    }


_DOMAINS = ("age_domain", "income_domain", "dependents_domain")
_PLACE = ("region_state", "state_municipality", "state_ddd")
_WORK = ("occupation_education", "occupation_age")
_KNOWN = (*(f"known_{c}" for c in domain.CATEGORIES), "known_DDD")
#: The fourteen rules as conjunctions of elementary ones.
JOINT = {
    "known_categories": _KNOWN, **{n: (n,) for n in (*_DOMAINS, *_PLACE, *_WORK, "marital_age")},
    "geographic_joint": ("known_Regiao", "known_Estado", "known_Municipio", "known_DDD", *_PLACE),
    "professional_joint": ("known_Escolaridade", "known_Ocupacao", "age_domain", "income_domain", *_WORK),
    "non_relational_joint": (*_KNOWN, *_DOMAINS),
    "structural_global": (*_KNOWN, *_DOMAINS, *_PLACE, *_WORK),
}
#: Rules that are conjunctions of others.
COMPOSED = ("geographic_joint", "professional_joint", "non_relational_joint", "structural_global")


#: Columns that an elementary predicate reads.
NEEDS = {f"known_{c}": (c,) for c in domain.CATEGORIES} | {
    "known_DDD": ("DDD",), "age_domain": ("Idade",), "income_domain": ("Renda",), "dependents_domain": ("Dependentes",),
    "region_state": ("Estado", "Regiao"), "state_municipality": ("Estado", "Municipio"), "state_ddd": ("Estado", "DDD"),
    "occupation_education": ("Ocupacao", "Escolaridade"), "occupation_age": ("Ocupacao", "Idade"), "marital_age": ("Idade", "Estado_Civil"),
}


@dataclass(frozen=True)
class UserRule:
    """A rule of the caller: SQL (of a dialect) that a valid row fulfils, and the columns it reads. Unknown counts as broken."""

    predicate: Callable[[Spark], str]
    columns: tuple[str, ...] = ()


_USER_RULES: dict[str, UserRule] = {}


def add_rule(name: str, predicate: Callable[[Spark], str], columns: Iterable[str] = ()) -> None:
    """Adds a rule to masks, counts, reasons and reports alike; its reason has the rule's name."""
    if not name.isidentifier() or name in JOINT or name in _USER_RULES:
        raise ValueError(f"{name!r} is no free name of a rule")
    _USER_RULES[name] = UserRule(predicate, tuple(columns))


def remove_rule(name: str) -> None:
    del _USER_RULES[name]


def user_rules(d: Spark, columns: Iterable[str] | None = None, named: dict[str, UserRule] | None = None) -> dict[str, str]:
    """name -> predicate of the rules that were added (or given), as far as a frame of some columns has what they read."""
    has = None if columns is None else set(columns)
    return {n: _ok(r.predicate(d)) for n, r in (_USER_RULES if named is None else named).items() if has is None or has.issuperset(r.columns)}


def rules(d: Spark, columns: Iterable[str] | None = None) -> dict[str, str]:
    """name -> predicate over the model columns, those of the caller last; for a frame of some columns those it can be judged by."""
    e, has = elementary(d), None if columns is None else set(columns)
    own = {n: "(" + " AND ".join(e[p] for p in parts) + ")" for n, parts in JOINT.items() if has is None or all(has.issuperset(NEEDS[p]) for p in parts)}
    return own | user_rules(d, columns)


#: Columns that a rule of final profiles reads besides the one it is named after.
_FINAL_NEEDS = {"Data_Nascimento_idade": ("Data_Nascimento", "Idade"), "telefone_ddd": ("Telefone", "DDD")}


#: Digits of the identifiers whose check digits are tried on a number.
NUMBERED = {"CPF": 11, "CNH": 11, "Titulo_Eleitor": 12}


def final_rules(d: Spark, columns: Iterable[str] | None = None, staged: bool = False) -> dict[str, str]:
    """Rules of identifiers and birth dates, for final profiles; for a frame of some columns those it can be judged by.

    ``staged``: the rows have the ``num_<column>`` of ``with_numbers``, on which check digits are tried; texts without one are judged as texts.
    """
    every = _final_rules(d)
    if staged:
        every |= {c: _by_number(d, c, every[c]) for c in NUMBERED}
    return every if columns is None else {n: p for n, p in every.items() if set(columns).issuperset(_FINAL_NEEDS.get(n, (n,)))}


def _final_rules(d: Spark) -> dict[str, str]:
    return {
        "Data_Nascimento_idade": _ok(f"{d.age_at('Data_Nascimento', domain.REFERENCE_DATE)} = {canonical.number('Idade')}"),
        "CPF": cpf_valid(d, "CPF"),
        "CNH": cnh_valid(d, "CNH"),
        "RG": _ok(d.matches("RG", r"^[0-9]{2}\.[0-9]{3}\.[0-9]{3}-[0-9Xx]$")),
        "Titulo_Eleitor": vote_valid(d, "Titulo_Eleitor"),
        "Telefone": _ok(d.matches("Telefone", r"^\([0-9]{2}\) [0-9]{5}-[0-9]{4}$")),
        "telefone_ddd": _ok(f"{d.area_code('Telefone')} = CAST(DDD AS VARCHAR(3))"),
    }


def masks_sql(d: Spark, rel: str, chosen: dict[str, str], keep: tuple[str, ...] = ()) -> str:
    """row_id, the columns ``keep`` and one boolean per rule: a projection in which every elementary predicate is computed once."""
    e, own = elementary(d), rules(d)
    joint = {n: JOINT[n] for n in chosen if n in JOINT and chosen[n] == own[n]}
    once = {f"is_{p}": e[p] for p in dict.fromkeys(p for parts in joint.values() for p in parts)}
    once |= {f"is_{n}": p for n, p in chosen.items() if n not in joint}
    ok = ", ".join(f"({' AND '.join(f'is_{p}' for p in joint.get(n, (n,)))}) AS ok_{n}" for n in chosen)
    return f"(SELECT {', '.join(('row_id', *keep))}, {ok} FROM {d.fixed(f'{rel} AS judged', once)} AS once)"


def rule_counts(d: Spark, rel: str, chosen: dict[str, str]) -> str:
    """Per rule: rows, invalid rows and rate, from one aggregation over one projection."""
    sums = ", ".join(f"sum(CASE WHEN ok_{n} THEN 0 ELSE 1 END) AS x_{n}" for n in chosen)
    one = f"(SELECT count(*) AS n, {sums} FROM {masks_sql(d, rel, chosen)} AS m)"
    pairs = [f"concat('{n}', ':', CAST(x_{n} AS VARCHAR(20)))" for n in chosen]
    cell = f"(SELECT n, {d.explode(pairs, 'cell')} FROM {one} AS o)"
    return f"SELECT split_part(cell, ':', 1) AS rule, n AS total, CAST(split_part(cell, ':', 2) AS BIGINT) AS invalid, round(1e0 - CAST(split_part(cell, ':', 2) AS DOUBLE) / nullif(n, 0), 6) AS valid_rate FROM {cell} AS c"


def failed_sql(d: Spark, rel: str, chosen: dict[str, str]) -> str:
    """row_id, n_failed and the comma-joined names of the failed rules."""
    names = " , ".join(f"CASE WHEN ok_{n} THEN NULL ELSE '{n}' END" for n in chosen)
    count = " + ".join(f"CASE WHEN ok_{n} THEN 0 ELSE 1 END" for n in chosen)
    return f"(SELECT row_id, {count} AS n_failed, concat_ws(',', {names}) AS failed FROM {masks_sql(d, rel, chosen)} AS m)"


def failure_distribution(d: Spark, rel: str, chosen: dict[str, str]) -> str:
    return f"SELECT least(n_failed, 3) AS at_most_three, count(*) AS n FROM {failed_sql(d, rel, chosen)} AS f GROUP BY least(n_failed, 3)"


def failure_combinations(d: Spark, rel: str, chosen: dict[str, str], k: int = 20) -> str:
    """The k most frequent sets of failed rules (a report's top-k)."""
    return f"SELECT failed, count(*) AS n FROM {failed_sql(d, rel, chosen)} AS f WHERE n_failed > 0 GROUP BY failed ORDER BY n DESC, failed LIMIT {k}"


def co_occurrence(d: Spark, rel: str, chosen: dict[str, str]) -> str:
    """Pairs of rules that fail together; conditional sums over one projection, no self-join."""
    pairs = [(a, b) for i, a in enumerate(chosen) for b in list(chosen)[i + 1 :]]
    sums = ", ".join(f"sum(CASE WHEN ok_{a} OR ok_{b} THEN 0 ELSE 1 END) AS x{i}" for i, (a, b) in enumerate(pairs))
    one = f"(SELECT {sums} FROM {masks_sql(d, rel, chosen)} AS m)"
    cells = [f"concat('{a}', ':', '{b}', ':', CAST(x{i} AS VARCHAR(20)))" for i, (a, b) in enumerate(pairs)]
    return f"SELECT split_part(cell, ':', 1) AS rule_a, split_part(cell, ':', 2) AS rule_b, CAST(split_part(cell, ':', 3) AS BIGINT) AS n FROM (SELECT {d.explode(cells, 'cell')} FROM {one} AS o) AS c WHERE CAST(split_part(cell, ':', 3) AS BIGINT) > 0"


def _cells(d: Spark, columns: tuple[str, ...], mark: str = chr(1)) -> list[str]:
    """``column`` and value of each column as one text; null is a value of its own."""
    return [f"concat('{c}{mark}', coalesce(CAST({c} AS VARCHAR(300)), '{chr(2)}'))" for c in columns]


def _values(d: Spark, rel: str, columns: tuple[str, ...]) -> str:
    """field, value and n of every distinct value of some columns; the rows are read once, and counted before they move."""
    return f"(SELECT split_part(cell, '{chr(1)}', 1) AS field, cell, count(*) AS n FROM (SELECT {d.explode(_cells(d, columns), 'cell')} FROM {rel} AS r) AS c GROUP BY cell)"


def duplicated_ids(d: Spark, rel: str, columns: tuple[str, ...] = domain.IDENTIFIERS) -> str:
    """Per identifier: occurrences beyond the first of a value (null is a value), and the values concerned."""
    return f"SELECT field AS identifier, CAST(sum(n - 1) AS BIGINT) AS extra, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_values FROM {_values(d, rel, columns)} AS g GROUP BY field"


def keep_first_sql(rel: str, key: str) -> str:
    """Adds ``later``: another row with a smaller row_id has the same key (null is a key too). A minimum per key joined back, so that a hot key is pre-aggregated."""
    return f"(SELECT r.*, r.row_id > k.first_id AS later FROM {rel} AS r JOIN (SELECT {key} AS k0, min(row_id) AS first_id FROM {rel} AS q GROUP BY {key}) AS k ON r.{key} IS NOT DISTINCT FROM k.k0)"


def null_counts(d: Spark, rel: str, columns: tuple[str, ...]) -> str:
    """Per field the rows without a value, from one aggregation."""
    sums = ", ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS x_{c}" for c in columns)
    cells = [f"concat('{c}:', CAST(coalesce(x_{c}, 0) AS VARCHAR(20)))" for c in columns]
    return f"SELECT split_part(cell, ':', 1) AS field, CAST(split_part(cell, ':', 2) AS BIGINT) AS n_null FROM (SELECT {d.explode(cells, 'cell')} FROM (SELECT {sums} FROM {rel} AS r) AS o) AS c"


def report_flags(d: Spark, final: bool = True, columns: Iterable[str] | None = None, named: dict[str, UserRule] | None = None, staged: bool = False) -> dict[str, str]:
    """reason -> whether a row has it, over canonical text columns; in the report's order. Several nulls of a row count apart (see :func:`validation_reasons`).

    For a frame of some columns the reasons that it can be judged by; a birth date without an age is only read. ``staged``: the rows have numbers of
    their identifiers (see :func:`final_rules`).
    """
    required = domain.FINAL_COLUMNS if final else domain.MODEL_COLUMNS
    has = set(required if columns is None else columns)
    n = canonical.number
    out: dict[str, str] = {}
    bad = lambda p: f"NOT {_ok(p)}"
    bounds = {"Idade": domain.AGE, "Renda": domain.INCOME, "Dependentes": domain.DEPENDENTS, "DDD": (11, 99)}
    for c, (low, high) in bounds.items():
        if c in has:
            out[f"{c}_below_min"] = _ok(f"{n(c)} < {float(low)!r}e0")
            out[f"{c}_above_max"] = _ok(f"{n(c)} > {float(high)!r}e0")
            if c != "Renda":
                out[f"{c}_non_integer"] = _ok(f"{n(c)} % 1 <> 0")
    for c, values in domain.CATEGORIES.items():
        if c in has:
            out[f"{c}_unexpected_category"] = bad(any_of(c, values))
    if "DDD" in has:
        out["DDD_unexpected_category"] = bad(any_of(n("DDD"), tuple(x for v in domain.STATES.values() for x in v[2])))
    e = elementary(d)
    for reason, rule in (("estado_regiao_incompativel", "region_state"), ("municipio_estado_incompativel", "state_municipality"), ("ddd_estado_incompativel", "state_ddd")):
        if has.issuperset(NEEDS[rule]):
            out[reason] = f"NOT {e[rule]}"
    if {"Ocupacao", "Escolaridade", "Idade"} <= has:
        whole = f"({n('Idade')} - {n('Idade')} % 1)"
        fits = f"{level_of('Escolaridade')} >= {_of_occupation('Ocupacao', 'level')} AND {whole} BETWEEN {_of_occupation('Ocupacao', 'min')} AND {_of_occupation('Ocupacao', 'max')}"
        out["ocupacao_escolaridade_idade_incompativel"] = bad(fits)
    if final:
        names = {"CPF": "CPF_invalido", "CNH": "CNH_invalido", "RG": "RG_invalido", "Titulo_Eleitor": "Titulo_Eleitor_invalido", "Telefone": "Telefone_invalido", "Data_Nascimento_idade": "idade_data_nascimento_incompativel", "telefone_ddd": "telefone_ddd_incompativel"}
        out |= {names[k]: f"NOT {p}" for k, p in final_rules(d, has, staged).items()}
        if "Data_Nascimento" in has and "Idade" not in has:
            out["data_nascimento_invalida"] = f"{d.age_at('Data_Nascimento', domain.REFERENCE_DATE)} IS NULL"
    return out | {r: f"NOT {p}" for r, p in user_rules(d, has, named).items()}


def _required(final: bool, columns: Iterable[str] | None) -> tuple[list[str], list[str]]:
    """The required columns that are there, and those that are not."""
    required = domain.FINAL_COLUMNS if final else domain.MODEL_COLUMNS
    has = set(required if columns is None else columns)
    return [c for c in required if c in has], [c for c in required if c not in has]


def validation_sql(d: Spark, rel: str, final: bool = True, columns: Iterable[str] | None = None, named: dict[str, UserRule] | None = None, carry: dict[str, str] | None = None) -> str:
    """row_id, n_null and n_bad_number (of the row's fields), ``is_<reason>`` and ``later_<key>`` (another row with a smaller id has the same identifier, or the same row), and ``valid``.

    Text is made canonical first. Keys travel as short hashes of their kind and value and are counted together; only those of several rows are joined back. ``columns``
    names what the frame has, where required columns may be absent: they are left out, and no row is valid. Columns beyond the required ones
    are kept for the rules of the caller. ``carry``: more columns, by expressions over the rows as they came.
    """
    carry = carry or {}
    there, missing = _required(final, columns)
    numbers = tuple(c for c in ("Idade", "Renda", "Dependentes", "DDD") if c in there)
    more = [c for c in dict.fromkeys(columns or ()) if c not in there and c != "row_id"]
    clean = f"(SELECT {', '.join(['row_id', *(c if c in numbers else f'{canonical.text(d, f"CAST({c} AS VARCHAR(300))")} AS {c}' for c in there), *more, *(f'{e} AS {c}' for c, e in carry.items())])} FROM {rel} AS raw)"
    reasons = report_flags(d, final, columns, named, d.staged)
    flags = {"n_null": " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in there) or "0"}
    flags["n_bad_number"] = " + ".join(f"CASE WHEN {canonical._finite(canonical.number(c))} THEN 0 ELSE 1 END" for c in numbers) or "0"
    flags |= {f"is_{r}": p for r, p in reasons.items()}
    whole = ", ".join(f"coalesce(CAST({c} AS VARCHAR(300)), '{chr(2)}')" for c in [*there, *more])
    keys = {"row": f"concat_ws('|', {whole or literal('')})"}
    if final:
        keys |= {c: f"coalesce({c}, '{chr(2)}')" for c in domain.IDENTIFIERS if c in there}
    flags |= d.key_flags(keys)
    lengths = {c: n for c, n in NUMBERED.items() if final and c in there}
    judged = d.kept(d.fixed(f"{d.with_numbers(clean, lengths)} AS clean", flags), "judged", ("row_id", *flags, *carry))
    later = d.later(judged, keys)
    ok = "FALSE" if missing else " AND ".join(["n_null = 0", "n_bad_number = 0", *(f"NOT is_{r}" for r in reasons), "later_id IS NULL"])
    picked = ["row_id", "n_null", "n_bad_number", *(f"is_{r}" for r in reasons), *(f"coalesce(m_{k}, 0) = 1 AS later_{k}" for k in keys), *carry, f"({ok}) AS valid"]
    return f"(SELECT {', '.join(picked)} FROM {judged} AS j LEFT JOIN {later} AS t ON j.row_id = t.later_id)"


def _reason_names(d: Spark, final: bool, columns: Iterable[str] | None = None, named: dict[str, UserRule] | None = None) -> dict[str, str]:
    """reason -> what a row adds to its count."""
    one = lambda p: f"CASE WHEN {p} THEN 1 ELSE 0 END"
    out = {"null_required_fields": "n_null", "invalid_numeric_values": "n_bad_number"} | {r: one(f"is_{r}") for r in report_flags(d, final, columns, named)}
    if final:
        there = _required(final, columns)[0]
        out |= {f"{c}_duplicado": one(f"later_{c}") for c in domain.IDENTIFIERS if c in there}
    return out | {"duplicated_rows": one("later_row")}


def validation_report(d: Spark, rel: str, final: bool = True, columns: Iterable[str] | None = None, named: dict[str, UserRule] | None = None) -> str:
    """n_rows, valid_rows, invalid_rows, and every reason that occurs with its count: one row each, from one aggregation.

    ``missing_required_columns`` counts columns, not rows.
    """
    names = {"n_rows": "1", "valid_rows": "CASE WHEN valid THEN 1 ELSE 0 END", "invalid_rows": "CASE WHEN valid THEN 0 ELSE 1 END"} | _reason_names(d, final, columns, named)
    sums = ", ".join(f"sum({e}) AS x{i}" for i, e in enumerate(names.values()))
    cells = [f"concat('{n}:', CAST(coalesce(x{i}, 0) AS VARCHAR(20)))" for i, n in enumerate(names)]
    cells.append(f"'missing_required_columns:{len(_required(final, columns)[1])}'")
    return f"""SELECT split_part(cell, ':', 1) AS reason, CAST(split_part(cell, ':', 2) AS BIGINT) AS n FROM (SELECT {d.explode(cells, 'cell')} FROM (SELECT {sums} FROM {validation_sql(d, rel, final, columns, named)} AS v) AS o) AS c
      WHERE split_part(cell, ':', 2) <> '0' OR split_part(cell, ':', 1) IN ('n_rows', 'valid_rows', 'invalid_rows')"""


def validation_reasons(d: Spark, rel: str, final: bool = True, columns: Iterable[str] | None = None, named: dict[str, UserRule] | None = None) -> str:
    """row_id, valid and the comma-joined reasons of every row."""
    cells = ", ".join(f"CASE WHEN {e} > 0 THEN '{r}' END" for r, e in _reason_names(d, final, columns, named).items())
    return f"SELECT row_id, valid, concat_ws(',', {cells}) AS reasons FROM {validation_sql(d, rel, final, columns, named)} AS v"


def missing_columns(columns: list[str], final: bool = True) -> list[str]:
    """Required columns that a frame lacks: with any, all of its rows are invalid. Names are compared by case."""
    return _required(final, columns)[1]


# Labels of the checklist and the reason that each one excludes.
CHECKLIST = (
    ("CPFs estruturalmente válidos", "CPF_invalido"), ("CPFs sem duplicidade no lote", "CPF_duplicado"), ("Datas de nascimento coerentes com as idades", "idade_data_nascimento_incompativel"),
    ("Municípios coerentes com os estados", "municipio_estado_incompativel"), ("DDDs coerentes com os estados", "ddd_estado_incompativel"),
    ("Telefones no formato esperado", "Telefone_invalido"), ("Telefones coerentes com os DDDs", "telefone_ddd_incompativel"),
)


def checklist(d: Spark, rel: str) -> str:
    """The labelled checks of a validation report (complete columns are known before the query)."""
    found = ", ".join(f"max(CASE WHEN reason = '{r}' THEN n END) AS x{i}" for i, (_, r) in enumerate(CHECKLIST))
    rep = f"(SELECT max(CASE WHEN reason = 'invalid_rows' THEN n END) AS bad, {found} FROM ({validation_report(d, rel)}) AS r)"
    shown = [("Quantidade de linhas correta", "coalesce(bad, 0) = 0"), ("Schema interno completo", "TRUE"), *((label, f"coalesce(x{i}, 0) = 0") for i, (label, _) in enumerate(CHECKLIST))]
    cells = [f"concat('{label}', '{chr(1)}', CASE WHEN {p} THEN '1' ELSE '0' END)" for label, p in shown]
    return f"SELECT split_part(cell, '{chr(1)}', 1) AS label, split_part(cell, '{chr(1)}', 2) = '1' AS passed FROM (SELECT {d.explode(cells, 'cell')} FROM {rep} AS r) AS c"


# Bounds of the older validators.
LEGACY_AGE, LEGACY_INCOME, MINOR_INCOME = (18, 65), (1200, 25000), 8000


def cpf_masked(d: Spark, x: str) -> str:
    return _ok(d.matches(x, r"^[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}$"))


def legacy_raw_summary(d: Spark, rel: str, sex: str | None = None) -> str:
    """Counters of the older check of raw numbers: violations per row and conformity. ``sex``: the 0/1 column, where there is one."""
    one = lambda p: f"CAST(coalesce(sum(CASE WHEN {p} THEN 1 ELSE 0 END), 0) AS BIGINT)"
    counters = {
        "idade_menor_18": one(f"Idade < {LEGACY_AGE[0]}"),
        "idade_maior_65": one(f"Idade > {LEGACY_AGE[1]}"),
        "renda_alta_para_menor": one(f"Idade < {LEGACY_AGE[0]} AND Renda > {MINOR_INCOME}"),
        "renda_fora_faixa": one(f"NOT coalesce(Renda BETWEEN {LEGACY_INCOME[0]} AND {LEGACY_INCOME[1]}, FALSE)"),
        "sexo_fora_0_1": one(f"NOT coalesce({sex} BETWEEN 0 AND 1, FALSE)") if sex else "CAST(0 AS BIGINT)",
    }
    total = " + ".join(counters)
    rate = f"CASE WHEN n = 0 THEN 0e0 ELSE ({total}) / CAST(n AS DOUBLE) END"
    return f"SELECT *, round({rate}, 6) AS violation_rate, round(1e0 - least(1e0, {rate}), 6) AS conformity FROM (SELECT count(*) AS n, {', '.join(f'{e} AS {c}' for c, e in counters.items())} FROM {rel} AS r) AS t"


def legacy_summary(d: Spark, rel: str) -> str:
    """The twelve counters of the older validator, which knew ages 18 to 65: errors per row and conformity."""
    f = final_rules(d)
    counters = {"cpf_formato": cpf_masked(d, "CPF"), "cpf_digito": f["CPF"], "cnh": f["CNH"], "titulo": f["Titulo_Eleitor"], "rg": f["RG"], "telefone": f["Telefone"], "idade": _ok(f"Idade BETWEEN {LEGACY_AGE[0]} AND {LEGACY_AGE[1]}")}
    sums = ", ".join(f"CAST(coalesce(sum(CASE WHEN {p} THEN 0 ELSE 1 END), 0) AS BIGINT) AS bad_{n}" for n, p in counters.items())
    twice = ", ".join(f"coalesce(max(CASE WHEN identifier = '{c}' THEN extra END), 0) AS dup_{c.lower()}" for c in domain.IDENTIFIERS)
    errors = " + ".join([*(f"bad_{n}" for n in counters), *(f"dup_{c.lower()}" for c in domain.IDENTIFIERS)])
    rate = f"CASE WHEN n = 0 THEN 0e0 ELSE ({errors}) / CAST(n AS DOUBLE) END"
    return f"SELECT *, round({rate}, 6) AS errors_per_row, round(1e0 - least(1e0, {rate}), 6) AS conformity FROM (SELECT count(*) AS n, {sums} FROM {rel} AS r) AS t CROSS JOIN (SELECT {twice} FROM ({duplicated_ids(d, rel)}) AS i) AS u"


# The columns that label the failures of a rule.
LABELS = {
    "region_state": ("Estado", "Regiao"), "state_municipality": ("Estado", "Municipio"), "state_ddd": ("Estado", "DDD"),
    "occupation_education": ("Escolaridade", "Ocupacao"), "occupation_age": ("Idade", "Ocupacao"), "marital_age": ("Idade", "Estado_Civil"),
}


def invalid_combinations(d: Spark, rel: str, k: int = 10) -> str:
    """Per rule the k most frequent values that break it (a report's top-k), labelled by the rule's columns, or by what is wrong with a number."""
    shown = {n: " , ' | ', ".join(f"coalesce(CAST({c} AS VARCHAR(60)), 'nan')" for c in cs) for n, cs in LABELS.items()}
    label = {n: f"concat({e})" for n, e in shown.items()}
    label |= {f"{a}_domain": canonical.failure_label(d, c, *map(float, b)) for a, c, b in (("age", "Idade", domain.AGE), ("income", "Renda", domain.INCOME), ("dependents", "Dependentes", domain.DEPENDENTS))}
    r = {n: p for n, p in rules(d).items() if n in label}
    keep = ("Idade", "Renda", "Dependentes", "Regiao", "Estado", "Municipio", "DDD", "Escolaridade", "Estado_Civil", "Ocupacao")
    cells = [f"CASE WHEN ok_{n} THEN NULL ELSE concat('{n}{chr(1)}', {label[n]}) END" for n in r]
    counts = f"(SELECT cell, count(*) AS n FROM (SELECT {d.explode(cells, 'cell')} FROM {masks_sql(d, rel, r, keep)} AS m) AS c WHERE cell IS NOT NULL GROUP BY cell)"
    placed = f"(SELECT split_part(cell, '{chr(1)}', 1) AS rule, split_part(cell, '{chr(1)}', 2) AS combination, n, row_number() OVER (PARTITION BY split_part(cell, '{chr(1)}', 1) ORDER BY n DESC, cell) AS place FROM {counts} AS c)"
    return f"SELECT rule, combination, n FROM {placed} AS p WHERE place <= {k}"


def dominant_rule(d: Spark, rel: str) -> str:
    """The rule, conjunctions left out, that most rows break (ties: the first in order)."""
    r = {n: p for n, p in rules(d).items() if n not in COMPOSED}
    order = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(r))
    return f"SELECT rule, total, invalid, valid_rate FROM ({rule_counts(d, rel, r)}) AS c ORDER BY invalid DESC, CASE rule {order} END LIMIT 1"
