"""Row generators: every value is a function of seed, row id and draw, so partitions and retries don't matter.

A generator is a list of steps, each a set of new columns over the ones before: projections over
the ids, and for the occupation one join with a small table. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veredas.functions import domain
from veredas.functions.dialect import Spark, literal, lookup, pick

Steps = list[dict[str, str]]
_TWO_PI = "6.283185307179586e0"


def select_steps(source: str, steps: Steps, keep: Iterable[str]) -> str:
    """Nested projections: each step sees the columns of the step before."""
    for step in steps:
        source = f"(SELECT *, {', '.join(f'{e} AS {c}' for c, e in step.items())} FROM {source}) AS t"
    return f"(SELECT {', '.join(keep)} FROM {source})"


def _part(text: str, index: str) -> str:
    return f"split_part({text}, ',', {index})"


def _uniformly(u: str, n: str) -> str:
    return f"CAST(floor({u} * {n}) AS INT) + 1"


def _triangular(u: str, a: float, mode: float, b: float) -> str:
    cut = (mode - a) / (b - a)
    return f"CASE WHEN {u} < {cut!r}e0 THEN {a!r}e0 + sqrt({u} * {(b - a) * (mode - a)!r}e0) ELSE {b!r}e0 - sqrt((1e0 - {u}) * {(b - a) * (b - mode)!r}e0) END"


def _weights(names: Iterable[str], weights: Iterable[float]) -> dict[str, float]:
    return dict(zip(names, weights, strict=True))


# The weights, age modes and boosts below, up to the income steps.
def occupation_weights_sql(d: Spark) -> str:
    """(level, age, occupation, lo, hi): the unit interval dealt among the occupations that an education level and age may have."""
    rows = [(i, n, int(o["level"]), int(o["min"]), int(o["max"]), o["weight"], n in domain.POSTGRADUATE_BOOST) for i, (n, o) in enumerate(domain.OCCUPATIONS.items())]
    boost = """CASE WHEN occupation = 'Estudante' THEN CASE WHEN age <= 24 THEN 2.4e0 WHEN age <= 30 THEN 1.4e0 WHEN age >= 45 THEN 0.25e0 ELSE 1e0 END
      WHEN occupation = 'Estagiário' THEN CASE WHEN age <= 24 THEN 2.2e0 WHEN age <= 30 THEN 1.35e0 ELSE 0.45e0 END
      WHEN occupation = 'Aposentado' THEN CASE WHEN age >= 65 THEN 7e0 WHEN age >= 60 THEN 4e0 ELSE 0.35e0 END
      WHEN occupation IN ('Coordenador', 'Gerente') THEN CASE WHEN age >= 35 THEN 1.45e0 WHEN age < 28 THEN 0.45e0 ELSE 1e0 END
      WHEN occupation = 'Diretor' THEN CASE WHEN age >= 45 THEN 2.3e0 WHEN age < 35 THEN 0.3e0 ELSE 1e0 END ELSE 1e0 END"""
    return f"""(SELECT level, age, occupation, (upto - w) / total AS lo, CASE WHEN upto >= total THEN 2e0 ELSE upto / total END AS hi, w / total AS share FROM (
      SELECT *, sum(w) OVER (PARTITION BY level, age ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto,
             sum(w) OVER (PARTITION BY level, age ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total FROM (
        SELECT level, age, occupation, k, weight * {boost} * CASE WHEN level = 5 AND post THEN 1.75e0 ELSE 1e0 END AS w
        FROM {d.values(rows, 'k, occupation, least_level, least_age, most_age, weight, post')} AS o CROSS JOIN {d.numbers(1, 5, 'level')} AS l CROSS JOIN {d.numbers(18, 85, 'age')} AS a
        WHERE level >= least_level AND age BETWEEN least_age AND most_age) AS x) AS y)"""


def _attribute(key: str) -> str:
    return lookup("Ocupacao", {n: o[key] for n, o in domain.OCCUPATIONS.items() if o[key] != domain.DEFAULTS.get(key)}, domain.DEFAULTS.get(key))


# What version 3 of the income model changes in version 2 (deviation, tail probability and what is added to it, tail, variability, experience), by variant.
ADJUSTMENTS = {"candidate_a": (1.07, 1.20, 0.004, 1.10, 1.03, 0.02), "selected": (1.12, 1.35, 0.006, 1.18, 1.06, 0.04)}
INCOME_VERSIONS = (("v1", 1, "selected"), ("v2", 2, "selected"), ("v3_candidate_a", 3, "candidate_a"), ("v3_selected", 3, "selected"))


def income_steps(d: Spark, seed: int, key: str, version: int = 3, variant: str = "selected") -> Steps:
    """Income of rows with Idade, Regiao, Escolaridade and Ocupacao, of model version 1 (and below), 2 or 3 (and above)."""
    version = min(max(version, 1), 3)
    u = lambda draw: d.uniform(seed, key, f"income{version}_{draw}")
    normal = lambda a, b: f"sqrt(-2e0 * ln(1e0 - {a})) * cos({_TWO_PI} * {b})"
    steps: Steps = [
        {"i_u1": u("u1"), "i_u2": u("u2"), "i_u3": u("u3"), "i_u4": u("u4"), "i_up": u("p")},
        {"z1": normal("i_u1", "i_u2"), "z2": normal("i_u3", "i_u4"), "o_mult": _attribute("mult"), "o_var": _attribute("var"), "e_mult": lookup("Escolaridade", domain.EDUCATION), "g_mult": lookup("Regiao", {k: v[1] for k, v in domain.REGIONS.items()})},
    ]
    if version == 1:
        age = "(0.72e0 + least(Idade, 58) / 58e0) * CASE WHEN Idade >= 67 THEN 0.88e0 ELSE 1e0 END"
        value = f"exp(ln(2100e0) + 0.52e0 * o_var * z1) * {age} * e_mult * o_mult * g_mult * CASE WHEN i_up < 0.12e0 THEN exp(0.30e0 * o_var * z2) ELSE 1e0 END"
    else:
        v, sigma, exp_, tail_p, tail_s = ("o_var", "o_sigma * o_var", "o_exp", "o_tail_p", "o_tail_s * o_var")
        if version == 3:
            wide, often, more, far, vary, learn = ADJUSTMENTS[variant]
            v = f"(1e0 + (o_var - 1e0) * {vary!r}e0)"
            sigma, exp_, tail_p, tail_s = f"o_sigma * {wide!r}e0 * {v}", f"least(o_exp + {learn!r}e0, 0.90e0)", f"least(o_tail_p * {often!r}e0 + {more!r}e0, 0.18e0)", f"o_tail_s * {far!r}e0 * {v}"
        steps.append({f"o_{k}": _attribute(k) for k in ("loc", "sigma", "tail_p", "tail_s", "edu", "exp", "min")})
        grown = f"(0.86e0 + greatest(0e0, least(1e0, (Idade - o_min) / greatest(38e0, 65e0 - o_min))) * {exp_}) * CASE WHEN Idade >= 67 THEN 0.92e0 ELSE 1e0 END"
        value = f"exp(ln(2050e0 * o_loc) + {sigma} * z1) * o_mult * (1e0 + (e_mult - 1e0) * o_edu) * {grown} * (1e0 + (g_mult - 1e0) * 0.72e0) * CASE WHEN i_up < {tail_p} THEN exp({tail_s} * z2) ELSE 1e0 END"
    steps.append({"Renda": d.bround(f"least({domain.INCOME[1]!r}e0, greatest({domain.INCOME[0]!r}e0, {value}))", 2)})
    return steps


def profile_steps(d: Spark, seed: int, key: str = "row_id") -> Steps:
    """The model columns but occupation and income from a row id."""
    picked = ("region", "bucket", "gender", "edu", "marital", "deps")
    u = {k: (d.draw if k in picked else d.uniform)(seed, key, k) for k in ("region", "state", "city", "ddd", "bucket", "age", "gender", "edu", "occ", "marital", "deps")}
    states = {r: [s for s, v in domain.STATES.items() if v[0] == r] for r in domain.REGIONS}
    ages = [("young", 18.0, 25.0, 34.0), ("adult", 28.0, 40.0, 54.0), ("mature", 45.0, 56.0, 70.0), ("senior", 61.0, 68.0, 85.0)]
    buckets = _weights([a[0] for a in ages], [0.24, 0.39, 0.27, 0.10])
    edu = lambda *w: pick(d, "u_edu", _weights(domain.EDUCATION, w))
    mar = lambda *w: pick(d, "u_marital", _weights(domain.MARITAL, w))
    dep = lambda *w: pick(d, "u_deps", _weights([str(k) for k in range(7)], w))
    return [
        {f"u_{k}": e for k, e in u.items()},
        {"Regiao": pick(d, "u_region", {r: w for r, (w, _) in domain.REGIONS.items()}), "Genero": pick(d, "u_gender", domain.GENDERS), "age_bucket": pick(d, "u_bucket", buckets)},
        {"Estado": d.part_by("Regiao", states, _uniformly("u_state", lookup("Regiao", {r: len(s) for r, s in states.items()}))), "age_raw": f"CASE age_bucket {' '.join(f'WHEN {literal(n)} THEN {_triangular("u_age", a, m, b)}' for n, a, m, b in ages)} END"},
        {
            "Municipio": d.part_by("Estado", {s: list(v[1]) for s, v in domain.STATES.items()}, _uniformly("u_city", "3")),
            "DDD": f"CAST({d.part_by('Estado', {s: list(map(str, v[2])) for s, v in domain.STATES.items()}, _uniformly('u_ddd', lookup('Estado', {s: len(v[2]) for s, v in domain.STATES.items()})))} AS INT)",
            "Idade": f"CAST(greatest(18e0, least(85e0, {d.bround('age_raw')})) AS INT)",
        },
        {"Escolaridade": f"CASE WHEN Idade < 22 THEN {edu(.10, .45, .36, .08, .01)} WHEN Idade < 30 THEN {edu(.08, .34, .22, .29, .07)} WHEN Idade < 55 THEN {edu(.14, .39, .08, .29, .10)} ELSE {edu(.28, .38, .02, .24, .08)} END",
         "Estado_Civil": f"CASE WHEN Idade < 25 THEN {mar(.82, .08, .08, .02, 0)} WHEN Idade < 40 THEN {mar(.38, .34, .18, .09, .01)} WHEN Idade < 65 THEN {mar(.18, .50, .12, .17, .03)} ELSE {mar(.12, .44, .06, .16, .22)} END"},
        {"edu_level": lookup("Escolaridade", {e: i + 1 for i, e in enumerate(domain.EDUCATION)})},
        {
         "Dependentes": f"CAST(CASE WHEN Idade < 24 THEN {dep(.84, .13, .03, 0, 0, 0, 0)} WHEN Estado_Civil IN ('Casado', 'União Estável') AND Idade BETWEEN 28 AND 55 THEN {dep(.20, .25, .30, .16, .06, .02, .01)} WHEN Estado_Civil = 'Solteiro' THEN {dep(.66, .20, .10, .03, .01, 0, 0)} WHEN Idade >= 60 THEN {dep(.45, .24, .18, .08, .03, .01, .01)} ELSE {dep(.32, .26, .24, .12, .04, .01, .01)} END AS INT)"},
    ]


def once(d: Spark, source: str, steps: Steps, keep: Iterable[str], columns: Iterable[str]) -> str:
    """The columns ``keep`` of a source and the ``columns`` that the steps give, each computed once a row."""
    inner = select_steps(source, steps, (*keep, *(f"{c} AS made_{c}" for c in columns)))
    return f"(SELECT {', '.join((*keep, *columns))} FROM {d.fixed(f'{inner} AS made', {c: f'made_{c}' for c in columns})} AS kept)"


def _occupied(d: Spark, ids: str, seed: int, columns: tuple[str, ...] = domain.MODEL_COLUMNS) -> str:
    """The profile (columns that are wanted, and what income rests on) with its occupation: a small table, joined by level, age and the interval that holds the draw."""
    wanted = {*columns, "Idade", "Regiao", "Escolaridade"} - {"Ocupacao", "Renda"}
    base = once(d, d.spread(ids), profile_steps(d, seed), ("row_id",), ("u_occ", "edu_level", *(c for c in domain.MODEL_COLUMNS if c in wanted)))
    return f"(SELECT {d.small('o')}p.*, o.occupation AS Ocupacao FROM {base} AS p JOIN {occupation_weights_sql(d)} AS o ON p.edu_level = o.level AND p.Idade = o.age AND p.u_occ >= o.lo AND p.u_occ < o.hi) AS j"


def _with_occupations(d: Spark, ids: str, seed: int, version: int, variant: str = "selected", columns: tuple[str, ...] = domain.MODEL_COLUMNS) -> str:
    """The profile with its occupation and income."""
    return once(d, _occupied(d, ids, seed, columns), income_steps(d, seed, "row_id", version, variant), ("row_id",), columns)


def incomes_sql(d: Spark, ids: str, seed: int = 41) -> str:
    """row_id, Ocupacao and ``Renda_<version>`` of every version of the income model: the people are made once, not once a version."""
    together: Steps = []
    for name, version, variant in INCOME_VERSIONS:
        steps = income_steps(d, seed, "row_id", version, variant)
        own = re.compile(rf"\b({'|'.join(c for step in steps for c in step)})\b")
        for i, step in enumerate(steps):
            if i == len(together):
                together.append({})
            together[i] |= {f"{c}_{name}": own.sub(rf"\1_{name}", e) for c, e in step.items()}
    return once(d, _occupied(d, ids, seed), together, ("row_id",), ("Ocupacao", *(f"Renda_{name}" for name, _, _ in INCOME_VERSIONS)))


def profiles_sql(d: Spark, ids: str, seed: int = 41, version: int = 3, variant: str = "selected", columns: tuple[str, ...] = domain.MODEL_COLUMNS) -> str:
    """row_id and the model columns (or those of them that are wanted) for a relation with a row_id."""
    return _with_occupations(d, ids, seed, version, variant, columns)


def _digits(number: str, n: int) -> list[str]:
    """Digits of a number below 10**n, leftmost first."""
    return [f"(CAST(floor({number} / 1e{n - 1 - i}) AS BIGINT) % 10)" for i in range(n)]


def _bijection(row: str, modulus: int, factor: int, shift: int) -> str:
    """Distinct rows below the modulus get distinct numbers below it (the factor shares no divisor with it)."""
    return f"((({row} % {modulus}) * {factor} + {shift}) % {modulus})"


def _sum(digits: list[str], weights: Iterable[int]) -> str:
    return " + ".join(f"{w} * {x}" for x, w in zip(digits, weights, strict=False))


def _by_numbers(d: Spark, people: dict[str, str]) -> Steps:
    """The last of :func:`identifier_steps` on whole numbers of row ids from 0 on: digits are cut from a number's text, and no column holds a single one."""
    b, h, t = d.digits_of("n_cpf", 9), d.digits_of("n_cnh", 9), d.digits_of("n_vote", 8)
    # A 1 in front keeps the zeros.
    shown = {f"s_{n}": f"CAST({10**k} + n_{n} AS STRING)" for n, k in (("cpf", 9), ("cnh", 9), ("vote", 8), ("rg", 8), ("phone", 8))}
    cut = lambda n, first, size: f"substr(s_{n}, {first + 2}, {size})"
    return [
        {**shown, "cpf1": d.check_low(_sum(b, range(10, 1, -1))), "cnh1": d.check_ten(_sum(h, range(9, 0, -1))), "cnh2": d.check_ten(_sum(h, range(1, 10))), "vote1": d.check_ten(_sum(t, range(9, 1, -1)))},
        {"cpf2": d.check_low(f"{_sum(b, range(11, 2, -1))} + 2 * cpf1"), "vote2": d.check_ten(f"{_sum(t, range(8, 0, -1))} + 9 * vote1 + 10 * uf")},
        {
            **people,
            "CPF": f"concat({cut('cpf', 0, 3)}, '.', {cut('cpf', 3, 3)}, '.', {cut('cpf', 6, 3)}, '-', cpf1, cpf2)",
            "CNH": f"concat({cut('cnh', 0, 9)}, cnh1, cnh2)",
            "RG": f"concat({cut('rg', 0, 2)}, '.', {cut('rg', 2, 3)}, '.', {cut('rg', 5, 3)}, '-', n_rg % 9)",
            "Titulo_Eleitor": f"concat({cut('vote', 0, 8)}, lpad(CAST(uf AS STRING), 2, '0'), vote1, vote2)",
            "Telefone": f"CASE WHEN DDD IS NOT NULL THEN concat('(', DDD, ') 9', {cut('phone', 0, 4)}, '-', {cut('phone', 4, 4)}) END",
        },
    ]


def identifier_steps(d: Spark, seed: int, key: str = "row_id") -> Steps:
    """Names, birth dates and the five identifiers; identifiers are unique by construction for the first 99,999,989 row ids.

    The masks of RG, Titulo and Telefone have eight free digits: beyond, their numbers come again (a validator
    finds them), while CPF and CNH go on to 999,999,937. Row ids of any size are allowed.
    """
    text = lambda parts: f"concat({', '.join(parts)})"
    name = lambda g: d.part(domain.FIRST_NAMES[g].split(","), _uniformly("u_first", "12"))
    drawn = {"u_first": d.uniform(seed, key, "first"), "u_last": d.uniform(seed, key, "last"), "u_sex": d.draw(seed, key, "sex"), "u_birth": d.uniform(seed, key, "birth"),
             "n_cpf": _bijection(key, 999_999_937, 700_000_009, 123_456), "n_cnh": _bijection(key, 999_999_937, 600_000_007, 654_321), "n_rg": _bijection(key, 99_999_989, 61_000_011, 777), "n_phone": _bijection(key, 99_999_989, 53_000_017, 4_321), "n_vote": _bijection(key, 99_999_989, 71_000_003, 999), "uf": f"1 + CAST(floor({d.uniform(seed, key, 'uf')} * 28) AS INT)"}
    people = {
        "Nome": f"concat(CASE WHEN Genero = 'Feminino' OR (Genero = 'Outro' AND {d.under('u_sex', 0.5)}) THEN {name('Feminino')} ELSE {name('Masculino')} END, ' ', {d.part(domain.LAST_NAMES.split(','), _uniformly('u_last', '16'))})",
        "Data_Nascimento": d.born("Idade", "u_birth", domain.REFERENCE_DATE),
    }
    if d.staged:
        return [drawn, *_by_numbers(d, people)]
    low = lambda x: f"CASE WHEN {x} > 9 THEN 0 ELSE {x} END"
    ten = lambda x: f"CASE WHEN {x} = 10 THEN 0 ELSE {x} END"
    b = [f"b{i}" for i in range(9)]
    h = [f"h{i}" for i in range(9)]
    t = [f"t{i}" for i in range(8)]
    return [
        drawn,
        {**dict(zip(b, _digits("n_cpf", 9), strict=True)), **dict(zip(h, _digits("n_cnh", 9), strict=True)), **dict(zip(t, _digits("n_vote", 8), strict=True)), **{f"p{i}": x for i, x in enumerate(_digits("n_rg", 8))}, **{f"f{i}": x for i, x in enumerate(_digits("n_phone", 8))}},
        {"cpf1": low(f"(11 - ({_sum(b, range(10, 1, -1))}) % 11)"), "cnh1": ten(f"(({_sum(h, range(9, 0, -1))}) % 11)"), "cnh2": ten(f"(({_sum(h, range(1, 10))}) % 11)"), "vote1": ten(f"(({_sum(t, range(9, 1, -1))}) % 11)")},
        {"cpf2": low(f"(11 - ({_sum([*b, 'cpf1'], range(11, 1, -1))}) % 11)"), "vote2": ten(f"(({_sum(t, range(8, 0, -1))} + 9 * vote1 + 10 * uf) % 11)")},
        {
            **people,
            "CPF": text([*b[:3], "'.'", *b[3:6], "'.'", *b[6:], "'-'", "cpf1", "cpf2"]),
            "CNH": text([*h, "cnh1", "cnh2"]),
            "RG": text(["p0", "p1", "'.'", "p2", "p3", "p4", "'.'", "p5", "p6", "p7", "'-'", "(n_rg % 9)"]),
            "Titulo_Eleitor": text([*t, "lpad(CAST(uf AS VARCHAR(2)), 2, '0')", "vote1", "vote2"]),
            "Telefone": f"CASE WHEN DDD IS NOT NULL THEN {text(["'('", 'DDD', "') 9'", *(f'f{i}' for i in range(4)), "'-'", *(f'f{i}' for i in range(4, 8))])} END",
        },
    ]


def final_profiles_sql(d: Spark, ids: str, seed: int = 41) -> str:
    """row_id and the eighteen final columns."""
    return once(d, f"{_with_occupations(d, ids, seed, 3)} AS m", identifier_steps(d, seed), ("row_id",), domain.FINAL_COLUMNS)


def broken_profiles_sql(d: Spark, ids: str, seed: int = 41, columns: tuple[str, ...] = domain.FINAL_COLUMNS) -> str:
    """Final profiles with a known share of defects, as raw model output would have: for validators to find. ``columns``: those that are wanted."""
    f = lambda draw, share: d.under(d.draw(seed, "row_id", "bad_" + draw), share)
    plain = lookup("Escolaridade", {new: old for old, new in domain.ALIASES.items() if new in domain.EDUCATION})
    changed = {
        "Estado": f"CASE WHEN {f('state', 0.02)} THEN 'ZZ' ELSE Estado END",
        "DDD": f"CASE WHEN {f('ddd', 0.02)} THEN 11 WHEN {f('noddd', 0.005)} THEN NULL ELSE DDD END",
        "Idade": f"CASE WHEN {f('age', 0.01)} THEN 17 ELSE Idade END",
        "Renda": f"CASE WHEN {f('income', 0.01)} THEN 700.5e0 WHEN {f('noincome', 0.005)} THEN NULL ELSE Renda END",
        "Escolaridade": f"CASE WHEN {f('alias', 0.03)} THEN coalesce({plain}, Escolaridade) WHEN {f('edu', 0.02)} THEN 'Fundamental' ELSE Escolaridade END",
        "Estado_Civil": f"CASE WHEN {f('widow', 0.02)} THEN 'Viúvo' ELSE Estado_Civil END",
        "CPF": f"CASE WHEN {f('cpf', 0.01)} THEN '529.982.247-25' WHEN {f('cpfbad', 0.01)} THEN '529.982.247-24' ELSE CPF END",
        "CNH": f"CASE WHEN {f('cnh', 0.01)} THEN '12345678900' ELSE CNH END",
        "RG": f"CASE WHEN {f('rg', 0.01)} THEN '1.234' ELSE RG END",
        "Telefone": f"CASE WHEN {f('phone', 0.01)} THEN '99999-9999' ELSE Telefone END",
        "Titulo_Eleitor": f"CASE WHEN {f('vote', 0.01)} THEN '000000000199' ELSE Titulo_Eleitor END",
        "Data_Nascimento": f"CASE WHEN {f('birth', 0.01)} THEN '1901-02-03' WHEN {f('nobirth', 0.005)} THEN 'x' ELSE Data_Nascimento END",
    }
    defects = {f"bad_{c}": e for c, e in changed.items() if c in columns}
    cols = ", ".join(f"bad_{c} AS {c}" if c in changed else c for c in columns)
    clean = profiles_sql(d, ids, seed, columns=columns) if set(columns) <= set(domain.MODEL_COLUMNS) else final_profiles_sql(d, ids, seed)
    return f"(SELECT row_id, {cols} FROM {d.fixed(f'{clean} AS clean', defects)} AS changed)"


def split_sql(d: Spark, source: str, holdout: int | None = None, seed: int = 41, fraction: float | None = None) -> str:
    """Adds ``side``: exactly ``holdout`` rows (or ``fraction`` of all, rounded half to even, one at least) of smallest hashed id are held out.

    Hashes are counted by their first four digits; only the block that holds the last chosen row is put in order,
    so that no task sees more than a 65,536th of the rows, however many are held out.
    """
    size = str(int(holdout)) if holdout is not None else f"greatest(1, CAST({d.bround(f'count(*) * {fraction!r}e0')} AS BIGINT))"
    hashed = f"(SELECT row_id, md5(concat_ws('|', '{seed}', CAST(row_id AS VARCHAR(20)), 'split')) AS h FROM {source} AS s)"
    blocks = f"(SELECT substr(h, 1, 4) AS block, count(*) AS n FROM {hashed} AS b GROUP BY substr(h, 1, 4))"
    # One row a block: the window over 65,536 of them is small.
    upto = f"(SELECT block, n, sum(n) OVER (ORDER BY block ROWS UNBOUNDED PRECEDING) AS upto FROM {blocks} AS c)"
    last = f"(SELECT block, {size.replace('count(*)', 'total')} - (upto - n) AS wanted FROM {upto} AS u CROSS JOIN (SELECT count(*) AS total FROM {source} AS t) AS t WHERE upto >= {size.replace('count(*)', 'total')} AND upto - n < {size.replace('count(*)', 'total')})"
    cut = f"(SELECT max(h) AS cut FROM (SELECT h, wanted, row_number() OVER (ORDER BY h) AS place FROM {hashed} AS r JOIN {last} AS l ON substr(r.h, 1, 4) = l.block) AS p WHERE place <= wanted)"
    return f"(SELECT row_id, CASE WHEN h <= cut THEN 'holdout' ELSE 'train' END AS side FROM {hashed} AS f CROSS JOIN {cut} AS k)"


def conditional_sample_sql(d: Spark, ids: str, occupation: str, seed: int = 41, version: int = 3, variant: str = "selected") -> str:
    """row_id, Ocupacao and Renda of made-up people of one occupation: education among the allowed ones, age in the occupation's bounds (up to 75 where it has none) and region, all uniformly."""
    o = domain.OCCUPATIONS[occupation]
    low, high = int(o["min"]), int(o["max"]) if o["max"] < 200 else 75
    levels, regions = list(domain.EDUCATION)[int(o["level"]) - 1 :], list(domain.REGIONS)
    u = lambda draw: d.uniform(seed + 1009 * version, "row_id", f"{variant}_{draw}")
    of = lambda values, draw: _part(literal(",".join(values)), _uniformly(u(draw), str(len(values))))
    people = d.fixed(f"{ids} AS i", {"Ocupacao": literal(occupation), "Escolaridade": of(levels, "edu"), "Regiao": of(regions, "region"), "Idade": f"{low} + CAST(floor({u('age')} * {high - low + 1}) AS INT)"})
    return select_steps(f"{people} AS people", income_steps(d, seed, "row_id", version, variant), ("row_id", "Ocupacao", "Renda"))


def legacy_income_sql(d: Spark, ids: str, seed: int = 41) -> str:
    """row_id and an income of the oldest model: log-normal around exp(8), within the bounds."""
    u = lambda draw: d.uniform(seed, "row_id", f"legacy_{draw}")
    value = f"exp(8e0 + 0.55e0 * sqrt(-2e0 * ln(1e0 - {u('u1')})) * cos({_TWO_PI} * {u('u2')}))"
    return f"(SELECT row_id, {d.bround(f'greatest({domain.INCOME[0]!r}e0, least({value}, {domain.INCOME[1]!r}e0))', 2)} AS Renda FROM {ids} AS i)"


def accounting_sql(d: Spark, masks: str, n: int) -> str:
    """One row on a table of row_id, batch, batch_valid and valid: candidates, accepted by batch and by global rules, selected (the first ``n`` valid ones), surplus, rejected, rows on which both masks differ, and rates.

    total = accepted + rejected, and accepted = selected + surplus.
    """
    one = lambda p: f"CAST(coalesce(sum(CASE WHEN {p} THEN 1 ELSE 0 END), 0) AS BIGINT)"
    return f"""SELECT total, accepted_batch, accepted, least(accepted, {n}) AS selected, greatest(accepted - {n}, 0) AS surplus, total - accepted AS rejected, total - accepted_batch AS rejected_batch, disagreeing, batches,
      CASE WHEN total = 0 THEN 0e0 ELSE round(accepted / CAST(total AS DOUBLE), 6) END AS acceptance_rate FROM (SELECT count(*) AS total, {one('batch_valid')} AS accepted_batch, {one('valid')} AS accepted, {one('batch_valid AND NOT valid')} AS disagreeing, count(DISTINCT batch) AS batches FROM {masks} AS m) AS t"""


def select_first_sql(masks: str, n: int) -> str:
    """The row ids of the first ``n`` valid rows: a top-k, no full sort."""
    return f"(SELECT row_id FROM {masks} AS m WHERE valid ORDER BY row_id LIMIT {n})"


def cross_batch_duplicates(d: Spark, rel: str, columns: tuple[str, ...] = domain.IDENTIFIERS) -> str:
    """Occurrences beyond the first of identifiers that stand in more than one batch, summed over the identifiers; ``rel`` has a ``batch``."""
    cells = [f"CASE WHEN {c} IS NULL THEN NULL ELSE concat('{c}{chr(1)}', {c}) END" for c in columns]
    per = f"(SELECT cell, batch, count(*) AS n FROM (SELECT batch, {d.explode(cells, 'cell')} FROM {rel} AS b) AS l WHERE cell IS NOT NULL GROUP BY cell, batch)"
    return f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates, count(*) AS n_values FROM (SELECT cell, sum(n) AS n, count(*) AS batches FROM {per} AS p GROUP BY cell) AS g WHERE batches > 1"


def generate_profiles(ids: DataFrame, seed: int = 41, version: int = 3) -> DataFrame:
    """The model columns for a frame with a row_id."""
    return ids.sparkSession.sql(f"SELECT * FROM {profiles_sql(Spark(), '{ids}', seed, version)}", ids=ids.select("row_id"))


def generate_final_profiles(ids: DataFrame, seed: int = 41) -> DataFrame:
    """The final columns for a frame with a row_id."""
    return ids.sparkSession.sql(f"SELECT * FROM {final_profiles_sql(Spark(), '{ids}', seed)}", ids=ids.select("row_id"))


def accept(candidates: DataFrame, valid: str, n: int) -> DataFrame:
    """The first ``n`` valid rows by row id: a top-k, no full sort. Raises where there are fewer."""
    found = candidates.where(valid).orderBy("row_id").limit(n)
    if found.count() < n:
        raise ValueError(f"fewer than {n} valid rows")
    return found


@dataclass(frozen=True)
class Accepted:
    """Chosen rows and how they came about."""

    rows: DataFrame
    candidates: int
    accepted: int
    batches: int

    @property
    def surplus(self) -> int:
        return self.accepted - self.rows.count()


#: Cells of a batch (identifiers by row) that are broadcast against those used before; more are joined by a shuffle.
BROADCAST_CELLS = 500_000


def _cells(rows: DataFrame, identifiers: Iterable[str]) -> DataFrame:
    """row_id and ``cell`` for every identifier of the rows that has a value."""
    named = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in identifiers])
    return rows.select("row_id", F.explode(named).alias("cell")).where("cell.value IS NOT NULL").select("row_id", "cell.name", "cell.value")


def _clashing(rows: DataFrame, used: DataFrame | None, identifiers: Iterable[str]) -> DataFrame:
    """The row ids that repeat an identifier used before, or one of an earlier row of their own."""
    cells = _cells(rows, identifiers)
    first = cells.groupBy("name", "value").agg(F.min("row_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    later = cells.join(first, ["name", "value"]).where("row_id > first_id").select("row_id")
    if used is None:
        return later.distinct()
    small = cells.count() <= BROADCAST_CELLS
    # The batch is the small side: what was used before is only scanned.
    again = used.join(F.broadcast(cells) if small else cells, ["name", "value"]).select("row_id")
    return later.union(again).distinct()


def accept_in_batches(
    make: Callable[[int, int], DataFrame],
    judge: Callable[[DataFrame], DataFrame],
    n: int,
    batch_rows: int,
    max_batches: int,
    identifiers: Iterable[str] = domain.IDENTIFIERS,
    redraw: Callable[[DataFrame, int], DataFrame] | None = None,
    redraws: int = 8,
) -> Accepted:
    """Makes batches until ``n`` candidates are valid together, and returns the first ``n`` by row id.

    ``make(first_row, rows)`` gives a batch, ``judge(batch)`` gives row_id and valid by the rules of rows. Between batches lies a state of
    two tables: the accepted rows and the identifiers used so far. A batch is made and judged once and written; its
    identifiers are held against the used ones. A row that repeats one gets others by ``redraw(rows, attempt)``, where that is given, up to
    ``redraws`` times, and is rejected after that. So k batches cost k batches, and a scan of the used identifiers each. Raises after
    ``max_batches``.
    """
    from veredas.session import work_folder

    identifiers = list(identifiers)
    folder, spark, total, used, made = None, None, 0, None, 0
    for k in range(1, max_batches + 1):
        batch = make((k - 1) * batch_rows, batch_rows)
        if folder is None:
            spark = batch.sparkSession
            folder = work_folder(spark, "acceptance")

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")  # noqa: B023
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}")  # noqa: B023

        batch = kept(batch, f"batch-{k}-0")
        clash = kept(_clashing(batch, used, identifiers), f"clash-{k}-0")
        for attempt in range(1, redraws + 1) if redraw else ():
            if clash.isEmpty():
                break
            again = redraw(batch.join(clash, "row_id", "left_semi"), attempt).select(batch.columns)
            batch = kept(batch.join(clash, "row_id", "left_anti").unionByName(again), f"batch-{k}-{attempt}")
            clash = kept(_clashing(batch, used, identifiers), f"clash-{k}-{attempt}")
        made += batch.count()
        good = judge(batch).where("valid").select("row_id").join(clash, "row_id", "left_anti")
        total += kept(batch.join(good, "row_id", "left_semi"), f"accepted/batch={k}").count()
        _cells(batch, identifiers).select("name", "value").distinct().write.parquet(f"{folder}/used/batch={k}")
        used = spark.read.schema("name string, value string").parquet(f"{folder}/used")
        if total >= n:
            rows = spark.read.schema(batch.schema).parquet(f"{folder}/accepted").select(batch.columns)
            return Accepted(rows.orderBy("row_id").limit(n), made, total, k)
    raise ValueError(f"fewer than {n} valid rows after {max_batches} batches")


def redraw_identifiers(rows: DataFrame, attempt: int, seed: int = 41, stride: int = 10_000_019) -> DataFrame:
    """Final rows with the identifiers of another number each: that of the row id moved on by ``attempt`` strides."""
    spark, moved = rows.sparkSession, rows.withColumn("number", F.col("row_id") + F.lit(attempt * stride))
    others = [c for c in domain.FINAL_COLUMNS if c not in domain.IDENTIFIERS]
    steps = [{k: e for k, e in step.items() if k not in others} for step in identifier_steps(Spark(), seed, "number")]
    return spark.sql(f"SELECT * FROM {select_steps('{rows}', steps, ('row_id', *domain.FINAL_COLUMNS))}", rows=moved.drop(*domain.IDENTIFIERS))
