"""Given frames made whole: repaired model columns, a dense numbering, and the identifiers that follow from it.

Any frame will do: columns of any type, absent columns (drawn from the rules), old spellings, numbers as text. Rows get numbers from
their content alone: equal rows are counted, the counts are summed by blocks of the content's hash, and a
row's number is the sum of what lies before it. So the numbering has no gaps, does not depend on partitions, and no task holds more
than a block; a row that stands in the frame a billion times is one row until it is dealt out again, in lots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veredas.functions import canonical, domain
from veredas.functions.dialect import Spark, lookup

from . import generate, validate

#: Copies of a row that one task deals out.
LOT = 10_000


def repaired_sql(d: Spark, rel: str, seed: int = 41, keep: tuple[str, ...] = ("row_id",), columns: tuple[str, ...] = domain.MODEL_COLUMNS) -> str:
    """Repairs raw rows: text in today's spelling, numbers held to their ranges, the region of a state, and places redrawn inside the state.

    Numbers may be text: what is none counts as absent (age 18, income and dependents least). A state that is unknown keeps its places.
    ``columns``: those that are wanted; others need not be there, but for the state, on which the region and the places rest.
    """
    u = lambda x: d.uniform(seed, "row_id", x)
    read = {*columns, *(("Estado",) if {"Regiao", "Municipio", "DDD"} & set(columns) else ())}
    texts = tuple(c for c in domain.CATEGORIES if c in read)
    held = {f"t_{c}": canonical.text(d, f"CAST({c} AS VARCHAR(300))") for c in texts}
    held |= {f"v_{c}": f"CASE WHEN {canonical._finite(canonical.number(c))} THEN {canonical.number(c)} END" for c in ("Idade", "Renda", "Dependentes", "DDD") if c in read}
    clean = d.fixed(f"{rel} AS given", held)
    cities = lookup("t_Estado", {s: ",".join(v[1]) for s, v in domain.STATES.items()})
    codes = lookup("t_Estado", {s: ",".join(map(str, v[2])) for s, v in domain.STATES.items()})
    n_codes = lookup("t_Estado", {s: len(v[2]) for s, v in domain.STATES.items()})
    own_code = f"CAST({d.bround('v_DDD')} AS INT)"
    whole = lambda c, lo, hi: f"CAST(least({hi}e0, greatest({lo}e0, coalesce({d.bround(f'v_{c}')}, {lo}e0))) AS INT)"
    made = {
        "Genero": " t_Genero", "Estado": " t_Estado", "Estado_Civil": " t_Estado_Civil", "Ocupacao": " t_Ocupacao", "Escolaridade": " t_Escolaridade",
        "Idade": f"\n      {whole('Idade', *domain.AGE)}", "Renda": f" least({domain.INCOME[1]!r}e0, greatest({domain.INCOME[0]!r}e0, coalesce(v_Renda, {domain.INCOME[0]!r}e0)))", "Dependentes": f" {whole('Dependentes', *domain.DEPENDENTS)}",
        "Regiao": f"\n      coalesce({validate.region_of('t_Estado')}, t_Regiao)",
        "Municipio": f"\n      CASE WHEN {validate.city_in_state('t_Estado', 't_Municipio')} THEN t_Municipio ELSE coalesce(split_part({cities}, ',', 1 + CAST(floor({u('fix_city')} * 3) AS INT)), t_Municipio) END",
        "DDD": f"\n      CASE WHEN {validate.ddd_in_state('t_Estado', own_code)} THEN {own_code} ELSE coalesce(CAST(split_part({codes}, ',', 1 + CAST(floor({u('fix_ddd')} * {n_codes}) AS INT)) AS INT), {own_code}) END",
    }
    return f"(SELECT {', '.join(keep)},{','.join(f'{e} AS {c}' for c, e in made.items() if c in columns)} FROM {clean} AS clean)"


def numbered_sql(d: Spark, rel: str, columns: tuple[str, ...], first: int = 0) -> str:
    """``row_id`` from ``first`` on without gaps, and the columns: a function of the rows' content."""
    cols = ", ".join(columns)
    content = "concat_ws('|', " + ", ".join(f"coalesce(replace(CAST({c} AS VARCHAR(300)), '|', '||'), '{chr(2)}')" for c in columns) + ")"
    kinds = f"(SELECT {cols}, count(*) AS n FROM {rel} AS g GROUP BY {cols})"
    hashed = d.fixed(f"{kinds} AS kinds", {"h": d.digest(content)})
    block = d.block("h")
    blocks = f"(SELECT {block} AS block, sum(n) AS n FROM {hashed} AS b GROUP BY {block})"
    # One row a block: the window over 65,536 of them is small.
    starts = f"(SELECT block, sum(n) OVER (ORDER BY block ROWS UNBOUNDED PRECEDING) - n AS before_block FROM {blocks} AS s)"
    before = "sum(n) OVER (PARTITION BY {} ORDER BY h ROWS UNBOUNDED PRECEDING) - n AS before"
    inside = f"(SELECT *, {block} AS block, {before.format(block)} FROM {hashed} AS i)"
    if d.staged:
        # The block is a column before the window, whose shuffle and order then serve the join with the starts too.
        inside = f"(SELECT *, {before.format('block')} FROM (SELECT *, {block} AS block FROM {hashed} AS i) AS b)"
    lots = f"(SELECT {d.dealt('start, lot')}{cols}, before_block + before AS start, n, {d.counted_out(f'floor((n - 1) / {LOT}) + 1', 'lot')} FROM {inside} AS p JOIN {starts} AS q ON p.block = q.block)"
    places = f"(SELECT {cols}, start + lot * {LOT} AS start, {d.counted_out(f'least({LOT}, n - lot * {LOT})', 'place')} FROM {lots} AS l)"
    return f"(SELECT CAST({first} + start + place AS BIGINT) AS row_id, {cols} FROM {places} AS o)"


def final_sql(d: Spark, rel: str, seed: int = 41, first: int = 0) -> str:
    """The eighteen final columns, and row_id, of a relation with the eleven model columns of any type."""
    repaired = repaired_sql(d, numbered_sql(d, rel, domain.MODEL_COLUMNS, first), seed)
    rounded = f"(SELECT row_id, {', '.join(c for c in domain.MODEL_COLUMNS if c != 'Renda')}, {d.bround('Renda', 2)} AS Renda FROM {repaired} AS r)"
    return generate.once(d, f"{rounded} AS m", generate.identifier_steps(d, seed), ("row_id",), domain.FINAL_COLUMNS)


def completed(df: DataFrame, seed: int = 41) -> DataFrame:
    """``df`` with all model columns, as text where it has them; absent ones come from the rules, row by row.

    A column ``Sexo`` of 0/1 codes stands for an absent Genero. Columns that are no model columns are left out.
    """
    if "Sexo" in df.columns and "Genero" not in df.columns:
        df = df.withColumn("Genero", F.expr(canonical.gender_of(canonical.number("Sexo"))))
    missing = [c for c in domain.MODEL_COLUMNS if c not in df.columns]
    if len(missing) == len(domain.MODEL_COLUMNS):
        raise ValueError(f"none of the columns {', '.join(domain.MODEL_COLUMNS)} is there")
    there = tuple(c for c in domain.MODEL_COLUMNS if c not in missing)
    known = df.select(*(F.col(c).cast("string").alias(c) for c in there))
    if not missing:
        return known
    spark = df.sparkSession
    numbered = spark.sql(f"SELECT * FROM {numbered_sql(Spark(), '{given}', there)}", given=known)
    drawn = spark.sql(f"SELECT row_id AS drawn_id, {', '.join(missing)} FROM {generate.profiles_sql(Spark(), '{ids}', seed)}", ids=numbered.select("row_id"))
    return numbered.join(drawn, F.col("row_id") == F.col("drawn_id")).select(*(F.col(c).cast("string").alias(c) for c in domain.MODEL_COLUMNS))


def finalize(df: DataFrame, seed: int = 41, first: int = 0) -> DataFrame:
    """The eighteen final columns of a given frame; identifiers are unique, and those of row ids from ``first`` on."""
    return df.sparkSession.sql(f"SELECT {', '.join(('row_id', *domain.FINAL_COLUMNS))} FROM {final_sql(Spark(), '{given}', seed, first)}", given=completed(df, seed))
