"""Profiles as vectors and back: numbers scaled to [0, 1] by their domain, categories one-hot."""

from __future__ import annotations

from veredas.functions import domain
from veredas.functions.dialect import Spark, literal

#: Numbers with their domain and whether they are whole, in the order of the vector; then the categories.
NUMBERS = {"Idade": (*domain.AGE, True), "Renda": (*domain.INCOME, False), "Dependentes": (*domain.DEPENDENTS, True)}
CATEGORIES = {**domain.CATEGORIES, "DDD": tuple(sorted(x for v in domain.STATES.values() for x in v[2]))}


def width() -> int:
    return len(NUMBERS) + sum(map(len, CATEGORIES.values()))


def encode_sql(d: Spark, rel: str) -> str:
    """row_id and ``v``: the vector of a row. A missing number stands for its least value; an unknown category is all zeros."""
    scaled = [f"least(1e0, greatest(0e0, (coalesce(TRY_CAST({c} AS DOUBLE), {float(lo)!r}e0) - {float(lo)!r}e0) / {float(hi - lo)!r}e0))" for c, (lo, hi, _) in NUMBERS.items()]
    return f"(SELECT row_id, {d.vector(scaled, CATEGORIES)} AS v FROM {rel} AS e)"


def decode_sql(d: Spark, vectors: str) -> str:
    """row_id and the columns of a vector: numbers scaled back, held to their domain and whole where they must be; the category of the largest cell (the first of equal ones)."""
    out, at = [], 1
    for c, (lo, hi, whole) in NUMBERS.items():
        x = f"least({float(hi)!r}e0, greatest({float(lo)!r}e0, v[{d.index(at)}] * {float(hi - lo)!r}e0 + {float(lo)!r}e0))"
        out.append(f"CAST({d.bround(x)} AS INT) AS {c}" if whole else f"{x} AS {c}")
        at += 1
    for c, values in CATEGORIES.items():
        part = f"{d.sliced('v', at, len(values))}"
        names = d.listed([literal(x) for x in values])
        out.append(f"{names}[{d.first_largest(part)}] AS {c}")
        at += len(values)
    return f"SELECT row_id, {', '.join(out)} FROM {vectors} AS w"
