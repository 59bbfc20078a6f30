"""Canonical values: text in one spelling, numbers in one form, rows as hashes of both."""

from __future__ import annotations

from collections.abc import Iterable

from . import domain
from .dialect import Spark

INTEGERS = ("Idade", "Dependentes", "DDD")
MONEY = ("Renda",)
MISSING = "'<NA>'"


def text(d: Spark, x: str) -> str:
    """Composed characters, then today's spelling of old values; null stays null."""
    return d.composed_and_spelled(x, domain.ALIASES)


def number(x: str) -> str:
    """A double, or null where the text is none."""
    return f"TRY_CAST({x} AS DOUBLE)"


def _finite(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) < 1e18)"


def typed(d: Spark, column: str) -> str:
    """The column in its type: whole numbers rounded half to even, amounts as doubles, categories as canonical text."""
    n = number(column)
    if column in INTEGERS:
        return f"CASE WHEN {_finite(n)} THEN CAST({d.bround(n)} AS BIGINT) END"
    return n if column in MONEY else text(d, f"CAST({column} AS VARCHAR(200))")


def _quoted(x: str) -> str:
    return f"concat(chr(34), replace(replace({x}, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(34))"


def _amount(n: str) -> str:
    cents = f"CAST(round(abs({n}) * 100) AS BIGINT)"
    end = f"CASE WHEN {cents} % 10 = 0 THEN CAST(CAST(floor(({cents} % 100) / 10) AS BIGINT) AS VARCHAR(2)) ELSE lpad(CAST({cents} % 100 AS VARCHAR(2)), 2, '0') END"
    return f"concat(CASE WHEN {n} < 0 THEN '-' ELSE '' END, CAST(CAST(floor({cents} / 100) AS BIGINT) AS VARCHAR(30)), '.', {end})"


def cell(d: Spark, column: str) -> str:
    """A value as JSON: null is the text ``<NA>``, whole numbers are cut, amounts have two decimals, texts are canonical."""
    plain, n = f"CAST({column} AS VARCHAR(300))", number(column)
    said = _quoted(f"coalesce({text(d, plain)}, {MISSING})")
    if column in INTEGERS:
        return f"CASE WHEN {_finite(n)} THEN CAST(CAST({n} - {n} % 1 AS BIGINT) AS VARCHAR(30)) ELSE {said} END"
    return f"CASE WHEN {_finite(n)} THEN {_amount(n)} ELSE {said} END" if column in MONEY else said


def row_key(d: Spark, columns: Iterable[str]) -> str:
    """The hash of a row: of the JSON array of its canonical values."""
    return d.sha256(f"concat('[', concat_ws(',', {', '.join(cell(d, c) for c in columns)}), ']')")


def named_row_key(d: Spark, columns: Iterable[str]) -> str:
    """The hash of ``name=value`` pairs by name, joined by bars; null is ``<NA>``."""
    return d.sha256("concat_ws('|', " + ", ".join(f"concat('{c}=', coalesce(CAST({c} AS VARCHAR(300)), {MISSING}))" for c in sorted(columns)) + ")")


def compared(d: Spark, x: str, column: str) -> str:
    """What two stages of a row are compared by, for an expression of a column: whole numbers rounded, amounts to two decimals, null as ``<NA>``."""
    n = number(x)
    if column in INTEGERS:
        shown = f"CASE WHEN {_finite(n)} THEN CAST(CAST({d.bround(n)} AS BIGINT) AS VARCHAR(30)) END"
    elif column in MONEY:
        shown = f"CASE WHEN {_finite(n)} THEN {_amount(n)} END"
    else:
        shown = f"CAST({x} AS VARCHAR(300))"
    return f"coalesce({shown}, {MISSING})"


def failure_label(d: Spark, column: str, low: float, high: float) -> str:
    """Why a number is outside its domain."""
    n = number(column)
    whole = f" WHEN {n} % 1 <> 0 THEN '{column}=não_inteiro'" if column in INTEGERS else ""
    return f"CASE WHEN {n} IS NULL OR isnan({n}) THEN '{column}=não numérico' WHEN {n} < {low!r}e0 THEN '{column}=abaixo_do_mínimo' WHEN {n} > {high!r}e0 THEN '{column}=acima_do_máximo'{whole} ELSE '{column}=outro' END"


def gender_of(x: str) -> str:
    """The gender behind an old 0/1 code: rounded, then held to 0 and 1."""
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN round({x}) <= 0 THEN 'Feminino' ELSE 'Masculino' END"
