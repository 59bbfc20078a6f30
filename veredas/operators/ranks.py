"""Exact ranks and quantiles of a column per group, without a task that sorts a whole group.

Values are counted first, so that repeated ones travel once a partition. Counts are then summed by bins of a
logarithmic scale, which rise with the value and need no look at the data: the few bins of a group are put in
order, and values are put in order inside their bin only. Ranks are the sums of both. Groups of null keys count like others.
"""

from __future__ import annotations

from collections.abc import Iterable

from veredas.functions.dialect import Spark

#: Bins to a doubling of the value.
STEPS = 64


def finite(x: str) -> str:
    """Neither null nor NaN nor infinite."""
    return f"({x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) < 1e308)"


def counted(rel: str, keys: dict[str, str], x: str, counts: dict[str, str], sets: str = "") -> str:
    """Keys, ``x`` and the sums of some 0/1 expressions per distinct finite value."""
    v = f"CAST({x} AS DOUBLE)"
    picked = ", ".join([*(f"{e} AS {k}" for k, e in keys.items()), f"{v} AS x", *(f"CAST(sum({e}) AS DOUBLE) AS {c}" for c, e in counts.items())])
    return f"(SELECT {picked} FROM {rel} AS counted WHERE {finite(v)} GROUP BY {sets or ', '.join([*keys.values(), v])})"


def ranked(values: str, keys: Iterable[str], counts: Iterable[str], known: bool = False) -> str:
    """Adds to counted values, per count c: ``c_before`` (of smaller values) and ``c_all`` of the group; and the group's next value ``nx``.

    ``known``: groups of null keys may be left out. Bins and values then meet by plain equality, on a bin that can't be null: no filter on it
    goes below the count of the values, which is shuffled once for both, and the values' shuffle by bin serves the window too.
    """
    keys, counts = list(keys), list(counts)
    cell = f"CAST(floor(log2(abs(x) + 1e0) * {STEPS}e0) AS INT) * CASE WHEN x < 0 THEN -1 ELSE 1 END"
    if known:
        cell = f"coalesce({cell}, 0)"
    base = f"(SELECT *, {cell} AS bin FROM {values} AS v)"
    by = f"PARTITION BY {', '.join(keys)}" if keys else ""
    bins = f"(SELECT {', '.join([*keys, 'bin'])}, min(x) AS x0, {', '.join(f'sum({c}) AS {c}' for c in counts)} FROM {base} AS b GROUP BY {', '.join([*keys, 'bin'])})"
    placed = ", ".join([*(f"sum({c}) OVER ({by} ORDER BY bin ROWS UNBOUNDED PRECEDING) - {c} AS {c}_low, sum({c}) OVER ({by}) AS {c}_all" for c in counts), f"lead(x0) OVER ({by} ORDER BY bin) AS x1"])
    places = f"(SELECT {', '.join([*keys, 'bin'])}, {placed} FROM {bins} AS t)"
    # The bin tells more rows apart than the keys, which counts when they are sorted.
    inside = f"PARTITION BY {', '.join(f'b.{k}' for k in (['bin', *keys] if known else [*keys, 'bin']))} ORDER BY b.x"
    out = [*(f"b.{k}" for k in keys), "b.x", *(f"b.{c}" for c in counts)]
    out += [f"p.{c}_low + sum(b.{c}) OVER ({inside} ROWS UNBOUNDED PRECEDING) - b.{c} AS {c}_before, p.{c}_all" for c in counts]
    on = " AND ".join([*(f"b.{k} {'=' if known else 'IS NOT DISTINCT FROM'} p.{k}" for k in keys), "b.bin = p.bin"])
    return f"(SELECT {', '.join(out)}, coalesce(lead(b.x) OVER ({inside}), p.x1) AS nx FROM {base} AS b JOIN {places} AS p ON {on})"


def at_rank(c: str, p: float, what: str) -> str:
    """An expression over the value that stands at the quantile's lower rank; an aggregate over ranked values."""
    low = f"floor({p!r}e0 * ({c}_all - 1))"
    return f"max(CASE WHEN {c}_before <= {low} AND {low} < {c}_before + {c} THEN {what} END)"


def quantile(c: str, p: float) -> str:
    """The interpolated quantile of the values that count ``c`` weighs; ``ranked`` must have no other value between them."""
    place = f"{p!r}e0 * ({c}_all - 1)"
    return at_rank(c, p, f"x + (CASE WHEN floor({place}) + 1 < {c}_before + {c} THEN x ELSE coalesce(nx, x) END - x) * ({place} - floor({place}))")


def share_above(c: str, p: float) -> str:
    """The share of values above the quantile: those after the ones at its lower rank."""
    return at_rank(c, p, f"({c}_all - {c}_before - {c}) / {c}_all")


def share_below(c: str, p: float) -> str:
    place = f"{p!r}e0 * ({c}_all - 1)"
    between = f"floor({place}) < {place} AND floor({place}) + 1 >= {c}_before + {c} AND nx > x"
    return at_rank(c, p, f"({c}_before + CASE WHEN {between} THEN {c} ELSE 0 END) / {c}_all")


def settled(x: str, digits: int = 6) -> str:
    """Rounded for a report. The step off ties (a thousandth of the last digit) is far above what the order of a sum changes, so that any partitioning gives the same digits."""
    return f"round({x} + 1e-{digits + 3}, {digits})"


def stats(c: str = "n") -> dict[str, str]:
    """Count, mean, sample deviation (null of one value) and extremes from counted values."""
    return {
        "n": f"CAST(sum({c}) AS BIGINT)",
        "mean": f"sum(x * {c}) / sum({c})",
        "std": f"CASE WHEN sum({c}) > 1 THEN sqrt(greatest(sum(x * x * {c}) - sum(x * {c}) * sum(x * {c}) / sum({c}), 0e0) / (sum({c}) - 1)) END",
        "lo": "min(x)",
        "hi": "max(x)",
    }


def group_quantiles(rel: str, keys: dict[str, str], x: str, ps: dict[str, float]) -> str:
    """Keys, ``n`` and named quantiles of every group."""
    r = ranked(counted(rel, keys, x, {"n": "1"}), keys, ["n"])
    picked = ", ".join([*keys, "CAST(sum(n) AS BIGINT) AS n", *(f"{quantile('n', p)} AS {name}" for name, p in ps.items())])
    return f"(SELECT {picked} FROM {r} AS r{' GROUP BY ' + ', '.join(keys) if keys else ''})"
