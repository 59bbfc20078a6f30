"""Quality gates: limits as a small table, from defaults and a configuration, applied to a row of metrics."""

from __future__ import annotations

from dataclasses import dataclass

from veredas.functions.dialect import Spark

# Limit and whether a failure rejects, per gate.
DEFAULTS: dict[str, tuple[float, bool]] = {
    "invalid_rows": (0.0, True), "duplicated_identifier": (0.0, True), "null_required_fields": (0.0, True), "exact_train_match_rate": (0.01, True),
    "duplicate_base_row_rate": (0.01, False), "total_variation_distance": (0.25, False), "correlation_difference": (0.30, False),
}
MIN_ROWS = 100
#: A gate whose metric may be missing.
OPTIONAL = ("duplicate_base_row_rate",)


@dataclass(frozen=True)
class Gate:
    """A largest value of a metric."""

    metric: str
    limit: float
    mandatory: bool


def configured(config: dict[str, object] | None = None) -> tuple[list[Gate], int, bool]:
    """The gates, the least number of rows, and whether too few rows reject (only in approval). A configured number is mandatory; a pair of value and mandatory says itself. Unknown keys raise."""
    config = dict(config or {})
    mode, least = config.pop("assessment_mode", "experimental"), config.pop("min_evaluation_rows", MIN_ROWS)
    if mode not in ("experimental", "approval"):
        raise ValueError(f"unknown assessment mode {mode!r}")
    unknown = [k for k in config if k.removesuffix("_max") not in DEFAULTS]
    if unknown:
        raise ValueError(f"unknown gates: {', '.join(map(str, unknown))}")
    gates = []
    for metric, (limit, mandatory) in DEFAULTS.items():
        given = config.get(f"{metric}_max", config.get(metric))
        if isinstance(given, dict):
            limit, mandatory = given["value"], bool(given.get("mandatory", True))
        elif given is not None:
            limit, mandatory = given, True
        if isinstance(limit, bool) or not isinstance(limit, int | float) or limit != limit:
            raise ValueError(f"the limit of {metric} must be a number")
        gates.append(Gate(metric, float(limit), mandatory))
    return gates, int(least), mode == "approval"


def statuses(d: Spark, rel: str, config: dict[str, object] | None = None) -> str:
    """approved, quarantined or rejected per row of metrics, and the comma-joined gates that failed. A metric that is missing, or no number, fails."""
    gates, least, strict = configured(config)
    usable = lambda m: f"({m} IS NOT NULL AND NOT isnan(CAST({m} AS DOUBLE)) AND abs({m}) < 1e308)"
    fails = {g.metric: f"NOT ({usable(g.metric)} AND {g.metric} <= {g.limit!r}e0)" if g.metric not in OPTIONAL else f"({g.metric} IS NOT NULL AND NOT ({usable(g.metric)} AND {g.metric} <= {g.limit!r}e0))" for g in gates}
    fails["min_evaluation_rows"] = f"NOT ({usable('synthetic_rows')} AND synthetic_rows >= {least})"
    must = [f"({fails[g.metric]})" for g in gates if g.mandatory] + ([f"({fails['min_evaluation_rows']})"] if strict else [])
    names = ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in fails.items())
    return f"SELECT *, CASE WHEN {' OR '.join(must)} THEN 'rejected' WHEN {' OR '.join(f'({p})' for p in fails.values())} THEN 'quarantined' ELSE 'approved' END AS status, concat_ws(',', {names}) AS failed FROM {rel} AS m"
