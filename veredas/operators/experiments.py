"""Tables of experiment runs: aggregates, marginal gains, limits, pivots; and event histories."""

from __future__ import annotations

from collections.abc import Iterable

from veredas.functions.dialect import Duck, Spark, literal

from .ranks import counted, quantile, ranked, settled, stats


# The metrics that runs are compared by, and those that are compared by size as well.
MAIN_METRICS = (
    "renda_wasserstein_normalized", "renda_ks", "genero_tvd", "correlation_difference", "duplicate_row_rate", "exact_train_match_rate",
    "dcr", "nndr", "training_seconds", "generation_seconds", "peak_memory_mb", "model_size_mb",
)
SIZE_METRICS = (*MAIN_METRICS, "artifact_size_mb", "batches_per_epoch", "generator_updates", "discriminator_updates")


def _by_metric(d: Spark, rel: str, keys: tuple[str, ...], metrics: tuple[str, ...]) -> str:
    """The keys, ``metric`` and ``v``: wide rows made long in one pass; what is no number is null."""
    value = " ".join(f"WHEN {k} THEN TRY_CAST({m} AS DOUBLE)" for k, m in enumerate(metrics))
    name = " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(metrics))
    return f"(SELECT {', '.join(keys)}, CASE k {name} END AS metric, CASE k {value} END AS v FROM (SELECT *, {d.explode(list(map(str, range(len(metrics)))), 'k')} FROM {rel} AS wide) AS e)"


def aggregate(d: Spark, rel: str, keys: tuple[str, ...], metrics: tuple[str, ...]) -> str:
    """Per key set and metric: n, mean, median, deviation (0 of one run), extremes, half width of the 95% interval (null below two runs). Metrics without a value are left out. One scan."""
    names = (*keys, "metric")
    r = ranked(counted(_by_metric(d, rel, keys, metrics), {k: k for k in names}, "v", {"n": "1"}), names, ["n"])
    t = stats()
    std, half = f"coalesce({t['std']}, 0e0)", f"1.96e0 * {t['std']} / sqrt(sum(n))"
    cells = f"{t['n']} AS n, {settled(t['mean'])} AS mean, {settled(quantile('n', 0.5))} AS median, {settled(std, 5)} AS std, {t['lo']} AS lo, {t['hi']} AS hi, {settled(half, 5)} AS ci95"
    return f"SELECT {', '.join(names)}, {cells} FROM {r} AS r GROUP BY {', '.join(names)}"


def status_counts(rel: str, failures: str, keys: tuple[str, ...]) -> str:
    """Per key set the runs of a summary, those approved, quarantined and rejected, and the failures beside it; sets of either table count."""
    one = lambda s: f"CAST(sum(CASE WHEN status = '{s}' AND NOT failure THEN 1 ELSE 0 END) AS BIGINT) AS {s}"
    both = f"(SELECT {', '.join(keys)}, status, FALSE AS failure FROM {rel} AS s UNION ALL SELECT {', '.join(keys)}, status, TRUE FROM {failures} AS f)"
    return f"SELECT {', '.join(keys)}, CAST(sum(CASE WHEN failure THEN 0 ELSE 1 END) AS BIGINT) AS completed_runs, {one('approved')}, {one('quarantined')}, {one('rejected')}, CAST(sum(CASE WHEN failure THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM {both} AS b GROUP BY {', '.join(keys)}"


# The distances whose fall is a gain of quality, and the costs that it is set against.
DISTANCES = ("renda_wasserstein_normalized", "renda_ks", "genero_tvd", "correlation_difference")
COSTS = {"training_seconds": "gain_per_second", "peak_memory_mb": "gain_per_memory_mb", "model_size_mb": "gain_per_model_mb"}


def quality_gains(d: Spark, rel: str, sizes: list[tuple[int, int]]) -> str:
    """Per model and pair of sizes: the mean fall of the distances that both sizes have, and its ratio to every cost's change (null where that is about 0)."""
    names = (*DISTANCES, *COSTS)
    g = f"(SELECT model, train_size, {', '.join(f'avg({m}) AS {m}' for m in names)} FROM {rel} AS r WHERE train_size IS NOT NULL GROUP BY model, train_size)"
    falls = [f"(a.{m} - b.{m})" for m in DISTANCES]
    have = " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END" for f in falls)
    gain = f"({' + '.join(f'coalesce({f}, 0e0)' for f in falls)}) / nullif({have}, 0)"
    ratio = ", ".join(f"round(CASE WHEN abs(d_{c}) > 1e-12 THEN gain / d_{c} END, 9) + 0e0 AS {n}" for c, n in COSTS.items())
    pairs = f"(SELECT a.model, p.a AS from_size, p.b AS to_size, {gain} AS gain, {', '.join(f'b.{c} - a.{c} AS d_{c}' for c in COSTS)} FROM {d.values(sizes, 'a, b')} AS p JOIN {g} AS a ON a.train_size = p.a JOIN {g} AS b ON b.train_size = p.b AND a.model = b.model)"
    return f"SELECT model, from_size, to_size, round(gain, 9) + 0e0 AS quality_gain, {ratio} FROM {pairs} AS q"


# The metrics whose change between sizes is a gain or a cost.
GAIN_METRICS = (*DISTANCES, "training_seconds", "peak_memory_mb", "model_size_mb", "artifact_size_mb")


def marginal_gains(d: Spark, rel: str, sizes: list[tuple[int, int]], metrics: tuple[str, ...] = GAIN_METRICS) -> str:
    """Per model, pair of sizes and metric: the change of the mean, and its share of the mean before (null where that is about 0). Metrics that a size lacks are left out."""
    long = _by_metric(d, rel, ("model", "train_size"), metrics)
    g = f"(SELECT model, train_size, metric, avg(v) AS v FROM {long} AS l WHERE train_size IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) GROUP BY model, train_size, metric)"
    share = "CASE WHEN abs(a.v) > 1e-12 THEN (b.v - a.v) / abs(a.v) END"
    return f"""SELECT a.model, concat(CAST(p.a AS VARCHAR(12)), '_to_', CAST(p.b AS VARCHAR(12))) AS comparison, p.a AS from_size, p.b AS to_size, a.metric, {settled('b.v - a.v')} AS change, {settled(share)} AS percent_change
      FROM {d.values(sizes, 'a, b')} AS p JOIN {g} AS a ON a.train_size = p.a JOIN {g} AS b ON b.train_size = p.b AND a.model = b.model AND a.metric = b.metric"""


# What counts as a run that was carried out, and the sentences below.
DONE = ("completed", "quality_quarantined", "quality_rejected")


def _dotted(n: str) -> str:
    """A whole number with a point before every three digits."""
    part = lambda p: f"lpad(CAST(CAST(floor({n} / 1e{p}) AS BIGINT) % 1000 AS VARCHAR(3)), 3, '0')"
    head = lambda p: f"CAST(CAST(floor({n} / 1e{p}) AS BIGINT) AS VARCHAR(20))"
    return f"CASE WHEN {n} < 1000 THEN CAST({n} AS VARCHAR(20)) WHEN {n} < 1000000 THEN concat({head(3)}, '.', {part(0)}) WHEN {n} < 1000000000 THEN concat({head(6)}, '.', {part(3)}, '.', {part(0)}) ELSE concat({head(9)}, '.', {part(6)}, '.', {part(3)}, '.', {part(0)}) END"


def _size(predicate: str) -> str:
    return f"CASE WHEN {predicate} THEN train_size END"


def capacity_limits(d: Spark, rel: str) -> str:
    """Per model the sizes tested, carried out and skipped, the largest that was, and the first run (by size) that was not, with its status and type.

    A size may both have been carried out and not; then it is in either list. ``rel`` has model, train_size, status and failure_type; rows without a size are left out.
    """
    done, skipped = f"status IN ({', '.join(map(literal, DONE))})", "status = 'skipped_after_failure'"
    failed = f"NOT ({done}) AND NOT {skipped}"
    kinds = f"(SELECT model, train_size, status, min(failure_type) AS failure_type FROM {rel} AS r WHERE train_size IS NOT NULL GROUP BY model, train_size, status)"
    # The first failure's status and type: of the smallest size, in the order of their names.
    first = f"(SELECT model AS first_model, status AS first_failure_status, coalesce(nullif(failure_type, ''), status) AS first_failure_type FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY train_size, status) AS place FROM {kinds} AS k WHERE {failed}) AS f WHERE place = 1)"
    sizes = f"(SELECT model, {d.joined_numbers(_size(f'NOT {skipped}'))} AS tested, {d.joined_numbers(_size(done))} AS completed, {d.joined_numbers(_size(skipped))} AS skipped, max({_size(done)}) AS largest, min({_size(failed)}) AS first_failed FROM {kinds} AS k GROUP BY model)"
    end = "O limite máximo absoluto não foi determinado."
    said = f"""CASE WHEN largest IS NULL THEN 'Nenhum tamanho foi concluído com sucesso neste ambiente. {end}' WHEN first_failed IS NULL THEN concat('O modelo foi executado com sucesso com pelo menos ', {_dotted('largest')}, ' registros neste ambiente. {end}')
      ELSE concat('O modelo foi executado com sucesso até ', {_dotted('largest')}, ' registros neste ambiente. A primeira falha foi observada em ', {_dotted('first_failed')}, ' registros. {end}') END"""
    return f"SELECT model, tested AS tested_train_sizes, completed AS completed_train_sizes, largest AS largest_tested_successful_size, first_failed AS first_failed_size, first_failure_status, first_failure_type, skipped AS skipped_train_sizes, skipped AS untested_larger_sizes, largest AS observed_interval_lower, first_failed AS observed_interval_upper, {said} AS conclusion FROM {sizes} AS s LEFT JOIN {first} AS f ON s.model = f.first_model"


def scalability_limits(d: Spark, rel: str, failures: str) -> str:
    """Per model the sizes that succeeded (not limited by resources), the largest, the first that failed and never succeeded, whether resources limited a run, and what follows.

    ``rel`` has model, train_size and resource_limited; ``failures`` model, train_size and status.
    """
    good = f"(SELECT model, train_size, 1 AS good, 0 AS bad, 0 AS scarce FROM {rel} AS r WHERE NOT coalesce(resource_limited, FALSE))"
    bad = f"(SELECT model, train_size, 0 AS good, 1 AS bad, CASE WHEN status = 'resource_limited' THEN 1 ELSE 0 END AS scarce FROM {failures} AS f)"
    sizes = f"(SELECT model, train_size, max(good) AS good, max(bad) AS bad, max(scarce) AS scarce FROM (SELECT * FROM {good} AS g UNION ALL SELECT * FROM {bad} AS b) AS u GROUP BY model, train_size)"
    one = f"(SELECT model, {d.joined_numbers(_size('good = 1'))} AS successful, max({_size('good = 1')}) AS largest, min({_size('bad = 1 AND good = 0')}) AS first_failed, max(scarce) = 1 AS resource_limited FROM {sizes} AS s GROUP BY model)"
    said = f"""CASE WHEN largest IS NULL THEN 'Nenhum tamanho de treinamento foi concluído com sucesso neste ambiente.' WHEN first_failed IS NULL THEN concat('Executado com sucesso com até ', {_dotted('largest')}, ' registros neste ambiente.')
      WHEN largest > first_failed THEN concat('Houve falha em ', {_dotted('first_failed')}, ' registros, mas também houve sucesso posterior até ', {_dotted('largest')}, '; o comportamento observado indica instabilidade neste ambiente.')
      ELSE concat('O limite observado está entre ', {_dotted('largest')}, ' e ', {_dotted('first_failed')}, ' registros neste ambiente; o valor exato não foi determinado.') END"""
    return f"SELECT model, successful AS successful_train_sizes, largest AS largest_tested_successful_size, first_failed AS first_failed_size, resource_limited, {said} AS conclusion FROM {one} AS o"


def pivot(d: Spark, rel: str, key: str, name: str, value: str, names: tuple[str, ...]) -> str:
    """The long table as one row a key."""
    return f"SELECT {key}, {', '.join(f'''round(max(CASE WHEN {name} = '{n}' THEN {value} END), 6) AS m_{n.lower()}''' for n in names)} FROM {rel} AS r GROUP BY {key}"


def long_metrics(d: Spark, rel: str, keys: tuple[str, ...], metrics: dict[str, tuple[str, ...]]) -> str:
    """Wide rows of runs as (keys, metric_group, metric_name, value); missing values are left out. One pass."""
    cells = [f"CASE WHEN {m} IS NULL OR isnan(CAST({m} AS DOUBLE)) THEN NULL ELSE concat('{g}:{m}:', CAST(CAST({m} AS DOUBLE) AS VARCHAR(40))) END" for g, ms in metrics.items() for m in ms]
    return f"SELECT {', '.join(keys)}, split_part(cell, ':', 1) AS metric_group, split_part(cell, ':', 2) AS metric_name, CAST(split_part(cell, ':', 3) AS DOUBLE) AS value FROM (SELECT {', '.join(keys)}, {d.explode(cells, 'cell')} FROM {rel} AS r) AS l WHERE cell IS NOT NULL"


def group_means(d: Spark, long: str) -> str:
    """Means of the values that are there, per metric group: of a correlation matrix, of a table by name, of epochs."""
    return f"SELECT metric_group, count(value) AS n, round(avg(value) + 1e-9, 6) AS mean FROM ({long}) AS l WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY metric_group"


# The order of the tables of runs; rows without a size come last.
SUMMARY_ORDER = ("train_size", "model", "seed")
LONG_ORDER = (*SUMMARY_ORDER, "metric_group", "metric_name")


def placed(d: Spark, rel: str, order: tuple[str, ...], limit: int | None = None) -> str:
    """The rows of a report with their place in its order, nulls last; all of them, or the first ``limit``.

    Rows are put in order inside a value of the first column only; its values, of which a report has few, are counted and summed up.
    """
    lead, rest = order[0], ", ".join(f"{c} NULLS LAST" for c in order[1:])
    if limit is not None:
        by = ", ".join(f"{c} NULLS LAST" for c in order)
        rel = f"(SELECT * FROM {rel} AS r ORDER BY {by} LIMIT {limit})"
    starts = f"(SELECT {lead} AS lead_value, sum(n) OVER (ORDER BY {lead} NULLS LAST ROWS UNBOUNDED PRECEDING) - n AS start FROM (SELECT {lead}, count(*) AS n FROM {rel} AS c GROUP BY {lead}) AS g)"
    inside = f"(SELECT {', '.join(order)}, row_number() OVER (PARTITION BY {lead} ORDER BY {rest}) AS place FROM {rel} AS f)"
    return f"SELECT CAST(start + place AS BIGINT) AS place, {', '.join(order)} FROM {inside} AS i JOIN {starts} AS s ON i.{lead} IS NOT DISTINCT FROM s.lead_value"


def by_metric_group(rel: str, group: str) -> str:
    """One of the filtered outputs of a long table."""
    return f"(SELECT * FROM {rel} AS l WHERE metric_group = '{group}')"


def rotated(d: Spark, models: list[str], seeds: list[int]) -> str:
    """The order of the models for every seed: the list turned by the seed's place, so that each model is first in turn."""
    rows = [(seed, i + 1, models[(i + k) % len(models)]) for k, seed in enumerate(seeds) for i in range(len(models))]
    return f"SELECT seed, place, model FROM {d.values(rows, 'seed, place, model')} AS v"


def history_filter(rel: str, kind: str | None = None, model: str | None = None, status: str | None = None, seed: int | None = None) -> str:
    """Records that match every given field."""
    given = [f"{c} = {literal(v)}" for c, v in (("kind", kind), ("model", model), ("status", status), ("seed", seed)) if v is not None and v != ""]
    return f"(SELECT * FROM {rel} AS h WHERE {' AND '.join(given) or 'TRUE'})"


def history_rows(d: Spark, rel: str) -> str:
    """Records as shown: what is missing says so."""
    shown = lambda c: f"coalesce(CAST({c} AS VARCHAR(60)), 'Não disponível') AS {c}"
    return f"SELECT identifier, kind, {', '.join(shown(c) for c in ('model', 'seed', 'status', 'row_count', 'train_rows'))}, coalesce(CAST(exact_train_match_rate AS VARCHAR(40)), 'Não avaliado') AS exact_train_match_rate FROM {rel} AS h"


def history_counts(d: Spark, rel: str) -> str:
    """Records by status (a missing one is named) and by model (a missing one is left out), and the newest record's identifier, status and kind."""
    cells = ["concat('status:', coalesce(status, 'Não disponível'))", "CASE WHEN model IS NULL OR model = '' THEN NULL ELSE concat('model:', model) END"]
    counts = f"(SELECT cell, count(*) AS n FROM (SELECT {d.explode(cells, 'cell')} FROM {rel} AS h) AS c WHERE cell IS NOT NULL GROUP BY cell)"
    last = f"(SELECT identifier, status, kind FROM {rel} AS l ORDER BY coalesce(created_at, '') DESC, identifier LIMIT 1)"
    return f"SELECT split_part(cell, ':', 1) AS field, split_part(cell, ':', 2) AS value, n FROM {counts} AS c UNION ALL SELECT 'latest', concat(identifier, '|', coalesce(status, ''), '|', kind), 1 FROM {last} AS l"


def latest_records(d: Spark, rel: str, limit: int) -> str:
    """The newest ``limit`` records, newest first."""
    return f"SELECT * FROM {rel} AS h ORDER BY coalesce(created_at, '') DESC, identifier LIMIT {limit}"


def status_histogram(d: Spark, rel: str) -> str:
    """Records as approved (or completed), quarantined or rejected; other statuses count nowhere."""
    s = "lower(coalesce(status, ''))"
    name = f"CASE WHEN {s} IN ('approved', 'completed') THEN 'approved' WHEN {s} LIKE '%quarantine%' THEN 'quarantined' WHEN {s} LIKE '%rejected%' THEN 'rejected' END"
    known = d.values([("approved",), ("quarantined",), ("rejected",)], "status")
    return f"SELECT k.status, coalesce(c.n, 0) AS n FROM {known} AS k LEFT JOIN (SELECT {name} AS status, count(*) AS n FROM {rel} AS h GROUP BY {name}) AS c ON k.status = c.status"


def recommendation_rank(status: str = "status", purpose: str = "purpose", legacy: str = "is_legacy", recommended: str = "recommended") -> str:
    """0 for an approved and recommended artifact up to 6 for a legacy one."""
    s, p = f"lower(coalesce({status}, ''))", f"lower(coalesce({purpose}, ''))"
    is_ = lambda v: f"({s} = '{v}' OR {p} = '{v}')"
    return f"CASE WHEN {is_('legacy')} OR coalesce({legacy}, FALSE) THEN 6 WHEN {s} = 'approved' AND coalesce({recommended}, FALSE) THEN 0 WHEN {is_('approved')} THEN 1 WHEN {is_('recommended_candidate')} THEN 2 WHEN {is_('candidate')} THEN 3 WHEN {is_('experimental')} OR {is_('smoke')} THEN 5 ELSE 4 END"


def ranked_artifacts(d: Spark, rel: str, models: tuple[str, ...] = ("ctgan", "simple_gan")) -> str:
    """The artifacts of every trained model in order of recommendation, newest first, then by name."""
    rank = recommendation_rank()
    return f"SELECT model, artifact_id, rank_value, row_number() OVER (PARTITION BY model ORDER BY rank_value, created_at DESC, artifact_id) AS place FROM (SELECT *, {rank} AS rank_value FROM {rel} AS a WHERE model IN ({', '.join(map(literal, models))})) AS r"


def generation_ready(d: Spark, rel: str, allowed: tuple[str, ...] = ("approved",), locale: str = "pt-BR") -> str:
    """Whether any artifact may generate, and the model to use: the best ready one's, else the programmatic one."""
    ready = f"lower(coalesce(status, '')) IN ({', '.join(map(literal, allowed))}) AND coalesce(vocabulary_version, 0) >= 2 AND locale = {literal(locale)} AND normalization = 'NFC'"
    best = f"(SELECT model FROM {rel} AS a WHERE {ready} ORDER BY {recommendation_rank()}, created_at DESC, artifact_id LIMIT 1)"
    return f"SELECT count(*) AS n_ready, coalesce(max(b.model), 'programmatic') AS default_model FROM (SELECT * FROM {rel} AS c WHERE {ready}) AS r CROSS JOIN {best} AS b"


def evidence_checks(d: Spark, rel: str, bounds: dict[str, tuple[float, float]]) -> str:
    """Per bounded metric of a long table: how many values there are, how many lie inside, and whether all do (none: not passed)."""
    rows = [(m, float(lo), float(hi)) for m, (lo, hi) in bounds.items()]
    bound = d.values(rows, "metric_name, lo, hi")
    if not isinstance(d, Duck):
        # The values meet the few bounds where they stand and are counted there: a left join would send all values of a metric to one task.
        one = lambda inside, outside: f"sum(CASE WHEN l.value BETWEEN c.lo AND c.hi THEN {inside} ELSE {outside} END)"
        met = f"(SELECT {d.small('c')}c.metric_name AS name, count(l.value) AS n, {one(1, 0)} AS n_inside, {one(0, 1)} AS n_outside FROM {rel} AS l JOIN {bound} AS c ON c.metric_name = l.metric_name GROUP BY c.metric_name)"
        return f"SELECT b.metric_name, coalesce(m.n, 0) AS n, coalesce(m.n_inside, 0) AS n_inside, coalesce(m.n > 0 AND m.n_outside = 0, FALSE) AS passed FROM {bound} AS b LEFT JOIN {met} AS m ON b.metric_name = m.name"
    return f"SELECT b.metric_name, count(l.value) AS n, CAST(coalesce(sum(CASE WHEN l.value BETWEEN b.lo AND b.hi THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_inside, count(l.value) > 0 AND coalesce(sum(CASE WHEN l.value BETWEEN b.lo AND b.hi THEN 0 ELSE 1 END), 0) = 0 AS passed FROM {bound} AS b LEFT JOIN {rel} AS l ON b.metric_name = l.metric_name GROUP BY b.metric_name"


def history_summary(d: Spark, rel: str) -> str:
    return f"SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, max(ts) AS latest FROM {rel} AS e GROUP BY event_type"


# Fragments of field names that an audit record never keeps.
FORBIDDEN = ("cpf", "cnh", "rg", "titulo", "telefone", "nome", "dataset", "dataframe", "stack", "traceback", "ip", "user_agent", "usuario", "user", "linha", "row")


# The fields that an audit record may keep. ``rows`` is among them, but holds a forbidden fragment.
ALLOWED = ("timestamp_utc", "event", "session_id", "page", "model", "artifact_id", "rows", "format", "seed", "column_selection_mode", "column_preset", "exported_column_count", "duration_seconds", "status", "error_type")


def allowed_field(name: str, allowed: Iterable[str] = ALLOWED) -> bool:
    """Whitelisted and without a forbidden fragment."""
    return name in set(allowed) and not any(f in name.lower() for f in FORBIDDEN)


def sanitized(d: Spark, rel: str, key: str, fields: dict[str, str]) -> str:
    """The fields of an event that its record may keep, one row each; the choice is made when the query is built."""
    kept = {n: e for n, e in fields.items() if allowed_field(n)}
    cells = [f"concat('{n}:', CAST({e} AS VARCHAR(200)))" for n, e in kept.items()]
    return f"SELECT {key}, split_part(cell, ':', 1) AS field, split_part(cell, ':', 2) AS value FROM (SELECT {key}, {d.explode(cells, 'cell')} FROM {rel} AS e) AS c WHERE cell IS NOT NULL"


def latest_per_user(d: Spark, rel: str) -> str:
    """The last event of each user by time and id."""
    return f"SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {rel} AS e) AS w WHERE k = 1"


def windowed(d: Spark, rel: str) -> str:
    """Events per hour and type."""
    return f"SELECT date_trunc('hour', ts) AS hour_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {rel} AS e GROUP BY 1, 2"
