"""Nested records (evaluations, manifests) as tables: a recursive walk to nodes, and rule tables over their paths.

A record is a JSON text. Records that differ in their values alone share a shape: the text with a mark for each value. Shapes are told apart first; each
distinct one is walked, level by level with Spark's variants, as many levels as the deepest has (which one aggregation finds), and gives a row for every
node: its path, kind, size (of containers), number or text. A record's own values are then put into the nodes of its shape. What Python's writers add
to JSON, NaN and infinities at any depth, counts as null. Metrics and checks are tables of paths, joined to the nodes of the shapes; a path may have a place
that stands for any one name. Where every record has a shape of its own (names that are data), each is walked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veredas.functions.dialect import Duck, Spark
from veredas.session import work_folder

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: Stands in a shape for a value that was taken out.
_MARK = chr(1)
_BLANKS, _BETWEEN = r"[ \t\n\r]*", r"[{}\[\],: \t\n\r]*"
#: Group 1: brackets, blanks and names without escapes; group 2: a value that is taken out, which is a string without escapes or a number of 15 digits at most
#: without exponent; group 3: a string or word that stays. Matches join each other, so that a long text is looked at once.
_TOKEN = (
    rf'\G({_BETWEEN}(?:"[^"\\]*"{_BLANKS}:{_BETWEEN})*+)'
    rf'(?:("[^"\\\x00-\x1F]*"(?!{_BLANKS}:)|-?(?:0|[1-9][0-9]{{0,14}}+)(?:\.[0-9]{{1,15}}+)?+(?![-+.\w]|{_BLANKS}:))'
    r'|("[^"\\]*(?:\\[\s\S][^"\\]*)*+"|[-+.\w]++))'
)


def standard_json(text: Column) -> Column:
    """``text`` with null for NaN, Infinity and -Infinity outside strings."""
    parts = F.regexp_extract_all(text, F.lit(f'{_STRING}|[^"]+'), F.lit(0))
    mended = F.transform(parts, lambda p: F.when(p.startswith('"'), p).otherwise(F.regexp_replace(p, r"-?\b(?:NaN|Infinity)\b", "null")))
    return F.when(text.contains("NaN") | text.contains("Infinity"), F.array_join(mended, "")).otherwise(text)


def _depth(text: Column) -> Column:
    """How deep brackets are nested outside strings."""
    marks = F.split(F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda a: a["most"])


def _walked(base: DataFrame) -> DataFrame:
    """The nodes of records (record and a text of standard JSON), level by level."""
    levels = base.agg(F.max(_depth(F.col("text")))).first()[0] or 0
    now = base.select("record", F.lit("$").alias("path"), F.try_parse_json("text").alias("v"))
    out = None
    for _ in range(levels):
        now.createOrReplaceTempView("veredas_walk")
        name = "CASE WHEN t.key IS NULL THEN concat('[', t.pos, ']') WHEN t.key RLIKE '^[A-Za-z0-9_]+$' THEN concat('.', t.key) ELSE concat('.\"', t.key, '\"') END"
        now = base.sparkSession.sql(f"SELECT w.record, concat(w.path, {name}) AS path, t.value AS v FROM veredas_walk AS w, LATERAL variant_explode(w.v) AS t")
        out = now if out is None else out.unionAll(now)
    if out is None:
        out = now.where("path <> '$'")
    kind = F.schema_of_variant("v")
    plain = F.expr("try_variant_get(v, '$', 'string')")
    named = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "text").when(kind == "BOOLEAN", "flag").when(kind == "VOID", "null").otherwise("number")
    size = F.when(kind.startswith("ARRAY"), F.expr("size(try_variant_get(v, '$', 'array<variant>'))")).when(kind.startswith("OBJECT"), F.expr("size(try_variant_get(v, '$', 'map<string, variant>'))"))
    return out.select("record", "path", named.alias("kind"), size.cast("long").alias("size"), F.when(named == "number", F.expr("try_variant_get(v, '$', 'double')")).alias("number"), F.when(named.isin("text", "flag"), plain).alias("value"))


def _shaped(records: DataFrame, key: str, text: str) -> DataFrame:
    """record, shape and tokens: the text with a mark for each value that is taken out, and these values as they stand there.

    What stays has a mark behind it and an empty token, so that the place of a mark is that of its token. A text that has the mark in it stays whole.
    """
    base = records.select(F.col(key).alias("record"), standard_json(F.col(text)).alias("text"))
    marked = F.contains("text", F.lit(_MARK)) | F.contains("text", F.lit(r"\u0001"))
    shape = F.when(marked, F.translate("text", _MARK, chr(2))).otherwise(F.regexp_replace("text", _TOKEN, f"$1$3{_MARK}"))
    return base.select("record", F.coalesce(shape, F.lit("")).alias("shape"), F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(2)).alias("tokens"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _shapes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct shapes, and their nodes (record is the shape), with the place of the token that a node's value was (leaf), from 0.

    A mark behind a string or a word is that of what stays; others become texts that name their place.
    """
    shapes = _written(rows.select("shape").distinct(), "shapes")
    pieces = F.split("shape", _MARK, -1)
    filled = F.transform(pieces, lambda p, i: F.when((i == F.size(pieces) - 1) | p.rlike(r'[-+.\w"]\z'), p).otherwise(F.concat(p, F.lit('"\\u0001'), i.cast("string"), F.lit('"'))))
    found = _walked(shapes.select(F.col("shape").alias("record"), F.array_join(filled, "").alias("text")))
    leaf = F.when((F.col("kind") == "text") & F.col("value").startswith(_MARK) & F.contains("record", F.lit(_MARK)), F.substr("value", F.lit(2)).cast("int"))
    return shapes, found.withColumn("leaf", leaf)


def _by_shape(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """record, tokens and n, each of the cells of the row's shape; ``cells``: shape and a list, written once."""
    held = _written(cells, "cells")
    return rows.join(held, "shape").select("record", "tokens", F.explode("cells").alias("n"))


#: SQL of a value l (leaf, number, value) of a row with tokens.
_TOKEN_OF = "tokens[l.leaf]"
_NUMBER = f"CASE WHEN l.leaf IS NULL THEN l.number WHEN NOT startswith({_TOKEN_OF}, '\"') THEN CAST({_TOKEN_OF} AS DOUBLE) + 0e0 END"
_TEXT = f"CASE WHEN l.leaf IS NULL THEN l.value WHEN startswith({_TOKEN_OF}, '\"') THEN substr({_TOKEN_OF}, 2, char_length({_TOKEN_OF}) - 2) END"


def _repeated(records: DataFrame, key: str) -> DataFrame | None:
    """The keys (again) that several records have, if any."""
    again = _written(records.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"), "again")
    return None if again.isEmpty() else again


def nodes(records: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, kind (object, array, text, number, flag, null), size, number and value of every node below the roots.

    ``path`` is ``$.name[0].name``; names that are more than letters, digits and ``_`` stand in quotes. A text that is no JSON, or a null one, has no nodes.
    """
    rows = _shaped(records, key, text)
    cells = F.collect_list(F.struct("path", "kind", "size", "number", "value", "leaf")).alias("cells")
    each = _by_shape(rows, _shapes(rows)[1].groupBy(F.col("record").alias("shape")).agg(cells)).selectExpr("record", "tokens", "n AS l")
    kind = f"CASE WHEN l.leaf IS NOT NULL AND NOT startswith({_TOKEN_OF}, '\"') THEN 'number' ELSE l.kind END"
    return each.selectExpr("record", "l.path", f"{kind} AS kind", "l.size", f"{_NUMBER} AS number", f"{_TEXT} AS value")


def duck_nodes_sql(rel: str, key: str, text: str) -> str:
    """The same nodes by DuckDB, of texts that are JSON."""
    kind = "CASE n.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'flag' WHEN 'NULL' THEN 'null' ELSE 'number' END"
    size = "CASE n.type WHEN 'ARRAY' THEN CAST(json_array_length(n.value) AS BIGINT) WHEN 'OBJECT' THEN CAST(len(json_keys(n.value)) AS BIGINT) END"
    return f"(SELECT r.{key} AS record, n.fullkey AS path, {kind} AS kind, {size} AS size, CASE WHEN {kind} = 'number' THEN CAST(n.value AS DOUBLE) END AS number, CASE WHEN {kind} IN ('text', 'flag') THEN n.value ->> '$' END AS value FROM {rel} AS r, json_tree(CAST(r.{text} AS JSON)) AS n WHERE n.fullkey <> '$')"


@dataclass(frozen=True)
class Metric:
    """Where a metric stands: paths of value, reference and difference; ``*`` is any one name, which becomes the column (or the metric's name where that is ``*``).

    ``of``: what is taken of the node: its number, its size, or the mean of all numbers under the path (``*.*`` reaches two levels down).
    """

    group: str
    name: str
    value: str
    reference: str | None = None
    difference: str | None = None
    of: str = "number"
    column: str | None = None


def _numeric(name: str, key: str, difference: str) -> Metric:
    at = "$.evaluation.against_holdout.numeric.*."
    return Metric("numeric", name, f"{at}synthetic.{key}", f"{at}reference.{key}", at + difference)


_HELD, _PRIVATE = "$.evaluation.against_holdout.", "$.evaluation.privacy."
# Groups, names and places of the metrics of a run.
METRICS = (
    _numeric("mean", "mean", "absolute_mean_diff"), _numeric("median", "median", "median_diff"), _numeric("std", "std", "std_diff"),
    *(Metric("numeric", m, f"{_HELD}numeric.*.{m}") for m in ("relative_mean_diff", "wasserstein_distance", "wasserstein_distance_normalized", "ks_statistic")),
    Metric("categorical", "total_variation_distance", f"{_HELD}categorical.*.total_variation_distance"),
    Metric("categorical", "missing_categories_count", f"{_HELD}categorical.*.missing_categories", of="size"),
    Metric("categorical", "unexpected_categories_count", f"{_HELD}categorical.*.unexpected_categories", of="size"),
    Metric("categorical", "category_coverage_holdout", f"{_PRIVATE}category_coverage_holdout.*"),
    Metric("relationships", "correlation_mean_abs_difference", f"{_HELD}correlations.summary.mean_abs_difference"),
    Metric("relationships", "correlation_max_abs_difference", f"{_HELD}correlations.summary.max_abs_difference"),
    Metric("relationships", "pearson_mean_abs_difference", f"{_HELD}correlations.pearson.absolute_difference.*.*", of="mean"),
    Metric("relationships", "spearman_mean_abs_difference", f"{_HELD}correlations.spearman.absolute_difference.*.*", of="mean"),
    Metric("relationships", "categorical_relationship_tvd", f"{_HELD}categorical_relationships.*.total_variation_distance"),
    Metric("relationships", "categorical_relationship_max_cell_difference", f"{_HELD}categorical_relationships.*.max_cell_difference"),
    *(Metric("relationships", "grouped_income_mean_abs_difference", f"{_HELD}grouped_income.{g}.absolute_difference.*", of="mean", column=g) for g in ("Regiao", "Escolaridade", "Ocupacao", "Faixa_Etaria")),
    Metric("conditional_income", "*", "$.evaluation.conditional_income.summary.*"),
    *(Metric("privacy", m, f"{_PRIVATE}{m}") for m in ("duplicate_row_rate", "unique_combination_rate", "unique_combinations", "exact_train_match_rate", "exact_holdout_match_rate")),
    Metric("privacy", "duplicate_base_row_rate", f"{_PRIVATE}duplicate_base_rows.duplicate_row_rate"),
    Metric("privacy", "duplicate_base_duplicated_occurrences", f"{_PRIVATE}duplicate_base_rows.duplicated_occurrences"),
    Metric("privacy", "duplicate_base_duplicated_groups", f"{_PRIVATE}duplicate_base_rows.duplicated_groups"),
    Metric("privacy", "duplicate_base_largest_group", f"{_PRIVATE}duplicate_base_rows.largest_duplicate_group"),
    *(Metric("privacy", f"exact_{s}_match_count", f"{_PRIVATE}exact_matches.{s}.exact_match_count") for s in ("train", "holdout")),
    *(Metric("privacy", f"distinct_{s}_rows_matched", f"{_PRIVATE}exact_matches.{s}.distinct_reference_rows_matched") for s in ("train", "holdout")),
    Metric("privacy", "dcr_train_mean", f"{_PRIVATE}nearest_neighbor_train.distance_to_closest_record.mean"),
    Metric("privacy", "dcr_train_min", f"{_PRIVATE}nearest_neighbor_train.distance_to_closest_record.min"),
    Metric("privacy", "nndr_train_mean", f"{_PRIVATE}nearest_neighbor_train.nearest_neighbor_distance_ratio.mean"),
    Metric("privacy", "columns_used", f"{_PRIVATE}columns_used", of="size"), Metric("privacy", "columns_excluded", f"{_PRIVATE}excluded_columns", of="size"),
    *(Metric("geography", "*", f"$.evaluation.geography.{s}.*", column=s) for s in ("validity", "diversity")),
    *(Metric("relational_validity", "*", f"$.evaluation.relational_validity.{s}.*", column=s) for s in ("validity", "invalid_counts")),
    Metric("raw_final_geography", "*", "$.raw_final_comparison.*"),
    Metric("postprocessing_geography", "*", "$.raw_final_comparison.postprocessing_geography.*"),
    Metric("postprocessing_geography", "field_modified_rows", "$.raw_final_comparison.postprocessing_geography.field_changes.*.modified_rows"),
    Metric("postprocessing_geography", "field_modified_rate", "$.raw_final_comparison.postprocessing_geography.field_changes.*.modified_rate"),
    Metric("validation", "reason_count", "$.validation.reason_counts.*"),
)


def _placed(d: Spark, rules: list[tuple], names: str) -> str:
    return d.values(rules, names)


def _hits(d: Spark, nodes_rel: str, metrics: tuple[Metric, ...], more: str = "") -> str:
    """The nodes that metrics are taken of: record, the metric, role, taken and x."""
    rows = []
    for m in metrics:
        for role, path in (("value", m.value), ("reference", m.reference), ("difference", m.difference)):
            if path:
                head, _, tail = path.partition("*")
                dots = -1 if "*" not in path else int(tail.startswith(".*"))
                rows.append((m.group, m.name, m.column, role, m.of if role == "value" else "number", head, tail.removeprefix(".*"), dots))
    middle = "substr(n.path, length(r.head) + 1, length(n.path) - length(r.head) - length(r.tail))"
    fits = f"CASE WHEN r.dots < 0 THEN n.path = r.head ELSE left(n.path, length(r.head)) = r.head AND right(n.path, length(r.tail)) = r.tail AND length(n.path) > length(r.head) + length(r.tail) AND length({middle}) - length(replace({middle}, '.', '')) = r.dots AND {middle} NOT LIKE '%[%' END"
    worth = "CASE WHEN r.taken = 'size' THEN CAST(n.size AS DOUBLE) ELSE n.number END"
    kinds = "CASE WHEN r.taken = 'size' THEN n.kind IN ('array', 'object') ELSE n.kind IN ('number', 'null', 'flag', 'text') END"
    placed, on = d.by_value(_placed(d, rows, 'metric_group, metric_name, column_name, role, taken, head, tail, dots'), fits, nodes_rel, "path")
    return f"(SELECT n.record, r.metric_group, CASE WHEN r.metric_name = '*' THEN {middle} ELSE r.metric_name END AS metric_name, CASE WHEN r.column_name IS NOT NULL THEN r.column_name WHEN r.metric_name <> '*' AND r.dots = 0 THEN {middle} END AS column_name, r.role, r.taken, {worth} AS x{more} FROM {nodes_rel} AS n JOIN {placed} AS r ON {on} WHERE {kinds})"


def metrics_sql(d: Spark, nodes_rel: str, metrics: tuple[Metric, ...] = METRICS) -> str:
    """record, metric_group, metric_name, column_name, value, reference and difference of every metric that a record holds: one join with the table of paths, one aggregation."""
    one = lambda role: f"max(CASE WHEN role = '{role}' AND taken <> 'mean' THEN x END)"
    return f"SELECT record, metric_group, metric_name, column_name, round(coalesce(avg(CASE WHEN role = 'value' AND taken = 'mean' THEN x END), {one('value')}), 9) AS value, {one('reference')} AS reference, {one('difference')} AS difference FROM {_hits(d, nodes_rel, metrics)} AS h GROUP BY record, metric_group, metric_name, column_name"


def run_metrics(records: DataFrame, key: str, text: str, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """What :func:`metrics_sql` gives of the records' nodes.

    Metrics are found for every distinct shape. A row then has all metrics of its record, which need no grouping; only those of records that share a key are grouped.
    """
    spark, names = records.sparkSession, "metric_group, metric_name, column_name"
    rows = _shaped(records, key, text)
    _written(_shapes(rows)[1], "nodes").createOrReplaceTempView("veredas_nodes")
    listed = lambda p: f"collect_list(CASE WHEN {p} THEN named_struct('number', x, 'leaf', leaf) END)"
    roles = {"ones": "role = 'value' AND taken <> 'mean'", "means": "role = 'value' AND taken = 'mean'", "refs": "role = 'reference'", "gaps": "role = 'difference'"}
    found = f"(SELECT record, {names}, {', '.join(f'{listed(p)} AS {n}' for n, p in roles.items())} FROM {_hits(Spark(), 'veredas_nodes', metrics, ', n.leaf')} AS h GROUP BY record, {names})"
    cells = spark.sql(f"SELECT record AS shape, collect_list(struct({names}, {', '.join(roles)})) AS cells FROM {found} AS f GROUP BY record")
    each = _by_shape(rows, cells)
    taken = lambda n: f"transform(n.{n}, l -> {_NUMBER})"
    summed = f"CASE WHEN size(n.means) > 0 THEN aggregate({taken('means')}, named_struct('total', 0e0, 'n', 0L), (a, x) -> named_struct('total', a.total + coalesce(x, 0e0), 'n', a.n + CASE WHEN x IS NULL THEN 0L ELSE 1L END)) END"
    parts = each.selectExpr("record", "n.metric_group", "n.metric_name", "n.column_name", f"array_max({taken('ones')}) AS v", f"{summed} AS s", f"array_max({taken('refs')}) AS reference", f"array_max({taken('gaps')}) AS difference")
    shown = lambda total, n, v: f"round(coalesce(CASE WHEN {n} > 0 THEN {total} / {n} END, {v}), 9) AS value"
    last = ["record", *names.split(", "), shown("s.total", "s.n", "v"), "reference", "difference"]
    again = _repeated(records, key)
    if again is None:
        return parts.selectExpr(*last)
    same = F.col("record").eqNullSafe(F.col("again"))
    grouped = parts.join(again, same, "left_semi").groupBy("record", *names.split(", ")).agg(F.sum("s.total").alias("total"), F.sum("s.n").alias("n"), *(F.max(c).alias(c) for c in ("v", "reference", "difference")))
    return parts.join(again, same, "left_anti").selectExpr(*last).unionAll(grouped.selectExpr("record", *names.split(", "), shown("total", "n", "v"), "reference", "difference"))


@dataclass(frozen=True)
class Check:
    """What a manifest must hold at a path: a text (compared without case and with ``_`` for blanks and dashes), or a number between two bounds; ``absent``: a text that no element of the list there may be."""

    name: str
    path: str
    text: str | None = None
    low: float | None = None
    high: float | None = None
    absent: str | None = None


def _checks_table(d: Spark, checks: tuple[Check, ...]) -> str:
    return d.values([(c.name, c.path, c.text and c.text.lower(), c.low, c.high, c.absent) for c in checks], "check_name, path, wanted, low, high, absent")


def _good(kind: str, number: str, value: str) -> str:
    """Whether a node is what a check c wants."""
    said = f"replace(replace(lower({value}), ' ', '_'), '-', '_')"
    return f"CASE WHEN c.absent IS NOT NULL THEN {kind} = 'array' WHEN c.wanted IS NOT NULL THEN coalesce({said} = c.wanted, FALSE) ELSE coalesce({number} >= c.low AND {number} <= c.high, FALSE) END"


_IN_LIST = "c.absent IS NOT NULL AND left(n.path, length(c.path) + 1) = concat(c.path, '[')"


def checks_sql(d: Spark, nodes_rel: str, records: str, checks: tuple[Check, ...]) -> str:
    """record, check_name and passed, of every check and every record (a relation with ``record``); what is not there fails."""
    table = _checks_table(d, checks)
    found = f"(SELECT n.record, c.check_name, max(CASE WHEN {_good('n.kind', 'n.number', 'n.value')} THEN 1 ELSE 0 END) AS good FROM {nodes_rel} AS n JOIN {table} AS c ON n.path = c.path GROUP BY n.record, c.check_name)"
    bad = f"(SELECT n.record, c.check_name, count(*) AS n FROM {nodes_rel} AS n JOIN {table} AS c ON {_IN_LIST} AND n.value = c.absent GROUP BY n.record, c.check_name)"
    return f"SELECT r.record, t.check_name, coalesce(f.good = 1, FALSE) AND b.n IS NULL AS passed FROM {records} AS r CROSS JOIN {table} AS t LEFT JOIN {found} AS f ON r.record = f.record AND t.check_name = f.check_name LEFT JOIN {bad} AS b ON r.record = b.record AND t.check_name = b.check_name"


def run_checks(records: DataFrame, key: str, text: str, checks: tuple[Check, ...]) -> DataFrame:
    """What :func:`checks_sql` gives of the records' nodes, a row for every row of ``records`` and check; rows that share a key are judged together.

    Places are found for every distinct shape, and a row's own values are judged where they stand.
    """
    spark, table = records.sparkSession, _checks_table(Spark(), checks)
    rows = _shaped(records, key, text)
    shapes, found = _shapes(rows)
    shapes.createOrReplaceTempView("veredas_shapes")
    _written(found, "nodes").createOrReplaceTempView("veredas_nodes")
    node = "collect_list(named_struct('kind', n.kind, 'number', n.number, 'value', n.value, 'leaf', n.leaf))"
    at = lambda name, on: f"(SELECT n.record, c.check_name, {node} AS {name} FROM veredas_nodes AS n JOIN {table} AS c ON {on} GROUP BY n.record, c.check_name)"
    cells = spark.sql(f"""SELECT s.shape, collect_list(named_struct('check', struct(t.*), 'found', f.found, 'listed', b.listed)) AS cells FROM veredas_shapes AS s CROSS JOIN {table} AS t
      LEFT JOIN {at('found', 'n.path = c.path')} AS f ON s.shape = f.record AND t.check_name = f.check_name LEFT JOIN {at('listed', f'{_IN_LIST} AND (n.leaf IS NOT NULL OR n.value = c.absent)')} AS b ON s.shape = b.record AND t.check_name = b.check_name GROUP BY s.shape""")
    each = _by_shape(rows, cells).selectExpr("record", "tokens", "n.check AS c", "n.found", "n.listed")
    parts = each.selectExpr("record", "c.check_name", f"coalesce(exists(found, l -> {_good('l.kind', _NUMBER, _TEXT)}), FALSE) AS good", f"coalesce(exists(listed, l -> {_TEXT} = c.absent), FALSE) AS bad")
    last = ["record", "check_name", "record IS NOT NULL AND good AND NOT bad AS passed"]
    again = _repeated(records, key)
    if again is None:
        return parts.selectExpr(*last)
    same = F.col("record").eqNullSafe(F.col("again"))
    grouped = parts.join(again, same, "left_semi").groupBy(F.col("record").alias("again"), "check_name").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    sharing = records.select(F.col(key).alias("record")).join(grouped, same)
    return parts.join(again, same, "left_anti").selectExpr(*last).unionAll(sharing.selectExpr(*last))


def without_nan(value: Column, kind: T.DataType) -> Column:
    """``value`` with null for NaN and infinities at any depth of structs, arrays and maps: what JSON can write."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(without_nan(value[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_nan(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: without_nan(x, kind.valueType))
    return value


def example_records_sql(d: Spark, runs: str) -> str:
    """Runs (run, model, ks, w1, seconds) as nested records of what an evaluation of theirs would hold."""
    num = lambda c: f"CAST(CAST(floor({c} * 1e4) AS BIGINT) AS VARCHAR(24)), '.5'"
    parts = [
        "'{\"evaluation\": {\"against_holdout\": {\"numeric\": {\"Renda\": {\"synthetic\": {\"mean\": '", num("seconds"), "'}, \"reference\": {\"mean\": 25.5}, \"absolute_mean_diff\": '", num("w1"), "', \"ks_statistic\": '", num("ks"),
        "'}}, \"categorical\": {\"Genero\": {\"total_variation_distance\": '", num("w1"), "', \"missing_categories\": [\"Outro\", \"'", "model", "'\"], \"unexpected_categories\": []}}, \"correlations\": {\"pearson\": {\"absolute_difference\": {\"Idade\": {\"Idade\": 0, \"Renda\": '", num("ks"),
        "'}, \"Renda\": {\"Idade\": null}}}}, \"grouped_income\": {\"Regiao\": {\"absolute_difference\": {\"Sul\": '", num("seconds"), "', \"Norte\": 4}}}}, \"privacy\": {\"duplicate_row_rate\": '", num("w1"), "', \"columns_used\": [\"Idade\", [1, {\"deep\": true}]]}}, \"validation\": {\"reason_counts\": {\"CPF_invalido\": 3}}, \"model\": \"'", "model", "'\", \"purpose\": \"Recommended-candidate\"}'",
    ]
    return f"(SELECT run AS record, concat({', '.join(parts)}) AS text FROM {runs} AS runs)"


def duck(d: Duck, runs: str) -> str:
    return duck_nodes_sql(example_records_sql(d, runs), "record", "text")
