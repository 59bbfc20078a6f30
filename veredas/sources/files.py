"""Readers and writers of profile tables.

Every reader gives a lazy frame and every writer goes through Spark's committers, a folder of part files each, so that
any store and any size will do. ``single`` makes one part file of a small export, as a person would open it.
"""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veredas.functions import domain
from veredas.operators import nested, validate

BOM = chr(0xFEFF)
TABLE_SUFFIXES = (".parquet", ".csv", ".json", ".jsonl")


def suffix_of(path: str) -> str:
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in TABLE_SUFFIXES:
        raise ValueError(f"unknown kind of table: {path!r}; known are {', '.join(TABLE_SUFFIXES)}")
    return suffix


def _separator(spark: SparkSession, path: str) -> str:
    """Semicolon or comma, whichever the header has more of; one line is read."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0].value if first else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, separator: str | None = None) -> DataFrame:
    """A table by its suffix: Parquet; CSV with a header (a byte-order mark is no part of a name); a JSON array; JSON lines.

    Without a schema, types are inferred. The separator of a CSV is found in its header unless it is given.
    """
    suffix = suffix_of(path)
    if suffix == ".parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix == ".csv":
        reader = reader.options(header=True, sep=separator or _separator(spark, path), quote='"', escape='"')
        found = reader.csv(path) if schema else reader.option("inferSchema", True).csv(path)
        return found.toDF(*(c.removeprefix(BOM) for c in found.columns))
    return reader.option("multiLine", suffix == ".json").json(path)


def without_nan(table: DataFrame) -> DataFrame:
    """Null where a number is none, at any depth: JSON has no form for it."""
    return table.select(*(nested.without_nan(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in table.schema))


def write_csv(table: DataFrame, path: str, single: bool = False) -> None:
    """Semicolons, a header in UTF-8 with a byte-order mark in every part file, no index."""
    first, *rest = table.columns
    marked = (table.coalesce(1) if single else table).toDF(BOM + first, *rest)
    marked.write.options(header=True, sep=";", quote='"', escape='"', encoding="UTF-8").csv(path)


def write_json(table: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines; with ``single`` one array of records with an indent of two, for exports that one task may hold."""
    if not single:
        without_nan(table).write.json(path)
        return
    table = without_nan(table)
    rows = table.select(F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}).alias("r"))

    def array(batches):
        import pandas as pd

        records = [json.loads(r) for b in batches for r in b["r"]]
        yield pd.DataFrame({"value": [json.dumps(records, ensure_ascii=False, indent=2)]})

    rows.coalesce(1).mapInPandas(array, "value string").write.text(path)


def write_table(table: DataFrame, path: str, single: bool = False) -> None:
    """Writes by the path's suffix; a folder that is there already is an error."""
    suffix = suffix_of(path)
    if suffix == ".parquet":
        (table.coalesce(1) if single else table).write.parquet(path)
    elif suffix == ".csv":
        write_csv(table, path, single)
    else:
        write_json(table, path, single and suffix == ".json")


def export_profiles(profiles: DataFrame, path: str, columns: list[str] | None = None, preset: str | None = None, single: bool = False) -> list[str]:
    """Exports chosen columns of complete profiles, in the chosen order: all eighteen must be there first, the choice comes last."""
    from veredas.operators.profilestats import resolve_columns

    chosen = resolve_columns(columns, preset)
    missing = validate.missing_columns(profiles.columns)
    if missing:
        raise ValueError(f"profiles lack {', '.join(missing)}")
    write_table(profiles.select(*chosen), path, single)
    return chosen


def save_splits(split: DataFrame, folder: str, about: dict[str, object] | None = None) -> None:
    """The calibration table and its train and holdout parts as Parquet, and what is known of them as JSON."""
    spark = split.sparkSession
    split.drop("side").write.parquet(f"{folder}/calibration")
    for side in ("train", "holdout"):
        split.where(F.col("side") == side).drop("side").write.parquet(f"{folder}/{side}")
    write_record(spark, {"columns": [c for c in split.columns if c != "side"], **(about or {})}, f"{folder}/metadata")


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON object with sorted keys and an indent of two; what JSON has no form for is written as text."""
    text = json.dumps(record, sort_keys=True, indent=2, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def read_record(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))


def write_metric_outputs(long: DataFrame, folder: str, formats: tuple[str, ...] = ("parquet",)) -> None:
    """A long table of metrics, a folder a metric group, in every format asked for."""
    for kind in formats:
        if kind not in ("parquet", "csv", "json"):
            raise ValueError(f"unknown format {kind!r}")
        getattr(long.write.partitionBy("metric_group").options(**({"header": True} if kind == "csv" else {})), kind)(f"{folder}/{kind}")


def read_manifests(spark: SparkSession, folder: str, schema: str, name: str = "manifest.json") -> DataFrame:
    """All records called ``name`` below a folder, with their ``path`` and ``folder``; a file that is no JSON object of the schema gives none."""
    damaged = "_damaged"
    fields = StructType.fromDDL(f"{schema}, {damaged} string")
    found = spark.read.schema(fields).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=damaged, recursiveFileLookup=True, pathGlobFilter=name).json(folder)
    placed = found.select("*", F.col("_metadata.file_path").alias("path"))
    return placed.where(F.col(damaged).isNull()).drop(damaged).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))


def with_evaluations(manifests: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Manifests with the evaluation that lies in the same folder, where there is one."""
    side = evaluations.drop("path").withColumnRenamed("folder", "_folder")
    return manifests.join(side, F.col("folder") == F.col("_folder"), "left").drop("_folder")


def append_events(events: DataFrame, folder: str) -> None:
    """Adds audit events as JSON lines."""
    events.write.mode("append").json(folder)


def read_events(spark: SparkSession, folder: str, schema: str, order: str = "timestamp_utc", limit: int = 100) -> DataFrame:
    """The last ``limit`` audit events by ``order`` (ties by the line); lines that are no event are left out."""
    lines = spark.read.text(folder).select("value", F.from_json("value", schema).alias("e")).where(F.col(f"e.{order}").isNotNull())
    last = lines.orderBy(F.desc(f"e.{order}"), F.desc("value")).limit(limit)
    return last.select("e.*")


def profile_schema() -> str:
    """The schema of exported profiles, for readers that should not infer."""
    kinds = {"Idade": "int", "DDD": "int", "Dependentes": "int", "Renda": "double"}
    return ", ".join(f"{c} {kinds.get(c, 'string')}" for c in domain.FINAL_COLUMNS)
