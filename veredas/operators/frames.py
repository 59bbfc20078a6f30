"""Reports on frames as they come: the plan is built from the columns that a frame has.

Columns may be text, and any of the required ones may be absent. A frame without row ids is numbered by its content first
(:mod:`finalize`), so that which of several equal rows counts as the later one does not depend on partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from veredas.functions.dialect import Spark

from . import finalize, validate


def _named(df: DataFrame) -> tuple[str, tuple[str, ...]]:
    """The frame as a temporary view with row ids, and its other columns."""
    view = f"frame_{uuid.uuid4().hex}"
    columns = tuple(c for c in df.columns if c != "row_id")
    if "row_id" not in df.columns:
        df.createOrReplaceTempView(f"{view}_given")
        df = df.sparkSession.sql(f"SELECT * FROM {finalize.numbered_sql(Spark(), f'{view}_given', columns)}")
    df.createOrReplaceTempView(view)
    return view, columns


def report(df: DataFrame, final: bool = True, rules: dict[str, validate.UserRule] | None = None) -> DataFrame:
    """reason and n: the validation report of a frame, with the rules that were added, or with those given."""
    view, columns = _named(df)
    return df.sparkSession.sql(validate.validation_report(Spark(), view, final, columns, rules))


def judged(df: DataFrame, final: bool = True, rules: dict[str, validate.UserRule] | None = None) -> DataFrame:
    """row_id, valid and reasons of every row."""
    view, columns = _named(df)
    return df.sparkSession.sql(validate.validation_reasons(Spark(), view, final, columns, rules))


def rule_counts(df: DataFrame, final: bool = True) -> DataFrame:
    """Per rule that the frame can be judged by, those of the caller included: rows, invalid rows and rate."""
    view, columns = _named(df)
    chosen = validate.rules(Spark(), columns) | (validate.final_rules(Spark(), columns) if final else {})
    return df.sparkSession.sql(validate.rule_counts(Spark(), view, chosen))
