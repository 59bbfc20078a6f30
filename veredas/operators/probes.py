"""What a job's stages did: rows, metrics of the caller, seconds and resources, from the run itself.

Figures come from observed metrics: Spark counts them while the stage's own action runs, so that no pass over the data is added. A callback
may receive every record as it is made, and a probe of resources is asked before and after.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "place int, stage string, seconds double, resource_before double, resource_after double, metric string, value double"


@dataclass
class Probes:
    """Collects a record a stage. ``resource``: a number such as memory in use; ``on_stage``: gets every record."""

    resource: Callable[[], float | None] | None = None
    on_stage: Callable[[dict[str, Any]], None] | None = None
    records: list[dict[str, Any]] = field(default_factory=list)

    def run(self, name: str, df: DataFrame, action: Callable[[DataFrame], Any], **metrics: Column) -> Any:
        """Runs ``action`` on ``df`` and keeps its figures: ``rows`` and the given aggregates over the rows that the action sees.

        An action that does not read all rows leaves counts of what it read. A failing action is recorded with what is known, and raises.
        """
        if any(r["stage"] == name for r in self.records):
            raise ValueError(f"stage {name!r} was run before")
        seen = Observation(name)
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in metrics.items()))
        record: dict[str, Any] = {"stage": name, "resource_before": self.resource() if self.resource else None, "metrics": {}}
        began = time.perf_counter()
        try:
            out = action(watched)
            record["metrics"] = dict(seen.get)
            return out
        finally:
            record |= {"seconds": time.perf_counter() - began, "resource_after": self.resource() if self.resource else None}
            self.records.append(record)
            if self.on_stage:
                self.on_stage(record)

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each metric of each stage, in the order of the run."""
        rows = [(k, r["stage"], r["seconds"], r["resource_before"], r["resource_after"], n, None if v is None else float(v)) for k, r in enumerate(self.records) for n, v in (r["metrics"] or {"rows": None}).items()]
        return spark.createDataFrame(rows, SCHEMA)


def valid_rows(mask: str = "valid") -> Column:
    """The metric of rows whose mask holds."""
    return F.coalesce(F.sum(F.when(F.col(mask), 1).otherwise(0)), F.lit(0))
