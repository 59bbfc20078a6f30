"""Made-up profiles from a data source: ``spark.read.format("profile_ids").options(rows=n).load()`` and what follows from the ids.

The source deals out row ids, split evenly over its partitions; a row's values are functions of seed and id, as in :func:`generate.profiles_sql`,
so that the rows do not depend on the number of partitions. The source deals out ids only; values are made by Spark's own expressions, in
which :func:`read` wraps it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veredas.operators import generate

NAME = "profile_ids"
#: Ids that one batch carries.
BATCH = 1 << 16


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


class _Ids(DataSourceReader):
    def __init__(self, first: int, rows: int, n: int) -> None:
        self.first, self.rows, self.n = first, rows, n

    def partitions(self) -> list[_Range]:
        cut = [self.first + self.rows * k // self.n for k in range(self.n + 1)]
        return [_Range(a, b) for a, b in zip(cut, cut[1:], strict=False) if b > a] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        for lo in range(partition.first, partition.last, BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(range(lo, min(lo + BATCH, partition.last)), pa.int64())], names=["row_id"])


class ProfileIds(DataSource):
    """Row ids from ``first`` on; options ``rows``, ``first`` (0) and ``partitions`` (8)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "row_id long"

    def _whole(self, name: str, default: int | None, least: int) -> int:
        said = self.options.get(name, default)
        try:
            value = int(said)
        except (TypeError, ValueError):
            value = least - 1
        if value < least:
            raise ValueError(f"option {name!r} must be a whole number of {least} or more, not {said!r}")
        return value

    def reader(self, schema: object) -> _Ids:
        return _Ids(self._whole("first", 0, 0), self._whole("rows", None, 0), self._whole("partitions", 8, 1))


def read(spark: SparkSession, rows: int, seed: int = 41, first: int = 0, partitions: int = 8, final: bool = False, version: int = 3) -> DataFrame:
    """row_id and the model columns (or the final ones) of some made-up profiles."""
    spark.dataSource.register(ProfileIds)
    ids = spark.read.format(NAME).options(rows=rows, first=first, partitions=partitions).load()
    return generate.generate_final_profiles(ids, seed) if final else generate.generate_profiles(ids, seed, version)
