"""The contract of a generator of profiles, the generator by rules, and the table of generators."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from veredas.sources.files import read_record, write_record

from .generate import generate_profiles


class Synthesizer(ABC):
    """Fits on a frame of profiles, samples lazily, and is saved and loaded by folder."""

    @abstractmethod
    def fit(self, profiles: DataFrame) -> Synthesizer: ...

    @abstractmethod
    def sample(self, spark: SparkSession, n: int) -> DataFrame: ...

    @abstractmethod
    def save(self, spark: SparkSession, folder: str) -> None: ...

    @classmethod
    @abstractmethod
    def load(cls, spark: SparkSession, folder: str) -> Synthesizer: ...


@dataclass
class Programmatic(Synthesizer):
    """Samples from the rules of the generator; fitting learns nothing. Every sample has a seed of its own."""

    seed: int = 41
    income_version: int = 3
    calls: int = 0

    def fit(self, profiles: DataFrame) -> Programmatic:
        return self

    def sample(self, spark: SparkSession, n: int) -> DataFrame:
        ids = spark.range(n).withColumnRenamed("id", "row_id")
        made = generate_profiles(ids, self.seed + self.calls, self.income_version)
        self.calls += 1
        return made

    def save(self, spark: SparkSession, folder: str) -> None:
        write_record(spark, {"kind": "programmatic", **asdict(self)}, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Programmatic:
        record = read_record(spark, folder)
        if record.pop("kind", None) != "programmatic":
            raise ValueError(f"{folder!r} holds no generator by rules")
        return cls(**record)


_MADE: dict[str, Callable[..., Synthesizer]] = {}


def register(name: str, make: Callable[..., Synthesizer], *aliases: str) -> None:
    for n in (name, *aliases):
        _MADE[n.lower()] = make


def create(name: str, **options: object) -> Synthesizer:
    """A generator by its name or alias."""
    if name.lower() not in _MADE:
        raise ValueError(f"unknown generator {name!r}; known are {', '.join(sorted(_MADE))}")
    return _MADE[name.lower()](**options)


register("programmatic", Programmatic, "rules", "baseline")
