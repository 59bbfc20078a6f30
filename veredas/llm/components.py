"""Connected components of an edge table, without a driver or a task that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least(neighbours: DataFrame) -> DataFrame:
    """Every (u, v) with m = the least of u and its neighbours; minima are aggregated before the shuffle."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m"))
    return neighbours.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (its smallest id) of every id of ``edges`` (a, b: long).

    Alternates large-star and small-star steps until nothing changes: each edge table is
    written to the shared folder, so the lineage stays short. Loops, repeated edges and edges with a null
    are allowed and tell nothing; an id that has only those is left out.
    """
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = _signature(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _least(both).where("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = _least(down)
        joined = small.select(F.col("m").alias("a"), F.col("v").alias("b")).union(small.select(F.col("m").alias("a"), F.col("u").alias("b")))
        now = materialize(joined.where("a <> b").distinct(), "edges")
        after = _signature(now)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
