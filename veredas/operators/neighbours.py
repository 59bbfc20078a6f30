"""The two nearest reference profiles of every profile, exactly, over all rows of both sides.

Profiles lie in cells, one for each pair of state and occupation: a number of them that does not grow with the data. Rows of a cell
that are alike are one row with a count. A cell knows which values it holds of every category and the range of its numbers; from two such
summaries follows how near two of their rows can be at the least. The search has two rounds:

1. every block of a cell's rows meets the reference blocks of the few cells that may lie nearest, until those hold two rows: that bounds each row's
   second-nearest distance from above;
2. a block meets the reference blocks of the other cells only where the least distance is below the largest bound of its rows.

A meeting of two blocks keeps two distances a row. Blocks are lots of a cell, of bounded size, so that a large cell is many of them; rows travel
as arrays, and no pair of rows is ever a row of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veredas.functions import domain
from veredas.functions.dialect import Spark
from veredas.session import work_folder

from .ranks import group_quantiles, settled

NUMBERS = ("Idade", "Renda", "Dependentes")
CATEGORIES = (*domain.CATEGORIES, "DDD")
CELL = ("Estado", "Ocupacao")
#: Rows of a block.
BLOCK = 4096
#: Cells that the first round looks at.
NEAR_CELLS = 3

_SQUARES = "side string, cell long, lot long, n long, rows binary, numbers binary, codes binary, counts binary"
_PART = "row long, d array<double>, tested long"


def scaled_sql(d: Spark, rel: str) -> str:
    """id, side, numbers scaled by the bounds of both sides together (a missing one is their median) and categories as text, of all rows."""
    good = lambda c: f"CASE WHEN {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE)) AND abs({c}) < 1e308 THEN CAST({c} AS DOUBLE) END"
    bounds = f"(SELECT {', '.join(f'min({good(c)}) AS lo_{c}, max({good(c)}) AS hi_{c}' for c in NUMBERS)} FROM {rel} AS t)"
    cells = [f"CASE WHEN {good(c)} IS NOT NULL THEN concat('{c}:', CAST({good(c)} AS VARCHAR(40))) END" for c in NUMBERS]
    long = f"(SELECT split_part(cell, ':', 1) AS name, CAST(split_part(cell, ':', 2) AS DOUBLE) AS v FROM (SELECT {d.explode(cells, 'cell')} FROM {rel} AS u) AS l WHERE cell IS NOT NULL)"
    middle = f"(SELECT {', '.join(f'''max(CASE WHEN name = '{c}' THEN mid END) AS mid_{c}''' for c in NUMBERS)} FROM {group_quantiles(long, {'name': 'name'}, 'v', {'mid': 0.5})} AS q)"
    scaled = ", ".join(f"(coalesce({good(c)}, mid_{c}, 0e0) - coalesce(lo_{c}, 0e0)) / CASE WHEN hi_{c} > lo_{c} THEN hi_{c} - lo_{c} ELSE 1e0 END AS z_{c}" for c in NUMBERS)
    named = ", ".join(f"coalesce(CAST({c} AS VARCHAR(60)), '<NA>') AS c_{c}" for c in CATEGORIES)
    return f"(SELECT row_id AS id, side, {scaled}, {named} FROM {rel} AS s CROSS JOIN {bounds} AS b CROSS JOIN {middle} AS m)"


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def _distances(za: np.ndarray, ca: np.ndarray, zb: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """Euclidean distances of scaled numbers and one-hot categories (two cells differ where a category does)."""
    total = np.zeros((len(za), len(zb)))
    for k in range(za.shape[1]):
        total += (za[:, k, None] - zb[None, :, k]) ** 2
    for k in range(ca.shape[1]):
        total += 2.0 * (ca[:, k, None] != cb[None, :, k])
    return np.sqrt(total)


def _two_nearest(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The two least distances of every row, where a column stands for as many reference rows as it counts."""
    out = np.full((len(d), 2), np.inf)
    first = d.argmin(1)
    out[:, 0] = d[np.arange(len(d)), first]
    twice = counts[first] > 1
    if d.shape[1] > 1:
        rest = d.copy()
        rest[np.arange(len(d)), first] = np.inf
        out[:, 1] = rest.min(1)
    out[twice, 1] = out[twice, 0]
    return out


def _met(pairs: DataFrame) -> DataFrame:
    """row, its two least distances in the reference block, and the distances computed, for every row of the pairs' query blocks that its ``bound`` does not rule out."""
    arrow = _schema(_PART)
    n_z, n_c = len(NUMBERS), len(CATEGORIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, m = r["n"], r["ref_n"]
                rows, bound = np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["bounds"], "<f8") if r["bounds"] is not None else np.full(n, np.inf)
                za, ca = np.frombuffer(r["numbers"], "<f8").reshape(n, n_z), np.frombuffer(r["codes"], "<i8").reshape(n, n_c)
                zb, cb = np.frombuffer(r["ref_numbers"], "<f8").reshape(m, n_z), np.frombuffer(r["ref_codes"], "<i8").reshape(m, n_c)
                open_ = np.flatnonzero(bound > r["least"] - 1e-9)
                if len(open_):
                    found = _two_nearest(_distances(za[open_], ca[open_], zb, cb), np.frombuffer(r["ref_counts"], "<i8"))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(open_) + 1, dtype=np.int32) * 2), pa.array(found.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[open_]), flat, pa.array(np.full(len(open_), m))], schema=arrow)

    return pairs.mapInArrow(run, _PART)


def _least_two(parts: DataFrame) -> DataFrame:
    """The two least of a row's distances, and how many were computed; two numbers a part are put together before and after the shuffle."""
    flat = parts.select("row", "tested", F.posexplode("d").alias("k", "v"))
    best = flat.groupBy("row").agg(F.slice(F.sort_array(F.collect_list("v")), 1, 2).alias("d"), F.sum(F.when(F.col("k") == 0, F.col("tested")).otherwise(0)).alias("tested"))
    return best.select("row", F.col("d")[0].alias("d1"), F.col("d")[1].alias("d2"), "tested")


def two_nearest(spark: SparkSession, rel: str, block: int = BLOCK) -> DataFrame:
    """id, d1 and d2 of every synthetic row of a relation with row_id, side and the model columns, and ``tested``: the distances computed for its kind."""
    folder = work_folder(spark, "neighbours")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    z, c = [f"z_{x}" for x in NUMBERS], [f"c_{x}" for x in CATEGORIES]
    rows = spark.sql(f"SELECT * FROM {scaled_sql(Spark(), rel)}")
    rows = rows.withColumns({name: F.xxhash64(name) for name in c}).withColumn("cell", F.xxhash64(*(f"c_{x}" for x in CELL)))
    rows = kept(rows.withColumn("kind", F.xxhash64(*z, *c)), "rows")
    kinds = rows.groupBy("side", "cell", "kind", *z, *c).agg(F.count("*").alias("k"))
    sizes = F.broadcast(kept(kinds.groupBy("side", "cell").agg(F.count("*").alias("m")), "sizes"))  # as many as there are cells
    lotted = kinds.join(sizes, ["side", "cell"]).withColumn("lot", F.pmod(F.xxhash64(F.col("kind"), F.lit(1)), F.ceil(F.col("m") / block)))
    arrow = _schema(_SQUARES)

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        take = lambda names, kind: np.column_stack([np.asarray(group.column(n), dtype=kind) for n in names]).tobytes()
        side, cell, lot = (x.as_py() for x in key)
        values = (side, cell, lot, group.num_rows, take(["kind"], "<i8"), take(z, "<f8"), take(c, "<i8"), take(["k"], "<i8"))
        return pa.Table.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    blocks = kept(lotted.groupBy("side", "cell", "lot").applyInArrow(packed, _SQUARES), "blocks")
    summary = kept(kinds.groupBy("side", "cell").agg(*(F.collect_set(x).alias(x) for x in c if x not in [f"c_{y}" for y in CELL]), *(F.first(f"c_{y}").alias(f"c_{y}") for y in CELL), *(F.min(x).alias(f"lo_{x}") for x in z), *(F.max(x).alias(f"hi_{x}") for x in z), F.sum("k").alias("k")), "summary")

    # The least distance of two cells. Their number is bounded by the categories, not by the rows.
    a, b = summary.where("side = 'syn'").alias("a"), summary.where("side = 'ref'").alias("b")
    gap = sum((F.greatest(F.col(f"a.lo_{x}") - F.col(f"b.hi_{x}"), F.col(f"b.lo_{x}") - F.col(f"a.hi_{x}"), F.lit(0.0)) ** 2 for x in z), F.lit(0.0))
    apart = sum((F.when(F.col(f"a.{x}") != F.col(f"b.{x}"), 2.0).otherwise(0.0) if x in [f"c_{y}" for y in CELL] else F.when(F.arrays_overlap(f"a.{x}", f"b.{x}"), 0.0).otherwise(2.0) for x in c), F.lit(0.0))
    near = a.crossJoin(F.broadcast(b)).select(F.col("a.cell").alias("cell"), F.col("b.cell").alias("ref_cell"), F.sqrt(gap + apart).alias("least"), F.col("b.k").alias("k"))
    ordered = near.withColumn("place", F.expr("row_number() OVER (PARTITION BY cell ORDER BY least, ref_cell)")).withColumn("upto", F.expr("sum(k) OVER (PARTITION BY cell ORDER BY least, ref_cell ROWS UNBOUNDED PRECEDING)"))
    ordered = kept(ordered.withColumn("early", (F.col("place") <= NEAR_CELLS) | (F.col("upto") - F.col("k") < 2)), "cells")

    queries, refs = blocks.where("side = 'syn'").drop("side"), blocks.where("side = 'ref'").select(F.col("cell").alias("ref_cell"), *(F.col(x).alias(f"ref_{x}") for x in ("n", "numbers", "codes", "counts")))
    wanted = ["n", "rows", "numbers", "codes", "ref_n", "ref_numbers", "ref_codes", "ref_counts", "least", "bounds"]
    early = queries.join(F.broadcast(ordered.where("early")), "cell").join(refs, "ref_cell").withColumn("bounds", F.lit(None).cast("binary"))
    first = kept(_met(early.select(*wanted)), "first")
    bounds = _least_two(first).withColumnRenamed("row", "kind").select("kind", F.coalesce("d2", F.lit(float("inf"))).alias("bound"))

    def with_bounds(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The query block with the bounds of its rows, in their order."""
        known = dict(zip(right.column("kind").to_pylist(), right.column("bound").to_pylist(), strict=True))
        own = [known.get(k, np.inf) for k in np.frombuffer(left.column("rows")[0].as_py(), "<i8").tolist()]
        return left.append_column("bounds", pa.array([np.array(own, "<f8").tobytes()], type=pa.binary())).append_column("most", pa.array([max(own)], type=pa.float64()))

    lots = lotted.where("side = 'syn'").select("kind", "cell", "lot").join(bounds, "kind")
    bounded = kept(queries.groupBy("cell", "lot").cogroup(lots.groupBy("cell", "lot")).applyInArrow(with_bounds, "cell long, lot long, n long, rows binary, numbers binary, codes binary, counts binary, bounds binary, most double"), "bounded")
    late = bounded.join(F.broadcast(ordered.where("NOT early")), "cell").where("least < most").join(refs, "ref_cell")
    found = _least_two(first.unionByName(kept(_met(late.select(*wanted)), "second")))
    finite = lambda x: F.when(F.col(x) < float("inf"), F.col(x)).alias(x)
    return rows.where("side = 'syn'").select("id", "kind").join(found.withColumnRenamed("row", "kind"), "kind").select("id", finite("d1"), finite("d2"), "tested")


def summary(spark: SparkSession, rel: str, block: int = BLOCK) -> DataFrame:
    """n, and mean and extremes of the nearest distance and of its ratio to the second (1 where that is 0), over all synthetic rows."""
    two_nearest(spark, rel, block).createOrReplaceTempView("veredas_two_nearest")
    return spark.sql(summary_sql(Spark(), "veredas_two_nearest"))


def summary_sql(d: Spark, rel: str) -> str:
    ratio = "CASE WHEN d2 IS NULL THEN NULL WHEN d2 = 0 THEN 1e0 ELSE d1 / d2 END"
    one = f"(SELECT 1 AS one, d1, {ratio} AS ratio FROM {rel} AS t)"
    middle = lambda x: f"(SELECT m FROM {group_quantiles(one, {'one': 'one'}, x, {'m': 0.5})} AS q)"
    return f"SELECT n, dcr_min, dcr_mean, nndr_mean, {settled('p.m')} AS dcr_median, {settled('r.m')} AS nndr_median FROM (SELECT count(*) AS n, {settled('min(d1)')} AS dcr_min, {settled('avg(d1)')} AS dcr_mean, {settled(f'avg({ratio})')} AS nndr_mean FROM {rel} AS t) AS s CROSS JOIN {middle('d1')} AS p CROSS JOIN {middle('ratio')} AS r"


def brute_sql(d: Spark, rel: str) -> str:
    """The same distances from all pairs, for checking."""
    numbers = " + ".join(f"(a.z_{x} - b.z_{x}) * (a.z_{x} - b.z_{x})" for x in NUMBERS)
    dist = f"sqrt({numbers} + {' + '.join(f'CASE WHEN a.c_{x} <> b.c_{x} THEN 2e0 ELSE 0e0 END' for x in CATEGORIES)})"
    pairs = f"(SELECT a.id, {dist} AS dist FROM scaled AS a CROSS JOIN scaled AS b WHERE a.side = 'syn' AND b.side = 'ref')"
    two = f"(SELECT id, list_sort(list(dist))[1] AS d1, list_sort(list(dist))[2] AS d2 FROM {pairs} AS p GROUP BY id)"
    return f"WITH scaled AS (SELECT * FROM {scaled_sql(d, rel)} AS z), two AS {two} {summary_sql(d, 'two')}"
