"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the text's UTF-8 bytes (null: empty); other columns are left out of the scan."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; one of our own only where none is set and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veredas-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet below the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/veredas/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that travel to a Python worker at once in long jobs of whole documents.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets Arrow batches of ``BATCH_ROWS`` rows at most; a smaller setting of the caller stays (0 or less: no bound, is replaced).

    The JVM holds a batch outside its heap, up to twice its size while it grows, for every task, and the worker holds it again.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of ``most`` rows at most for the jobs run inside; the caller's setting holds where it is smaller, and again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, most) if before > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps, whose frames nothing refers to any more.

    The cleaner learns from the driver's garbage collection; plans take two of them.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def text_bytes(docs: DataFrame) -> int:
    """Total bytes of ``body``; one pass over the column, one number back."""
    return int(docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0)


def n_parts(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-total // each))


def map_rows(df: DataFrame, f: Callable[[list, list], dict], schema: str, slice_bytes: int = 8 << 20) -> DataFrame:
    """``f(doc_ids, bodies) -> columns`` over Arrow batches of (doc_id, body), in slices bounded in bytes."""
    arrow = arrow_schema(schema)
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()  # what the worker's last task left behind is collected after its last batch
        for batch in batches:
            for lo, hi in slices(batch.column("body"), slice_bytes):
                part = batch.slice(lo, hi - lo)
                out = f(part.column("doc_id").to_pylist(), part.column("body").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)
            trim()

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def slices(bodies: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a binary column that hold at most ``most`` bytes each (one row at least)."""
    n = len(bodies)
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(bodies), 0), dtype=np.int64)
    ends = np.cumsum(size)
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield lo, hi
        lo = hi


def trim() -> None:
    """Gives a worker's freed memory back: workers are reused and would keep the peak of every step."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def offsets_of(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens) + 1, dtype=np.int64)
    np.cumsum(lens, out=out[1:])
    return out


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (wraps on purpose)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


#: Ids that one executor and the driver hold without strain (a long hash relation of some 5 MB).
BROADCAST_IDS = 200_000


def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted``, or the like of it that no column of ``docs`` has (names differ in more than case)."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def named(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def drop_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``ids`` (one column of longs, written once here).

    Up to BROADCAST_IDS ids are broadcast after counting them; more are anti-joined by a shuffle.
    """
    gone = free_name(docs, "_gone")
    ids = materialize(ids.toDF(gone).distinct(), "gone")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, named(key).cast("long") == named(gone), "left_anti")


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for every row, and that column's name, which no column of ``docs`` has; written once, so that the keys hold."""
    row = free_name(docs, "_row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def without_rows(rows: DataFrame, row: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows (of :func:`with_row`) whose key is not in ``gone``, with the columns they came with."""
    return drop_ids(rows, gone, row).select(*map(named, columns))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
