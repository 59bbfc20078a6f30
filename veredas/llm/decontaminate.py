"""Benchmark decontamination with DataFrame functions only.

A window is ten consecutive words of a benchmark item, or the whole item where
it is shorter. Windows are normalised (A-Z lower-cased, words re-joined by one
space) and go to the executors as a broadcast hash set; document windows are
probed against it and equal strings verify the hit.

Probing every word position of a large corpus would hash ten words each time.
Every benchmark window therefore names an anchor, its longest word; a document
without an anchor is done after one set intersection, and elsewhere only the
windows that cover an anchor are built. This is exact: a document window that
equals a benchmark window contains that window's anchor.

The benchmark is measured before it is broadcast (``BROADCAST_BYTES``). A larger one
is joined by a shuffle on the window, without anchors.

A null or empty text has no words, no hit and is never contaminated; items
without words have no window. Rows are kept apart even where ids repeat. Texts are searched whole, however long; an empty
table of documents gives an empty result, an empty benchmark no hits. Extra columns of either input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_ids, named, with_row, without_rows

WINDOW = 10
BROADCAST_BYTES = 32 << 20
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def _joined(w: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(w, start, size), " ")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows: window text, its length in words, anchor word, and the ids of its items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    each = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, n))).alias("g"))
    longest = F.array_max(F.transform("g", lambda x: F.struct(F.length(x).alias("n"), x.alias("word")))).getField("word")
    return (
        each.groupBy(F.array_join("g", " ").alias("window"), F.size("g").alias("size"), longest.alias("anchor"))
        .agg(F.collect_set("item_id").alias("items"))
    )


def _sized_windows(w: Column, size: int, positions: Column | None) -> Column:
    n = F.size(w)
    if positions is None:
        starts = F.sequence(F.lit(1), n - size + 1)
    else:
        starts = F.array_distinct(F.flatten(F.transform(positions, lambda p: F.sequence(F.greatest(p - size + 1, F.lit(1)), F.least(p, n - size + 1)))))
    made = F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(size).alias("size"), _joined(w, s, F.lit(size)).alias("window")))
    return F.when(n >= size, made)


def _windows_of(w: Column, sizes: list[int], positions: Column | None) -> Column:
    """(start, size, window text) of the document windows of the given sizes; all of them, or those that cover a position."""
    none = F.array().cast("array<struct<start: int, size: int, window: string>>")
    return F.flatten(F.array(*[F.coalesce(_sized_windows(w, k, positions), none) for k in sizes])) if sizes else none


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a hit), items (sorted as strings).

    The benchmark's windows are counted first. The documents are read once; only
    one row per document and the hits are shuffled.
    """
    found = item_windows(benchmark, window)
    stats = found.agg(F.sum(F.octet_length("window") + F.octet_length("anchor")).alias("b"), F.collect_set("size").alias("sizes")).first()
    small = (stats.b or 0) <= BROADCAST_BYTES
    sizes = sorted(stats.sizes)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    if small:
        anchors = [r.anchor for r in found.select("anchor").distinct().collect()]
        base = base.withColumn("hits", F.array_intersect("w", F.lit(anchors) if anchors else F.array().cast("array<string>")))
        at = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains("hits", x), i + 1)), lambda p: p.isNotNull())
        made = F.when(F.size("hits") > 0, _windows_of(F.col("w"), sizes, F.col("at")))
        base = base.withColumn("at", F.when(F.size("hits") > 0, at))
    else:
        made = _windows_of(F.col("w"), sizes, None)
    rows = base.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.explode_outer(made).alias("x")).select("doc_id", "row", "n_words", "x.start", "x.size", "x.window")
    side = found.select("window", "items")
    hit = rows.join(F.broadcast(side) if small else side, "window", "left")
    span = F.when(F.col("items").isNotNull(), F.struct("start", (F.col("start") + F.col("size")).alias("end")))
    per = hit.groupBy("row", "doc_id").agg(F.first("n_words").alias("n_words"), F.collect_list(span).alias("spans"), F.collect_set("items").alias("items"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n")),
        lambda acc: acc["n"],
    )
    return per.select("doc_id", "n_words", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without those that hold a benchmark window; all columns stay.

    Acts by id: rows that share an id with such a document go too, and rows with a null id stay.
    """
    return drop_ids(docs, contamination(docs, benchmark, window).where("n_hit > 0 and doc_id is not null").select("doc_id"))


def decontaminate_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows without those that hold a benchmark window; each is judged alone, whatever its id; all columns stay, whatever their names."""
    rows, row = with_row(docs)
    judged = contamination(rows.select(named(row).alias("doc_id"), "text"), benchmark, window)
    return without_rows(rows, row, judged.where("n_hit > 0").select("doc_id"), docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, list_aggregate(list_slice(w, s, s + k - 1), 'string_agg', ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, s, list_aggregate(list_slice(w, s, s + k - 1), 'string_agg', ' ') AS g FROM di),
h AS (SELECT doc_id, s, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS j FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
