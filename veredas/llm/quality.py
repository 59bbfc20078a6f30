"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one integer whose bit *i* says that rule *i* failed; a policy is nothing but
another integer, so that a new policy version, a comparison of two versions or
an ablation needs bitwise arithmetic over the ledger and never the texts again.

Words are runs of anything but the six ASCII white-space characters. A null or
empty text has no words and fails the first rule. Rows are judged one by one, so
ties and repeated rows get equal results, and whole texts are measured, however long; extra columns of the input are
ignored by :func:`ledger` and kept by :func:`apply_policy`.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, id_text, map_rows

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_A_CODE_POINT = _SPACE + bytes(range(0x80, 0xC0))

MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_lines": "long",
    "n_dup_lines": "long", "n_repeat_words": "long", "n_adjacent": "long",
}

#: name -> SQL predicate over the measurements, true where the rule fails; the place in the list is the bit.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "stutter": "10 * n_adjacent > 3 * n_words",
}
BASE_RULES = ("too_few_words", "repeated_windows")

#: version -> rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE_RULES,
    "v2": (*BASE_RULES, "symbols", "short_words", "long_words", "duplicate_lines", "stutter"),
}
CURRENT = "v2"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: tuple[str, ...]) -> int:
    return sum({bit(r) for r in rules})


def measure(body: bytes) -> tuple[int, int, int, int, int, int, int]:
    """The measurements of one text, in the order of MEASURES."""
    words = body.split()
    n = len(words)
    lines = [x for x in body.split(b"\n") if x.strip()]
    repeat = 0
    if n > WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            seen, end = Counter(windows), 0
            for at, w in enumerate(windows):
                if seen[w] > 1:
                    repeat += at + WINDOW - max(end, at)
                    end = at + WINDOW
    return (
        n,
        len(body.translate(None, _NOT_A_CODE_POINT)),
        len(body) - len(body.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat,
        sum(map(bytes.__eq__, words, words[1:])),
    )


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text; one narrow pass, no shuffle."""

    def rows(ids: list, bodies: list) -> dict:
        columns = list(zip(*map(measure, bodies), strict=True)) or [[]] * len(MEASURES)
        return {"doc_id": ids} | dict(zip(MEASURES, columns, strict=True))

    return map_rows(id_text(docs), rows, "doc_id long, " + ", ".join(f"{k} {v}" for k, v in MEASURES.items()))


def failures() -> Column:
    """The bitmask of failed rules, from the measurements."""
    bits = [F.when(F.expr(p), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(RULES.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed`` (bigint bitmask)."""
    return measures(docs).withColumn("failed", failures())


def verdict(rules: tuple[str, ...]) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(rules))) == 0


def judge(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy version."""
    return (
        ledger(docs)
        .withColumn("base_failed", ~verdict(BASE_RULES))
        .withColumn("kept", ~F.col("base_failed") & verdict(POLICIES[policy]))
    )


def apply_policy(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with all their columns; judged beside the row, without a shuffle.

    Columns of the input may have any names: the measurements travel in one struct that is dropped again.
    """
    @F.pandas_udf("struct<" + ", ".join(f"{k}: {v}" for k, v in MEASURES.items()) + ">")
    def measured(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(b) for b in bodies], columns=list(MEASURES))

    held = free_name(docs, "_measured")
    wanted = mask(POLICIES[policy])
    bits = " | ".join(f"CASE WHEN {_qualified(p, held)} THEN {1 << i} ELSE 0 END" for i, p in enumerate(RULES.values()))
    with_struct = docs.withColumn(held, measured(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return with_struct.where(F.expr(f"(({bits}) & {wanted}) = 0")).drop(held)


def _qualified(predicate: str, held: str) -> str:
    return re.sub(r"\b[a-z]\w*\b", lambda m: f"{held}.{m.group()}", predicate)


def ablation(ledger_rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects.

    Dropping the rule would bring back ``only_this`` documents. One aggregation
    over the bitmask; the rules are few and known, the output has a row for each.
    """
    rules = POLICIES[policy]
    m = F.col("failed").bitwiseAND(F.lit(mask(rules)))
    sums = []
    for r in rules:
        sums += [F.sum(m.bitwiseAND(F.lit(bit(r))).cast("boolean").cast("long")).alias(f"{r}_any"), F.sum((m == bit(r)).cast("long")).alias(f"{r}_only")]
    one = ledger_rows.agg(F.count("*").alias("n_docs"), F.sum((m == 0).cast("long")).alias("n_kept"), *sums)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(f"{r}_any"), F.lit(0)).alias("n_failed"), F.coalesce(F.col(f"{r}_only"), F.lit(0)).alias("only_this")) for r in rules])
    return one.select("n_docs", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.explode(each).alias("r")).select("r.*", "n_docs", "n_kept")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
g AS (SELECT doc_id, i, list_aggregate(list_slice(ws, i, i + 4), 'string_agg', ' ') AS g FROM p WHERE i + 4 <= len(ws)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r) GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n FROM p WHERE i < len(ws) AND ws[i] = ws[i + 1] GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(a.n, 0) AS n_adjacent
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN a USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
             (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) | (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
             | (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) | (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
             | (CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END) | (CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END)
             | (CASE WHEN 10 * n_adjacent > 3 * n_words THEN 64 ELSE 0 END) AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND failed = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM b
"""
