"""Fill-in-the-middle transformation by big-integer bit-parallelism.

A text is cut into units, its lines (a line ends behind its line feed), and two of the
bounds between units part it into prefix, middle and suffix. One Python integer is a class mask of
the text's bytes, a bit each: ``bytes.translate`` writes the mask's digits, a shift and a mask of line feeds
mark where units start, ``int.bit_count`` gives their number, and a ranked bit is
found by halving the integer again and again, which is linear in the text all in all. Code points are counted in the
mask of bytes that continue none.

The two cuts, whether a text is changed at all and the order of its parts come from the
SHA-256 of seed and id, so that a retried task gives the same output. Rows with equal ids and
texts get equal results, a null id counts as an empty one. A null text counts as empty; empty texts, and texts
that hold a sentinel, stay as they are (form ``plain``). Texts are cut whole, however long; one narrow pass without a shuffle.
Columns besides the id and the text are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_rows


def _digits(marked: set[int]) -> bytes:
    return bytes(0x31 if b in marked else 0x30 for b in range(256))


_FEED = _digits({0x0A})
_LEAD = _digits({*range(0x80), *range(0xC0, 0x100)})


@dataclass(frozen=True)
class Plan:
    """What decides the outputs; sentinels must not overlap one another."""

    seed: int = 7
    fim_percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        tails = [m[k:] for m in marks for k in range(1, len(m))]
        if not all(marks) or len(set(marks)) < 3 or any(m.startswith(t) for m in marks for t in tails) or any(a in b for a in marks for b in marks if a != b):
            raise ValueError("sentinels must not be empty, equal, or overlap one another")


def class_mask(body: bytes, digits: bytes) -> int:
    """Bit i is set where byte i is of the class."""
    return int(body[::-1].translate(digits), 2) if body else 0


def unit_starts(body: bytes) -> int:
    """Bits of the bytes that begin a line."""
    return ((class_mask(body, _FEED) << 1) | 1) & ((1 << len(body)) - 1)


def select(mask: int, width: int, rank: int) -> int:
    """Place of the set bit with ``rank`` (from 0) set bits below it."""
    at = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            mask, width = low, half
        else:
            mask, width, rank, at = mask >> half, width - half, rank - n, at + half
    return at


def cuts(body: bytes, first: int, second: int) -> tuple[int, int, int]:
    """Number of units, and the byte bounds behind the smaller and the larger of two draws modulo units + 1."""
    starts = unit_starts(body)
    n = starts.bit_count()
    lo, hi = sorted((first % (n + 1), second % (n + 1)))
    return n, *(len(body) if k == n else select(starts, len(body), k) for k in (lo, hi))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform_body(doc_id: int | None, body: bytes, plan: Plan) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output."""
    h1, h2, h3, h4 = draws(plan.seed, doc_id)
    n, a, b = cuts(body, h1, h2)
    marks = [m.encode() for m in (plan.prefix, plan.suffix, plan.middle)]
    if not body or any(m in body for m in marks) or h3 % 100 >= plan.fim_percent:
        return n, "plain", None, None, body
    prefix, middle, suffix = body[:a], body[a:b], body[b:]
    lead = class_mask(body, _LEAD)
    n_prefix = (lead & ((1 << a) - 1)).bit_count()
    n_middle = (lead & ((1 << b) - 1)).bit_count() - n_prefix
    if h4 % 100 < plan.spm_percent:
        return n, "spm", n_prefix, n_middle, b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle))
    return n, "psm", n_prefix, n_middle, b"".join((marks[0], prefix, marks[1], suffix, marks[2], middle))


def transform(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and ``output`` of every text."""
    plan = plan or Plan()

    def rows(ids: list, bodies: list) -> dict:
        each = [transform_body(i, b, plan) for i, b in zip(ids, bodies, strict=True)]
        return {"doc_id": ids} | {name: [x[k] for x in each] for k, name in enumerate(("n", "form", "prefix_chars", "middle_chars", "output"))}

    return map_rows(id_text(docs), rows, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", slice_bytes=4 << 20)


def restored(output: Column, form: Column, plan: Plan | None = None) -> Column:
    """The text that an output was made from; no sentinel but those put in stands in an output."""
    plan = plan or Plan()
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in (plan.prefix, plan.suffix, plan.middle)))
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:n], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
