"""SQL expressions that two engines spell differently.

The operators write plain SQL once; a dialect fills in the few functions whose names differ, so that
the same definition runs on Spark and is checked by DuckDB.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import SparkSession

from veredas.session import work_folder

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
WHOLE_STAGE = "spark.sql.codegen.wholeStage"


def _listed(values: Iterable[str]) -> str:
    """An array literal of texts without a comma, short to parse."""
    return f"split({literal(','.join(values))}, ',')"


class Spark:
    """Spark SQL (ANSI mode)."""

    def __init__(self, sf_dir: str = "", session: SparkSession | None = None) -> None:
        self.sf_dir = sf_dir
        self.session = session
        self._kept: dict[str, str] = {}

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def kept(self, rel: str, name: str, columns: Iterable[str] = (), wide: bool = True) -> str:
        """``rel`` (or some columns of it), written once and read from there by all that follows; without a session it is ``rel`` itself.

        Long rows of expressions (``wide``) are made projection by projection, in methods of a size that the JVM compiles: one method for a
        whole stage has more than the 8,000 bytes of code beyond which the JVM only interprets it.
        """
        if self.session is None:
            return rel
        if rel not in self._kept:
            path, conf = work_folder(self.session, name), self.session.conf
            before = {k: conf.get(k) for k in (METHOD_LIMIT, WHOLE_STAGE)}
            conf.set(METHOD_LIMIT, "8000")
            if wide:
                conf.set(WHOLE_STAGE, "false")
            try:
                self.session.sql(f"SELECT {', '.join(columns) or '*'} FROM {rel} AS kept").write.parquet(path)
            finally:
                for k, v in before.items():
                    conf.set(k, v)
            self._kept[rel] = f"parquet.`{path}`"
        return self._kept[rel]

    def spread(self, rel: str) -> str:
        """``rel`` with its rows dealt out evenly, for work that costs more than reading them."""
        if self.session is None:
            return rel
        # A given number of parts: adaptive execution would join them again by their size, which says nothing of the work.
        return f"(SELECT /*+ REPARTITION({4 * self.session.sparkContext.defaultParallelism}) */ * FROM {rel} AS spread)"

    def by_value(self, rules: str, fits: str, rel: str, column: str) -> tuple[str, str]:
        """``rules`` (as r) that fit a row of ``rel`` (as n) by its ``column`` alone, and what to join them on: every distinct value is tried once, not every row."""
        return f"(SELECT n.{column} AS tried, r.* FROM (SELECT DISTINCT {column} FROM {rel} AS every) AS n JOIN {rules} AS r ON {fits})", f"n.{column} = r.tried"

    def dealt(self, key: str) -> str:
        """A hint that rows are dealt out evenly, by a key that tells them apart: dealt out in turn, they would be sorted first so that retries give the same."""
        return f"/*+ REBALANCE({key}) */ "

    def small(self, name: str) -> str:
        """A hint that a relation of this name fits into every task."""
        return f"/*+ BROADCAST({name}) */ "

    def uniform(self, seed: int, key: str, draw: str) -> str:
        """In [0, 1), a function of seed, key and draw alone: the same on any partitioning."""
        return f"(CAST(conv(substr({self.draw(seed, key, draw)}, 1, 13), 16, 10) AS BIGINT) / 4503599627370496e0)"

    def draw(self, seed: int, key: str, draw: str) -> str:
        """What :meth:`under` compares: the digits of :meth:`uniform`'s number, not the number, which costs more than they do."""
        return f"md5(concat('{seed}|', coalesce(concat(CAST({key} AS STRING), '|'), ''), '{draw}'))"

    def under(self, x: str, p: float) -> str:
        """Whether a draw is below a share: digits are compared with those of the least number that is not."""
        least = math.ceil(p * 2**52)
        return f"{x} < '{least:013x}'" if least < 2**52 else f"{x} IS NOT NULL"

    def bround(self, x: str, n: int = 0) -> str:
        return f"bround({x}, {n})"

    def quantile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p}e0)" if "." in str(p) else f"percentile({x}, {p})"

    def digits(self, x: str) -> str:
        return f"regexp_replace({x}, '[^0-9]', '')"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE '{pattern}')".replace("\\", "\\\\")

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})".replace("\\", "\\\\")

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def digest(self, x: str) -> str:
        """:meth:`sha256` as what rows are put in order by: its bytes, half as long as the digits and in the same order."""
        return f"unhex({self.sha256(x)})"

    def block(self, h: str) -> str:
        """The first 16 bits of a :meth:`digest`, as text: Spark's faster hash table takes no bytes as a key."""
        return f"hex(substr({h}, 1, 2))"

    def born(self, age: str, u: str, reference: str) -> str:
        first = f"date_add(add_months(DATE'{reference}', -12 * ({age} + 1)), 1)"
        last = f"add_months(DATE'{reference}', -12 * {age})"
        return f"CAST(date_add({first}, CAST(floor({u} * (datediff({last}, {first}) + 1)) AS INT)) AS STRING)"

    def age_at(self, text: str, reference: str) -> str:
        other = f"coalesce(CAST(try_to_timestamp({text}, 'yyyy-MM-dd') AS DATE), CAST(try_to_timestamp({text}, 'dd/MM/yyyy') AS DATE))"
        # A plain ISO date is cast, which costs a tenth of a formatter; without braces, which stand for frames in spark.sql.
        d = f"CASE WHEN {text} RLIKE '^[1-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]\\\\z' THEN TRY_CAST({text} AS DATE) ELSE {other} END"
        # Years are counted by months and days as one number.
        return f"CAST(floor(({reference.replace('-', '')} - (year({d}) * 10000 + month({d}) * 100 + day({d}))) / 10000e0) AS INT)"

    def check_low(self, total: str) -> str:
        """The check digit 11 - total % 11, with 0 for what has two digits."""
        return f"((11 - ({total}) % 11) % 11 % 10)"

    def check_ten(self, total: str) -> str:
        """The check digit total % 11, with 0 for 10."""
        return f"(({total}) % 11 % 10)"

    #: Whether numbers of identifiers are staged before the rules that need them, and ranks are found column by column.
    staged = True

    def digits_of(self, number: str, n: int) -> list[str]:
        """Digits of a whole number below 10**n, leftmost first."""
        return [f"(({number} div {10 ** (n - 1 - i)}) % 10)" for i in range(n)]

    def part(self, texts: Iterable[str], index: str) -> str:
        """The text at a place (from 1) of a fixed list."""
        return f"{_listed(texts)}[{index} - 1]"

    def part_by(self, x: str, lists: dict[str, list[str]], index: str) -> str:
        """The text at a place (from 1) of the list that a value stands for."""
        return f"(CASE {x} {' '.join(f'WHEN {literal(k)} THEN {_listed(v)}' for k, v in lists.items())} END)[{index} - 1]"

    def with_numbers(self, rel: str, lengths: dict[str, int]) -> str:
        """``rel`` with ``num_<column>``: the number of a text that has so many digits and besides them full stops and hyphens only, else null."""
        if not lengths:
            return rel
        digit = lambda c, i: f"substr(bare_{c}, {i}, 1) BETWEEN '0' AND '9'"
        bare = ", ".join(f"translate({c}, '.-', '') AS bare_{c}" for c in lengths)
        numbers = ", ".join(f"CASE WHEN octet_length(bare_{c}) = {n} AND {digit(c, 1)} AND {digit(c, n)} THEN TRY_CAST(bare_{c} AS BIGINT) END AS num_{c}" for c, n in lengths.items())
        return f"(SELECT *, {numbers} FROM (SELECT *, {bare} FROM {rel} AS plain) AS bare)"

    def area_code(self, phone: str) -> str:
        """The two digits in brackets that a text begins with, else an empty text."""
        digit = lambda i: f"substr({phone}, {i}, 1) BETWEEN '0' AND '9'"
        return f"CASE WHEN {phone} IS NULL THEN NULL WHEN substr({phone}, 1, 1) = '(' AND substr({phone}, 4, 1) = ')' AND {digit(2)} AND {digit(3)} THEN substr({phone}, 2, 2) ELSE '' END"

    def key_flags(self, keys: dict[str, str]) -> dict[str, str]:
        """Columns by which equal keys are found: two numbers a key, of its kind and value."""
        return {f"key_{k}": f"xxhash64('{k}', {e})" for k, e in keys.items()} | {f"twin_{k}": f"xxhash64('{k} again', {e})" for k, e in keys.items()}

    def later(self, judged: str, keys: Iterable[str]) -> str:
        """``later_id`` and a ``m_<key>`` of 0 or 1 for each key: the rows of which a row with a smaller id has the same key.

        The first numbers alone are counted over all rows; rows that share one with another are told apart by both.
        """
        keys = list(keys)
        long = f"(SELECT {self.explode([f'key_{k}' for k in keys], 'cell')} FROM {judged} AS j)"
        shared = self.kept(f"(SELECT cell FROM {long} AS l GROUP BY cell HAVING count(*) > 1)", "shared", wide=False)
        pairs = f"(SELECT row_id, {self.explode([f'struct({i} AS kind, key_{k} AS cell, twin_{k} AS twin)' for i, k in enumerate(keys)], 'p')} FROM {judged} AS j)"
        held = self.kept(f"(SELECT l.row_id, l.p.kind, l.p.cell, l.p.twin FROM {pairs} AS l LEFT SEMI JOIN {shared} AS f ON l.p.cell = f.cell)", "held", wide=False)
        first = f"(SELECT kind, cell, twin, min(row_id) AS first_id FROM {held} AS h GROUP BY kind, cell, twin HAVING count(*) > 1)"
        marks = ", ".join(f"max(CASE WHEN h.kind = {i} THEN 1 ELSE 0 END) AS m_{k}" for i, k in enumerate(keys))
        found = f"(SELECT h.row_id AS later_id, {marks} FROM {held} AS h JOIN {first} AS f ON h.kind = f.kind AND h.cell = f.cell AND h.twin = f.twin AND h.row_id > f.first_id GROUP BY h.row_id)"
        return self.kept(found, "later", wide=False)

    def fixed(self, source: str, columns: dict[str, str]) -> str:
        """``source`` with new columns that are computed once a row.

        A generated row of one struct: the optimiser moves no predicate or expression of the columns through
        it, where it would put the whole definition of a column into every condition on it. The struct takes columns that a
        projection has made (``fixed_<column>``): a generator that isn't compiled interprets its expressions, a projection
        compiles them in any case, and what several of them share is computed once.
        """
        made = ", ".join(f"{e} AS fixed_{c}" for c, e in columns.items())
        cells = ", ".join(f"'{c}', fixed_{c}" for c in columns)
        return f"(SELECT * FROM (SELECT *, {made} FROM {source}) AS made LATERAL VIEW inline(array(named_struct({cells}))) fixed AS {', '.join(columns)})"

    def explode(self, items: list[str], alias: str) -> str:
        return f"explode(array({', '.join(items)})) AS {alias}"

    def nfc(self, x: str) -> str:
        """``x`` in Unicode's composed form, by the library that Spark itself brings; texts below U+0300, which are composed, pass untouched."""
        return f"CASE WHEN octet_length({x}) = char_length({x}) THEN {x} WHEN {x} RLIKE '[^\\\\x00-\\\\u02FF]' THEN reflect('com.ibm.icu.text.Normalizer', 'compose', {x}, FALSE) ELSE {x} END"

    def counted_out(self, n: str, alias: str) -> str:
        """A row for each whole number from 0 up to a number, exclusive."""
        return f"explode(sequence(0L, CAST({n} AS BIGINT) - 1)) AS {alias}"

    def composed_and_spelled(self, x: str, table: dict[str, str]) -> str:
        """``x`` composed, then :meth:`spelled`. The table's keys are ASCII: such texts are composed and looked up in a set, and others below U+0300 are left alone."""
        assert all(k.isascii() for k in table)
        # Texts before the letters are no keys, and the table's own values are composed.
        assert all(k >= "A" for k in table)
        known = f"CASE WHEN {x} < 'A' THEN {x} WHEN {x} IN ({', '.join(map(literal, table))}) THEN element_at(map_from_arrays({_listed(table)}, {_listed(table.values())}), {x}) ELSE {x} END"
        return f"CASE WHEN octet_length({x}) = char_length({x}) THEN {known} WHEN {x} IN ({', '.join(map(literal, table.values()))}) THEN {x} WHEN {x} RLIKE '[^\\\\x00-\\\\u02FF]' THEN {self.spelled(self.nfc(x), table)} ELSE {x} END"

    def spelled(self, x: str, table: dict[str, str]) -> str:
        """The table's value for a key, else the key itself; ``x`` is computed once."""
        return f"transform(array({x}), v -> coalesce(element_at(map_from_arrays({_listed(table)}, {_listed(table.values())}), v), v))[0]"

    def listed(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def one_hot(self, x: str, values: Iterable[str | int]) -> str:
        """A 1 at the place of ``x`` among some distinct values and 0 at the others, or nothing but 0: a list that is looked up, where a comparison for each cell makes a method that the JVM only interprets."""
        values = list(values)
        n, texts = len(values), all(isinstance(v, str) for v in values)
        lists = (f"concat(array_repeat(0e0, {i}), array(1e0), array_repeat(0e0, {n - 1 - i}))" for i in range(n))
        rows = ", ".join(f"{literal(v) if texts else f'{v}e0'}, {one}" for v, one in zip(values, lists, strict=True))
        return f"coalesce(element_at(map({rows}), {x if texts else f'CAST({x} AS DOUBLE)'}), array_repeat(0e0, {n}))"

    def vector(self, numbers: list[str], categories: dict[str, tuple]) -> str:
        """A list of numbers, then a cell of 0 or 1 for each value of some columns."""
        return f"concat({self.listed(numbers)}, {', '.join(self.one_hot(c, values) for c, values in categories.items())})"

    def index(self, place: int) -> int:
        """How brackets count the given place (from 1)."""
        return place - 1

    def sliced(self, x: str, first: int, n: int) -> str:
        return f"slice({x}, {first}, {n})"

    def first_largest(self, x: str) -> str:
        """What brackets take for the place of the first of the largest elements."""
        return f"CAST(array_position({x}, array_max({x})) - 1 AS INT)"

    def list_total(self, x: str) -> str:
        """The sum of a list."""
        return f"aggregate({x}, 0e0, (a, v) -> a + v)"

    def joined(self, x: str) -> str:
        """Sorted distinct strings of a group, comma-joined."""
        return f"array_join(array_sort(collect_set({x})), ',')"

    def joined_numbers(self, x: str) -> str:
        """Distinct whole numbers of a group in order, comma-joined."""
        return f"array_join(transform(array_sort(collect_set(CAST({x} AS BIGINT))), v -> CAST(v AS STRING)), ',')"

    def median(self, x: str) -> str:
        return self.quantile(x, 0.5)

    def json_text(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def numbers(self, first: int, last: int, name: str) -> str:
        return f"(SELECT CAST(id AS INT) AS {name} FROM range({first}, {last + 1}))"

    def values(self, rows: list[tuple], names: str) -> str:
        return f"(SELECT * FROM VALUES {', '.join(map(_literal_row, rows))} AS v({names}))"


class Duck(Spark):
    """DuckDB."""

    staged = False

    def digits_of(self, number: str, n: int) -> list[str]:
        return [f"(CAST(floor({number} / 1e{n - 1 - i}) AS BIGINT) % 10)" for i in range(n)]

    def part(self, texts: Iterable[str], index: str) -> str:
        return f"split_part({literal(','.join(texts))}, ',', {index})"

    def part_by(self, x: str, lists: dict[str, list[str]], index: str) -> str:
        return f"split_part({lookup(x, {k: ','.join(v) for k, v in lists.items()})}, ',', {index})"

    def with_numbers(self, rel: str, lengths: dict[str, int]) -> str:
        return rel

    def area_code(self, phone: str) -> str:
        return self.extract(phone, r"^\(([0-9]{2})\)", 1)

    def key_flags(self, keys: dict[str, str]) -> dict[str, str]:
        return {f"key_{k}": f"substr({self.sha256(f"concat('{k}{chr(1)}', {e})")}, 1, 32)" for k, e in keys.items()}

    def later(self, judged: str, keys: Iterable[str]) -> str:
        keys = list(keys)
        long = f"(SELECT row_id, {self.explode([f"concat('{i}', key_{k})" for i, k in enumerate(keys)], 'cell')} FROM {judged} AS j)"
        first = f"(SELECT cell, min(row_id) AS first_id FROM {long} AS l GROUP BY cell HAVING count(*) > 1)"
        marks = ", ".join(f"max(CASE WHEN substr(l.cell, 1, 1) = '{i}' THEN 1 ELSE 0 END) AS m_{k}" for i, k in enumerate(keys))
        return f"(SELECT l.row_id AS later_id, {marks} FROM {long} AS l JOIN {first} AS f ON l.cell = f.cell AND l.row_id > f.first_id GROUP BY l.row_id)"

    def spread(self, rel: str) -> str:
        return rel

    def by_value(self, rules: str, fits: str, rel: str, column: str) -> tuple[str, str]:
        return rules, fits

    def dealt(self, key: str) -> str:
        return "/*+ REBALANCE */ "

    def small(self, name: str) -> str:
        return ""

    def table(self, name: str) -> str:
        return name

    def uniform(self, seed: int, key: str, draw: str) -> str:
        return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR), '{draw}')), 1, 13)) AS BIGINT) / 4503599627370496e0)"

    def draw(self, seed: int, key: str, draw: str) -> str:
        return self.uniform(seed, key, draw)

    def under(self, x: str, p: float) -> str:
        return f"{x} < {p!r}e0"

    def bround(self, x: str, n: int = 0) -> str:
        return f"round_even({x}, {n})"

    def quantile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def digits(self, x: str) -> str:
        return f"regexp_replace({x}, '[^0-9]', '', 'g')"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def digest(self, x: str) -> str:
        return self.sha256(x)

    def block(self, h: str) -> str:
        return f"substr({h}, 1, 4)"

    def born(self, age: str, u: str, reference: str) -> str:
        first = f"(CAST(DATE '{reference}' - to_years(CAST({age} + 1 AS INT)) AS DATE) + 1)"
        last = f"CAST(DATE '{reference}' - to_years(CAST({age} AS INT)) AS DATE)"
        return f"strftime({first} + CAST(floor({u} * (date_diff('day', {first}, {last}) + 1)) AS INT), '%Y-%m-%d')"

    def age_at(self, text: str, reference: str) -> str:
        d = f"coalesce(try_strptime({text}, '%Y-%m-%d'), try_strptime({text}, '%d/%m/%Y'))"
        return f"CAST(year(DATE '{reference}') - year({d}) - CASE WHEN strftime(DATE '{reference}', '%m%d') < strftime({d}, '%m%d') THEN 1 ELSE 0 END AS INT)"

    def check_low(self, total: str) -> str:
        return f"CASE WHEN 11 - ({total}) % 11 > 9 THEN 0 ELSE 11 - ({total}) % 11 END"

    def check_ten(self, total: str) -> str:
        return f"CASE WHEN ({total}) % 11 = 10 THEN 0 ELSE ({total}) % 11 END"

    def composed_and_spelled(self, x: str, table: dict[str, str]) -> str:
        return self.spelled(self.nfc(x), table)

    def fixed(self, source: str, columns: dict[str, str]) -> str:
        return f"(SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})"

    def explode(self, items: list[str], alias: str) -> str:
        return f"unnest([{', '.join(items)}]) AS {alias}"

    def nfc(self, x: str) -> str:
        return f"nfc_normalize({x})"

    def counted_out(self, n: str, alias: str) -> str:
        return f"unnest(range(0, CAST({n} AS BIGINT))) AS {alias}"

    def spelled(self, x: str, table: dict[str, str]) -> str:
        return f"coalesce({lookup(x, table)}, {x})"

    def listed(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def vector(self, numbers: list[str], categories: dict[str, tuple]) -> str:
        return self.listed([*numbers, *(f"CASE WHEN {c} = {literal(x)} THEN 1e0 ELSE 0e0 END" for c, values in categories.items() for x in values)])

    def index(self, place: int) -> int:
        return place

    def sliced(self, x: str, first: int, n: int) -> str:
        return f"list_slice({x}, {first}, {first + n - 1})"

    def first_largest(self, x: str) -> str:
        return f"list_position({x}, list_max({x}))"

    def list_total(self, x: str) -> str:
        return f"list_sum({x})"

    def joined(self, x: str) -> str:
        return f"array_to_string(list_sort(list(DISTINCT {x})), ',')"

    def joined_numbers(self, x: str) -> str:
        return f"coalesce(array_to_string(list_transform(list_sort(list(DISTINCT CAST({x} AS BIGINT)) FILTER (({x}) IS NOT NULL)), lambda v: CAST(v AS VARCHAR)), ','), '')"

    def json_text(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def numbers(self, first: int, last: int, name: str) -> str:
        return f"(SELECT CAST(range AS INT) AS {name} FROM range({first}, {last + 1}))"

    def values(self, rows: list[tuple], names: str) -> str:
        return f"(SELECT * FROM (VALUES {', '.join(map(_literal_row, rows))}) AS v({names}))"


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return f"CAST({x!r} AS DOUBLE)"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _literal_row(row: tuple) -> str:
    return f"({', '.join(map(literal, row))})"


def any_of(x: str, values: tuple) -> str:
    return f"{x} IN ({', '.join(map(literal, values))})"


def pick(d: Spark, u: str, weights: dict[str, float]) -> str:
    """Inverse of a categorical distribution function, of a draw."""
    total, at, out = sum(weights.values()), 0.0, []
    names = list(weights)
    for name in names[:-1]:
        at += weights[name]
        out.append(f"WHEN {d.under(u, at / total)} THEN {literal(name)}")
    return f"CASE {' '.join(out)} ELSE {literal(names[-1])} END"


def lookup(x: str, table: dict, other: object = None) -> str:
    if not table:
        return literal(other)
    return f"CASE {x} {' '.join(f'WHEN {literal(k)} THEN {literal(v)}' for k, v in table.items())} ELSE {literal(other)} END"
