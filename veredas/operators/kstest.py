"""The exact two-sample Kolmogorov-Smirnov p-value, by counting lattice paths.

A merged order of n and m values is a path from (0, 0) to (n, m). Under the null hypothesis all paths are equally
likely; the p-value is the share of those that touch |i / n - j / m| >= d. The share of paths that stay inside, divided
by the number of paths to each point, follows a recurrence with weights i / (i + j) and j / (i + j), which is run by
diagonals i + j = k. As in the usual default, the exact value is taken while neither sample has more than ``EXACT_N`` values;
beyond, the asymptotic series of :func:`twosample.ks_p_value`. Ties count as in the statistic itself.

Spark forms the statistic of every group (counts, ranks and one aggregation); one number a group goes through Arrow.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from veredas.functions.dialect import Duck, Spark

from .twosample import distances_sql, ks_p_value

#: Fixed value: the size up to which the exact distribution is taken by default.
EXACT_N = 10_000


def exact_p_value(n: int, m: int, d: float) -> float:
    """P(D >= d) of two samples of n and m values."""
    common = math.gcd(n, m)
    h = round(d * (n // common * m))
    if h <= 0:
        return 1.0
    a, b = m // common, n // common  # |i / n - j / m| >= d  <=>  |i * a - j * b| >= h
    i = np.arange(n + 1)
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    for k in range(1, n + m + 1):
        lo, hi = max(0, k - m), min(n, k)
        at = i[lo : hi + 1]
        new = inside[lo : hi + 1] * (k - at)
        new[1 if lo == 0 else 0 :] += inside[max(lo - 1, 0) : hi] * at[1 if lo == 0 else 0 :]
        new[np.abs(at * a - (k - at) * b) >= h] = 0.0
        inside[lo : hi + 1] = new / k
        if lo:
            inside[lo - 1] = 0.0
    return float(min(1.0, max(0.0, 1.0 - inside[n])))


@F.pandas_udf(DoubleType())
def _exact(n: pd.Series, m: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([exact_p_value(int(x), int(y), z) for x, y, z in zip(n, m, d, strict=True)], dtype="float64")


def p_values(spark: SparkSession, rel: str, group: str, x: str, exact_n: int = EXACT_N) -> DataFrame:
    """grp, n_ref, n_syn, ks, p_value and ``exact`` (which of both it is) of every group that has both sides."""
    found = spark.sql(f"SELECT grp, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_syn AS BIGINT) AS n_syn, ks, {ks_p_value('ks', 'n_ref', 'n_syn')} AS series FROM {distances_sql(Spark(), rel, group, x)} AS w WHERE n_ref > 0 AND n_syn > 0")
    exact = F.greatest("n_ref", "n_syn") <= exact_n
    # The function is called for every row, so that the rows it is not meant for give it sizes of 1.
    size = lambda c: F.when(exact, F.col(c)).otherwise(F.lit(1))
    value = F.when(exact, _exact(size("n_ref"), size("n_syn"), F.col("ks"))).otherwise(F.col("series"))
    return found.select("grp", "n_ref", "n_syn", F.round("ks", 6).alias("ks"), F.round(value, 6).alias("p_value"), exact.alias("exact"))


def duck_sql(d: Duck, rel: str, group: str, x: str, exact_n: int = EXACT_N) -> str:
    """The same by a recursive query over the diagonals, for checking."""
    inside = "k + 1 - i BETWEEN 0 AND m AND abs(i * a - (k + 1 - i) * b) < h"
    step = f"list_transform(range(0, n + 1), lambda i: CASE WHEN {inside} THEN ((CASE WHEN i > 0 THEN v[i] ELSE 0e0 END) * i + v[i + 1] * (k + 1 - i)) / (k + 1) ELSE 0e0 END)"
    return f"""WITH RECURSIVE found AS (SELECT row_number() OVER () AS id, grp, CAST(n_ref AS BIGINT) AS n, CAST(n_syn AS BIGINT) AS m, ks FROM {distances_sql(d, rel, group, x)} AS w WHERE n_ref > 0 AND n_syn > 0),
      paths AS (SELECT id, n, m, m // gcd(n, m) AS a, n // gcd(n, m) AS b, CAST(round(ks * (n // gcd(n, m) * m)) AS BIGINT) AS h, 0 AS k, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 1e0 ELSE 0e0 END) AS v FROM found WHERE greatest(n, m) <= {exact_n}
        UNION ALL SELECT id, n, m, a, b, h, k + 1, {step} FROM paths WHERE k < n + m),
      ends AS (SELECT id, CASE WHEN h <= 0 THEN 1e0 ELSE least(1e0, greatest(0e0, 1e0 - v[n + 1])) END AS p FROM paths WHERE k = n + m)
      SELECT grp, n AS n_ref, m AS n_syn, round(ks, 6) AS ks, round(coalesce(p, {ks_p_value('ks', 'n', 'm')}), 6) AS p_value, p IS NOT NULL AS exact FROM found LEFT JOIN ends USING (id)"""
