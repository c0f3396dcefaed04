"""Adaptive histograms that depend on the values alone, not on how rows are stored, split or merged.

A centroid is a weight and an exact sum of values in fixed point, so that adding centroids is associative and commutative. The distinct
values of a group are its finest centroids. They are merged in one canonical order: always the two neighbours of the smallest gap, of
equal gaps the lower one, until few enough are left. Gaps of neighbours on a line never shrink by merging, so a heap of gaps finds the order.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestat.functions.rounding import rounded

#: Fractional bits of a value (values are below 2**22), and those that tell centroids apart where a group has too many.
BITS, COARSE = 40, 20
#: Distinct values of a group that one task merges; a group with more is first cut to cells of 2**-COARSE, whose sums stay exact.
MOST = 1 << 20


def centroids(values: DataFrame, by: str, x: str, weight: str, most: int = MOST) -> DataFrame:
    """by, n, s: the finest centroids of weighted values, at most about `most` a group; two such tables are merged by adding up equal cells."""
    fixed = F.round(F.col(x) * float(1 << BITS)).cast("long")
    exact = values.select(F.col(by), fixed.alias("r"), F.col(weight).cast("long").alias("w")).groupBy(by, "r").agg(F.sum("w").alias("n"))
    size = exact.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_size"))
    known = exact.join(F.broadcast(size), F.col(by).eqNullSafe(F.col("_by")))  # a row for each group
    cell = F.when(F.col("_size") > most, F.shiftright("r", BITS - COARSE)).otherwise(F.col("r"))
    return known.groupBy(by, cell.alias("cell")).agg(F.sum("n").alias("n"), F.sum(F.col("r").cast("decimal(38,0)") * F.col("n").cast("decimal(18,0)")).cast("decimal(38,0)").alias("s")).select(by, "n", "s")


def merged(sums: Sequence[int], weights: Sequence[int], bins: int) -> tuple[list[int], list[int]]:
    """The sums and weights that are left of ordered centroids when the nearest neighbours have been merged until `bins` are left."""
    s, n = list(sums), list(weights)
    after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
    version, alive = [0] * len(s), len(s)

    def gap(i: int) -> float:
        j = after[i]
        return float(s[j]) / n[j] - float(s[i]) / n[i]

    heap = [(gap(i), i, 0, 0) for i in range(len(s) - 1)] if alive > bins else []
    heapq.heapify(heap)
    while alive > bins:
        _, i, a, b = heapq.heappop(heap)
        if n[i] < 0 or a != version[i] or after[i] == len(s) or b != version[after[i]]:
            continue  # one of the two has changed since
        j = after[i]
        s[i], n[i], n[j] = s[i] + s[j], n[i] + n[j], -1
        version[i] += 1
        after[i] = after[j]
        if after[i] < len(s):
            before[after[i]] = i
            heapq.heappush(heap, (gap(i), i, version[i], version[after[i]]))
        if before[i] >= 0:
            p = before[i]
            heapq.heappush(heap, (gap(p), p, version[p], version[i]))
        alive -= 1
    return [x for x, w in zip(s, n, strict=True) if w >= 0], [w for w in n if w >= 0]


def khist(values: DataFrame, by: str, x: str, weight: str, out: str, bins: int, most: int = MOST) -> DataFrame:
    """by, x (a centre, to nine digits), out (its weight as a double): at most `bins` rows a group, in order.

    The same rows for any partitioning; exact while a group has at most `bins` distinct values. A group's centroids meet in one task,
    `most` of them at most.
    """
    name = values.schema[by].dataType.simpleString()

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(zip(map(int, table["s"].to_pylist()), table["n"].to_pylist(), strict=True), key=lambda r: r[0] / r[1])
        s, n = merged([r[0] for r in rows], [r[1] for r in rows], bins)
        centres = [float(a) / b / (1 << BITS) for a, b in zip(s, n, strict=True)]
        keys = pa.array([table[by][0].as_py()] * len(s), table.schema.field(by).type)
        return pa.table({by: keys, "x": pa.array(centres, pa.float64()), "w": pa.array([float(w) for w in n], pa.float64())})

    found = centroids(values, by, x, weight, most).groupBy(by).applyInArrow(fold, f"`{by}` {name}, x double, w double")
    return found.groupBy(by, rounded("x", 9).alias(x)).agg(F.sum("w").alias(out)).orderBy(by, x)
