"""Dense axes: a histogram with a row for every bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def densify(counts: DataFrame, axis: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every row of axis, with counts' values or 0. counts is an aggregate, at most as large as the axis."""
    joined = axis.join(counts, list(on), "left")
    return joined.withColumns({v: F.coalesce(F.col(v), F.lit(0).cast("long")) for v in values})


def axis(dim: DataFrame, lo: int, hi: int, name: str) -> DataFrame:
    """dim x lo..hi (inclusive), generated in the row."""
    return dim.withColumn(name, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
