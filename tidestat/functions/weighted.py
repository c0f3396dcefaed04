"""Weighted order statistics over (value, weight) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestat.functions.prefix import running


def weighted_quantiles(df: DataFrame, by: Sequence[str], x: str, w: str, probs: Sequence[float]) -> DataFrame:
    """by..., p, q: quantiles under reliability weights, linear in the cumulative weight.

    With sorted values, weights w, their running sum s and first weight w1, the target is
    h = p * (sum - w1) + w1; q interpolates between the neighbours of the first s > h. Zero weights count as
    absent. ``df`` is a histogram (values are aggregated first), so a group is at most as large as its bins.
    """
    hist = df.where(F.col(w) > 0).groupBy(*by, F.col(x).alias("x")).agg(F.sum(w).cast("double").alias("w"))
    least = hist.groupBy(*by).agg(F.sum("w").alias("total"), F.min_by("w", "x").alias("w1"), F.max("x").alias("top"))
    steps = running(hist, by, "x", {"s": "w"}, before="px").join(F.broadcast(least), list(by))  # a row for each group
    steps = steps.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    steps = steps.withColumn("h", F.col("p") * (F.col("total") - F.col("w1")) + F.col("w1"))
    inside = F.coalesce(F.col("px"), F.col("x"))
    at = F.when(
        F.col("s") > F.col("h"),
        F.struct(
            F.col("s"), (inside + (F.col("h") - (F.col("s") - F.col("w"))) / F.col("w") * (F.col("x") - inside)).alias("q")
        ),
    )
    return steps.groupBy(*by, "p").agg(F.coalesce(F.min(at)["q"], F.max("top")).alias("q"))


def box_summary(df: DataFrame, by: Sequence[str], x: str, w: str) -> DataFrame:
    """by..., q25, median, q75, lower, upper: quartiles, and fences at 1.5 IQR clamped to the range."""
    q = weighted_quantiles(df, by, x, w, (0.25, 0.5, 0.75))
    wide = q.groupBy(*by).agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]
    )
    ends = df.where(F.col(w) > 0).groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    reach = (F.col("q75") - F.col("q25")) * 1.5
    return wide.join(ends, list(by)).select(
        *by,
        "q25",
        "median",
        "q75",
        F.greatest("lo", F.col("q25") - reach).alias("lower"),
        F.least("hi", F.col("q75") + reach).alias("upper"),
    )


def n50(hist: DataFrame, length: str = "readlength", count: str = "count") -> DataFrame:
    """One row n50, n50_star over a length histogram.

    n50: the largest length at which the running sum of bases, from the longest down, passes half.
    n50_star: the next shorter length present, null where there is none.
    """
    each = hist.groupBy(F.col(length).alias("l")).agg(F.sum(F.col(length) * F.col(count)).alias("bases"))
    half = each.agg((F.sum("bases") * 0.5).alias("half"))
    steps = running(each, [], "l", {"cum": "bases"}, descending=True).crossJoin(F.broadcast(half))  # one row
    # shorter lengths than n50 are those whose sum has passed half before them
    return steps.agg(
        F.max(F.when(F.col("cum") > F.col("half"), F.col("l"))).alias("n50"),
        F.max(F.when(F.col("cum") - F.col("bases") > F.col("half"), F.col("l"))).alias("n50_star"),
    )
