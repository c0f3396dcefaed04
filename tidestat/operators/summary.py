"""Sample summaries over the (small) result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestat.functions.weighted import n50
from tidestat.operators.modhist import mod_proportion
from tidestat.schema import CONFIDENT_SHARE


def length_moments(hist: DataFrame) -> DataFrame:
    """One row total_bases, mean, std (population) of a readlength, count histogram."""
    x, c = F.col("readlength").cast("double"), F.col("count")
    sums = hist.agg(
        F.sum(F.col("readlength") * c).alias("total_bases"), F.sum(c).alias("n"), F.sum(x * x * c).alias("sq")
    )
    mean = F.col("total_bases") / F.col("n")
    return sums.select(
        "total_bases", mean.alias("mean"), F.sqrt(F.greatest(F.col("sq") / F.col("n") - mean * mean, F.lit(0.0))).alias("std")
    )


def sample_summary(chrom: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """Stat, value, Units; the rows whose statistic is given.

    Total Reads (M) from contig counts; Total Bases (Mb: bases / 1e6), N50, N50*, Mean and Std Read Length (Kb).
    """
    parts = []
    if chrom is not None:
        parts.append(chrom.agg((F.sum("count") / 1e6).alias("v")).select(F.inline(F.array(_row("Total Reads", "v", "M")))))
    if lengths is not None:
        one = length_moments(lengths).crossJoin(n50(lengths))  # one row each
        rows = [
            _row("Total Bases", F.col("total_bases") / 1e6, "Mb"),
            _row("N50", F.col("n50") / 1000, "Kb"),
            _row("N50*", F.col("n50_star") / 1000, "Kb"),
            _row("Mean Read Length", F.col("mean") / 1000, "Kb"),
            _row("Std Read Length", F.col("std") / 1000, "Kb"),
        ]
        parts.append(one.select(F.inline(F.array(*rows))))
    if not parts:
        raise ValueError("a summary needs contig counts or read lengths")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mod_summary(hist: DataFrame, thresh: float = CONFIDENT_SHARE) -> DataFrame:
    """Mod, Percent, Total_M of confident calls in a modification histogram, by name."""
    return (
        mod_proportion(hist, thresh)
        .groupBy("variable", "ismod")
        .agg(F.sum("proportion").alias("p"), F.sum("value").alias("v"))
        .where("ismod")
        .select(
            F.regexp_replace("variable", "mod_", "").alias("Mod"),
            (F.col("p") * 100).alias("Percent"),
            (F.col("v") / 1e6).alias("Total_M"),
        )
        .orderBy("Mod")
    )


def _row(name: str, value, units: str):
    value = F.col(value) if isinstance(value, str) else value
    return F.struct(F.lit(name).alias("Stat"), value.cast("double").alias("value"), F.lit(units).alias("Units"))
