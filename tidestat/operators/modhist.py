"""Call-grain histograms: by probability, and by relative position in the read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidestat.functions.dense import axis, densify
from tidestat.functions.tally import Reads, tally
from tidestat.functions.tally import cells as tallied
from tidestat.plans import svg
from tidestat.registry import Stat, cell, register
from tidestat.schema import CONFIDENT, CONFIDENT_SHARE, MODS
from tidestat.sources.relations import Relations


def mod_hist(mod_calls: DataFrame, mods: tuple[str, ...] = MODS) -> DataFrame:
    """ml (0..255), prob = ml / 255 and a count column for each modification; dense in ml.

    One aggregation with a conditional count per modification: no distinct pass and no pivot shuffle.
    """
    counts = mod_calls.groupBy(F.col("prob").alias("ml")).agg(
        *[F.count_if(F.col("mod") == m).alias(m) for m in mods]
    )
    return dense_hist(counts, mods)


def dense_hist(counts: DataFrame, mods: tuple[str, ...] = MODS) -> DataFrame:
    """mod_hist from ml and the observed counts."""
    ml = counts.sparkSession.range(256, numPartitions=1).select(F.col("id").cast("int").alias("ml"))
    return (
        densify(counts, ml, ["ml"], mods)
        .select("ml", (F.col("ml") / 255.0).cast("double").alias("prob"), *mods)
        .orderBy("ml")
    )


def observed(hist: DataFrame, mods: tuple[str, ...] = MODS) -> list[str]:
    """The modifications with a count: one row comes to the driver."""
    totals = hist.agg(*[F.sum(m).alias(m) for m in mods]).first()
    return [m for m in mods if totals[m]]


def mod_hist_long(hist: DataFrame) -> DataFrame:
    """ml, prob, variable, value: the wide histogram unpivoted over its columns named mod*."""
    return hist.unpivot(["ml", "prob"], [c for c in hist.columns if "mod" in c], "variable", "value")


def mod_proportion(hist: DataFrame, thresh: float = CONFIDENT_SHARE) -> DataFrame:
    """mod_hist_long with each value's share of its modification, and ismod = prob > thresh."""
    part = Window.partitionBy("variable")
    return mod_hist_long(hist).withColumns(
        {
            "proportion": F.try_divide(F.col("value"), F.sum("value").over(part)),
            "ismod": F.col("prob") > thresh,
        }
    )


def mod_meta_hist(mod_calls: DataFrame, n: int = 1000, thresh: float = CONFIDENT) -> DataFrame:
    """mod, bin in [0, 1], count of confident calls: dense in n bins for each observed modification."""
    at = F.greatest(F.floor(F.lit(n) * F.col("pos") / F.col("qlen")), F.lit(1)).cast("int")
    counts = (
        mod_calls.where((F.col("prob") > thresh) & (F.col("qlen") > 0))
        .groupBy("mod", at.alias("i"))
        .agg(F.count("*").alias("count"))
    )
    return dense_bins(counts, n)


def dense_bins(counts: DataFrame, n: int) -> DataFrame:
    """mod_meta_hist from mod, i (1..n), count."""
    dim = counts.select("mod").distinct()
    return (
        densify(counts, axis(dim, 1, n, "i"), ["mod", "i"], ["count"])
        .select("mod", ((F.col("i") - 1) / (n - 1)).alias("bin"), "count")
        .orderBy("mod", "bin")
    )


@register
class ModHist(Stat):
    name, title, file, grain = "ModHist", "Modification probabilities", "modhist.tsv.gz", "mod"
    columns = ("mods",)

    @classmethod
    def schema_of(cls, header: list[str]) -> str:
        """A count for each observed modification, whatever its name."""
        return ", ".join(f"`{c}` {({'ml': 'int', 'prob': 'double'}).get(c, 'long')}" for c in header)

    def compute(self, rel: Relations) -> DataFrame:
        return self._observed(mod_hist(rel.mod_calls))

    def call_cell(self) -> str:
        return cell(s="mod", a="prob")

    def counter(self):
        def count(reads: Reads) -> Iterator[dict]:
            some = reads.prob >= 0
            (mod, prob), n, _ = tally([reads.mod[some], reads.prob[some]])
            yield from tallied(n, s=[reads.mods[i] for i in mod], a=prob)

        return count

    def finish(self, cells: DataFrame, rel: Relations) -> DataFrame:
        each = [F.coalesce(F.sum(F.when(F.col("s") == m, F.col("n"))), F.lit(0)).alias(m) for m in MODS]
        return self._observed(dense_hist(cells.groupBy(F.col("a").cast("int").alias("ml")).agg(*each)))

    def _observed(self, hist: DataFrame) -> DataFrame:
        rows = hist.sparkSession.createDataFrame(hist.collect(), hist.schema)  # 256 rows: the calls are read once
        return rows.select("ml", "prob", *observed(rows))

    def plot(self, result: DataFrame) -> str:
        return svg.lines(mod_hist_long(result), "prob", "value", "variable")


@register
class ModMetaHist(Stat):
    name, title, file, grain = "ModMetaHist", "Modifications along the read", "mod_meta_hist.tsv.gz", "mod"
    columns = ("qlen", "mods")
    schema = "mod string, bin double, count long"

    def compute(self, rel: Relations) -> DataFrame:
        return mod_meta_hist(
            rel.mod_calls, int(self.options.get("n", 1000)), float(self.options.get("thresh", CONFIDENT))
        )

    def call_cell(self) -> str:
        n, thresh = int(self.options.get("n", 1000)), float(self.options.get("thresh", CONFIDENT))
        return f"if(qlen > 0 and prob > {thresh!r}D, {cell(s='mod', a=f'greatest(floor({n} * pos / qlen), 1)')}, null)"

    def counter(self):
        bins, thresh = int(self.options.get("n", 1000)), float(self.options.get("thresh", CONFIDENT))

        def count(reads: Reads) -> Iterator[dict]:
            some = (reads.prob > thresh) & (reads.qlen > 0)[reads.row]
            at = np.maximum(np.floor(bins * reads.pos[some] / reads.qlen[reads.row[some]]), 1).astype(np.int64)
            (mod, i), n, _ = tally([reads.mod[some], at])
            yield from tallied(n, s=[reads.mods[m] for m in mod], a=i)

        return count

    def finish(self, cells: DataFrame, rel: Relations) -> DataFrame:
        counts = cells.select(F.col("s").alias("mod"), F.col("a").cast("int").alias("i"), F.col("n").alias("count"))
        return dense_bins(counts, int(self.options.get("n", 1000)))

    def plot(self, result: DataFrame) -> str:
        return svg.lines(result, "bin", "count", "mod")
