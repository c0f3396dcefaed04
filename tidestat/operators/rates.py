"""Per-read rates: confident calls, and features, per base of the read.

A read is one row, so its rates are computed in the row (no shuffle by read, no state in a stream).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestat.functions.khist import khist as adaptive
from tidestat.functions.rounding import rounded
from tidestat.functions.tally import Reads, flat, tally
from tidestat.functions.tally import cells as tallied
from tidestat.functions.weighted import box_summary
from tidestat.plans import svg
from tidestat.registry import Stat, cell, register
from tidestat.schema import CONFIDENT, MODS
from tidestat.sources.relations import Relations

# Fixed value: bins of the adaptive histogram.
BINS = 150
NO_CALLS = "cast(array() as array<struct<pos:int,mod:string,prob:int,gpos:bigint>>)"


def confident_counts(reads: DataFrame, mods: Sequence[str] = MODS, thresh: float = CONFIDENT) -> DataFrame:
    """qlen, counts: for every read its confident calls of each modification, in the order of mods.

    The confident calls, few, are picked once in the row; only their names are looked at for each modification.
    """
    picked = f"transform(filter(coalesce(mods, {NO_CALLS}), x -> x.prob > {float(thresh)!r}D), x -> x.mod)"
    sizes = ", ".join(f"size(filter(c, m -> m = '{m}'))" for m in mods)
    return reads.select("qlen", F.expr(f"transform(array({picked}), c -> array({sizes}))[0]").alias("counts"))


def rates_of_counts(counts: DataFrame, mods: Sequence[str] = MODS) -> DataFrame:
    """mod, rate: a row for every read and modification of confident_counts; reads of length 0 are left out."""
    names = F.array(*[F.lit(m) for m in mods])
    each = counts.where("qlen > 0").select("qlen", F.posexplode("counts").alias("i", "n"))
    return each.select(F.element_at(names, F.col("i") + 1).alias("mod"), (F.col("n") / F.col("qlen")).alias("rate"))


def mod_rates(reads: DataFrame, mods: Sequence[str] = MODS, thresh: float = CONFIDENT) -> DataFrame:
    """mod, rate: a row for every read and modification, zero rates included; reads of length 0 are left out."""
    return rates_of_counts(confident_counts(reads, mods, thresh), mods)


def feature_rates(reads: DataFrame) -> DataFrame:
    """Feature, Rate: nucleosomes and MSPs per base for every read, zeros included."""
    one = [
        F.struct(
            F.lit(n).alias("Feature"), (F.size(F.coalesce(c, F.array().cast("array<int>"))) / F.col("qlen")).alias("Rate")
        )
        for n, c in (("nuc", "nuc_len"), ("msp", "msp_len"))
    ]
    return reads.where("qlen > 0").select(F.inline(F.array(*one)))


def exact_hist(rates: DataFrame, by: str, rate: str, count: str, digits: int | None = None) -> DataFrame:
    """by, rate, count: the exact distribution of the rates, optionally rounded first."""
    value = F.col(rate) if digits is None else rounded(rate, digits)
    return rates.groupBy(by, value.alias(rate)).agg(F.count("*").alias(count))


def khist(rates: DataFrame, by: str, rate: str, count: str, bins: int = BINS) -> DataFrame:
    """by, bin centre, weight: an adaptive histogram of at most `bins` bins, the same however rows are partitioned.

    Exact up to `bins` distinct rates; with more, neighbours are merged in a canonical order (see functions.khist).
    """
    exact = rates.groupBy(by, rate).agg(F.count("*").alias("_n"))
    return adaptive(exact, by, rate, "_n", count, bins)


def rate_share(hist: DataFrame, by: str = "mod", rate: str = "rate", count: str = "count") -> DataFrame:
    """by, rate, share: each bin's part of its group."""
    total = hist.groupBy(by).agg(F.sum(count).alias("_total"))  # a row for each group
    return hist.join(F.broadcast(total), by).select(by, rate, (F.col(count) / F.col("_total")).alias("share"))


def rate_boxplot(hist: DataFrame, by: str = "mod", rate: str = "rate", count: str = "count") -> DataFrame:
    """by, q25, median, q75, lower, upper of a rate histogram. Weights are counts: shares of the group give the same quantiles."""
    return box_summary(hist, [by], rate, count)


@register
class ModRate(Stat):
    name, title, file, grain = "ModRate", "Modification rate per read", "modrate.tsv.gz", "per-read mod"
    columns = ("qlen", "mods")
    schema = "mod string, rate double, count double"

    def compute(self, rel: Relations) -> DataFrame:
        rates = mod_rates(rel.reads, self._mods(), float(self.options.get("thresh", CONFIDENT)))
        return khist(rates, "mod", "rate", "count", int(self.options.get("n", BINS)))

    def _mods(self) -> tuple[str, ...]:
        return tuple(self.options.get("mods", MODS))

    def prepare(self) -> dict[str, str]:
        return {"confident": f"transform(filter(calls, k -> k.prob > {float(self.options.get('thresh', CONFIDENT))!r}D), k -> k.mod)"}

    def cells(self) -> str:
        each = [cell(s=f"'{m}'", a=f"size(filter({{confident}}, m -> m = '{m}'))", b="qlen") for m in self._mods()]
        return f"filter(array({', '.join(each)}), z -> qlen > 0)"

    def counter(self):
        mods, thresh = self._mods(), float(self.options.get("thresh", CONFIDENT))

        def count(reads: Reads) -> Iterator[dict]:
            confident = reads.prob > thresh
            row, mod, some = reads.row[confident], reads.mod[confident], reads.qlen > 0
            for name in mods:
                each = np.bincount(row[mod == reads.number(name)], minlength=reads.n)
                (a, b), n, _ = tally([each[some], reads.qlen[some]])
                yield from tallied(n, s=name, a=a, b=b)

        return count

    def finish(self, cells: DataFrame, rel: Relations) -> DataFrame:
        rates = cells.select(F.col("s").alias("mod"), (F.col("a") / F.col("b")).alias("rate"), "n")
        return adaptive(rates, "mod", "rate", "n", "count", int(self.options.get("n", BINS)))

    def plot_data(self, result: DataFrame) -> DataFrame:
        return rate_boxplot(result)

    def plot(self, result: DataFrame) -> str:
        return svg.boxes(self.plot_data(result), "mod")


@register
class NucMSPRate(Stat):
    name, title, file = "NucMSPRate", "Nucleosome and MSP rate per read", "nuc_msp_rate.tsv.gz"
    columns = ("qlen", "nuc_len", "msp_len")
    schema = "Feature string, Rate double, Count double"

    def compute(self, rel: Relations) -> DataFrame:
        return khist(feature_rates(rel.reads), "Feature", "Rate", "Count", int(self.options.get("n", BINS)))

    def cells(self) -> str:
        each = [cell(s=f"'{f}'", a=f"size(coalesce({f}_len, cast(array() as array<int>)))", b="qlen") for f in ("nuc", "msp")]
        return f"filter(array({', '.join(each)}), z -> qlen > 0)"

    def counter(self):
        def count(reads: Reads) -> Iterator[dict]:
            some = reads.qlen > 0
            for f in ("nuc", "msp"):
                (a, b), n, _ = tally([flat(reads.batch[f"{f}_len"])[0][some], reads.qlen[some]])
                yield from tallied(n, s=f, a=a, b=b)

        return count

    def finish(self, cells: DataFrame, rel: Relations) -> DataFrame:
        rates = cells.select(F.col("s").alias("Feature"), (F.col("a") / F.col("b")).alias("Rate"), "n")
        return adaptive(rates, "Feature", "Rate", "n", "Count", int(self.options.get("n", BINS)))

    def plot_data(self, result: DataFrame) -> DataFrame:
        return rate_boxplot(result, "Feature", "Rate", "Count")

    def plot(self, result: DataFrame) -> str:
        return svg.boxes(self.plot_data(result), "Feature")
