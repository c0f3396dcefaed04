"""Read-grain statistics: contig counts, read lengths, feature lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestat.functions.contigs import contig_order
from tidestat.functions.dense import axis, densify
from tidestat.functions.tally import Reads, cells, flat, tally, whole
from tidestat.plans import svg
from tidestat.registry import Stat, cell, register
from tidestat.sources.relations import Relations


def chrom_counts(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """chrom, count per observed contig in contig order; unmapped reads (tid -1) count as '*'."""
    return named_counts(reads.groupBy("tid").agg(F.count("*").alias("count")), contigs)


def named_counts(counts: DataFrame, contigs: DataFrame) -> DataFrame:
    """chrom_counts from tid, count."""
    named = counts.join(F.broadcast(contigs), "tid", "left")
    return (
        named.where(F.col("chrom").isNotNull() | (F.col("tid") == -1))
        .withColumn("chrom", F.coalesce("chrom", F.lit("*")))
        .orderBy(F.col("chrom") == "*", *contig_order())
        .select("chrom", "count")
    )


def read_length_hist(reads: DataFrame) -> DataFrame:
    """readlength, count: the exact sparse histogram, ascending."""
    return (
        reads.groupBy(F.col("qlen").alias("readlength")).agg(F.count("*").alias("count")).orderBy("readlength")
    )


def read_length_binned(hist: DataFrame, width: int = 500) -> DataFrame:
    """bins, count, readlength: counts summed in bins, and the unweighted mean over distinct lengths."""
    return hist.groupBy(F.floor(F.col("readlength") / width).alias("bins")).agg(
        F.sum("count").alias("count"), F.avg("readlength").alias("readlength")
    )


def feature_length_hist(rel: Relations, n: int = 1000) -> DataFrame:
    """Feature, Length, Count: dense over 1..n for nuc and msp."""
    counts = (
        rel.features.where(F.col("len").between(1, n))
        .groupBy(F.col("feature").alias("Feature"), F.col("len").alias("Length"))
        .agg(F.count("*").alias("Count"))
    )
    return dense_lengths(counts, n)


def dense_lengths(counts: DataFrame, n: int) -> DataFrame:
    """feature_length_hist from Feature, Length, Count."""
    dim = counts.sparkSession.createDataFrame([("nuc",), ("msp",)], "Feature string")
    return densify(counts, axis(dim, 1, n, "Length"), ["Feature", "Length"], ["Count"]).orderBy(
        F.col("Feature").desc(), "Length"
    )


def _counts(values: pa.Array) -> Iterator[dict]:
    """A cell for each value, null too."""
    found = values.value_counts()
    return cells(found.field("counts").to_numpy(), a=found.field("values"))


@register
class ChromStat(Stat):
    name, title, file = "ChromStat", "Reads per contig", "chromstats.tsv"
    columns = ("tid",)
    schema = "chrom string, count long"

    def compute(self, rel: Relations) -> DataFrame:
        return chrom_counts(rel.reads, rel.contigs)

    def cells(self) -> str:
        return f"array({cell(a='tid')})"

    def counter(self):
        return lambda reads: _counts(reads.batch["tid"])

    def finish(self, cells: DataFrame, rel: Relations) -> DataFrame:
        return named_counts(cells.select(F.col("a").cast("int").alias("tid"), F.col("n").alias("count")), rel.contigs)

    def plot(self, result: DataFrame) -> str:
        return svg.bars(result, "chrom", "count")


@register
class ReadLengthCounter(Stat):
    name, title, file = "ReadLengthCounter", "Read lengths", "readlengthcounts.tsv.gz"
    columns = ("qlen",)
    schema = "readlength long, count long"

    def compute(self, rel: Relations) -> DataFrame:
        return read_length_hist(rel.reads)

    def cells(self) -> str:
        return f"array({cell(a='qlen')})"

    def counter(self):
        return lambda reads: _counts(reads.batch["qlen"])

    def finish(self, cells: DataFrame, rel: Relations) -> DataFrame:
        return cells.select(F.col("a").alias("readlength"), F.col("n").alias("count")).orderBy("readlength")

    def plot_data(self, result: DataFrame) -> DataFrame:
        return read_length_binned(result).orderBy("bins")

    def plot(self, result: DataFrame) -> str:
        return svg.lines(self.plot_data(result), "readlength", "count")


@register
class NucMSPLenHist(Stat):
    name, title, file = "NucMSPLenHist", "Nucleosome and MSP lengths", "nuc_msp_length_hist.tsv.gz"
    columns = ("nuc_len", "msp_len")
    schema = "Feature string, Length int, Count long"

    def compute(self, rel: Relations) -> DataFrame:
        return feature_length_hist(rel, int(self.options.get("n", 1000)))

    def cells(self) -> str:
        n = int(self.options.get("n", 1000))
        each = [f"transform(filter(coalesce({f}_len, cast(array() as array<int>)), v -> v between 1 and {n}), v -> {cell(s=f"'{f}'", a='v')})" for f in ("nuc", "msp")]
        return f"concat({', '.join(each)})"

    def counter(self):
        most = int(self.options.get("n", 1000))

        def count(reads: Reads) -> Iterator[dict]:
            for f in ("nuc", "msp"):
                lens = whole(flat(reads.batch[f"{f}_len"])[1], 0)
                (lens,), n, _ = tally([lens[(lens >= 1) & (lens <= most)]])
                yield from cells(n, s=f, a=lens)

        return count

    def finish(self, cells: DataFrame, rel: Relations) -> DataFrame:
        counts = cells.select(F.col("s").alias("Feature"), F.col("a").cast("int").alias("Length"), F.col("n").alias("Count"))
        return dense_lengths(counts, int(self.options.get("n", 1000)))

    def plot_data(self, result: DataFrame) -> DataFrame:
        return result.where("Length > 1")

    def plot(self, result: DataFrame) -> str:
        return svg.lines(self.plot_data(result), "Length", "Count", "Feature")
