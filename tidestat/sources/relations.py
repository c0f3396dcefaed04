"""The shared relations: reads with nested calls, and the flat views derived from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relations:
    """reads (schema.READS), contigs (schema.CONTIGS) and, where needed, regions (sources.regions).

    The flat views are lazy projections: Catalyst prunes the nested arrays that a statistic does not use.
    """

    reads: DataFrame
    contigs: DataFrame
    regions: DataFrame | None = None

    @cached_property
    def mod_calls(self) -> DataFrame:
        """One row per call: read_id, tid, qlen, pos, mod, prob, gpos."""
        return self.reads.select("read_id", "tid", "qlen", F.inline("mods"))

    @cached_property
    def features(self) -> DataFrame:
        """One row per nucleosome or accessible patch: read_id, feature, len."""
        both = F.array(
            F.struct(F.lit("nuc").alias("feature"), F.col("nuc_len").alias("lens")),
            F.struct(F.lit("msp").alias("feature"), F.col("msp_len").alias("lens")),
        )
        return self.reads.select("read_id", F.inline(both)).select(
            "read_id", "feature", F.explode("lens").alias("len")
        )

    def limit(self, n: int | None) -> "Relations":
        """The first n reads by read_id; None or -1 keeps all, 0 is rejected."""
        if n is None or n == -1:
            return self
        if n < 1:
            raise ValueError("a read limit is a positive number, or None / -1 for all reads")
        return Relations(self.reads.orderBy("read_id").limit(n), self.contigs, self.regions)

    def head(self, n: int | None) -> "Relations":
        """n reads in the order of the source, as limit() but without reading further than these; None or -1 keeps all."""
        if n is None or n == -1:
            return self
        if n < 1:
            raise ValueError("a read limit is a positive number, or None / -1 for all reads")
        return Relations(self.reads.limit(n), self.contigs, self.regions)


def relations_from_parquet(spark, path: str, contigs: str, regions: DataFrame | None = None) -> Relations:
    """Relations from parquet tables in the layout of schema.READS and schema.CONTIGS."""
    from tidestat.schema import CONTIGS, READS

    return Relations(spark.read.schema(READS).parquet(path), spark.read.schema(CONTIGS).parquet(contigs), regions)
