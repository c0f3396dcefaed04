"""Region files: windows of a half-width dw around each interval's midpoint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestat.functions.prefix import numbered
from tidestat.schema import REGION_FILE

# Fixed value: the default half-width.
DEFAULT_WIDTH = 1500


def windows(rows: DataFrame, dw: int = DEFAULT_WIDTH, label: str | None = None) -> DataFrame:
    """chrom, start, stop (1-based, inclusive), strand (true only for '+'), regionindex, group, label, dw.

    ``rows`` has chrom, start (0-based), stop, strand, group and regionindex. A null strand counts as '+'.
    """
    mid = F.expr("(start + 1 + stop) div 2")
    return rows.select(
        "chrom",
        (mid - dw).alias("start"),
        (mid + dw).alias("stop"),
        (F.coalesce("strand", F.lit("+")) == "+").alias("strand"),
        "regionindex",
        "group",
        (F.lit(label) if label is not None else F.concat(F.lit("group"), F.col("group"))).alias("label"),
        F.lit(dw).alias("dw"),
    )


def load(
    spark: SparkSession, file: str, group: int = 1, dw: int = DEFAULT_WIDTH, label: str | None = None, sep: str | None = None
) -> DataFrame:
    """One region file with a header of chrom, start, stop and optionally strand, in any column order."""
    if sep is None:  # the one that the header has most of
        head = (spark.read.text(file).first() or [""])[0]
        sep = max("\t,; ", key=head.count)
    raw = spark.read.csv(file, sep=sep, header=True)  # strings; no inference
    named = {f.name: f.dataType for f in REGION_FILE}
    cols = [F.col(c).cast(t).alias(c) if c in raw.columns else F.lit("+").alias(c) for c, t in named.items()]
    if missing := [c for c in ("chrom", "start", "stop") if c not in raw.columns]:
        raise ValueError(f"{file} lacks columns {missing}")
    # rows of a split are in order, splits are told apart by where they begin in the file
    typed = raw.select(*cols, F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    rows = numbered(typed, "_block", "_at", "regionindex").drop("_block", "_at")
    return windows(
        rows.withColumns({"regionindex": F.col("regionindex").cast("long"), "group": F.lit(group)}),
        dw,
        label if label is not None else f"group{group}",
    )


def load_many(spark: SparkSession, config: Sequence[Mapping]) -> DataFrame:
    """The union of region files [{file, label, width}, ...]; the group is the file's 1-based place."""
    parts = [
        load(spark, c["file"], i, int(c.get("width", DEFAULT_WIDTH)), c.get("label"), c.get("sep"))
        for i, c in enumerate(config, 1)
    ]
    return reduce(DataFrame.unionByName, parts)


def to_tid(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Regions re-keyed by contig id; those on contigs that the header lacks are dropped (see missing_contigs)."""
    return regions.join(F.broadcast(contigs), "chrom")


def missing_contigs(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """chrom, count of the regions that to_tid drops, for a warning."""
    return regions.join(F.broadcast(contigs), "chrom", "left_anti").groupBy("chrom").count()
