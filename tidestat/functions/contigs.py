"""The contig order: plain names before names with an underscore, numbered ones by number, the rest by tid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contig_order(chrom: str = "chrom", tid: str = "tid") -> list[Column]:
    """Sort keys that put chr2 before chr10, chrX after the numbers, and chr1_random last."""
    name = F.col(chrom)
    odd = name.contains("_")
    return [
        odd,
        F.when(odd, name),
        ~name.rlike("^...[0-9]"),
        F.when(~odd, F.expr(f"try_cast(substring({chrom}, 4) as int)")),
        F.col(tid),
    ]
