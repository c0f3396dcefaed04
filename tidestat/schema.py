"""Explicit schemas of the relations and the fixed values that all statistics share."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# Modification names in ordinal order (the ordinal orders cross-correlation pairs).
MODS = ("mod_5mC", "mod_5hmC", "mod_6mA")
# A call is confident above this probability (of 255); the report compares prob / 255 with 0.9.
CONFIDENT = 0.9 * 255
CONFIDENT_SHARE = 0.9

MOD_CALL = StructType(
    [
        StructField("pos", IntegerType()),
        StructField("mod", StringType()),
        StructField("prob", IntegerType()),
        StructField("gpos", LongType()),
    ]
)

#: One row per read; calls and feature lengths stay nested so that per-read statistics need no shuffle.
READS = StructType(
    [
        StructField("read_id", LongType()),
        StructField("tid", IntegerType()),
        StructField("qlen", LongType()),
        StructField("left0", LongType()),
        StructField("right1", LongType()),
        StructField("mods", ArrayType(MOD_CALL)),
        StructField("nuc_len", ArrayType(IntegerType())),
        StructField("msp_len", ArrayType(IntegerType())),
    ]
)

CONTIGS = StructType([StructField("tid", IntegerType()), StructField("chrom", StringType())])

REGION_FILE = StructType(
    [
        StructField("chrom", StringType()),
        StructField("start", LongType()),
        StructField("stop", LongType()),
        StructField("strand", StringType()),
    ]
)

MANIFEST = StructType([StructField("Stat", StringType()), StructField("File", StringType())])

def mod_ordinal(column):
    """Ordinal of a modification name as a Column, null for names outside MODS."""
    from pyspark.sql import functions as F

    return F.expr(f"map({', '.join(f"'{m}', {i}" for i, m in enumerate(MODS))})")[column]


__all__ = ["CONFIDENT", "CONFIDENT_SHARE", "CONTIGS", "DoubleType", "MANIFEST", "MODS", "READS", "REGION_FILE", "mod_ordinal"]
