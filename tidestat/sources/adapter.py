"""Stand-in relations derived from the driver's `documents` table.

A document is a read: its length is the query length, its source the contig, the letters a / o / i are
modification calls, its words and lines are features. Values carry no biological meaning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tidestat.schema import MOD_CALL, READS
from tidestat.sources import shared
from tidestat.sources.relations import Relations

# Contig names by tid, chosen to exercise the contig order.
CONTIG_NAMES = tuple([f"chr{i}" for i in range(1, 17)] + ["chrX", "chrY", "chr1_random", "chrUn_k1"])

# The letter that stands for a call of each modification.
LETTERS = {"mod_6mA": "a", "mod_5mC": "o", "mod_5hmC": "i"}
#: SQL of the contig and of the place before a document's read.
TID, LEFT0 = "cast(substr(source, 4) as int)", "doc_id * 97 % 50000"
MOD_CALLS = ArrayType(MOD_CALL)
CALL = pa.struct([("pos", pa.int32()), ("mod", pa.string()), ("prob", pa.int32()), ("gpos", pa.int64())])
#: The modification of each byte, counted from 1; 0: none.
KINDS = np.zeros(256, np.uint8)
KINDS[[ord(x) for x in LETTERS.values()]] = range(1, len(LETTERS) + 1)
#: Bytes of text that are decoded at once, and those of a batch that goes to a decoder: its calls take ten times as much.
SLICE, BATCH = 1 << 20, 2 << 20
#: Bytes of a row group of decoded reads: a scan of few files, as that of a stream's batch, has as many tasks as there are cores.
GROUP = 8 << 20


def stored(df: DataFrame, name: str) -> str:
    """shared.stored in row groups of GROUP bytes."""
    return shared.stored(df, name, GROUP)


def contigs(spark: SparkSession) -> DataFrame:
    """The tid -> contig name dimension."""
    return spark.createDataFrame(list(enumerate(CONTIG_NAMES)), "tid int, chrom string")


def _calls(text: pa.Array, read_id: pa.Array, left0: pa.Array) -> pa.Array:
    """The calls of each text: places and values of the letters in all texts of a slice at once. Slices end at SLICE bytes, so that a
    batch of long texts takes no more working memory than one of short ones."""
    where = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1]
    parts, lo = [], 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(where, where[lo] + SLICE, "right")) - 1)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[where[lo] : where[hi]]
        parts.append(_slice_calls(data, where[lo : hi + 1] - where[lo], *(c.slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in (read_id, left0))))
        lo = hi
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(CALL))


def _slice_calls(data: np.ndarray, starts: np.ndarray, read_id: np.ndarray, left0: np.ndarray) -> pa.Array:
    """_calls of texts that lie side by side as UTF-8."""
    kinds = KINDS[data]
    at = np.flatnonzero(kinds)
    ends = np.searchsorted(at, starts)
    row = np.repeat(np.arange(len(read_id)), np.diff(ends))
    if len(data) and data.max() >= 0x80:  # a position is a code point: bytes that go on with one do not count
        points = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)
        pos = points[at] - np.concatenate([[0], points])[starts][row]
    else:
        pos = at - starts[row] + 1
    prob = (pos * pos * 31 + pos * 17 + read_id[row] * 11) % 256
    gpos = pa.array(left0[row] + pos, pa.int64(), mask=pos % 10 == 0)
    mod = pa.DictionaryArray.from_arrays(pa.array(kinds[at].astype(np.int32) - 1), pa.array(list(LETTERS))).cast(pa.string())
    calls = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), mod, pa.array(prob, pa.int32()), gpos], fields=list(CALL))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), calls)


def by_place(documents: DataFrame) -> DataFrame:
    """documents in ranges of (contig, place) of their reads, as a BAM file has them: the calls of a task lie on few places."""
    return documents.repartitionByRange(F.expr(TID), F.expr(LEFT0))


def reads(documents: DataFrame) -> DataFrame:
    """reads with nested calls and feature lengths: the decoder of this source, in Arrow batches."""
    base = documents.select(
        F.col("doc_id").alias("read_id"),
        F.expr(TID).alias("tid"),
        F.col("n_chars").alias("qlen"),
        F.expr(LEFT0).alias("left0"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    decode = F.arrow_udf(_calls, MOD_CALLS)
    return base.select(
        "read_id",
        "tid",
        "qlen",
        "left0",
        (F.col("left0") + F.col("qlen")).alias("right1"),
        decode("text", "read_id", "left0").alias("mods"),
        F.expr("transform(split(text, ' '), x -> length(x))").alias("nuc_len"),
        F.expr(r"transform(split(text, '\n'), x -> length(x))").alias("msp_len"),
    )


#: Where the reads of an application and a folder have been decoded to.
_DECODED: dict[tuple[str, str], str] = {}


def from_documents(spark: SparkSession, sf_dir: str, regions: DataFrame | None = None) -> Relations:
    """Relations over `documents` under sf_dir. Reads are decoded once an application, to a Parquet table in the shared folder: statistics
    read the columns and fields of it that they need."""
    return Relations(spark.read.schema(READS).parquet(decoded(spark, sf_dir)), contigs(spark), regions)


def decoded(spark: SparkSession, sf_dir: str) -> str:
    """Where the decoded reads lie."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _DECODED:
        batch = "spark.sql.execution.arrow.maxBytesPerBatch"
        before = spark.conf.get(batch)
        spark.conf.set(batch, str(BATCH))  # texts can be long: rows alone do not bound a batch
        try:
            _DECODED[key] = stored(reads(by_place(spark.read.parquet(f"{sf_dir}/documents.parquet"))), "reads")
        finally:
            spark.conf.set(batch, before)
    return _DECODED[key]


def region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw region rows (chrom, start, stop, strand, group, regionindex), one for each row of `supplier`, whose key gives all of them."""
    ids = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("id"))
    mid = (F.col("id") * 997) % 80000
    row = ids.withColumn("tid", (F.col("id") % len(CONTIG_NAMES)).cast("int"))
    return row.join(F.broadcast(contigs(spark)), "tid").select(
        "chrom",
        (mid - 51).alias("start"),
        (mid + 50).alias("stop"),
        F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"),
        ((F.col("id") % 3) + 1).cast("int").alias("group"),
        (F.floor(F.col("id") / 3) + 1).cast("long").alias("regionindex"),
    )
