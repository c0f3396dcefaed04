"""Small facts brought to where texts are read, so that texts do not move.

A row of a Parquet table has a place: its file and its row in it, which no change of splits or executors alters. Facts about rows
(place, document, values) are shuffled by chunks of CHUNK rows of a file and written in the shared folder, a folder for each
chunk. A scan then reads, for each batch, the facts of the chunks that its rows lie in: the part of a task that a split is.
Tables that have no places (not read from Parquet), or a shared folder that Python cannot open, are told by None: the caller joins.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.parquet as pq
from pyarrow import ArrowException
from pyarrow import fs as filesystems
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestat.llm.common import fresh, shared_dir, small_batches

#: Rows of a file whose facts lie together: some 130 MB of texts of 2 KB.
CHUNK = 1 << 16


def with_places(df: DataFrame) -> tuple[DataFrame, str, str] | None:
    """df with two more columns, and their names: a hash of the file that holds a row, and the row's number in it. None where df has
    no such places."""
    c_file, c_row = fresh(df, "__file", "__row")
    try:
        at = df.metadataColumn("_metadata")
        placed = df.select("*", F.xxhash64(at["file_path"]).alias(c_file), at["row_index"].alias(c_row))
        placed.schema  # resolves now
    except AnalysisException:
        return None
    return placed, c_file, c_row


def _uri(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write(facts: DataFrame, name: str) -> str | None:
    """The folder where facts (file, row, doc, value: all long) now lie by chunk; None where Python cannot see it."""
    spark = facts.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    chunked = facts.withColumn("chunk", F.floor(F.col("row") / CHUNK))
    chunked.repartition("file", "chunk").sortWithinPartitions("file", "chunk", "row").write.partitionBy("file", "chunk").parquet(path)
    uri = _uri(spark, path)
    try:
        at, base = filesystems.FileSystem.from_uri(uri)
        seen = at.get_file_info(f"{base}/_SUCCESS").type != filesystems.FileType.NotFound
    except (ArrowException, OSError, ValueError):
        return None
    return uri if seen else None


class Reader:
    """Facts on an executor, a chunk at a time: `values(file, row, doc)` of rows that come in the order of their table."""

    def __init__(self, uri: str, chunk: int):
        self.uri, self.chunk = uri, chunk
        self.at: filesystems.FileSystem | None = None
        self.held: tuple[int, int] | None = None
        self.rows = self.docs = self.found = np.empty(0, np.int64)

    def values(self, file: int, row: int, doc: int) -> np.ndarray:
        """The values of the facts about this row and this document; often none."""
        if self.held != (file, row // self.chunk):
            self._load(file, row // self.chunk)
        a, b = np.searchsorted(self.rows, (row, row + 1))
        return self.found[a:b][self.docs[a:b] == doc]

    def _load(self, file: int, chunk: int) -> None:
        if self.at is None:
            self.at, self.base = filesystems.FileSystem.from_uri(self.uri)
        there = self.at.get_file_info(filesystems.FileSelector(f"{self.base}/file={file}/chunk={chunk}", allow_not_found=True))
        parts = []
        for x in there:
            if x.path.endswith(".parquet"):
                with self.at.open_input_file(x.path) as opened:
                    t = pq.ParquetFile(opened).read(["row", "doc", "value"])
                parts.append(np.stack([c.to_numpy() for c in t.columns]))
        self.rows, self.docs, self.found = np.concatenate(parts, 1) if parts else np.empty((3, 0), np.int64)
        order = np.argsort(self.rows, kind="stable")
        self.rows, self.docs, self.found = self.rows[order], self.docs[order], self.found[order]
        self.held = (file, chunk)


__all__ = ["CHUNK", "Reader", "with_places", "write"]
