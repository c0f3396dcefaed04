"""One TSV file, gzipped or not, written by many tasks: a Python data source whose commit joins what they wrote.

Each task writes a part of its own beside the file (for .gz a gzip member); the commit copies the parts in their order behind a
header, a chunk at a time, into a file that then takes the name. Parts of failed attempts are never joined, and go in the end.
"""

from __future__ import annotations

import csv
import gzip
import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

CHUNK = 1 << 20


def filesystem(path: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _shown(value: object) -> object:
    """A value as Spark's CSV reader takes it."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Inf" if value > 0 else "-Inf"
    return value


def _lines(rows: Iterator[tuple]) -> bytes:
    out = io.StringIO()
    csv.writer(out, delimiter="\t", lineterminator="\n", doublequote=False, escapechar="\\").writerows([list(map(_shown, r)) for r in rows])
    return out.getvalue().encode()


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite = path.rstrip("/"), schema.names, overwrite
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def _opened(self, stream):
        return gzip.GzipFile(fileobj=stream, mode="wb", mtime=0) if self.path.endswith(".gz") else stream

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        system, folder = filesystem(self.parts)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}"
        with system.open_output_stream(name) as raw:
            out = self._opened(raw)
            for b in iterator:
                out.write(_lines(zip(*[c.to_pylist() for c in b.columns], strict=True)))
            if out is not raw:
                out.close()
        return _Part(task.partitionId(), name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, path = filesystem(self.path)
        known = system.get_file_info(path).type
        if known != fs.FileType.NotFound and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} exists")
        parent = path.rpartition("/")[0]
        if parent:
            system.create_dir(parent, recursive=True)
        made = f"{filesystem(self.parts)[1]}.joined"
        with system.open_output_stream(made) as raw:
            top = io.BytesIO()
            out = self._opened(top)
            out.write(_lines(iter([tuple(self.names)])))
            if out is not top:
                out.close()
            raw.write(top.getvalue())
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.number):
                with system.open_input_stream(part.path) as one:
                    while chunk := one.read(CHUNK):
                        raw.write(chunk)
        if known == fs.FileType.Directory:
            system.delete_dir(path)
        system.move(made, path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, folder = filesystem(self.parts)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class TsvFile(DataSource):
    """df.write.format("tsvfile").mode("overwrite").save(path): the rows in the order of their partitions, below a header."""

    @classmethod
    def name(cls) -> str:
        return "tsvfile"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)


def write_tsv(df: DataFrame, path: str) -> str:
    """df as one TSV file with a header, gzipped iff the path ends in .gz; what had the name is replaced once the file is whole."""
    df.sparkSession.dataSource.register(TsvFile)
    df.write.format("tsvfile").mode("overwrite").save(path)
    return path
