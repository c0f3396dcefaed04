"""Reads from BAM files: a Python data source after the public SAM/BAM specification.

A file is cut in byte ranges; each task finds the first block and record of its range by itself, so that one large file is
read by many tasks. With an index and intervals, or filters on contig and place, only the blocks that these touch are opened. Records are
decoded in batches (see bam_batch). Base modifications come from the MM and ML tags, feature lengths from nl and al (nucleosomes and
accessible patches), and genome positions from the CIGAR. Needs no library beyond pyarrow's file systems.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from tidestat.schema import CONTIGS, READS
from tidestat.sources.bam_batch import decode
from tidestat.sources.bam_index import WINDOW, Index, Interval, merged

_MAGIC = b"\x1f\x8b\x08\x04"
#: Bytes of a range; records that a guessed start must chain through.
RANGE_BYTES = 32 << 20
CHAIN = 4
#: What is decoded at once, at most (one record more).
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the .bam files of a folder."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = system.get_file_info(name)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and (info.is_file or f.path.endswith(".bam")))


class _Blocks:
    """The unpacked blocks of a file from the first block at or after `start`, as one stream that knows where blocks begin."""

    def __init__(self, file, start: int):
        self.file, self.size = file, file.size()
        self.next = self._find(start)
        self.data, self.marks = bytearray(), []  # (place in data, block start in the file)

    def _head(self, at: int) -> int | None:
        """The size of the block at a place, or None if there is none."""
        self.file.seek(at)
        head = self.file.read(18)
        if len(head) < 18 or head[:4] != _MAGIC or head[12:14] != b"BC":
            return None
        return struct.unpack_from("<H", head, 16)[0] + 1

    def _find(self, at: int) -> int:
        while at < self.size:
            self.file.seek(at)
            window = self.file.read(1 << 17)
            i = window.find(_MAGIC)
            while i >= 0:
                n = self._head(at + i)
                if n and (at + i + n >= self.size or self._head(at + i + n)):
                    return at + i
                i = window.find(_MAGIC, i + 1)
            at += max(1, len(window) - 3) if len(window) == 1 << 17 else self.size
        return self.size

    def more(self) -> bool:
        """Unpack one more block; False at the end."""
        if self.next >= self.size:
            return False
        n = self._head(self.next)
        if n is None:
            raise ValueError(f"no block at byte {self.next}")
        self.file.seek(self.next)
        packed = self.file.read(n)
        self.marks.append((len(self.data), self.next))
        self.data += zlib.decompress(packed[18:-8], -15)
        self.next += n
        return True

    def need(self, upto: int) -> bool:
        while len(self.data) < upto:
            if not self.more():
                return False
        return True

    def block_of(self, place: int) -> int:
        return next(b for at, b in reversed(self.marks) if at <= place)

    def virtual(self, place: int) -> int:
        """The virtual offset of a place."""
        at, block = next(m for m in reversed(self.marks) if m[0] <= place)
        return block << 16 | place - at

    def drop(self, place: int) -> int:
        """Forget what lies before a place; the place's new value."""
        if place < 1 << 20:
            return place
        keep = [m for m in self.marks if m[0] <= place][-1:] + [m for m in self.marks if m[0] > place]
        del self.data[:place]
        self.marks = [(at - place, b) for at, b in keep]  # of the first block, what it held before is below 0
        return 0


def _header(blocks: _Blocks) -> tuple[list[tuple[str, int]], int]:
    """(name, length) of the contigs, and where the records begin."""
    blocks.need(8)
    if bytes(blocks.data[:4]) != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", blocks.data, 4)[0]
    blocks.need(at + 4)
    n, at, out = struct.unpack_from("<i", blocks.data, at)[0], at + 4, []
    for _ in range(n):
        blocks.need(at + 4)
        size = struct.unpack_from("<i", blocks.data, at)[0]
        blocks.need(at + 8 + size)
        out.append((bytes(blocks.data[at + 4 : at + 3 + size]).decode(), struct.unpack_from("<i", blocks.data, at + 4 + size)[0]))
        at += 8 + size
    return out, at


def _plausible(blocks: _Blocks, at: int, contigs: list[tuple[str, int]]) -> int | None:
    """The end of what could be a record at a place, or None."""
    if not blocks.need(at + 36):
        return None
    size, tid, left, name, _, _, cigars, _, bases, mate, mate_left, _ = struct.unpack_from("<iiiBBHHHiiii", blocks.data, at)
    if size < 32 or size > 1 << 29 or not -1 <= tid < len(contigs) or not -1 <= mate < len(contigs) or name < 1 or bases < 0:
        return None
    if left < -1 or tid >= 0 and left > contigs[tid][1] or mate_left < -1 or 32 + name + 4 * cigars + (bases + 1) // 2 + bases > size:
        return None
    if not blocks.need(at + 36 + name) or blocks.data[at + 35 + name] or not all(33 <= c <= 126 for c in blocks.data[at + 36 : at + 35 + name]):
        return None
    return at + 4 + size


def _first_record(blocks: _Blocks, contigs: list[tuple[str, int]]) -> int | None:
    """The first place that starts a chain of records; None if the rest holds none."""
    at = 0
    while blocks.need(at + 36):
        end, n = at, 0
        while n < CHAIN and end is not None:
            if n and not blocks.need(end + 1):
                return at  # the chain reaches the end of the file
            end, n = _plausible(blocks, end, contigs), n + 1
        if end is not None:
            return at
        at += 1
    return None


@dataclass
class _Range(InputPartition):
    """Records of the blocks that begin at bytes start to stop."""

    path: str
    start: int
    stop: int
    number: int


@dataclass
class _Chunks(InputPartition):
    """Records that begin in ranges of virtual offsets."""

    path: str
    chunks: list[tuple[int, int]]
    number: int


class _Reader(DataSourceReader):
    """Records as Arrow batches of the asked columns.

    Given intervals, or filters that amount to some, only what an index names is read where a file has one; records beside the intervals
    are left out (of filters, Spark does that).
    """

    def __init__(self, path: str, width: int, columns: list[str], intervals: list[Interval] | None):
        self.path, self.width, self.columns = path, width, columns
        self.intervals = merged(intervals) if intervals is not None else None
        self.pushed: list[Interval] | None = None

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        wanted = self.pushed if self.intervals is None else self.intervals
        for path, size in _files(self.path):
            index = _index(path) if wanted is not None else None
            if index is None:
                out += [_Range(path, lo, min(size, lo + self.width), 0) for lo in range(0, max(1, size), self.width)]
                continue
            some: list[tuple[int, int]] = []
            for a, b in index.chunks(wanted):
                some.append((a, b))
                if sum((y >> 16) - (x >> 16) + 1 for x, y in some) >= self.width:
                    out.append(_Chunks(path, some, 0))
                    some = []
            if some:
                out.append(_Chunks(path, some, 0))
        for i, p in enumerate(out):
            p.number = i
        return out or [_Chunks("", [], 0)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(part, _Chunks) and not part.chunks:
            return
        keys = keep = None
        if self.intervals is not None:
            keys = np.array([t << 32 | lo for t, lo, _ in self.intervals], np.int64)
            keep = np.array([hi for _, _, hi in self.intervals], np.int64)
        columns = list(dict.fromkeys([*self.columns, *(("tid", "left0", "right1") if keys is not None else ())]))
        with _open(part.path) as file:
            done = part.number << 33
            for data, starts in self._records(file, part):
                batch = decode(data, starts, done, columns)
                done += len(starts)
                if keys is not None:
                    tid, left, right = (batch[c].to_numpy().astype(np.int64) for c in ("tid", "left0", "right1"))
                    i = np.searchsorted(keys, tid << 32 | np.maximum(right, left + 1), "left") - 1  # the last interval that begins before the read ends
                    j = np.maximum(i, 0)
                    on = (i >= 0) & (tid >= 0) & (keys[j] >> 32 == tid) & (keep[j] > left) if len(keys) else np.zeros(len(tid), bool)
                    batch = batch.filter(pa.array(on))
                yield batch.select(self.columns)

    def _records(self, file, part: InputPartition) -> Iterator[tuple[bytes, np.ndarray]]:
        """Bytes of whole records, and where in them each begins (after its size)."""
        if isinstance(part, _Chunks):
            for first, last in part.chunks:
                blocks = _Blocks(file, first >> 16)
                yield from _gathered(blocks, first & 0xFFFF, lambda at, b=blocks, end=last: b.virtual(at) < end)
            return
        head = _Blocks(file, 0)
        contigs, first = _header(head)
        blocks, at = (head, first) if part.start == 0 else (_Blocks(file, part.start), None)
        if at is None:
            at = _first_record(blocks, contigs)
        if at is not None:
            yield from _gathered(blocks, at, lambda at: blocks.block_of(at) < part.stop)


class _FilteredReader(_Reader):
    """A reader that is told the filters; Spark takes one only where it pushes filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Contigs and places narrow down what is read; every filter stays for Spark to apply."""
        tids, lo, hi = None, 0, 1 << 29
        for f in filters:
            column, value = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None, getattr(f, "value", None)
            if column == "tid" and isinstance(f, (EqualTo, In)):
                some = {value} if isinstance(f, EqualTo) else set(value)
                tids = some if tids is None else tids & some
            elif column in ("left0", "right1") and isinstance(value, int):
                first = 0 if column == "left0" else 1  # the last base of a read is at right1 - 1 from 0
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    lo = max(lo, value - first)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    hi = min(hi, value + 1)
            yield f
        if tids is not None and all(isinstance(t, int) and t >= 0 for t in tids):
            self.pushed = [(t, lo, hi) for t in sorted(tids)]


def _gathered(blocks: _Blocks, at: int, more: Callable[[int], bool]) -> Iterator[tuple[bytes, np.ndarray]]:
    lo, starts = at, []
    while blocks.need(at + 4) and more(at):
        size = struct.unpack_from("<i", blocks.data, at)[0]
        if not blocks.need(at + 4 + size):
            raise ValueError("the file ends inside a record")
        starts.append(at + 4 - lo)
        at += 4 + size
        if at - lo >= BATCH_BYTES or len(starts) >= BATCH_ROWS:
            yield bytes(blocks.data[lo:at]), np.array(starts)
            at = lo = blocks.drop(at)
            starts = []
    if starts:
        yield bytes(blocks.data[lo:at]), np.array(starts)


def _index(path: str) -> Index | None:
    """The index beside a file, if there is one."""
    for name in (path + ".bai", path.removesuffix(".bam") + ".bai"):
        try:
            with _open(name) as file:
                return Index.parse(file.read())
        except FileNotFoundError:
            continue
    return None


class BamSource(DataSource):
    """spark.read.format("bam").load(path): schema.READS, or columns of it given as a schema; read_id numbers a range's records within the
    range's own span of ids. With the option pushFilters, for sessions with spark.sql.python.filterPushdown.enabled, filters on tid, left0 and
    right1 narrow down what an index says to read; read_bam sets it."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self):
        return READS

    def reader(self, schema) -> _Reader:
        given = self.options.get("intervals")
        kind = _FilteredReader if self.options.get("pushFilters") == "true" else _Reader
        return kind(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)), schema.names, [tuple(x) for x in json.loads(given)] if given else None)


def read_bam(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, columns: Sequence[str] | None = None, intervals: Sequence[Interval] | None = None) -> DataFrame:
    """The records of a BAM file, or of the .bam files of a folder, as schema.READS or these columns of it; with intervals (tid, first place
    from 0, place after the last) those that overlap one, by the file's index where it has one."""
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").option("rangeBytes", range_bytes)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled") == "true":
        reader = reader.option("pushFilters", "true")
    if intervals is not None:
        reader = reader.option("intervals", json.dumps(merged(intervals)))
    if columns is not None:
        reader = reader.schema(StructType([READS[c] for c in columns]))
    return reader.load(path)


def region_intervals(regions: DataFrame) -> list[Interval]:
    """Intervals that cover windows (tid, start, stop), to places of the index's linear windows: at most one for each of those."""
    size = 1 << WINDOW
    first, last = F.floor((F.greatest("start", F.lit(1)) - 1) / size), F.floor((F.greatest("stop", F.lit(1)) - 1) / size)
    rows = regions.where("stop >= 1").select("tid", first.alias("a"), last.alias("b")).distinct().collect()
    return merged((r.tid, r.a * size, (r.b + 1) * size) for r in rows)


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """The contigs of the (first) file's header as schema.CONTIGS."""
    with _open(_files(path)[0][0]) as file:
        names, _ = _header(_Blocks(file, 0))
    return spark.createDataFrame([(i, n) for i, (n, _) in enumerate(names)], CONTIGS)
