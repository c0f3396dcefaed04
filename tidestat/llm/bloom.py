"""A pair of Bloom filters over 64-bit hashes, built by all tasks: which hashes were seen twice?

Filters are broadcast, so their size has a bound; there is no other way beyond it. A filter of more hashes than it has bits for
only lets more of them pass, up to all, and what follows must be right (only larger) with any of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidestat.llm.common import small_batches, spread, tidy

BITS_PER_KEY = 8
PROBES = 2
SEGMENT_BITS = 1 << 20
MAX_FILTER_BYTES = 64 << 20
#: Bit positions that a task holds before it passes them on.
HELD = 4_000_000


def positions(hashes: np.ndarray, segments: int) -> np.ndarray:
    """(n, PROBES) bit positions; all of a hash's bits lie in one segment."""
    seg = (spread(hashes, 7) % np.uint64(segments)).astype(np.int64)
    return np.stack([seg * SEGMENT_BITS + (spread(hashes, i) % np.uint64(SEGMENT_BITS)).astype(np.int64) for i in range(PROBES)], 1)


def _segments(bits: int) -> int:
    return max(1, min(-(-bits // SEGMENT_BITS), MAX_FILTER_BYTES * 8 // SEGMENT_BITS))


def _rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's set bits by segment: once holds those seen once, twice those seen more often."""
    if not held:
        return
    at, n = np.unique(np.concatenate(held), return_counts=True)
    seg = at // SEGMENT_BITS
    cuts = np.flatnonzero(np.diff(seg)) + 1
    once, twice = [], []
    for bits, counts in zip(np.split(at % SEGMENT_BITS, cuts), np.split(n, cuts), strict=True):
        once.append(bits[counts == 1].astype("<u4").tobytes())
        twice.append(bits[counts > 1].astype("<u4").tobytes())
    ids = seg[np.concatenate([[0], cuts])]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["seg", "once", "twice"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for s, once, twice in zip(*[c.to_pylist() for c in b.columns], strict=True):
            f1, f2 = filters.setdefault(s, (np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)))
            o, t = np.frombuffer(once, "<u4"), np.frombuffer(twice, "<u4")
            f2[o] |= f1[o]
            f1[o] = True
            f1[t] = f2[t] = True
    for s, (_, f2) in filters.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(f2).tobytes()], pa.binary())], names=["seg", "bits"])


def repeated(df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], estimate: int) -> Callable[[np.ndarray], np.ndarray]:
    """A test on executors: False only for hashes seen at most once in all of df.

    ``hashes(batches)`` yields arrays of uint64. The filter takes BITS_PER_KEY bits for each of `estimate` hashes, MAX_FILTER_BYTES at most.
    """
    segments = _segments(estimate * BITS_PER_KEY)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for h in hashes(batches):
            held.append(positions(h, segments).ravel())
            n += len(held[-1])
            if n > HELD:
                yield from _rows(held)
                held, n = [], 0
        yield from _rows(held)

    small_batches(df.sparkSession)
    parts = df.mapInArrow(tidy(collect), "seg long, once binary, twice binary")
    merged = parts.repartition(min(segments, 512), "seg").mapInArrow(tidy(_merge), "seg long, bits binary")
    shared = df.sparkSession.sparkContext.broadcast(_table(merged, segments))

    def test(h: np.ndarray) -> np.ndarray:
        bits, hold = positions(h, segments), np.ones(len(h), bool)
        for j in range(PROBES):
            hold &= (shared.value[bits[:, j] >> 3] >> (7 - (bits[:, j] & 7)).astype(np.uint8)) & 1 == 1
        return hold

    return test


def _slots(df: DataFrame, probes: int, bits: int) -> np.ndarray:
    """A bitmap of `bits` bits (a multiple of SEGMENT_BITS) with `probes` bits set for each hash of df's one long column."""
    segments = bits // SEGMENT_BITS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(_at(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), probes, bits).ravel())
            n += len(held[-1])
            if n > HELD:
                yield from _rows(held)
                held, n = [], 0
        yield from _rows(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for s, once, twice in zip(*[c.to_pylist() for c in b.columns], strict=True):
                f = found.setdefault(s, np.zeros(SEGMENT_BITS, bool))
                f[np.frombuffer(once, "<u4")] = True
                f[np.frombuffer(twice, "<u4")] = True
        for s, f in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(f).tobytes()], pa.binary())], names=["seg", "bits"])

    small_batches(df.sparkSession)
    parts = df.mapInArrow(tidy(deal), "seg long, once binary, twice binary")
    return _table(parts.repartition(min(segments, 64), "seg").mapInArrow(tidy(merge), "seg long, bits binary"), segments)


def _table(parts: DataFrame, segments: int) -> np.ndarray:
    """The segments (seg, bits) side by side on the driver: MAX_FILTER_BYTES at most."""
    table = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for b in parts.toArrow().to_batches():
        for s, bits in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            table[s] = np.frombuffer(bits.as_buffer(), np.uint8)
    return table.ravel()


def _at(hashes: np.ndarray, probes: int, bits: int) -> np.ndarray:
    return np.stack([(spread(hashes, 61 + i) % np.uint64(bits)).astype(np.int64) for i in range(probes)], 1)


def _test(df: DataFrame, probes: int, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    shared = df.sparkSession.sparkContext.broadcast(_slots(df, probes, bits))

    def test(h: np.ndarray) -> np.ndarray:
        at, hold = _at(h, probes, bits), np.ones(len(h), bool)
        for j in range(probes):
            hold &= (shared.value[at[:, j] >> 3] >> (7 - (at[:, j] & 7)).astype(np.uint8)) & 1 == 1
        return hold

    return test


def bitmap(df: DataFrame, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """A test for df's hashes of a fixed size whatever their number; others may pass too."""
    return _test(df, 1, bits)


def member(df: DataFrame, count: int) -> Callable[[np.ndarray], np.ndarray]:
    """A test that is True for all of df's `count` hashes and few others (more where they are many for MAX_FILTER_BYTES)."""
    return _test(df, 3, _segments(count * 10) * SEGMENT_BITS)
