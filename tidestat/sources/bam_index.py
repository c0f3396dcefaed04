"""BAI indexes: which bytes of a coordinate-sorted BAM file hold records that overlap given intervals.

Places in the file are virtual offsets: the byte where a block begins, shifted by 16, and the byte inside the unpacked block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

# Fixed values of the format: places of a window of the linear index, the first bin of each level and the shift of its places, the bin of metadata.
WINDOW = 14
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
METADATA = 37450

Interval = tuple[int, int, int]
"""tid, first place from 0, place after the last."""


def bins_of(lo: int, hi: int) -> list[tuple[int, int]]:
    """The ranges of bins, both ends inclusive, whose records may overlap places lo to hi - 1."""
    return [(base + (lo >> shift), base + ((hi - 1) >> shift)) for base, shift in LEVELS]


@dataclass
class Index:
    bins: list[dict[int, list[tuple[int, int]]]]
    linear: list[Sequence[int]]

    @classmethod
    def parse(cls, data: bytes) -> "Index":
        if data[:4] != b"BAI\x01":
            raise ValueError("not a BAI index")
        n, at = struct.unpack_from("<i", data, 4)[0], 8
        bins, linear = [], []
        for _ in range(n):
            count, at = struct.unpack_from("<i", data, at)[0], at + 4
            mine = {}
            for _ in range(count):
                number, chunks = struct.unpack_from("<Ii", data, at)
                flat = struct.unpack_from(f"<{2 * chunks}Q", data, at + 8)
                at += 8 + 16 * chunks
                if number != METADATA:
                    mine[number] = list(zip(flat[::2], flat[1::2], strict=True))
            windows = struct.unpack_from("<i", data, at)[0]
            linear.append(struct.unpack_from(f"<{windows}Q", data, at + 4))
            at += 4 + 8 * windows
            bins.append(mine)
        return cls(bins, linear)

    def chunks(self, intervals: Iterable[Interval]) -> list[tuple[int, int]]:
        """Disjoint ranges of virtual offsets, in order, that hold every record which overlaps one of the intervals."""
        found = []
        for tid, lo, hi in intervals:
            lo, hi = max(0, lo), min(hi, 1 << LEVELS[0][1])
            if not 0 <= tid < len(self.bins) or hi <= lo:
                continue
            windows = self.linear[tid]
            least = windows[min(lo >> WINDOW, len(windows) - 1)] if windows else 0  # no record that overlaps begins before
            mine = self.bins[tid]
            for first, last in bins_of(lo, hi):
                numbers = range(first, last + 1) if last - first < len(mine) else [b for b in mine if first <= b <= last]
                found += [(max(a, least), b) for n in numbers for a, b in mine.get(n, ()) if b > least]
        return joined(found)


def joined(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def merged(intervals: Iterable[Interval]) -> list[Interval]:
    """Intervals by contig and place, those that touch or overlap as one."""
    by: dict[int, list[tuple[int, int]]] = {}
    for tid, lo, hi in intervals:
        by.setdefault(tid, []).append((lo, hi))
    return [(tid, a, b) for tid in sorted(by) for a, b in joined(by[tid])]
