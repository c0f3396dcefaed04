"""The interval join as a sweep: points and windows sorted together, windows kept active while points pass.

For windows of very different widths: a binned join needs bins near one width, and lists wide windows many times or meets narrow ones in
crowded bins. Here a window is listed once for each tile that it touches, to carry it over the borders of the sorted ranges, and
tiles are wide (a million places).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Places of a tile, the least part of a contig that one task sees; rows of an Arrow batch that leaves the sweep.
TILE = 1 << 20
ROWS = 1 << 14
#: Cells of a block of sums, and the blocks that a task holds (64 MB) before they leave the sweep.
BLOCK, BLOCKS = 1 << 12, 1 << 10


def pile(calls: DataFrame, thresh: float, key: str = "tid", at: str = "gpos") -> DataFrame:
    """key, at, mod, FG (calls above thresh), BG (all): calls added up by place, so that a place is one row however deep it is covered."""
    where = calls.where(F.col(at).isNotNull()).groupBy(key, at, "mod")
    return where.agg(F.count_if(F.col("prob") > thresh).alias("FG"), F.count("*").alias("BG"))


def _events(points: DataFrame, regions: DataFrame, at: str, key: str, tile: int) -> DataFrame:
    """Points (as column p) and windows (as column r) in one table, sorted by (contig, tile, place), windows before points."""
    p_type, r_type = points.schema["p"].dataType, regions.schema["r"].dataType
    first, last = F.floor(F.col("start") / tile), F.floor(F.col("stop") / tile)
    opened = regions.where("stop >= start").withColumn("_tile", F.explode(F.sequence(first, last))).select(
        F.col(key).alias("_key"), "_tile", F.greatest(F.col("start"), F.col("_tile") * tile).cast("long").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(p_type).alias("p"), "r"
    )
    passed = points.where(F.col(at).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.floor(F.col(at) / tile).alias("_tile"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), "p", F.lit(None).cast(r_type).alias("r")
    )
    return opened.unionByName(passed).repartitionByRange("_key", "_tile").sortWithinPartitions("_key", "_tile", "_at", "_kind")


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, np.ndarray, np.ndarray, pa.StructArray]]:
    """The sweep of a task: a batch's points, the rows of some of them in it, their places, and the windows that may meet these."""
    here, active = None, None  # the tile, and its windows that may still meet points
    for b in batches:
        tiles = list(zip(b["_key"].to_pylist(), b["_tile"].to_pylist(), strict=True))
        edges = [0, *(i for i in range(1, len(tiles)) if tiles[i] != tiles[i - 1]), len(tiles)]
        place, kind = b["_at"].to_numpy(), b["_kind"].to_numpy()
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if tiles[lo] != here:
                here, active = tiles[lo], None
            new = b["r"].take(pa.array(lo + np.flatnonzero(kind[lo:hi] == 0)))
            active = new if active is None else pa.concat_arrays([active, new])
            rows = lo + np.flatnonzero(kind[lo:hi] == 1)
            if len(rows) and len(active):
                yield b["p"], rows, place[rows], active
            stop = active.field("stop").to_numpy(zero_copy_only=False)
            active = active.filter(pa.array(stop >= place[hi - 1]))


def sweep_join(points: DataFrame, regions: DataFrame, at: str = "gpos", key: str = "tid", tile: int = TILE) -> DataFrame:
    """points x regions with start <= at <= stop on one contig, each pair once: the rows of metaplot.interval_join.

    Both are sorted by (contig, tile, place), windows before points. A task streams its ranges and holds one batch and the windows
    that are active at it. Ranges end at tiles, so points should be added up by place before (see pile): a tile then has at most its places.
    """
    p_cols, r_cols = points.columns, [c for c in regions.columns if c != key]
    events = _events(points.select("*", F.struct(*p_cols).alias("p")), regions.select("*", F.struct(*r_cols).alias("r")), at, key, tile)
    out = StructType([*points.schema.fields, *[f for f in regions.schema.fields if f.name != key]])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows, place, active in _passing(batches):
            yield from met(p, rows, place, active)

    def met(p: pa.StructArray, rows: np.ndarray, place: np.ndarray, active: pa.StructArray) -> Iterator[pa.RecordBatch]:
        start, stop = (active.field(n).to_numpy(zero_copy_only=False) for n in ("start", "stop"))
        lo, hi = np.searchsorted(place, start, "left"), np.searchsorted(place, stop, "right")
        size = np.maximum(hi - lo, 0)
        ends = np.cumsum(size)
        for done in range(0, int(ends[-1]), ROWS):
            n = np.arange(done, min(done + ROWS, int(ends[-1])))  # numbers of pairs
            w = np.searchsorted(ends, n, "right")
            at_row = rows[lo[w] + n - (ends[w] - size[w])]
            columns = [*p.take(pa.array(at_row)).flatten(), *active.take(pa.array(w)).flatten()]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return events.mapInArrow(run, out)


def sweep_sums(piled: DataFrame, regions: DataFrame, key: str = "tid", at: str = "gpos", tile: int = TILE, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """group, label, dw, mod, i, FG, BG: what points (see pile) give to the i-th place of the windows of a group, label and dw, counted from
    a window's start, or back from its stop on a minus strand. Sums of a task's pairs; those of different tasks are to be added up.

    The sweep of sweep_join, but no pair leaves the task: a window adds a stretch of points to the sums of its places, a block of
    places at a time. A task holds a batch, its active windows and so many blocks; when these are full, they leave it and others begin.
    """
    kept = ("start", "stop", "strand", "group", "label", "dw")
    events = _events(piled.select(key, at, F.struct("mod", "FG", "BG").alias("p")), regions.select(key, "start", "stop", F.struct(*kept).alias("r")), at, key, tile)
    p_type, r_type = piled.schema, regions.schema
    out = StructType([*[StructField(c, r_type[c].dataType) for c in kept[3:]], StructField("mod", p_type["mod"].dataType), *[StructField(c, LongType()) for c in ("i", "FG", "BG")]])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, types = {}, []
        for p, rows, place, active in _passing(batches):
            types = [*(active.type.field(c).type for c in kept[3:]), p.type.field("mod").type]
            of = list(zip(*(active.field(c).to_pylist() for c in kept[3:]), strict=True))
            forth = active.field("strand").fill_null(False).to_numpy(zero_copy_only=False)
            start, stop = (active.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
            mods = p.field("mod").take(pa.array(rows)).dictionary_encode()
            code = mods.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            values = np.stack([p.field(c).fill_null(0).to_numpy(zero_copy_only=False)[rows] for c in ("FG", "BG")])
            for m in np.unique(code):
                at_mod, mod = np.flatnonzero(code == m), mods.dictionary[int(m)].as_py() if m >= 0 else None
                x, first = np.unique(place[at_mod], return_index=True)  # sorted already; a place that is listed twice counts as one
                v = np.add.reduceat(values[:, at_mod], first, axis=1)
                lo, hi = np.searchsorted(x, start, "left"), np.searchsorted(x, stop, "right")
                for w in np.flatnonzero(hi > lo):
                    i, add = (x[lo[w] : hi[w]] - start[w], v[:, lo[w] : hi[w]]) if forth[w] else (stop[w] - x[lo[w] : hi[w]][::-1], v[:, lo[w] : hi[w]][:, ::-1])
                    for k in range(int(i[0]) // block, int(i[-1]) // block + 1):
                        a, b = np.searchsorted(i, (k * block, (k + 1) * block))
                        if a == b:
                            continue
                        name = (*of[w], mod, k)
                        if name not in sums:
                            if len(sums) >= blocks:
                                yield from left(sums, types)
                                sums.clear()
                            sums[name] = np.zeros((2, block), np.int64)
                        j = i[a:b] - k * block
                        if j[-1] - j[0] == b - a - 1:  # side by side
                            sums[name][:, j[0] : j[-1] + 1] += add[:, a:b]
                        else:
                            sums[name][:, j] += add[:, a:b]
        yield from left(sums, types)

    def left(sums: dict[tuple, np.ndarray], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        for (*name, k), s in sums.items():
            j = np.flatnonzero(s[1])
            same = [pa.repeat(pa.scalar(v, t), len(j)) for v, t in zip(name, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(k * block + j), pa.array(s[0][j]), pa.array(s[1][j])], names=names)

    return events.mapInArrow(run, out)
