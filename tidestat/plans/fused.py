"""All statistics from one pass over the reads: each read gives tagged cells, which are added up by key once.

A statistic says, as SQL over a read, which cells it gives (Stat.cells), and makes its result of the sums (Stat.finish). One scan, one
generator and one aggregation serve all of them; sums are whole numbers and sums of shares, so that parts of the reads, batches of a stream
for instance, can be added up later.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestat.functions.tally import Reads, table
from tidestat.operators.rates import NO_CALLS
from tidestat.registry import Stat
from tidestat.sources.relations import Relations

KEYS = ("tag", "s", "a", "b", "c")
CELLS = "tag int, s string, a long, b long, c long, n long, m long, x double"
SCHEMA = pa.schema([("tag", pa.int32()), ("s", pa.string()), *[(c, pa.int64()) for c in "abcnm"], ("x", pa.float64())])


def shares(stat: Stat) -> bool:
    """Whether a statistic takes part in the shared pass."""
    return stat.cells() is not None or stat.call_cell() is not None


def emitted(stats: Sequence[Stat], rel: Relations) -> DataFrame:
    """CELLS of every read, before they are added up; the tag is the place of the statistic in the list.

    A read becomes two rows, one with the cells of its own and one with its calls; then a row for each call. So no call carries the
    arrays of its read, and cells of calls are made in generated code.
    """
    reads = rel.reads
    if "mods" in reads.columns:  # a source may leave out what no statistic reads
        reads = reads.withColumn("calls", F.expr(f"coalesce(mods, {NO_CALLS})"))
    own, of_calls = [], []
    for tag, s in enumerate(stats):
        made = {k: f"_{tag}_{k}" for k in s.prepare()}

        def named(sql: str, made: dict[str, str] = {"tag": str(tag), **made}) -> str:
            for k, c in made.items():
                sql = sql.replace(f"{{{k}}}", c)
            return sql

        for k, sql in s.prepare().items():
            reads = reads.withColumn(made[k], F.expr(named(sql)))
        own += [named(s.cells())] if s.cells() else []
        of_calls += [named(s.call_cell())] if s.call_cell() else []
    mine = f"concat({', '.join(own)})" if own else f"cast(array() as array<struct<{', '.join(c.replace(' ', ':') for c in CELLS.split(', '))}>>)"
    if of_calls:
        halves = f"inline(array(named_struct('mine', {mine}, 'each', cast(null as {reads.schema['calls'].dataType.simpleString()})), named_struct('mine', null, 'each', calls)))"
        each = reads.select("tid", "qlen", F.expr(halves)).select("tid", "qlen", "mine", F.expr("inline_outer(each)"))
        cells = each.select(F.expr(f"inline(coalesce(mine, array({', '.join(of_calls)})))")).where("tag is not null")
    else:
        cells = reads.select(F.expr(f"inline({mine})"))
    for tag, s in enumerate(stats):
        cells = s.place(cells, tag, rel)
    return cells


def added(cells: DataFrame) -> DataFrame:
    """Cells with equal keys as one: of emitted cells, or of sums."""
    return cells.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("x").alias("x"))


def sums(stats: Sequence[Stat], rel: Relations) -> DataFrame:
    """The added cells of these reads: counted a batch of reads at a time where all of the statistics can (Stat.counter), else from emitted cells."""
    counters = [s.counter() for s in stats]
    if any(c is None for c in counters):
        return added(emitted(stats, rel))
    needed = {c for s in stats for c in s.columns}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reads = Reads(b)
            for tag, counter in enumerate(counters):
                for found in counter(reads):
                    yield table(tag, found, SCHEMA)

    cells = rel.reads.select(*[c for c in rel.reads.columns if c in needed]).mapInArrow(count, CELLS)
    for tag, s in enumerate(stats):
        cells = s.place(cells, tag, rel)
    return added(cells)


def results(stats: Sequence[Stat], cells: DataFrame, rel: Relations) -> dict[str, DataFrame]:
    """Each statistic's result by name, from the added cells of these statistics (kept by the caller: each result reads them)."""
    return {s.name: s.finish(cells.where(F.col("tag") == tag).drop("tag"), rel) for tag, s in enumerate(stats)}


def fused(stats: Sequence[Stat], rel: Relations) -> dict[str, DataFrame]:
    """Results by name from one scan of the reads. Read them while `fused.cells` of the returned mapping is kept, and unpersist it then."""
    out = Fused(results(stats, cells := sums(stats, rel).persist(), rel))
    out.cells = cells
    return out


class Fused(dict):
    """Results by name; `cells` is the kept table that they read."""

    cells: DataFrame
