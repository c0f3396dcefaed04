"""Statistics of a stream that outlive it: every batch of reads leaves its sums in a folder of its own.

A batch's folder is named by its id and carries a mark that is set last, so that a batch that is run again replaces what it left, and one that
died half-way does not count. Totals are the sums of all marked folders; compacting adds up the folders so far into one, which
remembers up to which batch it goes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidestat.accumulator import STATES, Accumulator
from tidestat.plans.fused import CELLS, added, results, shares, sums
from tidestat.registry import Stat
from tidestat.sources.relations import Relations
from tidestat.sources.shared import stored

MARK = "_whole"


class Ledger:
    """The folders under a path: batch=<id> of single batches, upto=<id> of all batches up to one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.system = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.hadoop.Path("/".join([self.path, *names]))

    def whole(self) -> tuple[int, list[int]]:
        """Up to which batch the newest compacted folder goes (-1: there is none), and the marked batches after it."""
        names = [s.getPath().getName() for s in self.system.listStatus(self._at())] if self.system.exists(self._at()) else []
        marked = [n for n in names if self.system.exists(self._at(n, MARK))]
        upto = max((int(n.split("=")[1]) for n in marked if n.startswith("upto=")), default=-1)
        return upto, sorted(b for n in marked if n.startswith("batch=") and (b := int(n.split("=")[1])) > upto)

    def folders(self) -> list[str]:
        """The names of the folders that the totals consist of."""
        upto, batches = self.whole()
        return ([f"upto={upto}"] if upto >= 0 else []) + [f"batch={b}" for b in batches]

    def write(self, name: str, tables: dict[str, DataFrame]) -> None:
        self.system.delete(self._at(name), True)
        for table, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/{table}")
        self.system.create(self._at(name, MARK)).close()

    def read(self, table: str, schema: str, names: Sequence[str]) -> DataFrame:
        where = [f"{self.path}/{n}/{table}" for n in names]
        return self.spark.read.schema(schema).parquet(*where) if where else self.spark.createDataFrame([], schema)

    def drop(self, names: Sequence[str]) -> None:
        for n in names:
            self.system.delete(self._at(n, MARK), False)
            self.system.delete(self._at(n), True)


def _tables(stats: Sequence[Stat], rel: Relations) -> dict[str, DataFrame]:
    """What a set of reads leaves: the added cells of those that share a pass, and states by name."""
    together, alone = _split(stats)
    out = {"cells": sums(together, rel)} if together else {}
    if alone:
        out["states"] = reduce(DataFrame.unionByName, [s.merged(s.states(rel.reads)).select(F.lit(s.name).alias("name"), "part", "state") for s in alone])
    return out


def _split(stats: Sequence[Stat]) -> tuple[list[Stat], list[Accumulator]]:
    together = [s for s in stats if shares(s)]
    alone = [s for s in stats if not shares(s)]
    if bad := [s.name for s in alone if not isinstance(s, Accumulator)]:
        raise ValueError(f"{bad} have neither cells nor states that can be added up")
    return together, alone


def start(reads: DataFrame, stats: Sequence[Stat], static: Relations, path: str, checkpoint: str) -> StreamingQuery:
    """Take in a stream of reads (schema.READS) to the end of what is there, keeping the sums of every batch under path.

    `static` gives the contigs and regions. Start it again with the same checkpoint to go on, after a failure too: a batch that was
    under way is run again and replaces its folder, and a batch that a compacted folder holds already is left alone.
    """
    _split(stats)

    def take(batch: DataFrame, number: int) -> None:
        ledger = Ledger(batch.sparkSession, path)
        if number > ledger.whole()[0]:
            ledger.write(f"batch={number}", _tables(stats, Relations(batch, static.contigs, static.regions)))

    return reads.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, stats: Sequence[Stat], static: Relations, path: str) -> dict[str, DataFrame]:
    """Each statistic's result by name over all batches so far. The statistics are those of start(), in its order."""
    ledger, (together, alone) = Ledger(spark, path), _split(stats)
    names = ledger.folders()
    out = results(together, _once(added(ledger.read("cells", CELLS, names))), static) if together else {}
    for s in alone:
        out[s.name] = s.result(_numbered(ledger, names).where(F.col("name") == s.name))
    return {s.name: out[s.name] for s in stats}


def _once(cells: DataFrame) -> DataFrame:
    """Added cells as a table: each result reads those with its tag."""
    return cells.sparkSession.read.schema(CELLS).parquet(stored(cells.sortWithinPartitions("tag"), "totals"))


def compact(spark: SparkSession, stats: Sequence[Stat], path: str) -> None:
    """Add up all marked folders into one and delete them. Run it while no query writes; if it dies, the totals stay what they were."""
    ledger, (together, alone) = Ledger(spark, path), _split(stats)
    upto, batches = ledger.whole()
    names = ledger.folders()
    if len(names) < 2:
        return
    tables = {"cells": added(ledger.read("cells", CELLS, names))} if together else {}
    if alone:
        states = _numbered(ledger, names)
        tables["states"] = reduce(DataFrame.unionByName, [s.merged(states.where(F.col("name") == s.name)).select(F.lit(s.name).alias("name"), "part", "state") for s in alone])
    ledger.write(f"upto={batches[-1]}", tables)
    ledger.drop(names)


def _numbered(ledger: Ledger, names: Sequence[str]) -> DataFrame:
    """The states of several folders with parts that differ from folder to folder, in their order."""
    parts = [ledger.read("states", f"name string, {STATES}", [n]).withColumn("part", F.col("part") + (i << 32)) for i, n in enumerate(names)]
    return reduce(DataFrame.unionByName, parts) if parts else ledger.read("states", f"name string, {STATES}", [])
