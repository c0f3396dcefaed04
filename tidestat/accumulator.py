"""Statistics as accumulators: a state, how batches of reads change it, and how two states become one. No SQL is needed.

Each task folds its reads, Arrow batch by Arrow batch, into one state; states meet in a tree, so that no task holds more than a
node's worth of them however many tasks there were. The order of merging is that of the partitions.
"""

from __future__ import annotations

import pickle
from abc import abstractmethod
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidestat.registry import Stat
from tidestat.sources.relations import Relations

#: States that a node of the tree merges, and the levels below its root: FAN ** (LEVELS + 1) tasks at most without a wider root.
FAN, LEVELS = 64, 2
STATES = "part long, state binary"


class Accumulator(Stat):
    """A statistic by init, update, merge and rows; `columns` are those of a read that it sees, `schema` is its result's."""

    @abstractmethod
    def init(self) -> Any:
        """The state of no reads."""

    @abstractmethod
    def update(self, state: Any, batch: pa.RecordBatch) -> Any:
        """The state after a batch of reads (columns as declared)."""

    @abstractmethod
    def merge(self, first: Any, second: Any) -> Any:
        """The state of the reads of both."""

    @abstractmethod
    def rows(self, state: Any) -> Iterable[tuple]:
        """The rows of the result."""

    def compute(self, rel: Relations) -> DataFrame:
        return self.result(self.states(rel.reads))

    def states(self, reads: DataFrame) -> DataFrame:
        """STATES: one state a task, numbered by partition. States of several sets of reads may be united."""

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, some = self.init(), False
            for b in batches:
                if b.num_rows:
                    state, some = self.update(state, b), True
            if some:
                yield _packed([(TaskContext.get().partitionId(), pickle.dumps(state))])

        return reads.select(*self.columns).mapInArrow(fold, STATES)

    def merged(self, states: DataFrame) -> DataFrame:
        """STATES with at most one state for each node of the tree's last level."""

        def join(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table["part"].to_pylist(), table["state"].to_pylist(), strict=True))
            state = pickle.loads(rows[0][1])
            for _, other in rows[1:]:
                state = self.merge(state, pickle.loads(other))
            return pa.Table.from_batches([_packed([(rows[0][0], pickle.dumps(state))])])

        for level in range(1, LEVELS + 1):
            node = F.floor(F.col("part") / FAN**level)
            states = states.groupBy(node.alias("node")).applyInArrow(join, STATES)
        return states

    def result(self, states: DataFrame) -> DataFrame:
        """The statistic's table from states."""
        kind = self.schema if isinstance(self.schema, StructType) else StructType.fromDDL(self.schema)
        arrow = to_arrow_schema(kind)

        def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, found = self.init(), sorted(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
            for _, other in found:
                state = self.merge(state, pickle.loads(other))
            rows = list(self.rows(state))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], names=arrow.names)

        return self.merged(states).select("part", "state").coalesce(1).mapInArrow(end, kind)


def _packed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "state"])
