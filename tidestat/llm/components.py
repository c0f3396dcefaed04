"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestat.llm.common import materialise, tidy

#: A graph of at most so many edges (16 bytes each) is finished in one task.
ONE_TASK = 500_000


class Forest:
    """Union by size over any hashable labels."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        root = x
        while (p := self.up.setdefault(root, root)) != root:
            root = p
        while (p := self.up[x]) != root:
            self.up[x], x = root, p
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f.join(x, y)
    ids = list(f.up)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f.find(x) for x in ids])], names=["id", "root"])


def components(edges: DataFrame, name: str = "components", one_task: int = ONE_TASK) -> DataFrame:
    """id, root for every vertex of edges (a, b: both long, or both binary); equal roots mark one component.

    While the graph is large, each vertex moves to its neighbour (or itself) of least hash under a fresh order and
    the graph is contracted: its size falls by a constant factor a round in expectation, whatever its shape.
    """
    edges = materialise(edges.select("a", "b").where("a != b").distinct(), f"{name}-edges")
    kind, labels = edges.schema["a"].dataType.simpleString(), None
    for seed in range(100):
        if edges.limit(one_task + 1).count() <= one_task:
            last = edges.coalesce(1).mapInArrow(tidy(_finish), f"id {kind}, root {kind}")
            return materialise(last if labels is None else _compose(labels, last), name)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.xxhash64(F.col(c), F.lit(seed))  # noqa: B023, E731  used at once
        least = both.groupBy(F.col("a").alias("id")).agg(F.min(F.struct(order("b").alias("h"), F.col("b"))).alias("m"))
        move = F.when(F.struct(F.col("m.h"), F.col("m.b")) < F.struct(order("id").alias("h"), F.col("id").alias("b")), F.col("m.b")).otherwise(F.col("id"))
        moved = materialise(least.select("id", move.alias("root")), f"{name}-moves")
        labels = materialise(moved if labels is None else _compose(labels, moved), f"{name}-labels")
        a, b = moved.toDF("a", "ra"), moved.toDF("b", "rb")
        nxt = edges.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = materialise(nxt.where("a != b").distinct(), f"{name}-edges")
    raise RuntimeError("contraction did not end")


def _compose(labels: DataFrame, step: DataFrame) -> DataFrame:
    """labels followed by step; roots that step lacks stay."""
    to = step.toDF("root", "next")
    return labels.join(to, "root", "left").select("id", F.coalesce("next", "root").alias("root"))


__all__ = ["Forest", "components"]
