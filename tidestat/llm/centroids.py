"""Centroid clustering over whole numbers: Lloyd's rounds by exponion search, with exact ties and exact means.

A vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to every other one. Where the bounds
leave a doubt, only centroids inside a ball around its current centroid are looked at: those within twice the (tightened) upper bound
plus the distance from that centroid to its nearest neighbour, borders included, so that a centroid at the same distance is never missed.
Vectors stay where they are; a round moves k centroids to the tasks and, for each task, at most k sums of components back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestat.llm.common import discard, only, small_batches, stored, tidy

#: Components beyond this size count as it: squared distances of 2**10 of them still fit into a long.
MOST = 1 << 25
#: How much computed bounds are widened, far above the rounding of a square root and of the sums of rounds.
SLACK = 1e-9
ROWS = 4096


class Ball:
    """Centroids with what the search needs of them: for each one the others sorted by their distance from it."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        k = len(centroids)
        apart = np.sqrt(squared(centroids, centroids).astype(float))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.far = np.take_along_axis(apart, self.order, 1)
        # the centroid itself, or an equal one, comes first at distance 0: what counts is the nearest of the others
        np.fill_diagonal(apart, np.inf)
        self.near = apart.min(axis=1) if k else np.zeros(0)
        moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(float))
        self.moved = moved * (1 + SLACK)
        top = np.sort(self.moved)[::-1]
        # the largest move among the others
        self.others = np.where(self.moved == top[0], top[1] if k > 1 else 0.0, top[0]) if k else top


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid, one centroid at a time."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = vectors - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def nearest(vectors: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of the centroids `which` (of equally near ones that of the smallest number), the distance to it and to the second one."""
    which = np.sort(which)
    d = squared(vectors, centroids[which])
    at = d.argmin(axis=1)
    rows = np.arange(len(d))
    best = d[rows, at]
    d[rows, at] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1).astype(float)) if len(which) > 1 else np.full(len(d), np.inf)
    return which[at].astype(np.int32), best, second


def assign(vectors: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, ball: Ball) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroids with fresh bounds, and how many distances were computed. `at` is -1 where nothing is known."""
    at, upper, lower, cost = at.copy(), upper.copy(), lower.copy(), 0
    k = len(ball.centroids)
    new = at < 0
    if new.any():
        a, best, second = nearest(vectors[new], ball.centroids, np.arange(k))
        at[new], upper[new], lower[new] = a, np.sqrt(best.astype(float)) * (1 + SLACK), second * (1 - SLACK)
        cost += int(new.sum()) * k
    old = ~new
    upper[old] += ball.moved[at[old]]
    lower[old] -= ball.others[at[old]]
    bound = np.maximum(lower, ball.near[at] * (0.5 * (1 - SLACK)))
    doubt = np.flatnonzero(old & ~(upper < bound))
    if len(doubt):
        d = vectors[doubt] - ball.centroids[at[doubt]]
        exact = np.sqrt(np.einsum("ij,ij->i", d, d).astype(float))
        cost += len(doubt)
        upper[doubt] = exact * (1 + SLACK)
        still = ~(upper[doubt] < bound[doubt])
        doubt, exact = doubt[still], exact[still]
    for a in np.unique(at[doubt]):
        mine = at[doubt] == a
        rows = doubt[mine]
        radius = (2 * exact[mine] + ball.near[a]) * (1 + SLACK)  # inclusive, and not below the true one
        count = np.searchsorted(ball.far[a], radius, side="right")
        band = np.minimum(k, 1 << np.ceil(np.log2(np.maximum(count, 2))).astype(int))  # rings of doubling size share one matrix
        for n in np.unique(band):
            some = rows[band == n]
            which = ball.order[a, :n]
            if a not in which:
                which = np.append(which, a)
            b, best, second = nearest(vectors[some], ball.centroids, which)
            at[some], upper[some], lower[some] = b, np.sqrt(best.astype(float)) * (1 + SLACK), second * (1 - SLACK)
            cost += len(some) * len(which)
    return at, upper, lower, cost


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.int64)


def _round(state: DataFrame, ball: Ball) -> DataFrame:
    """state (id, v, cluster, upper, lower) after one assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                at, upper, lower, _ = assign(_matrix(b["v"]), *(b[c].to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")), ball)
                made = {"cluster": pa.array(at, pa.int32()), "upper": pa.array(upper), "lower": pa.array(lower)}
                yield pa.RecordBatch.from_arrays([made[n] if n in made else b[n] for n in b.schema.names], names=b.schema.names)

    return state.mapInArrow(tidy(run), state.schema)


def _sums(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each cluster its rows and the sums of their components: added up in each task first, so that a hot cluster is k rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            v, at = _matrix(b["v"]), b["cluster"].to_numpy()
            for a in np.unique(at):
                mine = v[at == a]
                n, sums = total.get(int(a), (0, None))
                part = mine.sum(axis=0)
                total[int(a)] = (n + len(mine), part if sums is None else sums + part)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64()))],
                names=["cluster", "n", "sums"],
            )

    parts = state.select("v", "cluster").mapInArrow(tidy(run), "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i")
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in each.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k times the dimension
        out.setdefault(r.cluster, (r.n, {}))[1][r.i] = int(r.s)
    return {a: (n, [s[i] for i in range(len(s))]) for a, (n, s) in out.items()}


def vectors_of(table: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """id, v: the vectors of exactly `size` finite components, each floor(scale * x), as whole numbers of at most MOST."""
    kept = only(table, key, vector).toDF("id", "x").where(
        (F.size("x") == size) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    )
    whole = lambda c: F.greatest(F.least(F.floor(F.lit(float(scale)) * c.cast("double")), F.lit(MOST)), F.lit(-MOST)).cast("int")
    return kept.select("id", F.transform("x", whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of least SHA-256 of "seed:id" (those without an id last, ties by components); k rows come to the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def cluster(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2
) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid: for every kept vector its centroid's number after `rounds` rounds and
    one more assignment, the squared distance to it, its sums over the cluster and over all, and the centroid's components.

    Kept are vectors of exactly `size` components, none null or not finite; components become floor(scale * x). A round assigns every
    vector to the nearest centroid (ties: the smaller number) and moves each centroid that has vectors to the floor of their mean.
    Cases: with fewer vectors than k all of them are centroids; an empty table gives no rows; repeated rows count each, and are
    centroids each; a null key is kept, but is a centroid only after all others; components beyond MOST count as MOST; other
    columns are ignored, whatever their names. Every round is written to the shared folder, and the one before it deleted there.
    """
    spark = table.sparkSession
    small_batches(spark)
    vectors = vectors_of(table, key, vector, size, scale)
    start = vectors.select("id", "v", F.lit(-1).cast("int").alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    path = stored(start, "vectors")
    state = spark.read.schema(start.schema).parquet(path)
    centroids, before = first_centroids(state.select("id", "v"), k, seed), None
    for i in range(rounds + 1 if len(centroids) else 0):
        nxt = stored(_round(state, Ball(centroids, before)), f"round{i}")
        discard(spark, path)
        path, state = nxt, spark.read.schema(start.schema).parquet(nxt)
        if i < rounds:
            before, centroids = centroids, centroids.copy()
            for a, (n, sums) in _sums(state).items():
                centroids[a] = [s // n for s in sums]
    return _finish(state, centroids, key)


def _finish(state: DataFrame, centroids: np.ndarray, key: str) -> DataFrame:
    spark = state.sparkSession
    table = spark.createDataFrame([(a, c.tolist()) for a, c in enumerate(centroids)], "cluster int, centroid array<long>")
    at = state.select("id", "v", "cluster").join(F.broadcast(table), "cluster")  # k rows
    gap = F.zip_with("v", "centroid", lambda x, c: (x - c) * (x - c))
    each = at.select("id", "cluster", F.aggregate(gap, F.lit(0).cast("long"), lambda s, x: s + x).alias("distance"), "centroid")
    sums = each.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    both = sums.crossJoin(F.broadcast(total))  # one row
    return each.join(F.broadcast(both), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
