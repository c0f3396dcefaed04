"""Centroid clustering against plain rounds, and its bounds against all distances."""

import hashlib
import math
import random

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidestat.llm import centroids, queries


def lloyd(rows, k, rounds, seed=2):
    """cluster and squared distance of each row (id, vector), by all distances."""
    kept = [(i, [max(-centroids.MOST, min(centroids.MOST, math.floor(256 * x))) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    for n in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, w)) for w in c] for _, v in kept]
        at = [x.index(min(x)) for x in d]
        if n < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), a in zip(kept, at) if a == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, a, x[a]) for (i, _), a, x in zip(kept, at, d)), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, Cluster int, VEC_ID_ string")


def check(spark, rows, kept, k, rounds, size):
    out = centroids.cluster(table(spark, rows), k=k, rounds=rounds, size=size).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out), key=str) == lloyd(kept, k, rounds)
    for r in out:
        assert r.cluster_inertia == sum(x.distance for x in out if x.cluster == r.cluster) and r.inertia == sum(x.distance for x in out)


def test_rounds_and_odd_rows(spark):
    rng = random.Random(3)
    some = [(i, [float(np.float32(rng.gauss(i % 5, 0.3))) for _ in range(4)]) for i in range(300)]
    ties = [(1000 + i, [float(rng.randint(0, 2)) / 256 for _ in range(4)]) for i in range(300)]  # equal vectors and equal distances
    copies = [(2000, [0.5] * 4)] * 50 + [(None, [0.25] * 4), (None, [0.25] * 4)]
    kept = some + ties + copies
    bad = [(3000, None), (3001, []), (3002, [1.0] * 3), (3003, [1.0] * 5), (3004, [1.0, None, 1.0, 1.0]), (3005, [float("nan"), 0.0, 0.0, 0.0]), (3006, [float("inf")] * 4)]
    check(spark, kept + bad, kept, 20, 4, 4)
    check(spark, ties + bad, ties, 40, 3, 4)
    check(spark, some[:7], some[:7], 40, 5, 4)  # fewer vectors than centroids
    check(spark, [(1, [3e38, -3e38, 0.0, 1.0]), (2, [0.0] * 4)], [(1, [3e38, -3e38, 0.0, 1.0]), (2, [0.0] * 4)], 2, 2, 4)
    check(spark, some[:9], some[:9], 1, 2, 4)
    assert centroids.cluster(table(spark, bad)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 3), st.sampled_from([2, 5, 1000]))
def test_bounds_never_hide_a_nearer_centroid(seed, k, size, spread):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, spread, (60, size))
    c, before = rng.integers(0, spread, (k, size)), None
    at, up, low = np.full(60, -1, np.int32), np.full(60, np.inf), np.zeros(60)
    for _ in range(4):
        at, up, low, _ = centroids.assign(v, at, up, low, centroids.Ball(c, before))
        d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert (at == d.argmin(axis=1)).all()  # of ties, the smaller number
        own = np.sqrt(d[np.arange(60), at])
        d[np.arange(60), at] = 10**12
        assert (up >= own).all() and (k == 1 or (low <= np.sqrt(d.min(axis=1))).all())
        before, c = c, np.maximum(0, c + rng.integers(-2, 3, c.shape))


def test_exponion_saves_distances():
    rng = np.random.default_rng(1)
    where = rng.integers(0, 3000, (40, 8))
    v = where[rng.integers(0, 40, 4000)] + rng.integers(-40, 40, (4000, 8))
    at, up, low = np.full(4000, -1, np.int32), np.full(4000, np.inf), np.zeros(4000)
    at, up, low, full = centroids.assign(v, at, up, low, centroids.Ball(where))
    moved = where + rng.integers(-3, 4, where.shape)
    *_, cost = centroids.assign(v, at, up, low, centroids.Ball(moved, where))
    assert full == 40 * 4000 and cost < full / 10


def test_query(spark, small):
    out = queries.op13_centroid_clustering(spark, small)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    want = con.execute(queries.ORACLE["op13_centroid_clustering"])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(want.fetchall())
