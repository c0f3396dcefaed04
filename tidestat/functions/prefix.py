"""Running sums over a sorted axis without a task that sees all of it.

Rows are cut into buckets of the axis: whole numbers between the smallest and the largest value of their group, so that the cut depends
on the values alone and not on how they are stored. A window sums each bucket; what lies in the buckets before it is added from the
buckets' totals, a small table. A group spreads over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a group. Their totals (one row each) meet every later bucket of the group: half the square of this, whatever the rows.
BUCKETS = 256


def buckets_of(df: DataFrame, by: Sequence[str], x: str, n: int = BUCKETS, name: str = "_bucket") -> DataFrame:
    """df with the bucket, 0 to n - 1, of each value of x in its group; those of null, NaN and equal values are one.

    The groups' ends are broadcast: `by` names a few things (modifications, features), not data.
    """
    value = F.col(x).cast("double")
    finite = F.when(F.isnan(value), None).otherwise(value)
    ends = df.groupBy(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    place = F.floor((value - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * n)
    bucket = F.when(F.isnan(value), n - 1).when(value.isNull() | (F.col("_hi") == F.col("_lo")), 0).otherwise(F.least(place, F.lit(n - 1)))
    return df.join(F.broadcast(ends), same, "left").withColumn(name, F.coalesce(bucket, F.lit(0)).cast("int")).drop("_lo", "_hi", *[f"_by{i}" for i in range(len(by))])


def running(
    df: DataFrame, by: Sequence[str], x: str, sums: Mapping[str, Column | str], before: str | None = None, descending: bool = False, n: int = BUCKETS
) -> DataFrame:
    """df with running sums: for each name in `sums`, the sum of its column over the rows of the group up to this one, in the order of x.

    Rows of equal x each see all of them, as with a window over a range; `before` names a column for the x of the row before this one in
    the order (null where there is none). `by` may be empty: rows are one group then, those of null x another.
    """
    whole = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.col(x).isNull())
    cut = buckets_of(base, whole, x, n)
    cut = cut.withColumns({f"_w{i}": F.expr(c) if isinstance(c, str) else c for i, c in enumerate(sums.values())})
    names = [f"_w{i}" for i in range(len(sums))]
    order = F.col(x).desc() if descending else F.col(x).asc()
    inside = Window.partitionBy(*whole, "_bucket").orderBy(order)
    edge = F.min if descending else F.max  # of the buckets before, the value nearest to this one
    totals = cut.groupBy(*whole, "_bucket").agg(*[F.sum(w).alias(w) for w in names], edge(x).alias("_x"))
    later = "sequence(0, _bucket - 1)" if descending else f"sequence(_bucket + 1, {n - 1})"
    ahead = totals.where("_bucket > 0" if descending else f"_bucket < {n - 1}").withColumn("_bucket", F.explode(F.expr(later)))
    offsets = ahead.groupBy(*whole, "_bucket").agg(*[F.sum(w).alias(f"{w}o") for w in names], edge("_x").alias("_xo"))
    offsets = offsets.toDF(*[f"_o{i}" for i in range(len(whole))], "_ob", *[f"{w}o" for w in names], "_xo")
    same = F.col("_bucket") == F.col("_ob")
    for i, b in enumerate(whole):
        same = same & F.col(b).eqNullSafe(F.col(f"_o{i}"))
    mine = cut.select("*", *[F.sum(w).over(inside).alias(f"{w}s") for w in names])
    if before:
        mine = mine.withColumn("_xb", F.lag(x).over(inside))
    out = mine.join(F.broadcast(offsets), same, "left")  # n rows a group
    made = {name: F.col(f"{w}s") + F.coalesce(F.col(f"{w}o"), F.lit(0)) for name, w in zip(sums, names, strict=True)}
    if before:
        made[before] = F.coalesce("_xb", "_xo")
    return out.select(*df.columns, *[c.alias(name) for name, c in made.items()])


def numbered(df: DataFrame, block: str, place: str, name: str) -> DataFrame:
    """df with row numbers from 1 in the order of (block, place): blocks are counted, and each is numbered by a task of its own.

    The counts, a row for each block (a split of a file, say), are summed in one window and broadcast.
    """
    counts = df.groupBy(block).agg(F.count("*").alias("_n")).withColumn("_all", F.col("_n") < 0)
    earlier = Window.partitionBy("_all").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(block).alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = df.join(F.broadcast(starts), F.col(block).eqNullSafe(F.col("_of")), "left")
    inside = F.row_number().over(Window.partitionBy(block).orderBy(place))
    return joined.withColumn(name, F.col("_before") + inside).drop("_of", "_before")
