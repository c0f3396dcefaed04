"""Auto- and cross-correlation of confident calls inside a window of each read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestat.functions import bits
from tidestat.functions.tally import Reads, tally
from tidestat.functions.tally import cells as tallied
from tidestat.plans import svg
from tidestat.registry import Stat, cell, register
from tidestat.schema import CONFIDENT, MODS, mod_ordinal
from tidestat.sources.relations import Relations

# Lags 1..10 and 10..280 in tens, the window length and its first position.
LAGS = tuple(sorted({*range(1, 11), *range(10, 281, 10)}))
LENGTH, OFFSET = 1024, 180
#: Positions of a read, of all modifications, up to which lags are matched on sets of them rather than on words of bits.
FEW = 96


def mod_cross_cor(
    reads: DataFrame,
    mod_calls: DataFrame,
    lags: Sequence[int] = LAGS,
    mods: Sequence[str] = MODS,
    length: int = LENGTH,
    offset: int = OFFSET,
    thresh: float = CONFIDENT,
    duplicate_lags: bool = False,
) -> DataFrame:
    """ModA, ModB, Lag, CrossCor for every pair of modifications (A not after B in ordinal) and lag.

    For a read with qlen >= length + offset: matches n = #{(a, b): b - a = lag} over distinct positions in the
    window, divided by sqrt(#a * #b), 0 where a side is empty; summed over reads and divided by all eligible
    reads. Lags are positive. duplicate_lags keeps repeated lags of the argument as repeated rows.

    The plan packs each read's distinct positions into one array per modification (one shuffle by read, with
    a bounded window of positions; none for nested calls, see nested_cross_cor) and counts lag matches in the row, so no
    pair of calls is ever shuffled.
    """
    if any(x < 1 for x in lags):
        raise ValueError("lags are positive")
    spark = reads.sparkSession
    lag_list = list(lags) if duplicate_lags else sorted(set(lags))
    eligible = reads.where(F.col("qlen") >= length + offset).agg(F.count("*").alias("t"))
    calls = mod_calls.where(
        (F.col("qlen") >= length + offset)
        & F.col("pos").between(offset, offset + length - 1)
        & (F.col("prob") > thresh)
        & F.col("mod").isin(*mods)
    ).select("read_id", mod_ordinal(F.col("mod")).alias("o"), F.col("pos").cast("int").alias("pos"))
    ords = [i for i, m in enumerate(MODS) if m in mods]
    packed = calls.groupBy("read_id").agg(
        *[F.collect_set(F.when(F.col("o") == o, F.col("pos"))).alias(f"p{o}") for o in ords]
    )
    return _finish(spark, lag_sums(packed, ords, lags), eligible, ords, lag_list)


def nested_positions(
    reads: DataFrame, mods: Sequence[str] = MODS, length: int = LENGTH, offset: int = OFFSET, thresh: float = CONFIDENT
) -> DataFrame:
    """p0, p1, ...: each eligible read's distinct confident positions in the window, by ordinal; in the row, without a shuffle."""
    near = f"filter(mods, x -> x.prob > {float(thresh)!r}D and x.pos between {offset} and {offset + length - 1})"
    kept = reads.where(F.col("qlen") >= length + offset).select(F.expr(near).alias("near"))
    ords = [i for i, m in enumerate(MODS) if m in mods]
    return kept.select(*[F.expr(f"array_distinct(transform(filter(near, x -> x.mod = '{MODS[o]}'), x -> x.pos))").alias(f"p{o}") for o in ords])


def lag_sums(packed: DataFrame, ords: Sequence[int], lags: Sequence[int], dense: bool = False) -> DataFrame:
    """a, b, lag, s: over rows of position sets p0, p1, ..., the sums of matches over norms; one keyed aggregation.

    A lag's matches are the intersection of b with a moved by the lag. With `dense` the sets become 64-bit words instead and each
    lag a shift of words: better from some hundreds of positions in a set.
    """
    pairs = [(a, b) for a in ords for b in ords if a <= b]
    lag_array = f"array({', '.join(map(str, sorted(set(lags))))})"
    sets = [f"p{o}" for o in ords]
    sizes = [F.size(p).alias(f"n{p[1:]}") for p in sets]
    if dense:
        base = f"least({', '.join(f'array_min({p})' for p in sets)}, 2147483647)"
        top = f"greatest({', '.join(f'array_max({p})' for p in sets)}, 0)"
        packed = packed.select(*sets, F.expr(base).alias("base"), F.expr(top).alias("top")).where("top >= base")
        sized = packed.select(*sizes, *[F.expr(bits.words_sql(p, "base", "top")).alias(p) for p in sets])
        matches = lambda a, b: bits.lag_matches_sql(f"p{a}", f"p{b}", "g")
    else:
        sized = packed.select(*sizes, *sets)
        matches = lambda a, b: f"size(array_intersect(transform(p{a}, x -> x + g), p{b}))"
    cells = [
        f"struct({a} as a, {b} as b, sqrt(double(n{a}) * n{b}) as norm, "
        f"if(n{a} = 0 or n{b} = 0, array(), transform({lag_array}, g -> struct(g as lag, {matches(a, b)} as n))) as hits)"
        for a, b in pairs
    ]
    per_read = sized.select(F.expr(f"inline(array({', '.join(cells)}))")).where("norm > 0")
    return (
        per_read.select("a", "b", "norm", F.inline("hits"))
        .where("n > 0")
        .groupBy("a", "b", "lag")
        .agg(F.sum(F.col("n") / F.col("norm")).alias("s"))
    )


def _finish(spark: SparkSession, sums: DataFrame, eligible: DataFrame, ords: Sequence[int], lag_list: Sequence[int]) -> DataFrame:
    pairs = [(a, b) for a in ords for b in ords if a <= b]
    grid = spark.createDataFrame(
        [(a, b, MODS[a], MODS[b], g) for a, b in pairs for g in lag_list],
        "a int, b int, ModA string, ModB string, lag int",
    )
    return (
        grid.join(sums, ["a", "b", "lag"], "left")
        .crossJoin(eligible)  # one row: an aggregate without keys
        .select(
            "ModA",
            "ModB",
            F.col("lag").alias("Lag"),
            F.try_divide(F.coalesce("s", F.lit(0.0)), F.col("t")).alias("CrossCor"),
            "a",
            "b",
        )
        .orderBy("a", "b", "Lag")
        .drop("a", "b")
    )


def nested_cross_cor(
    reads: DataFrame, lags: Sequence[int] = LAGS, mods: Sequence[str] = MODS, length: int = LENGTH, offset: int = OFFSET,
    thresh: float = CONFIDENT, duplicate_lags: bool = False, dense: bool = True,
) -> DataFrame:
    """mod_cross_cor of reads with nested calls: nothing shuffles but the sums."""
    if any(x < 1 for x in lags):
        raise ValueError("lags are positive")
    ords = [i for i, m in enumerate(MODS) if m in mods]
    eligible = reads.where(F.col("qlen") >= length + offset).agg(F.count("*").alias("t"))
    sums = lag_sums(nested_positions(reads, mods, length, offset, thresh), ords, lags, dense)
    return _finish(reads.sparkSession, sums, eligible, ords, list(lags) if duplicate_lags else sorted(set(lags)))


def _lag_hits(row: np.ndarray, pos: np.ndarray, o: np.ndarray, lags: Sequence[int], reads: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """The columns a, b, lag of positions' pairs at a lag within a read, how many, and their sums over the norm; positions are distinct and sorted.

    Each position meets its first neighbour, its second, and so on, as long as one is within the largest lag: a batch's worth at a time.
    """
    size, top = np.bincount(row * len(MODS) + o, minlength=reads * len(MODS)), max(lags, default=0)
    wanted = np.zeros(top + 1, bool)
    wanted[list(lags)] = True
    hits, sums, i, step = np.zeros((len(MODS), len(MODS), top + 1), np.int64), np.zeros((len(MODS), len(MODS), top + 1)), np.arange(len(row)), 1
    while len(i := i[: np.searchsorted(i, len(row) - step)]):
        i = i[(row[i + step] == row[i]) & (pos[i + step] - pos[i] <= top)]
        j, lag = i + step, pos[i + step] - pos[i]
        met = wanted[lag] & (o[i] <= o[j])
        a, b, at = i[met], j[met], (o[i[met]] * len(MODS) + o[j[met]]) * (top + 1) + lag[met]
        norm = np.sqrt(size[row[a] * len(MODS) + o[a]].astype(float) * size[row[b] * len(MODS) + o[b]])
        hits += np.bincount(at, minlength=hits.size).reshape(hits.shape)
        sums += np.bincount(at, 1 / norm, hits.size).reshape(hits.shape)
        step += 1
    found = np.nonzero(hits)
    return list(found), hits[found], [sums[found]]


@register
class ModCrossCor(Stat):
    name, title, file, grain = "ModCrossCor", "Modification cross-correlation", "modcrosscor.tsv.gz", "per-read mod"
    columns = ("qlen", "mods")
    schema = "ModA string, ModB string, Lag int, CrossCor double"

    def compute(self, rel: Relations) -> DataFrame:
        known = {k: v for k, v in self.options.items() if k in ("lags", "mods", "length", "offset", "thresh", "duplicate_lags", "dense")}
        return nested_cross_cor(rel.reads, **known)

    def _known(self) -> tuple[list[int], list[int], int, int, float, bool | None]:
        o = self.options
        lags = list(o.get("lags", LAGS))
        if any(g < 1 for g in lags):
            raise ValueError("lags are positive")
        ords = [i for i, m in enumerate(MODS) if m in o.get("mods", MODS)]
        return lags, ords, int(o.get("length", LENGTH)), int(o.get("offset", OFFSET)), float(o.get("thresh", CONFIDENT)), o.get("dense")

    def prepare(self) -> dict[str, str]:
        _, ords, length, offset, thresh, dense = self._known()
        near = f"filter(calls, k -> qlen >= {length + offset} and k.prob > {thresh!r}D and k.pos between {offset} and {offset + length - 1})"
        sets = {f"p{o}": f"array_distinct(transform(filter({{near}}, k -> k.mod = '{MODS[o]}'), k -> k.pos))" for o in ords}
        out = {"near": near, **sets}
        if dense is None or dense:
            most_few = "false" if dense else f"{' + '.join(f'size({{{p}}})' for p in sets)} <= {FEW}"
            least = ", ".join(f"array_min({{{p}}})" for p in sets)
            most = ", ".join(f"array_max({{{p}}})" for p in sets)
            out |= {"few": most_few, "low": f"least({least}, 2147483647)", "high": f"greatest({most}, 0)"}
            out |= {f"w{o}": f"if({{few}} or {{high}} < {{low}}, cast(array() as array<bigint>), {bits.words_sql(f'{{p{o}}}', '{low}', 'greatest({high}, {low})')})" for o in ords}
        return out

    def cells(self) -> str:
        lags, ords, length, offset, _, dense = self._known()
        lag_array = f"array({', '.join(map(str, sorted(set(lags))))})"
        out = [f"filter(array({cell(a='-1')}), z -> qlen >= {length + offset})"]
        for a in ords:
            for b in (b for b in ords if a <= b):
                sizes = f"size({{p{a}}})", f"size({{p{b}}})"
                some = f"filter({lag_array}, g -> {sizes[0]} > 0 and {sizes[1]} > 0)"
                hits = f"size(array_intersect(transform({{p{a}}}, v -> v + g), {{p{b}}}))"
                if dense is None or dense:
                    hits = f"if({{few}}, {hits}, {bits.lag_matches_sql(f'{{w{a}}}', f'{{w{b}}}', 'g')})"
                found = f"filter(transform({some}, g -> struct(g as g, {hits} as n)), h -> h.n > 0)"
                each = cell(a=str(a), b=str(b), c="h.g", x=f"h.n / sqrt(double({sizes[0]}) * {sizes[1]})")
                out.append(f"transform({found}, h -> {each})")
        return f"concat({', '.join(out)})"

    def counter(self):
        lags, ords, length, offset, thresh, _ = self._known()

        def count(reads: Reads) -> Iterator[dict]:
            long = reads.qlen >= length + offset
            yield from tallied([int(long.sum())], a=-1)
            ordinal = np.full(len(reads.mods), -1)
            for o in ords:
                if (i := reads.number(MODS[o])) >= 0:
                    ordinal[i] = o
            some = (reads.prob > thresh) & (reads.pos >= offset) & (reads.pos < offset + length) & long[reads.row] & (ordinal[reads.mod] >= 0)
            (row, pos, o), _, _ = tally([reads.row[some], reads.pos[some], ordinal[reads.mod[some]]])  # distinct, and sorted
            (a, b, lag), n, (x,) = _lag_hits(row, pos, o, lags, reads.n)
            yield from tallied(n, a=a, b=b, c=lag, x=x)

        return count

    def finish(self, cells: DataFrame, rel: Relations) -> DataFrame:
        lags, ords, *_ = self._known()
        sums = cells.where("a >= 0").select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("c").cast("int").alias("lag"), F.col("x").alias("s"))
        eligible = cells.where("a < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
        lag_list = lags if self.options.get("duplicate_lags") else sorted(set(lags))
        return _finish(cells.sparkSession, sums, eligible, ords, lag_list)

    def plot(self, result: DataFrame) -> str:
        pair = F.concat_ws(" ", F.regexp_replace("ModA", "mod_", ""), F.regexp_replace("ModB", "mod_", ""))
        return svg.lines(result.withColumn("pair", pair), "Lag", "CrossCor", "pair")
