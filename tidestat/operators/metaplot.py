"""Region-centred profiles: the interval join of calls with windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidestat.functions.dense import densify
from tidestat.functions.loess import curve
from tidestat.functions.tally import Reads, tally, whole
from tidestat.functions.tally import cells as tallied
from tidestat.operators.sweep import pile, sweep_sums
from tidestat.plans import svg
from tidestat.registry import Stat, cell, register
from tidestat.schema import CONFIDENT
from tidestat.sources import regions as region_source
from tidestat.sources.relations import Relations
from tidestat.sources.shared import stored

#: Regions up to this many rows go to every executor; beyond it the binned join shuffles both sides.
BROADCAST_REGIONS = 200_000


# The smooth layer's share of points in a fit, degree and number of points.
SPAN, DEGREE, POINTS = 0.05, 4, 3000
#: Windows whose widths differ by more than this factor are joined by a sweep.
MIXED = 16
#: Where a bin with windows has more than so many of them, calls are added up by place before they meet windows.
CROWDED = 2


def bin_width(regions: DataFrame) -> int:
    """A power of two near the mean window width, from one small aggregate."""
    return _widths(regions)[0]


def _widths(regions: DataFrame) -> tuple[int, bool]:
    """The bin width, and whether the widths are too different for bins."""
    size = F.col("stop") - F.col("start") + 1
    mean, least, most = regions.agg(F.avg(size), F.min(size), F.max(size)).first()
    return 1 << max(6, min(20, round(mean or 1.0).bit_length())), (most or 1) > MIXED * max(1, least or 1)


def interval_join(points: DataFrame, regions: DataFrame, at: str = "gpos", key: str = "tid", width: int | None = None) -> DataFrame:
    """points x regions with start <= at <= stop on one contig, each pair once.

    Windows are listed under each bin of the contig that they touch and a point under its one bin, so the
    join is an equi-join on (contig, bin) with a short residual; a dense contig spreads over its bins.
    """
    width = width or bin_width(regions)
    binned, small = _binned(regions, width)
    if small:
        binned = F.broadcast(binned)
    keyed = points.where(F.col(at).isNotNull()).withColumn("_bin", F.floor(F.col(at) / width))
    return keyed.join(binned, [key, "_bin"]).where(F.col(at).between(F.col("start"), F.col("stop"))).drop("_bin")


def _binned(regions: DataFrame, width: int) -> tuple[DataFrame, bool]:
    """Windows under each bin that they touch, and whether these are few enough to broadcast."""
    binned = regions.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    return binned, binned.limit(BROADCAST_REGIONS + 1).count() <= BROADCAST_REGIONS


def _crowded(binned: DataFrame) -> bool:
    """Whether a bin with windows has more than CROWDED of them on average."""
    mean = binned.groupBy("tid", "_bin").count().agg(F.avg("count")).first()[0]
    return (mean or 0) > CROWDED


def swept(regions: DataFrame, few: bool = False) -> bool:
    """Whether calls are added up by place and swept rather than joined by bins: windows of very different widths, or over each other
    (each call would meet all of them). few: also where windows are too many for a broadcast."""
    width, mixed = _widths(regions)
    if mixed:
        return True
    binned, small = _binned(regions, width)
    return (few and not small) or _crowded(binned)


def interval_overlap(reads: DataFrame, regions: DataFrame, width: int = 1 << 14) -> DataFrame:
    """read_id, group, regionindex of reads whose span (left0 + 1 .. right1) overlaps a window, each pair once.

    Both sides are listed under the bins that they touch; a pair is kept only in the first bin that both touch.
    """
    lo, hi = F.col("left0") + 1, F.col("right1")
    a = reads.select("read_id", "tid", lo.alias("lo"), hi.alias("hi")).withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.greatest("hi", "lo") / width)))
    )
    b = regions.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width)))
    )
    if b.limit(BROADCAST_REGIONS + 1).count() <= BROADCAST_REGIONS:
        b = F.broadcast(b)
    first = F.floor(F.greatest("lo", "start") / width)
    return (
        a.join(b, ["tid", "_bin"])
        .where((F.col("start") <= F.col("hi")) & (F.col("stop") >= F.col("lo")) & (F.col("_bin") == first))
        .select("read_id", "group", "regionindex")
    )


def _xp():
    """The place in a window, mirrored on minus strands."""
    return (F.when(F.col("strand"), F.col("gpos") - F.col("start")).otherwise(F.col("stop") - F.col("gpos")) - F.col("dw")).cast("int")


def profile_counts(mod_calls: DataFrame, regions: DataFrame, thresh: float = CONFIDENT, sweep: bool | None = None) -> DataFrame:
    """group, Region, dw, Mod, xp, FG, BG: the observed part of metaplot, one join and one aggregation.

    sweep: join by the sorted sweep, over calls added up by place; by default where window widths are very different or windows lie over each other.
    """
    if swept(regions) if sweep is None else sweep:
        return piled_counts(pile(mod_calls, thresh), regions)
    return (
        interval_join(mod_calls.select("tid", "gpos", "mod", "prob"), regions)
        .groupBy("group", F.col("label").alias("Region"), "dw", F.col("mod").alias("Mod"), _xp().alias("xp"))
        .agg(F.count_if(F.col("prob") > thresh).alias("FG"), F.count("*").alias("BG"))
    )


def piled_counts(piled: DataFrame, regions: DataFrame) -> DataFrame:
    """profile_counts of calls that are added up by place (sweep.pile)."""
    met = sweep_sums(piled, regions)
    by = met.groupBy("group", F.col("label").alias("Region"), "dw", F.col("mod").alias("Mod"), (F.col("i") - F.col("dw")).cast("int").alias("xp"))
    return by.agg(F.sum("FG").alias("FG"), F.sum("BG").alias("BG"))


def metaplot(mod_calls: DataFrame, regions: DataFrame, thresh: float = CONFIDENT, sweep: bool | None = None) -> DataFrame:
    """Region, Mod, xp (-dw..dw), FG (confident calls), BG (all calls): dense for each observed (Region, Mod).

    A call inside several windows counts once for each; minus strands are mirrored.
    """
    sweep = swept(regions) if sweep is None else sweep
    counts = profile_counts(mod_calls, regions, thresh, sweep)
    return dense_profile(_kept(counts) if sweep else counts)


def _kept(counts: DataFrame) -> DataFrame:
    """profile_counts as a table: results read them more than once, and are swept once."""
    return counts.sparkSession.read.schema(counts.schema).parquet(stored(counts, "profiles"))


def dense_profile(counts: DataFrame) -> DataFrame:
    """metaplot from profile_counts."""
    dim = counts.select("group", "Region", "dw", "Mod").distinct()
    full = dim.withColumn("xp", F.explode(F.sequence(-F.col("dw"), F.col("dw"))))
    return (
        densify(counts.drop("dw"), full, ["group", "Region", "Mod", "xp"], ["FG", "BG"])
        .orderBy("group", "Mod", "xp")
        .select("Region", "Mod", "xp", "FG", "BG")
    )


def metaplot_zscore(profile: DataFrame) -> DataFrame:
    """profile with R = FG / BG (null where BG = 0) and its z-score z within (Region, Mod), sample deviation."""
    part = Window.partitionBy("Region", "Mod")
    r = profile.withColumn("R", F.try_divide(F.col("FG"), F.col("BG")))
    return r.withColumn("z", F.try_divide(F.col("R") - F.avg("R").over(part), F.stddev_samp("R").over(part)))


def loess(
    profile: DataFrame, x: str = "xp", y: str = "R", by: tuple[str, ...] = ("Region", "Mod"), span: float = SPAN, degree: int = DEGREE, points: int = POINTS
) -> DataFrame:
    """by..., x (double), smooth: a local polynomial regression of each profile, at `points` places of its axis.

    A profile is one group: 2 * dw + 1 points at most, whatever the calls. Places without a value (null, NaN) are left out.
    """

    def fit(group: pa.Table) -> pa.Table:
        xs, ys = (np.array([np.nan if v is None else v for v in group[c].to_pylist()], float) for c in (x, y))
        some = np.flatnonzero(~np.isnan(xs) & ~np.isnan(ys))
        some = some[np.argsort(xs[some], kind="stable")]
        grid, smooth = curve(xs[some], ys[some], span, degree, points)
        return pa.table({**{c: pa.array([group[c][0].as_py()] * len(grid), group.schema.field(c).type) for c in by}, x: grid, "smooth": smooth})

    fields = ", ".join(f"`{c}` {profile.schema[c].dataType.simpleString()}" for c in by)
    return profile.select(*by, x, y).groupBy(*by).applyInArrow(fit, f"{fields}, `{x}` double, smooth double")


@register
class MetaPlot(Stat):
    name, title, file, grain = "MetaPlot", "Modifications around regions", "metaplot.tsv.gz", "mod"
    columns = ("tid", "mods")
    schema = "Region string, Mod string, xp int, FG long, BG long"

    def compute(self, rel: Relations) -> DataFrame:
        return metaplot(rel.mod_calls, self._regions(rel))

    def call_cell(self) -> str:
        return f"if(gpos is not null and tid is not null, {cell(s='mod', a='tid', b='gpos', m=f'int(prob > {CONFIDENT!r}D)')}, null)"

    def counter(self):
        def count(reads: Reads) -> Iterator[dict]:
            tid, gpos = reads.batch["tid"], reads.calls["gpos"]
            some = pc.is_valid(gpos).to_numpy(zero_copy_only=False) & pc.is_valid(tid).to_numpy(zero_copy_only=False)[reads.row]
            columns = [whole(tid, 0)[reads.row[some]], whole(gpos, 0)[some], reads.mod[some]]
            (a, b, mod), n, (m,) = tally(columns, reads.prob[some] > CONFIDENT)
            yield from tallied(n, s=pa.array(reads.mods, pa.string()).take(pa.array(mod)), a=a, b=b, m=m)

        return count

    def place(self, cells: DataFrame, tag: int, rel: Relations) -> DataFrame:
        """Calls (contig, place) become profile cells (group, place in the window) where the regions fit into a broadcast and lie side by side;
        else they stay, are added up by place with all other cells, and are swept afterwards: calls times windows over each other would be made."""
        if self._swept(rel):
            return cells
        regions = self._regions(rel)
        binned, _ = _binned(regions.select("tid", "start", "stop", "strand", "group", "dw"), width := bin_width(regions))
        mine = F.col("tag") == tag
        keyed = cells.withColumns({"_tid": F.when(mine, F.col("a").cast("int")), "_at": F.when(mine, F.floor(F.col("b") / width))})
        near = binned.select(F.col("tid").alias("_rtid"), F.col("_bin").alias("_rbin"), "start", "stop", "strand", "group", "dw")
        met = keyed.join(F.broadcast(near), (F.col("_tid") == F.col("_rtid")) & (F.col("_at") == F.col("_rbin")), "left")
        met = met.where(~mine | F.col("b").between(F.col("start"), F.col("stop"))).withColumn("gpos", F.col("b"))
        a, b = F.when(mine, F.col("group").cast("long")).otherwise(F.col("a")), F.when(mine, _xp().cast("long")).otherwise(F.col("b"))
        return met.select("tag", "s", a.alias("a"), b.alias("b"), "c", "n", "m", "x")

    def finish(self, cells: DataFrame, rel: Relations) -> DataFrame:
        regions = self._regions(rel)
        if self._swept(rel):
            piled = cells.select(F.col("a").cast("int").alias("tid"), F.col("b").alias("gpos"), F.col("s").alias("mod"), F.col("m").alias("FG"), F.col("n").alias("BG"))
            return dense_profile(_kept(piled_counts(piled, regions)))
        labels = regions.select("group", F.col("label").alias("Region"), "dw").distinct()
        counts = cells.select(F.col("a").cast("int").alias("group"), F.col("s").alias("Mod"), F.col("b").cast("int").alias("xp"), F.col("m").alias("FG"), F.col("n").alias("BG"))
        return dense_profile(counts.join(F.broadcast(labels), "group"))  # a row for each region file

    def _swept(self, rel: Relations) -> bool:
        """Whether calls are added up by place and swept, rather than placed in windows as they come; found once."""
        if not hasattr(self, "_piled"):
            self._piled = swept(self._regions(rel), few=True)
        return self._piled

    def _regions(self, rel: Relations) -> DataFrame:
        files = self.options.get("config")
        spark = rel.reads.sparkSession
        raw = region_source.load_many(spark, files) if files else rel.regions
        if raw is None:
            raise ValueError("MetaPlot needs region files in its configuration, or regions in the relations")
        return raw if "tid" in raw.columns else region_source.to_tid(raw, rel.contigs)

    def plot_data(self, result: DataFrame) -> DataFrame:
        return metaplot_zscore(result)

    def plot(self, result: DataFrame) -> str:
        smooth = loess(self.plot_data(result), y="z")
        return svg.lines(smooth.select("xp", F.col("smooth").alias("z"), F.concat_ws(" ", "Region", "Mod").alias("line")), "xp", "z", "line")
