"""The shared pass, adaptive histograms, running sums and the sweep, each against the plain way."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import tidestat.operators  # noqa: F401
from tidestat.functions import khist
from tidestat.functions.prefix import numbered, running
from tidestat.operators import crosscor, metaplot, rates
from tidestat.operators.sweep import pile, sweep_join, sweep_sums
from tidestat.plans.fused import CELLS, added, emitted, fused, results, sums
from tidestat.registry import Stat, stats
from tidestat.schema import CONTIGS, MODS, READS
from tidestat.sources import regions
from tidestat.sources.relations import Relations

NINE = ["ChromStat", "ReadLengthCounter", "ModHist", "ModMetaHist", "ModRate", "NucMSPRate", "NucMSPLenHist", "ModCrossCor", "MetaPlot"]
REGION = "tid int, start long, stop long, strand boolean, regionindex long, group int, label string, dw long"


def random_reads(rng, n=60):
    rows = []
    for i in range(n):
        qlen = rng.choice([0, 10, 700, 1204, 2500])
        calls = [
            dict(pos=rng.randint(1, max(1, qlen)), mod=rng.choice([*MODS, "mod_other"]), prob=rng.choice([0, 229, 230, 255]), gpos=rng.choice([None, rng.randint(1, 3000)]))
            for _ in range(rng.choice([0, 3, 40]))
        ]
        mods = None if i % 11 == 0 else calls
        rows.append((i, rng.choice([0, 1, 2, -1]), qlen, 5, 5 + qlen, mods, [rng.randint(0, 1100) for _ in range(i % 4)] if i % 7 else None, [3, 3]))
    return rows


def random_regions(rng, n=40, wide=()):
    out = []
    for i in range(n):
        dw = rng.choice([5, 20, *wide])
        mid = rng.randint(-10, 3000)
        g = 1 + (dw > 10) + (dw > 100)
        out.append((rng.choice([0, 1, 7]), mid - dw, mid + dw, rng.random() < 0.5, i, g, f"g{g}", dw))
    return [(t, s, e, x, i, g, f"{lab}-{dw}", dw) for t, s, e, x, i, g, lab, dw in out]


@pytest.fixture(scope="module")
def rel(spark, tmp_path_factory):
    rng = random.Random(4)
    path = str(tmp_path_factory.mktemp("reads") / "reads")
    spark.createDataFrame(random_reads(rng), READS).repartition(3).write.parquet(path)
    contigs = spark.createDataFrame([(0, "chr10"), (1, "chr2"), (2, "chrX")], CONTIGS)
    regs = spark.createDataFrame([r for r in random_regions(rng) if r[5] < 3], REGION)
    # one label and width a group
    regs = regs.withColumns({"group": F.when(F.col("dw") == 5, 1).otherwise(2), "label": F.concat(F.lit("w"), F.col("dw"))})
    return Relations(spark.read.schema(READS).parquet(path), contigs, regs.coalesce(1))


def plain(df):
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(value(v) for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("piled", [False, True])
@pytest.mark.parametrize("dense", [True, False, None])
def test_one_pass_equals_nine(rel, monkeypatch, piled, dense):
    monkeypatch.setattr(crosscor, "FEW", 3)  # some reads by sets, some by words
    if piled:
        monkeypatch.setattr(metaplot, "BROADCAST_REGIONS", 0)
    chosen = stats(NINE, {"ModCrossCor": {"dense": dense} if dense is not None else {}, "ModMetaHist": {"n": 50}})
    out = fused(chosen, rel)
    for s in chosen:
        got, want = out[s.name], s.compute(rel)
        assert got.columns == want.columns and plain(got) == plain(want), s.name
    out.cells.unpersist()


def test_one_scan(rel):
    plan = added(emitted(stats(NINE), rel))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_crowded_windows_do_not_multiply_calls(rel, spark):
    """Thirty windows over each other: a call stays one cell of the shared pass, and the profile is that of all pairs."""
    rows = [(t, 900 + i - 500, 900 + i + 500, i % 2 == 0, i, 1, "w", 500) for t in (0, 1) for i in range(30)]
    crowded = Relations(rel.reads, rel.contigs, spark.createDataFrame(rows, REGION))
    chosen = stats(["MetaPlot"])
    calls = crowded.mod_calls.where("gpos is not null and tid is not null").count()
    assert emitted(chosen, crowded).count() == calls
    out = fused(chosen, crowded)
    want = chosen[0].compute(crowded)
    assert plain(out["MetaPlot"]) == plain(want) and want.agg(F.sum("BG")).first()[0] > 3 * calls
    out.cells.unpersist()


def test_crowded_profile_makes_no_pairs(rel, spark, monkeypatch):
    """Two hundred windows over each other: the profile alone adds calls up by place, and joins none of them with windows."""
    rows = [(t, 900 + i - 50, 900 + i + 50, i % 2 == 0, i, 1, "w", 50) for t in (0, 1) for i in range(200)]
    regs = spark.createDataFrame(rows, REGION)
    want = metaplot.metaplot_zscore(metaplot.metaplot(rel.mod_calls, regs, sweep=False))

    def forbidden(*_, **__):
        raise AssertionError("each call met each window over it")

    monkeypatch.setattr(metaplot, "interval_join", forbidden)
    got = metaplot.metaplot_zscore(metaplot.metaplot(rel.mod_calls, regs))
    assert got.columns == want.columns and plain(got) == plain(want) and len(plain(want)) > 101


def test_batches_count_what_cells_say(rel, spark):
    """The shared pass counts a batch of reads at once: the same cells as by SQL, for odd reads and options too, and no cell for each call."""
    odd = [
        (900, None, None, 5, 5, [dict(pos=None, mod="mod_6mA", prob=255, gpos=7)], None, [None, 3]),
        (901, 1, 2500, 5, 5, [dict(pos=200, mod=None, prob=None, gpos=8), dict(pos=200, mod="mod_5mC", prob=240, gpos=1 << 61), None], [], None),
        (902, None, 1300, 5, 5, [dict(pos=p, mod=m, prob=250, gpos=None) for p in (180, 180, 190, 460, 1203, 1204) for m in MODS], [0, 1000, 1001], [1]),
    ]
    whole = Relations(rel.reads.unionByName(spark.createDataFrame(odd, READS)), rel.contigs, rel.regions)
    config = {"ModCrossCor": {"lags": [1, 3, 270, 10, 10], "mods": ["mod_6mA", "mod_5mC"], "length": 1100, "offset": 100}, "ModMetaHist": {"n": 7, "thresh": 100}, "ModRate": {"mods": ["mod_other", "mod_6mA", "none"]}}
    for chosen in (stats(NINE), stats(NINE, config)):
        by_sql, by_batch = (results(chosen, cells(chosen, whole).persist(), whole) for cells in (lambda s, r: added(emitted(s, r)), sums))
        for s in chosen:
            assert plain(by_batch[s.name]) == plain(by_sql[s.name]), s.name
    plan = sums(chosen, whole)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "inline" not in plan
    spark.catalog.clearCache()
    assert sums(chosen, Relations(whole.reads.where("false"), rel.contigs, rel.regions)).schema.names == [c.split()[0] for c in CELLS.split(", ")]


def test_lag_hits_of_crowded_reads():
    rng = random.Random(6)
    reads = [{(rng.randint(1, 60), rng.randint(0, 2)) for _ in range(rng.choice([0, 1, 90]))} for _ in range(12)]
    rows = sorted((r, p, o) for r, some in enumerate(reads) for p, o in some)
    want = {}
    for some in reads:
        size = [sum(o == k for _, o in some) for k in range(3)]
        for p, a in some:
            for q, b in some:
                if a <= b and q - p in (1, 4, 20):
                    n, x = want.get((a, b, q - p), (0, 0.0))
                    want[a, b, q - p] = n + 1, x + 1 / math.sqrt(size[a] * size[b])
    keys, n, (x,) = crosscor._lag_hits(*np.array(rows).T, [1, 4, 20], len(reads))
    got = {tuple(map(int, k)): (int(m), v) for *k, m, v in zip(*keys, n, x, strict=True)}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_some_statistics_and_parts_added_up(rel):
    chosen = stats(["ReadLengthCounter", "NucMSPLenHist"])  # no calls
    assert plain(results(chosen, added(emitted(chosen, rel)), rel)["ReadLengthCounter"]) == plain(chosen[0].compute(rel))
    chosen = stats(["ModMetaHist", "ModRate", "ModCrossCor"])
    halves = [Relations(rel.reads.where(f"read_id % 2 = {i}"), rel.contigs) for i in (0, 1)]
    both = added(added(emitted(chosen, halves[0])).unionByName(added(emitted(chosen, halves[1])))).persist()
    for s in chosen:
        assert plain(results(chosen, both, rel)[s.name]) == plain(s.compute(rel))
    both.unpersist()
    empty = Relations(rel.reads.where("false"), rel.contigs, rel.regions)
    out = fused(stats(NINE), empty)
    assert out["ModHist"].count() == 256 and out["MetaPlot"].count() == 0 and out["ModRate"].count() == 0
    out.cells.unpersist()


def test_runner_takes_one_pass(rel, tmp_path, spark, monkeypatch):
    import tidestat
    from tidestat.registry import REGISTRY, register
    from tidestat.sources.config import StatConfig

    def forbidden(self, rel):
        raise AssertionError("computed alone")

    for n in NINE:
        monkeypatch.setattr(REGISTRY[n], "compute", forbidden)

    @register
    class Longest(Stat):
        name, title, file, schema = "Longest", "Longest read", "longest.tsv", "qlen long"

        def compute(self, rel):
            return rel.reads.agg(F.max("qlen").alias("qlen"))

    try:
        saved = tidestat.run_stats(rel, str(tmp_path / "S/stats"), StatConfig((*NINE, "Longest"), {}))
    finally:
        del REGISTRY["Longest"]
    assert saved.stats["Longest"].first()[0] == 2500 and saved.stats["ReadLengthCounter"].agg(F.sum("count")).first()[0] == 60
    assert saved.stats["MetaPlot"].count() > 0 and not spark.sparkContext._jsc.getPersistentRDDs()


# adaptive histograms


def nearest_merged(values, bins):
    s, n = [a for a, _ in values], [b for _, b in values]
    while len(s) > bins:
        gaps = [s[i + 1] / n[i + 1] - s[i] / n[i] for i in range(len(s) - 1)]
        j = gaps.index(min(gaps))
        s[j : j + 2], n[j : j + 2] = [s[j] + s[j + 1]], [n[j] + n[j + 1]]
    return s, n


def test_merging_order():
    rng = random.Random(2)
    for size in (0, 1, 5, 60, 200):
        for spread in (300, 10**9):
            keys = sorted(rng.sample(range(spread), size))
            values = [(k * w, w) for k, w in zip(keys, [rng.randint(1, 9) for _ in keys])]
            for bins in (1, 7, 60):
                assert khist.merged([a for a, _ in values], [b for _, b in values], bins) == nearest_merged(values, bins)


def test_khist_knows_no_partitions(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randint(0, 3000) / rng.randint(1000, 9000)) for _ in range(4000)]
    want = None
    for parts in (1, 3, 200):
        df = spark.createDataFrame(rows, "k string, rate double").repartition(parts)
        for most in (khist.MOST, 100):
            got = plain(khist.khist(df.groupBy("k", "rate").agg(F.count("*").alias("n")), "k", "rate", "n", "count", 150, most))
            assert sum(r[2] for r in got) == 4000 and sum(r[0] == "a" for r in got) == 150
            if most != 100:
                want = want or got
                assert got == want
    mean = sum(x for k, x in rows if k == "a") / sum(k == "a" for k, _ in rows)
    assert sum(r[1] * r[2] for r in want if r[0] == "a") / sum(r[2] for r in want if r[0] == "a") == pytest.approx(mean)


def test_khist_cells_keep_weight_and_mean(spark):
    """A group of more values than a task may merge is cut to cells first: the same for any partitioning, exact sums."""
    df = spark.range(5000).selectExpr("'k' as k", "id / 7919.0D as rate", "1 as n")
    one, many = (plain(khist.khist(df.repartition(p), "k", "rate", "n", "count", 20, 1000)) for p in (1, 50))
    assert one == many and len(one) == 20 and sum(r[2] for r in one) == 5000
    assert sum(r[1] * r[2] for r in one) / 5000 == pytest.approx(2499.5 / 7919)


# running sums


def test_running_sums(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), x, rng.randint(1, 5)) for x in rng.sample(range(-10**6, 10**6), 900)] + [("one", 5, 2), (None, None, 3)]
    df = spark.createDataFrame(rows, "k string, x long, w long").repartition(5)
    for by in (["k"], []):
        for down in (False, True):
            order = F.col("x").desc() if down else F.col("x").asc()
            some = df if by else df.where("x is not null")
            w = Window.partitionBy(*by).orderBy(order)
            want = some.select("*", F.sum("w").over(w).alias("s"), F.lag("x").over(w).alias("px"))
            got = running(some, by, "x", {"s": "w"}, before="px", descending=down, n=16)
            assert plain(got) == plain(want)


def test_no_task_sees_a_whole_group(spark):
    df = spark.range(3000).selectExpr("id % 3 as k", "cast(id * id as double) as x", "1L as w")
    plan = running(df, ["k"], "x", {"s": "w"})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("hashpartitioning(k") >= 1
    assert all("_bucket" in line for line in plan.split("\n") if line.strip(" +-:").startswith("Window"))


def test_row_numbers_over_many_splits(spark, tmp_path):
    n = 5000
    (tmp_path / "r.csv").write_text("chrom,start,stop\n" + "".join(f"chr1,{i * 10},{i * 10 + 7}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = regions.load(spark, str(tmp_path / "r.csv"), dw=3)
        assert spark.read.csv(str(tmp_path / "r.csv")).rdd.getNumPartitions() > 3
        got = {r.regionindex: r.start for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {i + 1: (i * 10 + 1 + i * 10 + 7) // 2 - 3 for i in range(n)}


def test_numbered_blocks(spark):
    df = spark.createDataFrame([(b, p) for b in (30, 10, 20) for p in (5, 1, 9)], "b int, p int")
    got = [(r.b, r.p) for r in sorted(numbered(df, "b", "p", "n").collect(), key=lambda r: r.n)]
    assert got == sorted(got) and len(got) == 9


# the sweep


@pytest.mark.parametrize("tile", [4096, 1 << 20])
def test_sweep_equals_bins(spark, tile):
    rng = random.Random(tile)
    points = spark.createDataFrame(
        [(rng.choice([0, 1, None]), rng.choice([None, rng.randint(-50, 3000)]), rng.choice(MODS), rng.choice([1, 255])) for _ in range(700)], "tid int, gpos long, mod string, prob int"
    )
    regs = spark.createDataFrame(random_regions(rng, 60, wide=(1000, 500_000)), REGION).repartition(3)
    want = metaplot.interval_join(points.where("tid is not null"), regs)
    got = sweep_join(points, regs, tile=tile)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want.select(*got.columns)) and want.count() > 700
    for batch in (7,):  # windows stay active from batch to batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert plain(sweep_join(points, regs, tile=tile)) == plain(got)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts = [plain(metaplot.profile_counts(points, regs, sweep=s)) for s in (True, False, None)]
    assert counts[0] == counts[1] == counts[2]
    assert sweep_join(points.where("false"), regs).count() == 0 and sweep_join(points, regs.where("false")).count() == 0


def test_sweep_lists_a_window_once_a_tile(spark):
    """Widths of ten to a million: no window is listed for each bin of the narrow ones."""
    regs = spark.createDataFrame([(0, 10, 20, True, 1, 1, "n", 5), (0, 1, 1_000_001, True, 2, 2, "w", 500_000)], REGION)
    points = spark.range(0, 900_000, 1000).selectExpr("0 as tid", "id + 1 as gpos", "'m' as mod", "255 as prob")
    met = sweep_join(pile(points, 229.5), regs)
    assert met.groupBy("label").count().collect() == [("w", 900)]
    events = met._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in events and math.ceil(1_000_001 / (1 << 20)) == 1


def test_no_pair_leaves_the_sweep(spark):
    """900,000 pairs of calls and windows leave their tasks as the places of a window, whatever the number of windows."""
    points = pile(spark.range(3000).selectExpr("0 as tid", "id + 1 as gpos", "if(id % 3 = 0, 'm', null) as mod", "int(id % 256) as prob"), 229.5)
    regs = spark.range(300).selectExpr("0 as tid", "id - 2000L as start", "id + 4000L as stop", "id % 2 = 0 as strand", "id as regionindex", "1 as `group`", "'w' as label", "3000L as dw").repartition(2)
    by = points.join(regs, "tid").where("gpos between start and stop").selectExpr("mod", "if(strand, gpos - start, stop - gpos) as i", "FG", "BG")
    want = by.groupBy("mod", "i").agg(F.sum("FG"), F.sum("BG"))
    for tile, block, blocks, most in ((1 << 20, 4096, 1024, 2 * 6001), (1000, 64, 1024, 8 * 6001), (1 << 20, 700, 5, 900_000)):
        got = sweep_sums(points, regs, tile=tile, block=block, blocks=blocks).persist()
        assert got.count() <= most and got.where("i < 0 or i > 6000 or label <> 'w' or dw <> 3000").count() == 0
        assert plain(got.groupBy("mod", "i").agg(F.sum("FG"), F.sum("BG"))) == plain(want)
        got.unpersist()


def test_rates_in_the_row_equal_the_calls(rel):
    """Per-read rates of nested calls against calls counted by read."""
    mods = {m: i for i, m in enumerate(MODS)}
    got = sorted((r.mod, round(r.rate, 9)) for r in rates.mod_rates(rel.reads).collect())
    want = [(m, round(sum(c.mod == m and c.prob >= 230 for c in r.mods or []) / r.qlen, 9)) for r in rel.reads.collect() if r.qlen for m in mods]
    assert got == sorted(want)
