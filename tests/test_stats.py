"""Statistics on hand-made reads: the edge cases of each, against values worked out by hand or by a plain loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

import tidestat
from tidestat.functions import bits
from tidestat.functions.contigs import contig_order
from tidestat.functions.weighted import n50, weighted_quantiles
from tidestat.operators import crosscor, metaplot, modhist, rates, reads, summary
from tidestat.registry import REGISTRY, Stat, register, stat_title, stats
from tidestat.schema import CONTIGS, MODS, READS
from tidestat.sources import config, regions
from tidestat.sources.relations import Relations

A, B, C = MODS


def read(i, qlen=2000, tid=0, left=0, mods=(), nuc=(), msp=()):
    calls = [dict(pos=p, mod=m, prob=q, gpos=g) for p, m, q, g in mods]
    return (i, tid, qlen, left, left + qlen, calls, list(nuc), list(msp))


@pytest.fixture(scope="module")
def make(spark):
    contigs = spark.createDataFrame([(0, "chr10"), (1, "chr2"), (2, "chrX"), (3, "chr1_random")], CONTIGS)

    def relations(*rows):
        return Relations(spark.createDataFrame(list(rows), READS), contigs)

    return relations


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_contig_order_and_unmapped(make):
    r = make(*[read(i, tid=t) for i, t in enumerate([3, 2, 0, 1, 1, -1])])
    assert rows(reads.chrom_counts(r.reads, r.contigs)) == [("chr2", 2), ("chr10", 1), ("chrX", 1), ("chr1_random", 1), ("*", 1)]


def test_contig_order_names(spark):
    names = ["chr1_random", "chrX", "chr10", "chrM", "chr2", "chrUn_k1", "chr1"]
    df = spark.createDataFrame(list(enumerate(names)), "tid int, chrom string").orderBy(*contig_order())
    assert [r.chrom for r in df.collect()] == ["chr1", "chr2", "chr10", "chrX", "chrM", "chr1_random", "chrUn_k1"]


def test_lengths_and_limit(make):
    r = make(read(5, 10), read(1, 20), read(3, 10))
    assert rows(reads.read_length_hist(r.reads)) == [(10, 2), (20, 1)]
    assert sorted(x.read_id for x in r.limit(2).reads.collect()) == [1, 3]
    assert r.limit(-1) is r and r.limit(None) is r
    with pytest.raises(ValueError):
        r.limit(0)


def test_feature_lengths_are_dense(make):
    out = reads.feature_length_hist(make(read(1, nuc=[0, 1, 1000, 1001], msp=[5, 5])))
    assert out.count() == 2000
    assert {tuple(r) for r in out.where("Count > 0").collect()} == {("nuc", 1, 1), ("nuc", 1000, 1), ("msp", 5, 2)}


def test_mod_hist_counts_duplicates(make):
    r = make(read(1, mods=[(3, A, 200, None), (3, A, 200, None), (4, B, 255, 9)]))
    hist = modhist.mod_hist(r.mod_calls)
    assert hist.count() == 256
    got = {x.ml: (x[A], x[B], x[C]) for x in hist.where(f"{A} + {B} + {C} > 0").collect()}
    assert got == {200: (2, 0, 0), 255: (0, 1, 0)}
    assert modhist.observed(hist) == [A, B]
    assert tidestat.REGISTRY["ModHist"]().compute(r).columns == ["ml", "prob", A, B]


def test_confident_is_230(make):
    r = make(read(1, 100, mods=[(1, A, 229, None), (50, A, 230, None), (100, A, 255, None)]))
    got = {(x.mod, round(x.bin * 999) + 1): x["count"] for x in modhist.mod_meta_hist(r.mod_calls).where("count > 0").collect()}
    assert got == {(A, 500): 1, (A, 1000): 1}


def test_tiny_position_is_bin_one(make):
    r = make(read(1, 100_000, mods=[(1, A, 255, None)]))
    out = modhist.mod_meta_hist(r.mod_calls)
    assert out.count() == 1000 and out.where("count > 0").first().bin == 0


def test_rates_include_zeros_and_skip_empty_reads(make):
    r = make(read(1, 100, mods=[(1, A, 255, None), (2, A, 10, None)]), read(2, 50), read(3, 0))
    got = {tuple(x) for x in rates.exact_hist(rates.mod_rates(r.reads), "mod", "rate", "count").collect()}
    assert got == {(A, 0.01, 1), (A, 0.0, 1), (B, 0.0, 2), (C, 0.0, 2)}
    f = {tuple(x) for x in rates.feature_rates(make(read(1, 10, nuc=[1, 2])).reads).collect()}
    assert f == {("nuc", 0.2), ("msp", 0.0)}


def test_khist_is_exact_below_its_bins(make):
    r = make(*[read(i, 100, nuc=[1] * (i % 5)) for i in range(50)])
    got = {(x.Feature, round(x.Rate, 9)): x.Count for x in rates.khist(rates.feature_rates(r.reads), "Feature", "Rate", "Count").collect()}
    assert got == {("nuc", k / 100): 10.0 for k in range(5)} | {("msp", 0.0): 50.0}


def brute_crosscor(table, lags, length=1024, offset=180):
    total, t = {}, 0
    for qlen, calls in table:
        if qlen < length + offset:
            continue
        t += 1
        at = {m: {p for p, n, q in calls if n == m and q >= 230 and offset <= p <= offset + length - 1} for m in MODS}
        for i, a in enumerate(MODS):
            for b in MODS[i:]:
                if at[a] and at[b]:
                    for g in lags:
                        hit = sum(p + g in at[b] for p in at[a]) / math.sqrt(len(at[a]) * len(at[b]))
                        total[a, b, g] = total.get((a, b, g), 0) + hit
    return {(a, b, g): total.get((a, b, g), 0) / t for i, a in enumerate(MODS) for b in MODS[i:] for g in lags}


def test_crosscor_against_a_loop(make):
    rng = random.Random(1)
    table = [(q, [(rng.randint(150, 1300), rng.choice(MODS), rng.choice([10, 229, 230, 255])) for _ in range(300)]) for q in (1203, 1204, 3000, 1500)]
    table += [(5000, []), (1204, [(179, A, 255), (180, A, 255), (1203, A, 255), (1204, A, 255), (180, A, 255)])]
    r = make(*[read(i, q, mods=[(p, m, x, None) for p, m, x in c]) for i, (q, c) in enumerate(table)])
    got = {(x.ModA, x.ModB, x.Lag): x.CrossCor for x in crosscor.mod_cross_cor(r.reads, r.mod_calls).collect()}
    want = brute_crosscor(table, crosscor.LAGS)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for dense in (True, False):  # in the row, on words and on sets
        nested = {(x.ModA, x.ModB, x.Lag): x.CrossCor for x in crosscor.nested_cross_cor(r.reads, dense=dense).collect()}
        assert nested.keys() == want.keys() and all(abs(nested[k] - want[k]) < 1e-9 for k in want)


def test_crosscor_lags(make):
    r = make(read(1, 2000))
    assert crosscor.mod_cross_cor(r.reads, r.mod_calls, lags=[10, 10, 20], duplicate_lags=True).count() == 18
    with pytest.raises(ValueError):
        crosscor.mod_cross_cor(r.reads, r.mod_calls, lags=[0])


def window(spark, *items):
    return spark.createDataFrame(
        [(t, s, e, strand, i + 1, g, f"g{g}", (e - s) // 2) for i, (t, s, e, strand, g) in enumerate(items)],
        "tid int, start long, stop long, strand boolean, regionindex long, group int, label string, dw long",
    )


def test_metaplot(make, spark):
    r = make(read(1, mods=[(1, A, 255, 105), (2, A, 10, 105), (3, A, 255, None), (4, A, 255, 111)]))
    regs = window(spark, (0, 100, 110, True, 1), (0, 101, 111, False, 1), (0, 1, 400_001, True, 2), (1, 100, 110, True, 1))
    out = metaplot.metaplot(r.mod_calls, regs)
    one = {x.xp: (x.FG, x.BG) for x in out.where("Region = 'g1' and BG > 0").collect()}
    assert one == {0: (1, 2), 1: (1, 2), -5: (1, 1)}
    assert out.where("Region = 'g1'").count() == 11
    assert out.where("Region = 'g2'").agg(F.sum("BG")).first()[0] == 3  # a wide region beside expired narrow ones
    z = metaplot.metaplot_zscore(out.where("Region = 'g1'"))
    assert z.where("R is null").count() == 8


def test_interval_overlap(make, spark):
    r = make(read(1, 100, left=0), read(2, 40_000, left=90), read(3, 10, left=500_000))
    regs = window(spark, (0, 100, 110, True, 1), (0, -50, 0, True, 1), (0, 1, 1, True, 1), (0, 20_000, 60_000, True, 2))
    got = sorted((x.read_id, x.regionindex) for x in metaplot.interval_overlap(r.reads, regs).collect())
    assert got == [(1, 1), (1, 3), (2, 1), (2, 4)]


def test_loess_keeps_lines(spark):
    df = spark.createDataFrame([("g", A, x, 2.0 * x) for x in range(-20, 21)], "Region string, Mod string, xp int, R double")
    assert all(abs(r.smooth - 2 * r.xp) < 1e-6 for r in metaplot.loess(df, span=0.3).collect())


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("a", float(x), w) for x, w in zip((1, 2, 3, 5, 8, 13, 99), (3, 1, 4, 1, 5, 9, 0))], "k string, x double, w long")
    got = {r.p: r.q for r in weighted_quantiles(df, ["k"], "x", "w", (0.25, 0.5, 0.75, 1.0)).collect()}
    assert got[0.25] == pytest.approx(3.0) and got[0.5] == pytest.approx(7.4) and got[0.75] == pytest.approx(10.2222222) and got[1.0] == 13.0


def test_n50(spark):
    h = spark.createDataFrame([(10, 1), (8, 1), (5, 2)], "readlength long, count long")
    assert rows(n50(h)) == [(8, 5)]
    assert rows(n50(spark.createDataFrame([(7, 3)], "readlength long, count long"))) == [(7, None)]


def test_summaries(spark):
    lengths = spark.createDataFrame([(10, 1), (20, 3)], "readlength long, count long")
    got = {r.Stat: r.value for r in summary.sample_summary(None, lengths).collect()}
    assert got["Total Bases"] == pytest.approx(7e-5) and got["Mean Read Length"] == pytest.approx(0.0175)
    assert got["Std Read Length"] == pytest.approx(math.sqrt(18.75) / 1000)
    with pytest.raises(ValueError):
        summary.sample_summary()


def test_bits(spark):
    df = spark.createDataFrame([(1, 0), (1, 63), (1, 64), (1, 64), (1, 127), (1, 128), (2, 5)], "k int, p int")
    packed = bits.pack(df, ["k"], "p", 128)
    got = packed.select("k", bits.total_bits(F.col("words")).alias("n"), bits.get_bit(F.col("words"), F.lit(64)).alias("b"), bits.get_bit(F.col("words"), F.lit(200)).alias("out"))
    assert sorted(map(tuple, got.collect())) == [(1, 4, 1, None), (2, 1, 0, None)]


def test_region_files(spark, tmp_path, make):
    (tmp_path / "a.bed").write_text("chrom\tstart\tstop\nchr2\t9\t20\nchrQ\t0\t1\n")
    (tmp_path / "b.bed").write_text("strand\tchrom\tstop\tstart\n-\tchr2\t20\t9\n.\tchrX\t20\t9\n+\tchrX\t20\t9\n")
    out = regions.load_many(spark, [{"file": str(tmp_path / "a.bed"), "label": "L", "width": 5}, {"file": str(tmp_path / "b.bed")}])
    got = [(r.chrom, r.start, r.stop, r.strand, r.regionindex, r.group, r.label) for r in out.collect()]
    assert got[0] == ("chr2", 10, 20, True, 1, 1, "L")
    assert [x[3] for x in got[2:]] == [False, False, True] and [x[4:] for x in got[2:]] == [(1, 2, "group2"), (2, 2, "group2"), (3, 2, "group2")]
    contigs = make(read(1)).contigs
    assert regions.to_tid(out, contigs).count() == 4
    assert rows(regions.missing_contigs(out, contigs)) == [("chrQ", 1)]
    (tmp_path / "c.bed").write_text("chrom\tbegin\nx\t1\n")
    with pytest.raises(ValueError):
        regions.load(spark, str(tmp_path / "c.bed"))


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("stats: [ChromStat, ModRate]\nconfigs:\n  ModRate: {n: 20}\n")
    c = config.load(f)
    assert [s.name for s in stats(c.stats, c.configs)] == ["ChromStat", "ModRate"]
    for bad in ({"stats": []}, {"stats": "x", "configs": {}}, {"stats": [], "configs": {"a": 1}}, [1]):
        with pytest.raises(ValueError):
            config.parse(bad)
    with pytest.raises(KeyError):
        stats(["os"])


def test_new_statistic(make):
    @register
    class Longest(Stat):
        name, title, file = "Longest", "Longest read", "longest.tsv"

        def compute(self, rel):
            return rel.reads.agg(F.max("qlen").alias("qlen"))

    try:
        assert rows(stats(["Longest"])[0].compute(make(read(1, 5), read(2, 9)))) == [(9,)]
        assert stat_title("Longest") == "Longest read" and stat_title("?") == "Unk: ?"
    finally:
        del REGISTRY["Longest"]


def test_run_and_report(make, tmp_path, spark):
    r = make(*[read(i, 2000 + i, tid=i % 4, mods=[(200 + 7 * i, MODS[i % 3], 255, 100 + i)], nuc=[147], msp=[30, 40]) for i in range(8)])
    (tmp_path / "r.bed").write_text("chrom\tstart\tstop\nchr10\t90\t110\n")
    conf = config.StatConfig((*config.DEFAULT_STATS, "MetaPlot"), {"MetaPlot": [{"file": str(tmp_path / "r.bed"), "label": "R", "width": 50}]})
    saved = tidestat.run_stats(r, str(tmp_path / "S1/stats"), conf, report=str(tmp_path / "report.html"))
    assert {x.Stat for x in saved.meta.collect()} == set(conf.stats)
    assert saved.stats["ReadLengthCounter"].agg(F.sum("count")).first()[0] == 8
    assert saved.stats["ModMetaHist"].count() == 3000 and saved.stats["MetaPlot"].count() > 0
    page = (tmp_path / "report.html").read_text()
    assert "S1" in page and page.count("<svg") == 9 and "N50*" in page


def test_streams_equal_batches(make, tmp_path, spark):
    from tidestat.streaming.stats import read_stream, start, streaming_stat

    r = make(*[read(i, 1300 + i % 3, tid=0, mods=[(i + 1, MODS[i % 3], 255, 50 + i), (200 + i, MODS[0], 255, None), (210 + i, MODS[1], 255, None)], nuc=[1] * (i % 2)) for i in range(12)])
    r.reads.repartition(4).write.parquet(str(tmp_path / "reads"))
    regions = spark.createDataFrame([(0, 1, 200, True, 1, "R", 100)], "tid int, start long, stop long, strand boolean, group int, label string, dw int")
    for name in ("ChromStat", "ReadLengthCounter", "ModHist", "ModMetaHist", "ModRate", "NucMSPRate", "NucMSPLenHist", "ModCrossCor", "MetaPlot"):
        q = start(streaming_stat(read_stream(spark, str(tmp_path / "reads"), 1), name, regions), f"s_{name}", str(tmp_path / name))
        q.awaitTermination()
        batch = streaming_stat(r.reads, name, regions)
        assert batch.count() > 0
        assert sorted(map(tuple, spark.table(f"s_{name}").collect())) == sorted(map(tuple, batch.collect()))
    with pytest.raises(KeyError):
        streaming_stat(r.reads, "?")


def test_bits_from_flags_and_set(spark):
    rng = random.Random(9)
    flags = [[rng.random() < 0.3 for _ in range(n)] for n in (0, 1, 64, 65, 200)]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "k int, f array<boolean>").withColumn("w", bits.from_bits(F.col("f")))
    unsigned = lambda ws: sum((w % 2**64) << (64 * i) for i, w in enumerate(ws))
    for r in df.withColumn("on", bits.set_bit(F.col("w"), F.lit(63))).withColumn("off", bits.set_bit(F.col("w"), F.lit(64), False)).collect():
        want = sum(1 << i for i, b in enumerate(r.f) if b)
        assert unsigned(r.w) == want
        assert unsigned(r.on) == (want | 1 << 63 if len(r.f) else 0) and unsigned(r.off) == want & ~(1 << 64)


def test_region_files_of_any_delimiter(spark, tmp_path):
    from tidestat.sources import regions

    want = None
    for i, sep in enumerate("\t,; "):
        (tmp_path / f"{i}.txt").write_text(f"chrom{sep}start{sep}stop{sep}strand\nchr1{sep}10{sep}20{sep}-\n")
        got = [tuple(r) for r in regions.load(spark, str(tmp_path / f"{i}.txt"), dw=5, label="x").collect()]
        want = want or got
        assert got == want and len(got) == 1


def test_head_of_the_source(make):
    r = make(read(3, 5), read(1, 9), read(2, 7))
    assert r.head(2).reads.count() == 2 and r.head(None) is r
    with pytest.raises(ValueError):
        r.head(0)


def test_bit_crosscor(spark):
    rng = random.Random(3)
    sets = [(k, rng.sample(range(1024), rng.randint(1, 200))) for k in range(6)]
    df = spark.createDataFrame([(k, p) for k, s in sets for p in s], "k int, p int")
    words = {r.k: list(r.words) for r in bits.pack(df, ["k"], "p", 1024).collect()}
    lags = [0, 1, 10, 63, 64, 65, 128, 280, 1023]
    table = spark.createDataFrame([(a, b, words[a], words[b]) for a in words for b in words], "a int, b int, x array<long>, y array<long>")
    got = {(r.a, r.b): r.c for r in table.select("a", "b", bits.crosscor(F.col("x"), F.col("y"), lags).alias("c")).collect()}
    at = {k: set(s) for k, s in sets}
    for (a, b), c in got.items():
        for g, v in zip(lags, c, strict=True):
            assert v == pytest.approx(sum(p + g in at[b] for p in at[a]) / math.sqrt(len(at[a]) * len(at[b])))
    with pytest.raises(ValueError):
        bits.lag_matches(F.col("x"), F.col("y"), -1)


def test_loess_against_direct_fits():
    import numpy as np

    from tidestat.functions.loess import curve, local_fit, vertices

    rng = np.random.default_rng(1)
    x = np.sort(rng.choice(np.arange(-1500, 1501), 2000, replace=False)).astype(float)
    for k in range(5):  # polynomials up to the degree come back, between the vertices to a cubic's error
        y = (x / 1500) ** k
        grid, smooth = curve(x, y, 0.05, 4, 3000)
        assert len(grid) == 3000 and grid[0] == x[0] and grid[-1] == x[-1]
        assert np.abs(smooth - (grid / 1500) ** k).max() < 1e-6
    y = np.sin(x / 200) + rng.normal(0, 0.2, len(x))
    near = int(0.05 * len(x))
    at = x[vertices(len(x), near // 5)]
    grid, smooth = curve(x, y, 0.05, 4, 3000)
    direct = np.array([local_fit(x, y, g, near, 4)[0] for g in grid[::50]])
    assert np.abs(smooth[::50] - direct).max() < 0.05  # blended
    exact = np.interp(at, grid, smooth)
    assert np.abs(exact - [local_fit(x, y, v, near, 4)[0] for v in at]).max() < 0.01
    lo = near // 2
    d = x[1000 - near : 1000 + near] - x[1000]
    order = np.argsort(np.abs(d), kind="stable")[:near]
    u = d[order] / np.abs(d[order]).max()
    w = np.sqrt(np.clip(1 - (np.abs(u) / 1.001) ** 3, 0, None) ** 3)
    want = np.linalg.lstsq(np.vander(u, 5, increasing=True) * w[:, None], y[1000 - near : 1000 + near][order] * w, rcond=None)[0][0]
    assert local_fit(x, y, x[1000], near, 4)[0] == pytest.approx(want, abs=1e-3) and lo
    assert curve(x[:1], y[:1], 0.05, 4, 3000)[1].tolist() == y[:1].tolist() and len(curve(x[:2], y[:2], 0.05, 4, 30)[0]) == 30


def test_drawings_of_many_rows(spark, monkeypatch):
    from tidestat.plans import report, svg

    monkeypatch.setattr(svg, "MOST", 100)
    monkeypatch.setattr(svg, "BINS", 10)
    df = spark.range(1000).selectExpr("id as x", "id * 2.0D as y", "concat('s', id % 12) as k")
    few = svg.thinned(df, "x", "y", "k")
    assert few.count() == 120 and few.select("k").distinct().count() == 12 and few.where("abs(y - 2 * x) > 1e-6").count() == 0
    assert svg.lines(df, "x", "y", "k").count("<polyline") == 12  # no line is lost
    with pytest.raises(ValueError):
        svg.bars(df, "k", "y")
    assert "990 more rows" in report.html_table(df, 10) and "more rows" not in report.html_table(df.limit(10), 10)


def test_saved_types(make, tmp_path, spark):
    from tidestat.plans.sinks import read_stats

    r = make(read(1, 2000, mods=[(1, A, 255, None)]))
    tidestat.run_stats(r, str(tmp_path / "s"), config.StatConfig(("ModHist", "ReadLengthCounter"), {}))
    saved = read_stats(spark, str(tmp_path / "s"))
    assert saved.stats["ModHist"].dtypes == [("ml", "int"), ("prob", "double"), (A, "bigint")]
    assert saved.stats["ReadLengthCounter"].dtypes == [("readlength", "bigint"), ("count", "bigint")]
    assert (tmp_path / "s/modhist.tsv.gz").is_file()


def test_rate_shares(spark):
    h = spark.createDataFrame([("a", 0.1, 3), ("a", 0.2, 1), ("b", 0.5, 7)], "mod string, rate double, count long")
    assert sorted(rows(rates.rate_share(h))) == [("a", 0.1, 0.75), ("a", 0.2, 0.25), ("b", 0.5, 1.0)]
