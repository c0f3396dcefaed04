"""Streams that are killed and go on, statistics as accumulators, and results as single files."""

import gzip
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tests.test_fused import NINE, plain, random_reads, random_regions
from tidestat.accumulator import Accumulator
from tidestat.plans import tsv
from tidestat.registry import stats
from tidestat.schema import CONTIGS, READS
from tidestat.sources.relations import Relations
from tidestat.streaming import durable
from tidestat.streaming.stats import read_stream


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import a test


class LongestTwo(Accumulator):
    """The two longest reads of each contig, and how many there are."""

    name, title, file, schema, columns = "LongestTwo", "Longest reads", "longest.tsv", "tid int, n long, first long, second long", ("tid", "qlen")

    def init(self):
        return {}

    def update(self, state, batch):
        tid, qlen = (batch[c].to_numpy(zero_copy_only=False) for c in ("tid", "qlen"))
        for t in np.unique(tid):
            mine = np.sort(qlen[tid == t])[::-1]
            state = self.merge(state, {int(t): (len(mine), mine[:2].tolist())})
        return state

    def merge(self, first, second):
        out = dict(first)
        for t, (n, top) in second.items():
            m, other = out.get(t, (0, []))
            out[t] = n + m, sorted(top + other, reverse=True)[:2]
        return out

    def rows(self, state):
        return [(t, n, top[0], top[1] if len(top) > 1 else None) for t, (n, top) in sorted(state.items())]


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r[2])
    return [(t, len(v), *(sorted(v, reverse=True) + [None])[:2]) for t, v in sorted(by.items())]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = random_reads(rng, 80)
    path = tmp_path_factory.mktemp("stream") / "reads"
    spark.createDataFrame(rows, READS).repartition(5).write.parquet(str(path))
    contigs = spark.createDataFrame([(0, "chr10"), (1, "chr2"), (2, "chrX")], CONTIGS)
    regs = spark.createDataFrame([r for r in random_regions(rng, 12) if r[7] == 5], "tid int, start long, stop long, strand boolean, regionindex long, group int, label string, dw long")
    return rows, str(path), Relations(spark.read.schema(READS).parquet(str(path)), contigs, regs)


def test_accumulator(spark, given, monkeypatch):
    from tidestat import accumulator

    rows, _, rel = given
    assert list(map(tuple, LongestTwo().compute(rel).collect())) == brute(rows)
    monkeypatch.setattr(accumulator, "FAN", 2)
    many = Relations(rel.reads.repartition(13), rel.contigs)
    assert list(map(tuple, LongestTwo().compute(many).collect())) == brute(rows)
    nothing = LongestTwo().compute(Relations(rel.reads.where("false"), rel.contigs))
    assert nothing.collect() == [] and nothing.columns == ["tid", "n", "first", "second"]


def test_killed_and_started_again(spark, given, tmp_path, monkeypatch):
    rows, path, rel = given
    chosen = [*stats(NINE), LongestTwo()]
    out, check = str(tmp_path / "sums"), str(tmp_path / "check")
    run = lambda: durable.start(read_stream(spark, path, 1), chosen, rel, out, check).awaitTermination()
    real, calls = durable.Ledger.write, []

    def dying(self, name, tables):
        calls.append(name)
        if len(calls) == 2:  # half-way: a folder without its mark
            tables["cells"].write.parquet(f"{self.path}/{name}/cells")
            raise RuntimeError("killed")
        real(self, name, tables)
        if len(calls) == 4:  # after the folder is whole, before the stream knows
            raise RuntimeError("killed")

    monkeypatch.setattr(durable.Ledger, "write", dying)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run()
    compacted = durable.Ledger(spark, out).whole()
    assert compacted[0] == -1 and compacted[1]
    monkeypatch.setattr(durable.Ledger, "write", real)
    durable.compact(spark, chosen, out)  # holds the batch that will be run again
    assert durable.Ledger(spark, out).whole() == (compacted[1][-1], [])
    run()
    for _ in range(2):
        got = durable.totals(spark, [*stats(NINE), LongestTwo()], rel, out)
        for s in chosen:
            want = brute(rows) if s.name == "LongestTwo" else plain(s.compute(rel))
            assert (list(map(tuple, got[s.name].collect())) if s.name == "LongestTwo" else plain(got[s.name])) == want, s.name
        durable.compact(spark, chosen, out)
    assert len(durable.Ledger(spark, out).folders()) == 1
    run()  # nothing new
    assert list(map(tuple, durable.totals(spark, chosen, rel, out)["LongestTwo"].collect())) == brute(rows)


def test_statistics_without_sums_are_refused(spark, given, tmp_path):
    from tidestat.registry import Stat

    class Alone(Stat):
        name = "Alone"

        def compute(self, rel):
            return rel.reads

    with pytest.raises(ValueError, match="Alone"):
        durable.start(read_stream(spark, given[1]), [Alone()], given[2], str(tmp_path / "s"), str(tmp_path / "c"))
    assert durable.totals(spark, stats(["ReadLengthCounter"]), given[2], str(tmp_path / "none"))["ReadLengthCounter"].count() == 0


# files


def test_one_file_of_many_tasks(spark, tmp_path):
    df = spark.range(0, 5000, 1, 4).selectExpr("id", "id / 3 as x", "case when id % 7 = 0 then null else concat('a\\t\"', id, '\\\\') end as s", "id % 2 = 0 as b")
    for name in ("t.tsv.gz", "t.tsv"):
        path = tmp_path / "deep" / name
        tsv.write_tsv(df.orderBy(F.col("id").desc()), str(path))
        assert path.is_file() and [p.name for p in path.parent.iterdir() if "parts" in p.name] == []
        text = subprocess.run(["gunzip", "-c", str(path)], capture_output=True, check=True).stdout.decode() if name.endswith(".gz") else path.read_text()
        lines = text.split("\n")
        assert lines[0] == "id\tx\ts\tb" and lines[1].startswith("4999\t") and len(lines) == 5002
        back = spark.read.schema(df.schema).csv(str(path), sep="\t", header=True)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    odd = spark.createDataFrame([(float("nan"), None), (float("inf"), 1), (float("-inf"), 2)], "x double, n int")
    tsv.write_tsv(odd, str(path))
    assert path.read_text() == "x\tn\nNaN\t\nInf\t1\n-Inf\t2\n"
    tsv.write_tsv(odd.where("false"), str(tmp_path / "e.tsv.gz"))
    assert gzip.open(tmp_path / "e.tsv.gz").read() == b"x\tn\n"


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = tmp_path / "t.tsv.gz"
    tsv.write_tsv(spark.range(3), str(path))
    before = path.read_bytes()
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="no"):
        tsv.write_tsv(bad, str(path))
    assert path.read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["t.tsv.gz"]


def test_folder_of_the_name_gives_way(spark, tmp_path):
    (tmp_path / "t.tsv").mkdir()
    (tmp_path / "t.tsv" / "part-0").write_text("old")
    tsv.write_tsv(spark.range(1), str(tmp_path / "t.tsv"))
    assert (tmp_path / "t.tsv").read_text() == "id\n0\n"
    with pytest.raises(Exception):
        spark.range(1).write.format("tsvfile").mode("append").save(str(tmp_path / "t.tsv"))
