"""The engine's own queries, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidestat.operators  # noqa: F401  registers the statistics
from tidestat.accumulator import Accumulator
from tidestat.functions import bits
from tidestat.functions.khist import BITS
from tidestat.functions.rounding import rounded
from tidestat.operators import crosscor, metaplot, modhist, rates, reads, summary
from tidestat.plans import fused, runner
from tidestat.plans.tsv import write_tsv
from tidestat.registry import REGISTRY, stats
from tidestat.sources import adapter, config, regions
from tidestat.sources.shared import shared_dir
from tidestat.streaming import durable
from tidestat.streaming import stats as streaming

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6
DW = 100


def _regions(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.region_rows(spark, d)
    return regions.to_tid(regions.windows(rows, DW), adapter.contigs(spark))


def _rel(spark: SparkSession, sf_dir: str):
    return adapter.from_documents(spark, sf_dir)


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: rounded(c, DIGITS) for c in cols})


def chrom_counts(spark, d):
    r = _rel(spark, d)
    return reads.chrom_counts(r.reads, r.contigs)


def read_length_hist(spark, d):
    return reads.read_length_hist(_rel(spark, d).reads)


def read_length_binned(spark, d):
    return _round(reads.read_length_binned(read_length_hist(spark, d)), "readlength")


def nuc_msp_len_hist(spark, d):
    return reads.feature_length_hist(_rel(spark, d))


def mod_hist(spark, d):
    return _round(modhist.mod_hist(_rel(spark, d).mod_calls), "prob")


def mod_hist_unpivot(spark, d):
    return _round(modhist.mod_hist_long(modhist.mod_hist(_rel(spark, d).mod_calls)), "prob")


def mod_proportion(spark, d):
    return _round(modhist.mod_proportion(modhist.mod_hist(_rel(spark, d).mod_calls)), "prob", "proportion")


def mod_meta_hist(spark, d):
    return _round(modhist.mod_meta_hist(_rel(spark, d).mod_calls), "bin")


def mod_rate_exact(spark, d):
    return rates.exact_hist(rates.mod_rates(_rel(spark, d).reads), "mod", "rate", "count", DIGITS)


def mod_rate_khist(spark, d):
    return rates.khist(rates.mod_rates(_rel(spark, d).reads), "mod", "rate", "count")


def mod_rate_khist_coarse(spark, d):
    """The adaptive histogram where it is exact: rates of two digits are fewer than its bins."""
    coarse = rates.mod_rates(_rel(spark, d).reads).withColumn("rate", rounded("rate", 2))
    return rates.khist(coarse, "mod", "rate", "count")


def nuc_msp_rate_khist_coarse(spark, d):
    coarse = rates.feature_rates(_rel(spark, d).reads).withColumn("Rate", rounded("Rate", 2))
    return rates.khist(coarse, "Feature", "Rate", "Count")


def mod_cross_cor_nested(spark, d):
    """The cross-correlation over nested calls, without a shuffle by read."""
    return _round(crosscor.nested_cross_cor(_rel(spark, d).reads), "CrossCor")


def nuc_msp_rate_exact(spark, d):
    return rates.exact_hist(rates.feature_rates(_rel(spark, d).reads), "Feature", "Rate", "Count", DIGITS)


def nuc_msp_rate_khist(spark, d):
    return rates.khist(rates.feature_rates(_rel(spark, d).reads), "Feature", "Rate", "Count")


def mod_rate_share(spark, d):
    return _round(rates.rate_share(mod_rate_exact(spark, d)), "share")


def nuc_msp_len_plot(spark, d):
    """What the report draws of the feature lengths."""
    return stats(["NucMSPLenHist"])[0].plot_data(nuc_msp_len_hist(spark, d))


def regions_files(spark, d):
    """Windows of two region files, of different order of columns, width and label; the files are written from `supplier` first."""
    rows, where = adapter.region_rows(spark, d), f"{shared_dir(spark)}/regions-{uuid.uuid4().hex}"
    even = rows.where("strand = '+'").orderBy("regionindex", "group").select("chrom", "start", "stop")  # without a strand
    odd = rows.where("strand = '-'").orderBy("regionindex", "group").select("strand", "stop", "chrom", "start")
    files = [write_tsv(t, f"{where}/{n}.tsv") for t, n in ((even, "even"), (odd, "odd"))]
    config = [{"file": files[0], "label": "plus", "width": 50}, {"file": files[1]}]
    return regions.to_tid(regions.load_many(spark, config), adapter.contigs(spark))


class LongestReads(Accumulator):
    """The reads of each contig, and the two longest lengths of them."""

    name, title, file, columns = "LongestReads", "Longest reads", "longest.tsv", ("tid", "qlen")
    schema = "tid int, n long, first long, second long"

    def init(self):
        return {}

    def update(self, state, batch):
        for tid, qlen in zip(batch["tid"].to_pylist(), batch["qlen"].to_pylist(), strict=True):
            n, top = state.get(tid, (0, []))
            state[tid] = n + 1, sorted([*top, qlen], reverse=True)[:2]
        return state

    def merge(self, first, second):
        for tid, (n, top) in second.items():
            m, other = first.get(tid, (0, []))
            first[tid] = n + m, sorted(top + other, reverse=True)[:2]
        return first

    def rows(self, state):
        return [(tid, n, *(top + [None])[:2]) for tid, (n, top) in state.items()]


def longest_reads(spark, d):
    """A statistic without SQL, as an accumulator."""
    return LongestReads().compute(_rel(spark, d))


def saved_stats(spark, d):
    """A whole run: all nine statistics computed, written as files with a manifest, and read back, in the form of fused_stats."""
    rel = adapter.from_documents(spark, d, _regions(spark, d))
    return _long(runner.run_stats(rel, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}/stats", config.parse({"stats": list(FUSED), "configs": {}})).stats)


def rate_boxplot(spark, d):
    out = rates.rate_boxplot(mod_rate_exact(spark, d))
    return _round(out, "q25", "median", "q75", "lower", "upper")


def mod_cross_cor(spark, d):
    r = _rel(spark, d)
    return _round(crosscor.mod_cross_cor(r.reads, r.mod_calls), "CrossCor")


def regions_load(spark, d):
    return _regions(spark, d)


def interval_overlap(spark, d):
    return metaplot.interval_overlap(_rel(spark, d).reads, _regions(spark, d))


def metaplot_profile(spark, d):
    return metaplot.metaplot(_rel(spark, d).mod_calls, _regions(spark, d))


def metaplot_zscore(spark, d):
    out = metaplot.metaplot_zscore(metaplot_profile(spark, d)).select("Region", "Mod", "xp", "FG", "BG", "R", "z")
    return _round(out, "R", "z")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """The windows of _regions and, for every twentieth of them, one some five hundred times as wide."""
    narrow = _regions(spark, d)
    wide = narrow.where("regionindex % 20 = 0").withColumns(
        {"start": F.col("start") - 50_000, "stop": F.col("stop") + 50_000, "dw": F.col("dw") + 50_000, "group": F.col("group") + 10, "label": F.concat(F.lit("wide"), F.col("group"))}
    )
    return narrow.unionByName(wide)


def metaplot_sweep(spark, d):
    """Profiles over windows of 201 and of 100,201 places, by the sorted sweep: the observed cells."""
    counts = metaplot.profile_counts(_rel(spark, d).mod_calls, _mixed(spark, d), sweep=True)
    return counts.select("Region", "Mod", "xp", "FG", "BG")


def fused_stats(spark, d):
    """All nine statistics from one scan of the reads, in one long table: stat, k (what it is of), x (its place on the axis), value."""
    return _long(fused.fused(stats(FUSED), adapter.from_documents(spark, d, _regions(spark, d))))


def stream_fused_stats(spark, d):
    """fused_stats of the reads as a stream: its batches' sums, each in a folder of its own, added up."""
    static, chosen = adapter.from_documents(spark, d, _regions(spark, d)), stats(FUSED)
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    durable.start(streaming.read_stream(spark, adapter.decoded(spark, d), 2), chosen, static, f"{where}/sums", f"{where}/checkpoint").awaitTermination()
    return _long(durable.totals(spark, chosen, static, f"{where}/sums"))


def _long(out: Mapping[str, DataFrame]) -> DataFrame:
    """All results of FUSED in one table: stat, k, x, value."""
    parts = []
    for name, (k, x, values) in FUSED.items():
        part = out[name]
        if name == "ModHist":
            part = part.unpivot(["ml"], [c for c in part.columns if c.startswith("mod_")], "mod", "n")
        for v in values:
            key = F.concat_ws("|", *[F.col(c) for c in k], *([F.lit(v)] if len(values) > 1 else []))
            parts.append(part.select(F.lit(name).alias("stat"), key.alias("k"), rounded(F.col(x).cast("double"), DIGITS).alias("x"), rounded(F.col(v).cast("double"), DIGITS).alias("value")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


#: For each statistic of fused_stats: what names a row, its axis, and its values.
FUSED = {
    "ChromStat": (["chrom"], "count", ["count"]),
    "ReadLengthCounter": ([], "readlength", ["count"]),
    "ModHist": (["mod"], "ml", ["n"]),
    "ModMetaHist": (["mod"], "bin", ["count"]),
    "ModRate": (["mod"], "rate", ["count"]),
    "NucMSPRate": (["Feature"], "Rate", ["Count"]),
    "NucMSPLenHist": (["Feature"], "Length", ["Count"]),
    "ModCrossCor": (["ModA", "ModB"], "Lag", ["CrossCor"]),
    "MetaPlot": (["Region", "Mod"], "xp", ["FG", "BG"]),
}


def sample_summary(spark, d):
    return _round(summary.sample_summary(chrom_counts(spark, d), read_length_hist(spark, d)), "value")


def mod_summary(spark, d):
    return _round(summary.mod_summary(modhist.mod_hist(_rel(spark, d).mod_calls)), "Percent", "Total_M")


def limit_reads(spark, d):
    return _rel(spark, d).limit(100).reads.select("read_id", "tid", "qlen", "left0", "right1")


def stats_manifest(spark, d):
    """The registered statistics with the rows that each has in fused_stats."""
    rows = [(n, REGISTRY[n].file, REGISTRY[n].title, REGISTRY[n].grain) for n in sorted(FUSED)]
    counts = fused_stats(spark, d).groupBy(F.col("stat").alias("Stat")).agg(F.count("*").alias("Rows"))
    return spark.createDataFrame(rows, "Stat string, File string, Title string, Grain string").join(counts, "Stat")


def packed_bits(spark, d):
    calls = _rel(spark, d).mod_calls.where("prob > 229 and pos between 180 and 1203")
    packed = bits.pack(calls.withColumn("p", F.col("pos") - 180), ["read_id", "mod"], "p", 1024)
    return packed.select("read_id", "mod", bits.total_bits(F.col("words")).alias("bits"), bits.lag_matches(F.col("words"), F.col("words"), 10).alias("lag10"))


def stream_read_length_hist(spark, d):
    """The read lengths as a stream to its end: the complete result of a memory sink."""
    documents = spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(f"{d}/documents.parque[t]")  # a pattern may name a file
    name = f"stream_{uuid.uuid4().hex}"
    result = streaming.streaming_stat(adapter.reads(documents), "ReadLengthCounter")
    streaming.start(result, name, f"{shared_dir(spark)}/{name}").awaitTermination()
    return spark.table(name)


QUERIES: dict[str, Query] = {
    "chrom_counts": chrom_counts,
    "read_length_hist": read_length_hist,
    "read_length_binned": read_length_binned,
    "nuc_msp_len_hist": nuc_msp_len_hist,
    "mod_hist": mod_hist,
    "mod_hist_unpivot": mod_hist_unpivot,
    "mod_proportion": mod_proportion,
    "mod_meta_hist": mod_meta_hist,
    "mod_rate_exact": mod_rate_exact,
    "mod_rate_khist": mod_rate_khist,
    "mod_rate_khist_coarse": mod_rate_khist_coarse,
    "nuc_msp_rate_khist_coarse": nuc_msp_rate_khist_coarse,
    "mod_cross_cor_nested": mod_cross_cor_nested,
    "nuc_msp_rate_exact": nuc_msp_rate_exact,
    "nuc_msp_rate_khist": nuc_msp_rate_khist,
    "rate_boxplot": rate_boxplot,
    "mod_rate_share": mod_rate_share,
    "nuc_msp_len_plot": nuc_msp_len_plot,
    "regions_files": regions_files,
    "longest_reads": longest_reads,
    "saved_stats": saved_stats,
    "mod_cross_cor": mod_cross_cor,
    "regions_load": regions_load,
    "interval_overlap": interval_overlap,
    "metaplot": metaplot_profile,
    "metaplot_zscore": metaplot_zscore,
    "metaplot_sweep": metaplot_sweep,
    "fused_stats": fused_stats,
    "stream_fused_stats": stream_fused_stats,
    "sample_summary": sample_summary,
    "mod_summary": mod_summary,
    "limit_reads": limit_reads,
    "stats_manifest": stats_manifest,
    "packed_bits": packed_bits,
    "stream_read_length_hist": stream_read_length_hist,
}

_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(adapter.CONTIG_NAMES))
_WITH = f"""WITH contigs(tid, chrom) AS (VALUES {_NAMES}),
reads AS (SELECT doc_id AS read_id, CAST(substr(source, 4) AS INT) AS tid, n_chars AS qlen,
  (doc_id * 97) % 50000 AS left0, (doc_id * 97) % 50000 + n_chars AS right1, text FROM documents),
letters AS (SELECT read_id, tid, qlen, left0, unnest(string_split(text, '')) AS c,
  generate_subscripts(string_split(text, ''), 1) AS pos FROM reads),
mod_calls AS (SELECT read_id, tid, qlen, CAST(pos AS BIGINT) AS pos,
  CASE c WHEN 'a' THEN 'mod_6mA' WHEN 'o' THEN 'mod_5mC' ELSE 'mod_5hmC' END AS mod,
  CASE c WHEN 'a' THEN 2 WHEN 'o' THEN 0 ELSE 1 END AS o,
  CAST((CAST(pos AS BIGINT) * pos * 31 + CAST(pos AS BIGINT) * 17 + read_id * 11) % 256 AS INT) AS prob,
  CASE WHEN pos % 10 <> 0 THEN left0 + pos END AS gpos FROM letters WHERE c IN ('a', 'o', 'i')),
features AS (SELECT read_id, qlen, 'nuc' AS "Feature", unnest(list_transform(string_split(text, ' '), lambda x: length(x))) AS len FROM reads
  UNION ALL SELECT read_id, qlen, 'msp', unnest(list_transform(string_split(text, chr(10)), lambda x: length(x))) FROM reads),
regions AS (SELECT id % 20 AS tid, (id * 997) % 80000 - {DW} AS start, (id * 997) % 80000 + {DW} AS stop,
  id % 2 = 0 AS strand, CAST(id // 3 + 1 AS BIGINT) AS regionindex, CAST(id % 3 + 1 AS INT) AS grp, 'group' || (id % 3 + 1) AS label,
  {DW} AS dw FROM (SELECT CAST(s_suppkey AS BIGINT) AS id FROM supplier)),
mods(mod, o) AS (VALUES ('mod_5mC', 0), ('mod_5hmC', 1), ('mod_6mA', 2))
"""
_LENGTHS = "lengths AS (SELECT qlen AS readlength, count(*) AS count FROM reads GROUP BY 1)"
_MODHIST = """wide AS (SELECT CAST(m.range AS INT) AS ml, m.range / 255.0 AS prob,
  count(*) FILTER (mod = 'mod_5mC') AS "mod_5mC", count(*) FILTER (mod = 'mod_5hmC') AS "mod_5hmC",
  count(*) FILTER (mod = 'mod_6mA') AS "mod_6mA" FROM range(256) m LEFT JOIN mod_calls c ON c.prob = m.range GROUP BY m.range),
long AS (SELECT ml, prob, 'mod_5mC' AS variable, "mod_5mC" AS value FROM wide UNION ALL
  SELECT ml, prob, 'mod_5hmC', "mod_5hmC" FROM wide UNION ALL SELECT ml, prob, 'mod_6mA', "mod_6mA" FROM wide),
shares AS (SELECT *, value / sum(value) OVER (PARTITION BY variable) AS proportion, prob > 0.9 AS ismod FROM long)"""
_RATES = f"""rates AS (SELECT m.mod, round(CAST(count(c.pos) AS DOUBLE) / r.qlen, {DIGITS}) AS rate FROM reads r CROSS JOIN mods m
  LEFT JOIN mod_calls c ON c.read_id = r.read_id AND c.mod = m.mod AND c.prob > 229 WHERE r.qlen > 0 GROUP BY r.read_id, r.qlen, m.mod),
ratehist AS (SELECT mod, rate, count(*) AS count FROM rates GROUP BY 1, 2)"""
_PROFILE = f"""profile AS (SELECT g.label AS "Region", g.mod AS "Mod", CAST(a.range AS INT) AS xp,
  count(*) FILTER (h.prob > 229) AS "FG", count(h.prob) AS "BG" FROM
  (SELECT DISTINCT r.label, c.mod FROM mod_calls c JOIN regions r ON r.tid = c.tid AND c.gpos BETWEEN r.start AND r.stop) g
  CROSS JOIN range(-{DW}, {DW} + 1) a LEFT JOIN
  (SELECT r.label, c.mod, c.prob, CASE WHEN r.strand THEN c.gpos - r.start ELSE r.stop - c.gpos END - r.dw AS xp
   FROM mod_calls c JOIN regions r ON r.tid = c.tid AND c.gpos BETWEEN r.start AND r.stop) h
  ON h.label = g.label AND h.mod = g.mod AND h.xp = a.range GROUP BY 1, 2, 3)"""
_LAGS = ", ".join(f"({g})" for g in crosscor.LAGS)

ORACLE: dict[str, str] = {
    "chrom_counts": _WITH + "SELECT chrom, count(*) AS count FROM reads JOIN contigs USING (tid) GROUP BY 1",
    "read_length_hist": f"{_WITH}, {_LENGTHS} SELECT readlength, count FROM lengths",
    "read_length_binned": f"{_WITH}, {_LENGTHS} SELECT CAST(readlength // 500 AS BIGINT) AS bins, CAST(sum(count) AS BIGINT) AS count, round(avg(readlength), 6) AS readlength FROM lengths GROUP BY 1",
    "nuc_msp_len_hist": _WITH + """SELECT f."Feature", CAST(n.range AS INT) AS "Length", count(x.len) AS "Count" FROM
      (VALUES ('nuc'), ('msp')) f("Feature") CROSS JOIN range(1, 1001) n LEFT JOIN features x ON x."Feature" = f."Feature" AND x.len = n.range GROUP BY 1, 2""",
    "mod_hist": f'{_WITH}, {_MODHIST} SELECT ml, round(prob, 6) AS prob, "mod_5mC", "mod_5hmC", "mod_6mA" FROM wide',
    "mod_hist_unpivot": f"{_WITH}, {_MODHIST} SELECT ml, round(prob, 6) AS prob, variable, value FROM long",
    "mod_proportion": f"{_WITH}, {_MODHIST} SELECT ml, round(prob, 6) AS prob, variable, value, round(proportion, 6) AS proportion, ismod FROM shares",
    "mod_meta_hist": _WITH + """, bins AS (SELECT mod, greatest(CAST(floor(1000 * pos / qlen) AS INT), 1) AS i, count(*) AS count FROM mod_calls WHERE prob > 229 AND qlen > 0 GROUP BY 1, 2)
      SELECT m.mod, round((n.range - 1) / 999.0, 6) AS bin, coalesce(b.count, 0) AS count FROM (SELECT DISTINCT mod FROM bins) m CROSS JOIN range(1, 1001) n LEFT JOIN bins b ON b.mod = m.mod AND b.i = n.range""",
    "mod_rate_exact": f"{_WITH}, {_RATES} SELECT mod, rate, count FROM ratehist",
    "nuc_msp_rate_exact": _WITH + """SELECT "Feature", round(CAST(n AS DOUBLE) / qlen, 6) AS "Rate", count(*) AS "Count" FROM
      (SELECT read_id, qlen, "Feature", count(*) AS n FROM features WHERE qlen > 0 GROUP BY ALL) GROUP BY 1, 2""",
    "rate_boxplot": f"""{_WITH}, {_RATES}, s AS (SELECT mod, rate AS x, CAST(count AS DOUBLE) AS w, sum(count) OVER (PARTITION BY mod ORDER BY rate) AS s,
      sum(count) OVER (PARTITION BY mod) AS total, first_value(count) OVER (PARTITION BY mod ORDER BY rate) AS w1,
      lag(rate) OVER (PARTITION BY mod ORDER BY rate) AS px FROM ratehist),
      q AS (SELECT mod, p, min_by(coalesce(px, x) + (p * (total - w1) + w1 - (s - w)) / w * (x - coalesce(px, x)), x) FILTER (s > p * (total - w1) + w1) AS q, max(x) AS top
        FROM s CROSS JOIN (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) v(p) GROUP BY 1, 2),
      b AS (SELECT mod, max(coalesce(q, top)) FILTER (p = 0.25) AS q25, max(coalesce(q, top)) FILTER (p = 0.5) AS median, max(coalesce(q, top)) FILTER (p = 0.75) AS q75 FROM q GROUP BY 1),
      e AS (SELECT mod, min(rate) AS lo, max(rate) AS hi FROM ratehist GROUP BY 1)
      SELECT mod, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, round(greatest(lo, q25 - (q75 - q25) * 1.5), 6) AS lower, round(least(hi, q75 + (q75 - q25) * 1.5), 6) AS upper FROM b JOIN e USING (mod)""",
    "mod_cross_cor": f"""{_WITH}, k AS (SELECT DISTINCT read_id, o, pos FROM mod_calls WHERE prob > 229 AND qlen >= 1204 AND pos BETWEEN 180 AND 1203),
      tot AS (SELECT read_id, o, count(*) AS n FROM k GROUP BY 1, 2), lags(lag) AS (VALUES {_LAGS}),
      hits AS (SELECT a.read_id, a.o AS a, b.o AS b, b.pos - a.pos AS lag, count(*) AS n FROM k a JOIN k b ON a.read_id = b.read_id AND a.o <= b.o AND b.pos - a.pos BETWEEN 1 AND 280 GROUP BY ALL),
      s AS (SELECT h.a, h.b, h.lag, sum(h.n / sqrt(CAST(ta.n AS DOUBLE) * tb.n)) AS s FROM hits h JOIN tot ta ON ta.read_id = h.read_id AND ta.o = h.a JOIN tot tb ON tb.read_id = h.read_id AND tb.o = h.b GROUP BY ALL)
      SELECT ma.mod AS "ModA", mb.mod AS "ModB", CAST(lags.lag AS INT) AS "Lag", round(coalesce(s.s, 0) / (SELECT count(*) FROM reads WHERE qlen >= 1204), 6) AS "CrossCor"
      FROM mods ma JOIN mods mb ON ma.o <= mb.o CROSS JOIN lags LEFT JOIN s ON s.a = ma.o AND s.b = mb.o AND s.lag = lags.lag""",
    "regions_load": _WITH + 'SELECT CAST(tid AS INT) AS tid, chrom, start, stop, strand, regionindex, grp AS "group", label, dw FROM regions JOIN contigs USING (tid)',
    "interval_overlap": _WITH + 'SELECT read_id, grp AS "group", regionindex FROM reads r JOIN regions g ON r.tid = g.tid AND g.start <= r.right1 AND g.stop >= r.left0 + 1',
    "metaplot": f'{_WITH}, {_PROFILE} SELECT "Region", "Mod", xp, "FG", "BG" FROM profile',
    "metaplot_zscore": f"""{_WITH}, {_PROFILE}, r AS (SELECT *, CASE WHEN "BG" <> 0 THEN CAST("FG" AS DOUBLE) / "BG" END AS "R" FROM profile),
      z AS (SELECT *, avg("R") OVER (PARTITION BY "Region", "Mod") AS m, stddev_samp("R") OVER (PARTITION BY "Region", "Mod") AS sd FROM r)
      SELECT "Region", "Mod", xp, "FG", "BG", round("R", 6) AS "R", round(("R" - m) / nullif(sd, 0), 6) AS z FROM z""",
    "sample_summary": f"""{_WITH}, {_LENGTHS}, c AS (SELECT readlength AS l, sum(readlength * count) OVER (ORDER BY readlength DESC) AS cum,
        sum(readlength * count) OVER () AS total, lead(readlength) OVER (ORDER BY readlength DESC) AS nxt FROM lengths),
      h AS (SELECT max(l) AS n50, max_by(nxt, l) AS n50s FROM c WHERE cum > 0.5 * total)
      SELECT 'Total Reads' AS "Stat", round(count(*) / 1e6, 6) AS value, 'M' AS "Units" FROM reads JOIN contigs USING (tid)
      UNION ALL SELECT 'Total Bases', round(sum(qlen) / 1e6, 6), 'Mb' FROM reads
      UNION ALL SELECT 'N50', round(n50 / 1000, 6), 'Kb' FROM h UNION ALL SELECT 'N50*', round(n50s / 1000, 6), 'Kb' FROM h
      UNION ALL SELECT 'Mean Read Length', round(avg(qlen) / 1000, 6), 'Kb' FROM reads
      UNION ALL SELECT 'Std Read Length', round(stddev_pop(qlen) / 1000, 6), 'Kb' FROM reads""",
    "mod_summary": f"""{_WITH}, {_MODHIST} SELECT replace(variable, 'mod_', '') AS "Mod", round(sum(proportion) * 100, 6) AS "Percent", round(sum(value) / 1e6, 6) AS "Total_M" FROM shares WHERE ismod GROUP BY 1""",
    "limit_reads": _WITH + "SELECT read_id, tid, qlen, left0, right1 FROM reads ORDER BY read_id LIMIT 100",
    "packed_bits": _WITH + """, k AS (SELECT DISTINCT read_id, mod, pos FROM mod_calls WHERE prob > 229 AND pos BETWEEN 180 AND 1203)
      SELECT a.read_id, a.mod, CAST(count(*) AS INT) AS bits, CAST(count(b.pos) AS INT) AS lag10 FROM k a LEFT JOIN k b ON b.read_id = a.read_id AND b.mod = a.mod AND b.pos = a.pos + 10 GROUP BY 1, 2""",
    "stream_read_length_hist": f"{_WITH}, {_LENGTHS} SELECT readlength, count FROM lengths",
    "mod_rate_khist_coarse": f"""{_WITH}, {_RATES} SELECT m.mod, round(CAST(n AS DOUBLE) / qlen, 2) AS rate, CAST(count(*) AS DOUBLE) AS count FROM
      (SELECT r.read_id, r.qlen, m.mod, count(c.pos) AS n FROM reads r CROSS JOIN mods m LEFT JOIN mod_calls c ON c.read_id = r.read_id AND c.mod = m.mod AND c.prob > 229
       WHERE r.qlen > 0 GROUP BY ALL) m GROUP BY 1, 2""",
    "nuc_msp_rate_khist_coarse": _WITH + """SELECT "Feature", round(CAST(n AS DOUBLE) / qlen, 2) AS "Rate", CAST(count(*) AS DOUBLE) AS "Count" FROM
      (SELECT read_id, qlen, "Feature", count(*) AS n FROM features WHERE qlen > 0 GROUP BY ALL) GROUP BY 1, 2""",
}
ORACLE["mod_cross_cor_nested"] = ORACLE["mod_cross_cor"]


def _khist_sql(source: str, by: str, rate: str, count: str) -> str:
    """The adaptive histogram of `source` (k, rate, n): the nearest neighbours merged, one pair a step, until few enough are left."""
    return f"""{_WITH.replace("WITH", "WITH RECURSIVE", 1)}, source AS ({source}),
      exact AS (SELECT k, r, sum(n) AS n FROM (SELECT k, CAST(round(rate * {1 << BITS}) AS BIGINT) AS r, n FROM source) GROUP BY 1, 2),
      steps(k, s, n) AS (SELECT k, list(CAST(r * n AS HUGEINT) ORDER BY r), list(CAST(n AS HUGEINT) ORDER BY r) FROM exact GROUP BY k
        UNION ALL SELECT k, list_concat(s[1:j - 1], list_concat([s[j] + s[j + 1]], s[j + 2:])), list_concat(n[1:j - 1], list_concat([n[j] + n[j + 1]], n[j + 2:])) FROM
          (SELECT k, s, n, list_position(g, list_min(g)) AS j FROM (SELECT *, list_transform(range(1, len(s)), lambda i: CAST(s[i + 1] AS DOUBLE) / CAST(n[i + 1] AS DOUBLE) - CAST(s[i] AS DOUBLE) / CAST(n[i] AS DOUBLE)) AS g
            FROM steps WHERE len(s) > {rates.BINS}))),
      bins AS (SELECT k, unnest(s) AS s, unnest(n) AS n FROM steps WHERE len(s) <= {rates.BINS})
      SELECT k AS "{by}", round(CAST(s AS DOUBLE) / CAST(n AS DOUBLE) / {1 << BITS}, 9) AS "{rate}", CAST(sum(n) AS DOUBLE) AS "{count}" FROM bins GROUP BY 1, 2"""


ORACLE["mod_rate_khist"] = _khist_sql(
    """SELECT mod AS k, CAST(c AS DOUBLE) / qlen AS rate, 1 AS n FROM (SELECT r.read_id, r.qlen, m.mod, count(c.pos) AS c FROM reads r CROSS JOIN mods m
      LEFT JOIN mod_calls c ON c.read_id = r.read_id AND c.mod = m.mod AND c.prob > 229 WHERE r.qlen > 0 GROUP BY ALL)""", "mod", "rate", "count")  # fmt: skip
ORACLE["nuc_msp_rate_khist"] = _khist_sql(
    """SELECT "Feature" AS k, CAST(c AS DOUBLE) / qlen AS rate, 1 AS n FROM (SELECT read_id, qlen, "Feature", count(*) AS c FROM features WHERE qlen > 0 GROUP BY ALL)""",
    "Feature", "Rate", "Count")
ORACLE["metaplot_sweep"] = f"""{_WITH}, mixed AS (SELECT tid, start, stop, strand, label, dw FROM regions UNION ALL
    SELECT tid, start - 50000, stop + 50000, strand, 'wide' || grp, dw + 50000 FROM regions WHERE regionindex % 20 = 0)
  SELECT label AS "Region", mod AS "Mod", CAST(CASE WHEN strand THEN gpos - start ELSE stop - gpos END - dw AS INT) AS xp, count(*) FILTER (prob > 229) AS "FG", count(*) AS "BG"
  FROM mod_calls c JOIN mixed r ON r.tid = c.tid AND c.gpos BETWEEN r.start AND r.stop GROUP BY 1, 2, 3"""
_LONG = {
    "ChromStat": ("chrom_counts", "chrom", "count", {"": "count"}),
    "ReadLengthCounter": ("read_length_hist", "''", "readlength", {"": "count"}),
    "ModHist": ("mod_hist_unpivot", "variable", "ml", {"": "value"}),
    "ModMetaHist": ("mod_meta_hist", "mod", "bin", {"": "count"}),
    "ModRate": ("mod_rate_khist", "mod", "rate", {"": "count"}),
    "NucMSPRate": ("nuc_msp_rate_khist", '"Feature"', '"Rate"', {"": '"Count"'}),
    "NucMSPLenHist": ("nuc_msp_len_hist", '"Feature"', '"Length"', {"": '"Count"'}),
    "ModCrossCor": ("mod_cross_cor", '"ModA" || \'|\' || "ModB"', '"Lag"', {"": '"CrossCor"'}),
    "MetaPlot": ("metaplot", '"Region" || \'|\' || "Mod"', "xp", {"|FG": '"FG"', "|BG": '"BG"'}),
}
_ROWS = ", ".join(f"('{n}', '{REGISTRY[n].file}', '{REGISTRY[n].title}', '{REGISTRY[n].grain}')" for n in sorted(FUSED))
ORACLE["fused_stats"] = " UNION ALL ".join(
    f"SELECT '{stat}' AS stat, {k} || '{end}' AS k, round(CAST({x} AS DOUBLE), {DIGITS}) AS x, round(CAST({v} AS DOUBLE), {DIGITS}) AS value FROM ({ORACLE[query]})"
    for stat, (query, k, x, values) in _LONG.items()
    for end, v in values.items()
)
ORACLE["mod_rate_share"] = f"{_WITH}, {_RATES} SELECT mod, rate, round(count / sum(count) OVER (PARTITION BY mod), {DIGITS}) AS share FROM ratehist"
ORACLE["nuc_msp_len_plot"] = f'SELECT * FROM ({ORACLE["nuc_msp_len_hist"]}) WHERE "Length" > 1'
ORACLE["longest_reads"] = f"{_WITH} SELECT tid, count(*) AS n, max(qlen) AS first, (list(qlen ORDER BY qlen DESC))[2] AS second FROM reads GROUP BY tid"
ORACLE["regions_files"] = f"""{_WITH}, rows AS (SELECT id % 20 AS tid, (id * 997) % 80000 - 51 AS lo, (id * 997) % 80000 + 50 AS hi, id % 2 = 0 AS plus,
    row_number() OVER (PARTITION BY id % 2 ORDER BY id // 3 + 1, id % 3 + 1) AS i FROM (SELECT CAST(s_suppkey AS BIGINT) AS id FROM supplier))
  SELECT CAST(tid AS INT) AS tid, chrom, (lo + 1 + hi) // 2 - dw AS start, (lo + 1 + hi) // 2 + dw AS stop, plus AS strand, i AS regionindex, CAST(CASE WHEN plus THEN 1 ELSE 2 END AS INT) AS "group",
    CASE WHEN plus THEN 'plus' ELSE 'group2' END AS label, dw FROM (SELECT *, CAST(CASE WHEN plus THEN 50 ELSE {regions.DEFAULT_WIDTH} END AS INT) AS dw FROM rows) JOIN contigs USING (tid)"""
ORACLE["saved_stats"] = ORACLE["fused_stats"]
ORACLE["stream_fused_stats"] = ORACLE["fused_stats"]
ORACLE["stats_manifest"] = f"""SELECT v.*, n AS "Rows" FROM (VALUES {_ROWS}) v("Stat", "File", "Title", "Grain") JOIN (SELECT stat, count(*) AS n FROM ({ORACLE["fused_stats"]}) GROUP BY 1) c ON c.stat = v."Stat\""""
