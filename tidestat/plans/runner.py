"""End-to-end runs: compute, write, read back, report."""

from __future__ import annotations

import logging
import time
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from tidestat.plans.fused import fused, shares
from tidestat.plans.report import html_report, sample_name
from tidestat.plans.sinks import SavedStats, read_stats, write_stats
from tidestat.registry import stats
from tidestat.schema import READS
from tidestat.sources import regions
from tidestat.sources.config import StatConfig, load
from tidestat.sources.relations import Relations

log = logging.getLogger("tidestat")


BANNER = "tidestat | statistics over long sequencing reads"


def run_stats(rel: Relations, path: str, config: StatConfig | str | None = None, nr: int | None = None, report: str | None = None) -> SavedStats:
    """Compute the configured statistics over the first nr reads (None or -1: all), write them, read them back.

    Those that have cells (all nine) come from one pass over the reads, whose sums stay cached until they are written (a lost part is
    computed again); any others read the reads, which stay cached as well then.
    ``report``: a local file for the HTML report.
    """
    return _run(rel.limit(nr), path, config, report)


def _run(rel: Relations, path: str, config: StatConfig | str | None, report: str | None) -> SavedStats:
    import tidestat.operators  # noqa: F401  registers the statistics

    began = time.monotonic()
    conf = _config(config)
    chosen = stats(conf.stats, conf.configs)
    spark = rel.reads.sparkSession
    if rel.regions is None and isinstance(conf.configs.get("MetaPlot"), list):
        loaded = regions.load_many(spark, conf.configs["MetaPlot"])
        for r in regions.missing_contigs(loaded, rel.contigs).collect():  # a row for each unknown contig
            log.warning("%d regions are on %s, which the header lacks: left out", r["count"], r["chrom"])
        rel = Relations(rel.reads, rel.contigs, regions.to_tid(loaded, rel.contigs))
    log.info("output: %s", path)
    log.info("computing %s", ", ".join(s.name for s in chosen))
    together = [s for s in chosen if shares(s)]
    kept = rel.reads.persist(StorageLevel.MEMORY_AND_DISK) if len(together) < len(chosen) > 1 else None  # more than one reads them
    cells = None
    try:
        done = {}
        if together:
            done = fused(together, rel)
            cells = done.cells
        results = write_stats(chosen, rel, path, done=done)
        saved = read_stats(spark, path, schemas={k: v.schema for k, v in results.items()})  # also of a registry's own
    finally:
        for frame in (kept, cells):
            if frame is not None:
                frame.unpersist()
    if report:
        stat_report(saved, report)
        log.info("report: %s", report)
    log.info("done in %.1f s", time.monotonic() - began)
    return saved


def _config(config: StatConfig | str | None) -> StatConfig:
    return config if isinstance(config, StatConfig) else load(config) if config else StatConfig()


def run_bam(spark: SparkSession, bam: str, config: StatConfig | str | None = None, path: str | None = None, nr: int | None = None, report: str | None = None) -> SavedStats:
    """run_stats of a BAM file (or a folder of them) in the file's own order, which ends the reading after nr reads. Results go to
    the folder `stats` beside the file unless path is given; regions come from the configuration's MetaPlot files. Only what the statistics
    need of a read is decoded; a run of MetaPlot alone reads the blocks that its regions touch, if the file has an index."""
    import tidestat.operators  # noqa: F401  registers the statistics
    from tidestat.sources import bam as source

    log.info(BANNER)
    log.info("file: %s", bam)
    log.info("configuration: %s", config if isinstance(config, str) else "given" if config else "the default")
    log.info("reads: %s", "all" if nr in (None, -1) else f"the first {nr}")
    where = path or f"{str(bam).rstrip('/').rpartition('/')[0] or '.'}/stats"
    conf = _config(config)
    contigs = source.bam_contigs(spark, bam)
    needed = {"read_id", "tid", "qlen"}.union(*[s.columns for s in stats(conf.stats, conf.configs)])
    near = None
    if conf.stats == ("MetaPlot",) and nr in (None, -1) and isinstance(conf.configs.get("MetaPlot"), list):
        near = source.region_intervals(regions.to_tid(regions.load_many(spark, conf.configs["MetaPlot"]), contigs))
    reads = source.read_bam(spark, bam, columns=[c for c in READS.names if c in needed], intervals=near)
    return _run(Relations(reads, contigs).head(nr), where, conf, report)


def run_report(spark: SparkSession, path: str, file: str) -> str:
    """The HTML report of the statistics saved under path; its path."""
    return stat_report(read_stats(spark, path), file)


def stat_report(saved: SavedStats, file: str) -> str:
    """Write the HTML report of saved statistics; its path."""
    Path(file).write_text(html_report(sample_name(saved.path), saved.stats))
    return file
