"""TSV outputs with a manifest, and reading them back."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidestat.plans.tsv import write_tsv
from tidestat.registry import REGISTRY, Stat
from tidestat.schema import MANIFEST
from tidestat.sources.relations import Relations


def write_table(df: DataFrame, path: str) -> str:
    """One TSV file with a header, gzipped iff the path ends in .gz."""
    return write_tsv(df, path)


def write_stats(
    stats: Iterable[Stat], rel: Relations, path: str, manifest: str = "meta.tsv", done: Mapping[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Write every statistic under path, with the manifest (Stat, File): results by name, those in `done` as they are, others computed."""
    spark = rel.reads.sparkSession
    results, rows = {}, []
    for s in stats:
        df = (done or {}).get(s.name)
        df = s.compute(rel) if df is None else df
        write_table(df, f"{path}/{s.file}")
        rows.append((s.name, s.file))
        results[s.name] = df
    write_table(spark.createDataFrame(rows, MANIFEST), f"{path}/{manifest}")
    return results


@dataclass(frozen=True)
class SavedStats:
    path: str
    meta: DataFrame
    stats: Mapping[str, DataFrame]


def read_stats(spark: SparkSession, path: str, manifest: str = "meta.tsv", schemas: Mapping | None = None) -> SavedStats:
    """The manifest and each table that it lists; types come from `schemas` or the registry, and are inferred where neither has them."""
    meta = spark.read.schema(MANIFEST).csv(f"{path}/{manifest}", sep="\t", header=True)
    out = {}
    for name, file in meta.collect():  # a row for each statistic
        schema = (schemas or {}).get(name)
        if schema is None and name in REGISTRY:
            header = (spark.read.text(f"{path}/{file}").first() or [""])[0].split("\t")
            schema = REGISTRY[name].schema_of(header)
        reader = spark.read.schema(schema) if schema is not None else spark.read.option("inferSchema", True)
        out[name] = reader.csv(f"{path}/{file}", sep="\t", header=True)
    return SavedStats(path, meta, out)
