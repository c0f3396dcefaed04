"""The single-pass statistics over a stream of reads.

Each is one keyed aggregation over the rows (per-read values are computed in the row), so the state is the histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidestat.operators.crosscor import LAGS, lag_sums, nested_positions
from tidestat.operators.metaplot import profile_counts
from tidestat.operators.rates import exact_hist, feature_rates, mod_rates
from tidestat.schema import CONFIDENT, MODS, READS
from tidestat.sources.relations import Relations


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """reads as they arrive as parquet files under path."""
    reader = spark.readStream.schema(READS)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def streaming_stat(reads: DataFrame, name: str, regions: DataFrame | None = None) -> DataFrame:
    """The aggregation `name` over a stream (or a batch) of reads: observed bins only, and for ModCrossCor the sums over reads.

    MetaPlot joins the stream with a static table of regions.
    """
    if name == "MetaPlot" and regions is None:
        raise ValueError("MetaPlot needs regions")
    calls = lambda: reads.select("qlen", F.inline("mods"))
    plans = {
        "ChromStat": lambda: reads.groupBy("tid").agg(F.count("*").alias("count")),
        "ReadLengthCounter": lambda: reads.groupBy(F.col("qlen").alias("readlength")).agg(F.count("*").alias("count")),
        "ModHist": lambda: calls().groupBy("mod", F.col("prob").alias("ml")).agg(F.count("*").alias("count")),
        "ModMetaHist": lambda: calls()
        .where((F.col("prob") > CONFIDENT) & (F.col("qlen") > 0))
        .groupBy("mod", F.greatest(F.floor(1000 * F.col("pos") / F.col("qlen")), F.lit(1)).cast("int").alias("i"))
        .agg(F.count("*").alias("count")),
        "NucMSPLenHist": lambda: Relations(reads, None)
        .features.where(F.col("len").between(1, 1000))
        .groupBy(F.col("feature").alias("Feature"), F.col("len").alias("Length"))
        .agg(F.count("*").alias("Count")),
        "ModCrossCor": lambda: lag_sums(nested_positions(reads), range(len(MODS)), LAGS),
        "MetaPlot": lambda: profile_counts(reads.select("tid", F.inline("mods")), regions),
        "ModRate": lambda: exact_hist(mod_rates(reads), "mod", "rate", "count", 6),
        "NucMSPRate": lambda: exact_hist(feature_rates(reads), "Feature", "Rate", "Count", 6),
    }
    if name not in plans:
        raise KeyError(f"no streaming form of {name!r}; known: {sorted(plans)}")
    return plans[name]()


def start(result: DataFrame, sink: str, checkpoint: str, fmt: str = "memory") -> StreamingQuery:
    """Run to the end of what is there, keeping the complete result in `sink`."""
    writer = result.writeStream.outputMode("complete").format(fmt).option("checkpointLocation", checkpoint)
    return writer.queryName(sink).trigger(availableNow=True).start()
