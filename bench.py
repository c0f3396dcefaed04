"""Times the headline queries on $BENCH_SF_DIR; one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidestat import queries as own
from tidestat.sources import adapter

HEADLINE = (
    "chrom_counts",
    "read_length_hist",
    "mod_hist",
    "mod_meta_hist",
    "mod_rate_exact",
    "mod_rate_khist",
    "nuc_msp_rate_exact",
    "nuc_msp_len_hist",
    "mod_cross_cor",
    "interval_overlap",
    "metaplot",
    "sample_summary",
    "mod_summary",
    "rate_boxplot",
)
#: Timed beside the total, which stays comparable from round to round.
BESIDE = ("metaplot_sweep", "fused_stats")


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [here, os.environ.get("PYTHONPATH")]))  # for the workers, wherever this is run
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    spark.read.parquet(f"{d}/documents.parquet").selectExpr("sum(n_chars)").write.format("noop").mode("overwrite").save()  # starts the engine
    began = time.perf_counter()
    adapter.from_documents(spark, d)  # the reads are decoded once, for all that follow
    took["decode_reads"] = round(time.perf_counter() - began, 3)

    def timed(names: tuple[str, ...]) -> dict[str, float]:
        out = {}
        for name in names:
            began = time.perf_counter()
            own.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            out[name] = round(time.perf_counter() - began, 3)
        return out

    took |= timed(HEADLINE)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "beside": timed(BESIDE), "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
