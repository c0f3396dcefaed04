"""python -m tidestat BAM [--config YAML] [--out FOLDER] [--reads N] [--report HTML]"""

import argparse
import logging

from pyspark.sql import SparkSession

from tidestat.plans.runner import run_bam


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="tidestat", description="Statistics of a BAM file of long reads.")
    args.add_argument("bam")
    args.add_argument("--config")
    args.add_argument("--out")
    args.add_argument("--reads", type=int)
    args.add_argument("--report")
    got = args.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s", datefmt="%Y-%m-%d %H:%M:%S")
    run_bam(SparkSession.builder.appName("tidestat").getOrCreate(), got.bam, got.config, got.out, got.reads, got.report)


if __name__ == "__main__":
    main()
