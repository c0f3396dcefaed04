"""tidestat: quality-control statistics over long sequencing reads, as Spark DataFrames.

The library models reads, base-modification calls, nucleosome / accessible-patch features and genomic
regions as relations and expresses every statistic as a declarative DataFrame plan.
"""

from tidestat.plans.runner import run_bam, run_report, run_stats, stat_report
from tidestat.registry import REGISTRY, Stat, register, stats

__all__ = ["REGISTRY", "Stat", "register", "run_bam", "run_report", "run_stats", "stat_report", "stats"]
