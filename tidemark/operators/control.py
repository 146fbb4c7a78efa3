"""Control decisions by disk pressure, as expressions over rows of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels in order, with the free bytes or basis points below which each is reached, budgets and thresholds.
LEVELS = ("Healthy", "Soft", "Hard", "Critical")
FREE = {"Soft": (400_000, 4_000), "Hard": (200_000, 2_000), "Critical": (100_000, 1_000)}
BUDGET = {"Healthy": 32, "Soft": 64, "Hard": 128, "Critical": 256}
RECLAIM = {"Healthy": 20_000, "Soft": 15_000, "Hard": 18_000, "Critical": 5_000}


def decide(inputs: DataFrame) -> DataFrame:
    """inputs: free_bytes, capacity_bytes, reclaimable, backlog, latency. Pressure, thresholds and whether to run.

    The level is the worst that bytes or ratio reach; thresholds only ever get lower with pressure; from Hard on,
    foreground latency holds nothing back.
    """
    bps = F.when(F.col("capacity_bytes") == 0, F.lit(0).cast("long")).otherwise(F.least(F.call_function("div", F.col("free_bytes") * 10_000, F.col("capacity_bytes")), F.lit(65_535).cast("long")))
    rows = inputs.withColumn("free_bps", bps)
    hit = lambda level: (F.col("free_bytes") <= FREE[level][0]) | (F.col("free_bps") <= FREE[level][1])
    level = F.when(hit("Critical"), 3).when(hit("Hard"), 2).when(hit("Soft"), 1).otherwise(0)
    rows = rows.withColumn("level", level)
    budget, reclaim, least = F.lit(None).cast("long"), F.lit(None).cast("long"), 1 << 62
    for k, name in enumerate(LEVELS):
        least = min(least, RECLAIM[name])
        budget = F.when(F.col("level") == k, F.lit(BUDGET[name]).cast("long")).otherwise(budget)
        reclaim = F.when(F.col("level") == k, F.lit(least).cast("long")).otherwise(reclaim)
    bypass = F.col("level") >= 2
    run = ~F.col("latency") | bypass
    work = (F.col("reclaimable") > 0) | (F.col("backlog") > 0)
    return rows.select(
        *inputs.columns, "free_bps", F.col("level").cast("long").alias("level"), budget.alias("budget"), reclaim.alias("min_reclaim_bytes"),
        bypass.alias("bypasses_latency"), run.alias("may_run"), ((F.col("level") >= 1) & work & run).alias("run_now"),
    )
