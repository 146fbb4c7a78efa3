"""Quantiles as the benches define them, and the deterministic generator.

Ranks are exact and grouped: values are counted first, so that a hot group is as small as its distinct values, and ranks
come from running counts. No array of a whole group is ever built.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_ranks(rows: DataFrame, group: str, value: str, percents: dict[str, int]) -> DataFrame:
    """group and, for each name, the value at position round(p * (n - 1) / 100) of the sorted group (halves go up)."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("_to", upto).withColumn("_n", F.sum("_c").over(Window.partitionBy(group)))
    at = lambda p: F.expr(f"((_n - 1) * {p} * 2 + 100) div 200")
    hit = lambda p: F.max(F.when((at(p) < F.col("_to")) & (at(p) >= F.col("_to") - F.col("_c")), F.col(value)))
    return counted.groupBy(group).agg(*(hit(p).alias(name) for name, p in percents.items()))


def timing_summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, average (rounded down), p50, p99, most."""
    base = rows.groupBy(group).agg(F.count("*").alias("n"), F.expr(f"sum({value}) div count(*)").alias("average"), F.max(value).alias("most"))
    return base.join(nearest_ranks(rows, group, value, {"p50": 50, "p99": 99}), group)


def bucket_quantile(rows: DataFrame, group: str, value: str, bounds: list[int], percent: int, name: str) -> DataFrame:
    """group and the upper bound of the bucket that holds the percentile; values beyond the last count as in it."""
    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col(value) <= b, b).otherwise(bucket)
    counted = rows.groupBy(group, bucket.cast("long").alias("_b")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("_c").over(Window.partitionBy(group))
    return counted.withColumn("_to", upto).withColumn("_n", whole).filter(F.col("_to") * 100 >= F.col("_n") * percent).groupBy(group).agg(F.min("_b").alias(name))


def splitmix64(rows: DataFrame, seed: str, name: str) -> DataFrame:
    """rows with the first draw of the public SplitMix64 generator from a seed column, as a signed number."""

    @F.pandas_udf("long")
    def draw(s: pd.Series) -> pd.Series:
        x = s.to_numpy(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return pd.Series((x ^ (x >> np.uint64(31))).view(np.int64))

    return rows.withColumn(name, draw(seed))
