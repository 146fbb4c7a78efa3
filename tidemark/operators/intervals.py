"""Byte ranges: union, difference, containment. Always with the segment as an equality key of the join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesce_ranges(ranges: DataFrame, key: str = "segment_id") -> DataFrame:
    """key, start, end: overlapping and touching ranges as one (gaps and islands over a running maximum)."""
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def subtract_ranges(minuend: DataFrame, subtrahend: DataFrame, key: str = "segment_id") -> DataFrame:
    """key, start, end of what the first ranges cover and the second don't, by a sweep over boundaries."""
    edge = lambda df, at, a, b: df.select(key, F.col(at).alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    edges = edge(minuend, "start", 1, 0).unionByName(edge(minuend, "end", -1, 0)).unionByName(edge(subtrahend, "start", 0, 1)).unionByName(edge(subtrahend, "end", 0, -1))
    steps = edges.groupBy(key, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy(key).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.select(key, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.sum("a").over(upto).alias("in_a"), F.sum("b").over(upto).alias("in_b"))
    return coalesce_ranges(rows.filter("in_a > 0 AND in_b = 0 AND end IS NOT NULL").select(key, "start", "end"), key)


def classify(records: DataFrame, retired: DataFrame, expired: DataFrame, key: str = "segment_id") -> DataFrame:
    """records (key, start, end) with state: retired before expired before live; a range that cuts a record raises.

    Both range sets must be coalesced: then at most one of their ranges holds a record, and the last one that starts at
    or before a record is the one to look at, so that the range join is a running last value.
    """
    out = records
    for name, ranges in (("retired", retired), ("expired", expired)):
        tagged = out.withColumn("_range", F.lit(False)).unionByName(ranges.select(key, "start", "end").withColumn("_range", F.lit(True)), allowMissingColumns=True)
        at_or_before = Window.partitionBy(key).orderBy("start", F.desc("_range"), "end").rowsBetween(Window.unboundedPreceding, 0)
        after = Window.partitionBy(key).orderBy("start", F.desc("_range"), "end").rowsBetween(1, Window.unboundedFollowing)
        reach = F.last(F.when(F.col("_range"), F.col("end")), ignorenulls=True).over(at_or_before)
        next_start = F.first(F.when(F.col("_range"), F.col("start")), ignorenulls=True).over(after)
        tagged = tagged.withColumn("_reach", reach).withColumn("_next", next_start).filter("NOT _range")
        cut = ((F.col("_reach") > F.col("start")) & (F.col("_reach") < F.col("end"))) | (F.col("_next") < F.col("end"))
        inside = F.coalesce(F.col("_reach") >= F.col("end"), F.lit(False))
        state = F.when(F.coalesce(cut, F.lit(False)), F.raise_error(F.lit("a range covers a part of a record")).cast("boolean")).otherwise(inside)
        out = tagged.withColumn(f"_{name}", state).drop("_range", "_reach", "_next")
    state = F.when(F.col("_retired"), "retired").when(F.col("_expired"), "expired").otherwise("live")
    return out.withColumn("state", state).drop("_retired", "_expired")


def overlapping_pairs(a: DataFrame, b: DataFrame, block: int) -> DataFrame:
    """a (id, first, last) and b (id, first, last): a_id, b_id of closed ranges that share a value.

    Each range is entered in every block that it touches, blocks are joined by equality, and a pair counts in the first
    block that both touch, so that none is met twice and nothing has to be made distinct.
    """
    entered = lambda df, x: df.select(F.col("id").alias(f"{x}_id"), F.col("first").alias(f"{x}_first"), F.col("last").alias(f"{x}_last"), F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"last div {block}"))).alias("block"))
    met = entered(a, "a").join(entered(b, "b"), "block").filter("a_first <= b_last AND b_first <= a_last")
    return met.filter(F.col("block") == F.expr(f"greatest(a_first, b_first) div {block}")).select("a_id", "b_id")
