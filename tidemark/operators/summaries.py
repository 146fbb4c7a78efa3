"""Garbage accounting: segment summaries from versions, the same as sums of signed deltas, and views by the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarize(versions: DataFrame) -> DataFrame:
    """segment_id and its counters: one aggregation, combined on the map side."""
    live = F.col("retire_lsn").isNull()
    unknown = live & F.col("end_epoch").isNull()
    total = lambda on, what="len": F.coalesce(F.sum(F.when(on, F.col(what))), F.lit(0))
    return versions.groupBy("segment_id").agg(
        F.sum("len").alias("total_bytes"),
        total(live).alias("live_bytes"),
        total(~live).alias("retired_bytes"),
        F.lit(0).cast("long").alias("expired_bytes"),
        F.count_if(live).alias("live_refs"),
        total(unknown).alias("unknown_bytes"),
        F.count_if(unknown).alias("unknown_refs"),
        F.min(F.when(live, F.col("end_epoch"))).alias("min_end_epoch"),
        F.max(F.when(live, F.col("end_epoch"))).alias("max_end_epoch"),
    )


def end_epoch_histogram(versions: DataFrame) -> DataFrame:
    """segment_id, end_epoch, refs, bytes of live versions with a lifetime."""
    rows = versions.filter("retire_lsn IS NULL AND end_epoch IS NOT NULL")
    return rows.groupBy("segment_id", "end_epoch").agg(F.count("*").alias("refs"), F.sum("len").alias("bytes"))


def extension_histogram(versions: DataFrame) -> DataFrame:
    """segment_id, extension_count, refs of live versions with a lifetime."""
    rows = versions.filter("retire_lsn IS NULL AND end_epoch IS NOT NULL")
    return rows.groupBy("segment_id", "extension_count").agg(F.count("*").alias("refs"))


def deltas(versions: DataFrame) -> DataFrame:
    """segment_id, metric, bucket, delta: the changelog behind the summaries, in long form.

    Each record allocates, live and of unknown lifetime; a retirement moves its bytes; a lifetime moves them to a bucket.
    """
    one, size = F.lit(1).cast("long"), F.col("len")
    none = F.lit(None).cast("long")
    row = lambda metric, delta, on=None, bucket=none: F.when(F.lit(True) if on is None else on, F.struct(F.lit(metric).alias("metric"), bucket.alias("bucket"), delta.alias("delta")))
    dead = F.col("retire_lsn").isNotNull()
    known = ~dead & F.col("end_epoch").isNotNull()
    moves = F.array(
        row("total_bytes", size), row("live_bytes", size), row("live_refs", one), row("unknown_bytes", size), row("unknown_refs", one),
        row("live_bytes", -size, dead), row("live_refs", -one, dead), row("unknown_bytes", -size, dead), row("unknown_refs", -one, dead), row("retired_bytes", size, dead),
        row("unknown_bytes", -size, known), row("unknown_refs", -one, known),
        row("epoch_bytes", size, known, F.col("end_epoch")), row("epoch_refs", one, known, F.col("end_epoch")), row("extension_refs", one, known, F.col("extension_count")),
    )
    return versions.select("segment_id", F.explode(F.array_compact(moves)).alias("d")).select("segment_id", "d.*")


def apply_deltas(changes: DataFrame) -> DataFrame:
    """segment_id, metric, bucket, value: sums of deltas without those that cancel out; one below zero raises."""
    sums = changes.groupBy("segment_id", "metric", "bucket").agg(F.sum("delta").alias("value")).filter("value <> 0")
    guard = F.when(F.col("value") < 0, F.raise_error(F.lit("a summary counter fell below zero")).cast("long")).otherwise(F.col("value"))
    return sums.withColumn("value", guard)


def live_after(summaries: DataFrame, histogram: DataFrame, epoch: int) -> DataFrame:
    """segment_id, live_refs, live_bytes by the clock: buckets that end later, unknown ones, and what no bucket holds."""
    later = F.col("end_epoch") > epoch
    zero = F.lit(0)
    sums = histogram.groupBy("segment_id").agg(
        F.sum("refs").alias("h_refs"), F.sum("bytes").alias("h_bytes"),
        F.coalesce(F.sum(F.when(later, F.col("refs"))), zero).alias("l_refs"), F.coalesce(F.sum(F.when(later, F.col("bytes"))), zero).alias("l_bytes"),
    )
    rows = summaries.join(sums, "segment_id", "left").fillna(0, ["h_refs", "h_bytes", "l_refs", "l_bytes"])
    part = lambda what, live: F.col(f"unknown_{what}") + F.col(f"l_{what}") + F.greatest(F.col(live) - F.col(f"unknown_{what}") - F.col(f"h_{what}"), zero)
    return rows.select("segment_id", part("refs", "live_refs").alias("live_refs"), part("bytes", "live_bytes").alias("live_bytes"))


def as_of_epoch(summaries: DataFrame, histogram: DataFrame, epoch: int) -> DataFrame:
    """The summaries with ended buckets moved from live to expired."""
    ended, later = F.col("end_epoch") <= epoch, F.when(F.col("end_epoch") > epoch, F.col("end_epoch"))
    sums = histogram.groupBy("segment_id").agg(
        F.coalesce(F.sum(F.when(ended, F.col("bytes"))), F.lit(0)).alias("e_bytes"), F.coalesce(F.sum(F.when(ended, F.col("refs"))), F.lit(0)).alias("e_refs"),
        F.min(later).alias("lo"), F.max(later).alias("hi"),
    )
    rows = summaries.join(sums, "segment_id", "left").fillna(0, ["e_bytes", "e_refs"])
    return rows.select(
        "segment_id", "total_bytes", F.greatest(F.col("live_bytes") - F.col("e_bytes"), F.lit(0)).alias("live_bytes"), F.greatest(F.col("live_refs") - F.col("e_refs"), F.lit(0)).alias("live_refs"),
        "retired_bytes", (F.col("expired_bytes") + F.col("e_bytes")).alias("expired_bytes"), F.col("lo").alias("min_end_epoch"), F.col("hi").alias("max_end_epoch"),
    )
