"""Placement and reclamation plans: scoring, routing and ranking of segments.

Arithmetic is integer, ratios are basis points. A null frontier disables what depends on the clock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.summaries import live_after


@dataclass(frozen=True)
class Thresholds:
    """Limits of the planner, scaled to the derived tables (FIXTURES.md)."""

    max_copy_bytes: int = 60_000
    max_l0_copy_bytes: int = 200_000
    min_l0_distance: int = 2
    min_l0_useful_bps: int = 6_600
    min_reclaim_bytes: int = 20_000
    min_garbage_bps: int = 6_000
    min_bucket_bytes: int = 500
    min_exact_distance: int = 1
    max_extensions: int = 1
    min_join_bytes: int = 1_000
    max_join_sources: int = 8


#: Fixed weights of a rewrite's score, by scenario.
WEIGHTS = {"L0Compaction": 1500, "DeadRef": 2000, "JoinMultiple": 2500, "PinnedEpochExpiry": 1750}


def ratio_bps(part: Column, whole: Column) -> Column:
    """Basis points of a ratio, 0 of nothing, at most 65535."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.least(F.call_function("div", part * 10_000, whole), F.lit(65_535).cast("long")))


def score(reclaimed: Column, copied: Column, scenario: str) -> Column:
    return F.call_function("div", reclaimed * WEIGHTS[scenario], F.greatest(copied, F.lit(1).cast("long")))


class Planner:
    """Plans over segment_summaries, histogram and extensions of one snapshot."""

    def __init__(self, segments: DataFrame, histogram: DataFrame, extensions: DataFrame, current_epoch: int, writes_merged_epoch: int | None, published_lsn: int = 1 << 62, limits: Thresholds = Thresholds()):  # noqa: B008
        self.limits, self.now, self.histogram = limits, current_epoch, histogram
        #: The clock's cutoff: null without a frontier (least() would skip the null).
        self.cutoff = None if writes_merged_epoch is None else min(writes_merged_epoch, current_epoch)
        unstable = extensions.filter(F.col("extension_count") > limits.max_extensions).select("segment_id").distinct().withColumn("unstable", F.lit(True))
        rows = segments.join(unstable, "segment_id", "left").withColumn("stable", F.col("unstable").isNull()).drop("unstable")
        if self.cutoff is None:
            rows = rows.withColumn("clock_refs", F.col("live_refs")).withColumn("clock_bytes", F.col("live_bytes"))
        else:
            clock = live_after(segments, histogram, self.cutoff).select("segment_id", F.col("live_refs").alias("clock_refs"), F.col("live_bytes").alias("clock_bytes"))
            rows = rows.join(clock, "segment_id")
        rows = rows.withColumn("garbage_bytes", F.col("retired_bytes") + F.col("expired_bytes"))
        complete = F.col("max_lsn").isNull() | (F.col("max_lsn") <= published_lsn)
        ready = ~F.col("claimed") & complete & (F.col("total_bytes") > 0)
        self.all = rows
        self.sources = rows.filter(ready & (F.col("state") == "Sealed"))
        self.deletable = rows.filter(ready & F.col("state").isin("Sealed", "GcRelocating"))

    def _plan(self, rows: DataFrame, scenario: str, action: str, segment: Column | None, copied, reclaim, points) -> DataFrame:
        number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
        return rows.select(F.lit(scenario).alias("scenario"), F.lit(action).alias("action"), number(segment if segment is not None else None).alias("segment_id"), number(copied).alias("copied_bytes"), number(reclaim).alias("reclaim_bytes"), number(points).alias("score"))

    def routes(self, rows: DataFrame | None = None) -> DataFrame:
        """segment_id, end_epoch, destination, refs, bytes: where live bytes of each segment would go."""
        rows = self.all if rows is None else rows
        limits = self.limits
        buckets = self.histogram.filter("bytes > 0 AND refs > 0")
        if self.cutoff is not None:
            buckets = buckets.filter(F.col("end_epoch") > self.cutoff)
        useful = (F.col("end_epoch") - self.now >= max(limits.min_exact_distance, 1)) & (F.col("bytes") >= limits.min_bucket_bytes)
        known = buckets.join(rows.select("segment_id", "stable"), "segment_id").select("segment_id", "end_epoch", F.when(F.col("stable") & useful, "ExactEpoch").otherwise("Spillover").alias("destination"), "refs", "bytes")
        unknown = rows.filter("unknown_bytes > 0").select("segment_id", F.lit(None).cast("long").alias("end_epoch"), F.lit("Spillover").alias("destination"), F.col("unknown_refs").alias("refs"), F.col("unknown_bytes").alias("bytes"))
        return known.unionByName(unknown)

    def empty_deletes(self) -> DataFrame:
        """One plan for all segments that hold nothing live; none where there are none."""
        got = self.deletable.filter("clock_refs = 0").agg(F.count("*").alias("n"), F.sum("total_bytes").alias("b")).filter("n > 0")
        return self._plan(got, "EmptyDelete", "DeleteSegments", None, 0, F.col("b"), F.col("b") * 10_000)

    def l0(self, accounted_lsn: int | None = 1 << 62) -> DataFrame:
        """Ingest segments: rewritten if enough of them has a useful lifetime, else reclassified together."""
        limits = self.limits
        rows = self.sources.filter("placement = 'Ingest'")
        rows = rows.filter("unknown_bytes = 0" if accounted_lsn is None else (F.col("unknown_bytes") == 0) | F.col("max_lsn").isNull() | (F.col("max_lsn") <= accounted_lsn))
        own = self.histogram.filter((F.col("bytes") > 0) & (F.col("refs") > 0) & (F.col("end_epoch") - self.now >= max(limits.min_l0_distance, 1))).groupBy("segment_id").agg(F.sum("bytes").alias("useful"))
        rows = rows.join(own, "segment_id", "left").fillna(0, ["useful"])
        rows = rows.withColumn("worth", (F.col("useful") > 0) & (ratio_bps(F.col("useful"), F.col("live_bytes")) >= limits.min_l0_useful_bps))
        moved = rows.filter(F.col("worth") & (F.col("live_bytes") <= limits.max_l0_copy_bytes))
        routed = moved.join(self.routes(moved).select("segment_id").distinct(), "segment_id", "left_semi").unionByName(moved.filter("live_bytes = 0"))
        move = self._plan(routed, "L0Compaction", "MoveLiveBytes", F.col("segment_id"), F.col("live_bytes"), F.col("total_bytes"), score(F.col("useful"), F.col("live_bytes"), "L0Compaction"))
        rest = rows.filter("NOT worth").agg(F.count("*").alias("n"), F.sum("total_bytes").alias("b")).filter("n > 0")
        return move.unionByName(self._plan(rest, "L0Compaction", "ReclassifySegments", None, 0, 0, F.col("b")))

    def dead_refs(self) -> DataFrame:
        limits = self.limits
        rows = self.sources.filter("placement <> 'Ingest'").filter((F.col("garbage_bytes") >= limits.min_reclaim_bytes) & (ratio_bps(F.col("garbage_bytes"), F.col("total_bytes")) >= limits.min_garbage_bps) & (F.col("live_bytes") <= limits.max_copy_bytes))
        return self._plan(rows, "DeadRef", "MoveLiveBytes", F.col("segment_id"), F.col("live_bytes"), F.col("garbage_bytes"), score(F.col("garbage_bytes"), F.col("live_bytes"), "DeadRef"))

    def join_sources(self) -> DataFrame:
        """end_epoch, segment_id, bytes, garbage_bytes: segments whose live bytes all end in one useful epoch; the largest of each."""
        limits = self.limits
        rows = self.sources.filter("placement <> 'Ingest' AND stable").select("segment_id", "live_bytes", "live_refs", "garbage_bytes").join(self.histogram, "segment_id")
        rows = rows.filter((F.col("bytes") == F.col("live_bytes")) & (F.col("refs") == F.col("live_refs")) & (F.col("end_epoch") - self.now >= max(limits.min_exact_distance, 1)) & (F.col("bytes") >= limits.min_bucket_bytes))
        place = F.row_number().over(Window.partitionBy("end_epoch").orderBy(F.desc("bytes"), "segment_id"))
        return rows.withColumn("_n", place).filter(F.col("_n") <= limits.max_join_sources).select("end_epoch", "segment_id", "bytes", "garbage_bytes")

    def joins(self) -> DataFrame:
        limits = self.limits
        rows = self.join_sources().groupBy("end_epoch").agg(F.count("*").alias("n"), F.sum("bytes").alias("copied"), F.sum("garbage_bytes").alias("reclaim"))
        rows = rows.filter((F.col("n") >= 2) & (F.col("copied") >= limits.min_join_bytes) & (F.col("copied") <= limits.max_copy_bytes))
        return self._plan(rows, "JoinMultiple", "MoveLiveBytesFromSources", F.col("end_epoch"), F.col("copied"), F.col("reclaim"), score(F.col("reclaim"), F.col("copied"), "JoinMultiple") + F.col("n"))

    def pinned(self) -> DataFrame:
        """Exact-epoch segments whose epoch is over and which the clock still finds live."""
        if self.cutoff is None:
            return self._plan(self.sources.filter("false"), "PinnedEpochExpiry", "MoveLiveBytes", F.col("segment_id"), 0, 0, 0)
        rows = self.sources.filter((F.col("placement") == "ExactEpoch") & (F.col("placement_epoch") <= self.cutoff) & (F.col("clock_bytes") > 0))
        reclaim = F.greatest(F.col("total_bytes") - F.col("clock_bytes"), F.lit(0).cast("long"))
        small = rows.filter(F.col("clock_bytes") <= self.limits.max_copy_bytes)
        move = self._plan(small, "PinnedEpochExpiry", "MoveLiveBytes", F.col("segment_id"), F.col("clock_bytes"), reclaim, score(reclaim, F.col("clock_bytes"), "PinnedEpochExpiry"))
        large = rows.filter(F.col("clock_bytes") > self.limits.max_copy_bytes)
        return move.unionByName(self._plan(large, "PinnedEpochExpiry", "ReclassifySegment", F.col("segment_id"), 0, 0, F.col("clock_bytes")))

    def plans(self) -> DataFrame:
        """All plans. Rank them with ranked(); they may overlap, and claims settle that later."""
        return self.empty_deletes().unionByName(self.l0()).unionByName(self.dead_refs()).unionByName(self.joins()).unionByName(self.pinned())


def ranked(plans: DataFrame) -> DataFrame:
    """Plans in order: deletes of empty segments, then the best score; ties by scenario as listed, then segment."""
    order = F.array_position(F.array(*map(F.lit, ("EmptyDelete", "L0Compaction", "DeadRef", "JoinMultiple", "PinnedEpochExpiry"))), F.col("scenario"))
    return plans.orderBy((F.col("scenario") == "EmptyDelete").desc(), F.desc("score"), order, F.col("segment_id").asc_nulls_last())
