"""Streaming queries: drained now, they must equal what the batch operators make of the same log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.model import LAST_EPOCH, Model, duck
from tidemark.streaming.sweep import fold_stream, forwarded, log_stream, run_batches, stream_in_parts, swept


def _sweep(spark: SparkSession, sf_dir: str, tries: int = 1) -> dict[str, DataFrame]:
    log = Model(spark, sf_dir).mutations
    frontier = log.groupBy("k").agg((F.max("lsn") - 200 * (F.col("k") % 2)).alias("through"))
    deleted = log.select("k").distinct().filter("k % 11 = 0")
    return swept(log_stream(spark, sf_dir), frontier, deleted, tries)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after a stream of four batches."""
    log = Model(spark, sf_dir).mutations
    last = log.agg(F.max("lsn")).head()[0] or 0
    return fold_stream(stream_in_parts(log, "lsn", [last // 4, last // 2, 3 * last // 4]))


def forwarded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir).settled()
    names = ["segment_id", "offset", "event_lsn", "event"]
    middle = m.garbage_events.agg(F.max("event_lsn")).head()[0] or 0
    moves = m.relocations.select((F.col("to_segment") - 1000).alias("segment_id"), F.col("to_offset").alias("offset"), "to_segment")
    return forwarded(stream_in_parts(m.garbage_events.select(*names), "event_lsn", [middle // 2]), moves)


def drained_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    def each(batch: DataFrame, number: int, folder: str) -> None:
        batch.groupBy("op").agg(F.count("*").alias("n"), F.max("lsn").alias("last")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    folder = run_batches(log_stream(spark, sf_dir), each, "drain")
    got = spark.read.schema("op string, n long, last long").parquet(f"{folder}/out/*")
    return got.groupBy("op").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The LSN up to which nothing is pending: just below the first pending row, or the end of the log."""
    pending = _sweep(spark, sf_dir)["pending"]
    end = Model(spark, sf_dir).mutations.agg(F.max("lsn")).scalar()
    return pending.agg(F.min("lsn").alias("first")).select(F.coalesce(F.col("first") - 1, end).alias("frontier"))


QUERIES = {
    "ss01_drained_log": drained_log,
    "ss02_swept_sums": lambda spark, sf_dir: _sweep(spark, sf_dir)["applied"],
    "ss03_pending_rows": lambda spark, sf_dir: _sweep(spark, sf_dir)["pending"].select("lsn", "k", "op"),
    "ss04_dropped_rows": lambda spark, sf_dir: _sweep(spark, sf_dir)["dropped"],
    "ss05_frontier": frontier,
    "ss06_stateful_fold": lambda spark, sf_dir: _states(spark, sf_dir).select("k", "live"),
    "ss07_lazy_epochs": lambda spark, sf_dir: _states(spark, sf_dir).select("k", (F.col("live") - F.size(F.filter("ends", lambda e: e <= LAST_EPOCH))).alias("readable")),
    "ss08_forwarded_events": forwarded_events,
    "ss09_tried_again": lambda spark, sf_dir: _sweep(spark, sf_dir, tries=2)["applied"],
}

_LATE = "WITH f AS (SELECT k, max(lsn) - 200 * (k % 2) AS through FROM mutations GROUP BY k)"
SQL = {
    "ss01_drained_log": duck("SELECT op, count(*)::BIGINT AS n, max(lsn) AS last FROM mutations GROUP BY op"),
    "ss02_swept_sums": duck(f"{_LATE} SELECT k, count(*)::BIGINT AS puts, sum(len)::BIGINT AS bytes FROM mutations JOIN f USING (k) WHERE lsn <= through AND op = 'put' AND k % 11 <> 0 GROUP BY k"),
    "ss03_pending_rows": duck(f"{_LATE} SELECT lsn, k, op FROM mutations JOIN f USING (k) WHERE lsn > through AND k % 11 <> 0"),
    "ss04_dropped_rows": duck("SELECT k, count(*)::BIGINT AS n FROM mutations WHERE k % 11 = 0 GROUP BY k"),
    "ss07_lazy_epochs": duck("SELECT k, count(*) FILTER (retire_lsn IS NULL AND (end_epoch IS NULL OR end_epoch > 29)) AS readable FROM (SELECT k, retire_lsn, end_epoch FROM versions UNION ALL SELECT DISTINCT k, -1, NULL FROM mutations) GROUP BY k"),
    "ss08_forwarded_events": duck('SELECT segment_id, "offset", event_lsn, event FROM garbage_events UNION ALL SELECT r.to_segment, "offset", event_lsn, event FROM garbage_events g JOIN relocations r ON r.to_segment = g.segment_id + 1000 AND r.to_offset = g."offset"'),
    "ss05_frontier": duck(f"{_LATE} SELECT coalesce(min(lsn) - 1, (SELECT max(lsn) FROM mutations)) AS frontier FROM mutations JOIN f USING (k) WHERE lsn > through AND k % 11 <> 0"),
    "ss06_stateful_fold": duck("SELECT k, count(*) FILTER (retire_lsn IS NULL) AS live FROM (SELECT k, retire_lsn FROM versions UNION ALL SELECT DISTINCT k, -1 FROM mutations) GROUP BY k"),
}
SQL["ss09_tried_again"] = SQL["ss02_swept_sums"]
