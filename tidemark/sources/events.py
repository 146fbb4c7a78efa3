"""The domain tables, derived from the driver's ``events`` by integer arithmetic (see FIXTURES.md).

Everything is lazy and distributed. Positions in the log are numbered block by block, so that no window ever runs over
the whole log in one task: a block holds a bounded number of log positions, and only block totals are accumulated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Log positions (LSNs) of a block when rows are numbered.
BLOCK = 1 << 16
#: Records of a segment.
SEGMENT_RECORDS = 128
ORIGIN = "2024-01-01"


def mutations(spark: SparkSession, sf_dir: str, through_epoch: int | None = None) -> DataFrame:
    """lsn, k, shard, epoch, op (put, life, tomb, del), end_epoch, len: one row for each event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    epoch = F.datediff(F.to_date("ts"), F.lit(ORIGIN).cast("date")).cast("long")
    op = (
        F.when(F.col("event_type") == "purchase", "life")
        .when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0), "del")
        .when(F.col("event_type") == "error", "tomb")
        .otherwise("put")
    )
    out = events.select(
        (2 * F.col("event_id") + 2).alias("lsn"),
        F.col("user_id").alias("k"),
        (F.col("event_id") % 3).alias("shard"),
        epoch.alias("epoch"),
        op.alias("op"),
        (epoch + 1 + F.col("event_id") % 12).alias("end_epoch"),
        (64 + (1 + (F.col("event_id") * 7919) % 4096) + 4).alias("len"),
    )
    return out if through_epoch is None else out.filter(F.col("epoch") <= through_epoch)


def epoch_changes(log: DataFrame) -> DataFrame:
    """lsn, epoch: where each epoch begins; the log starts in epoch 0."""
    begun = log.filter("epoch > 0").groupBy("epoch").agg((F.min("lsn") - 1).alias("lsn")).select("lsn", "epoch")
    return log.sparkSession.createDataFrame([(0, 0)], "lsn long, epoch long").unionByName(begun)


def numbered(rows: DataFrame, name: str, order: str = "lsn", block: int = BLOCK) -> DataFrame:
    """rows with their number (from 1) in the order of a column of integers, without a window over all rows."""
    rows = rows.withColumn("_block", F.expr(f"{order} div {block}"))
    totals = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("_block", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    return rows.join(base, "_block").withColumn(name, F.col("_base") + own).drop("_block", "_base")


def records(log: DataFrame, per_segment: int = SEGMENT_RECORDS) -> DataFrame:
    """lsn, k, shard, epoch, len, segment_id, offset: puts, laid out in segments."""
    puts = numbered(log.filter("op = 'put'").select("lsn", "k", "shard", "epoch", "len"), "put_seq")
    placed = puts.withColumn("segment_id", F.expr(f"1 + (put_seq - 1) div {per_segment}"))
    end = F.sum("len").over(Window.partitionBy("segment_id").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("offset", end - F.col("len")).drop("put_seq")
