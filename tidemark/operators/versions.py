"""Version resolution: the ordered fold of each key's mutations, in closed form with windows.

A put ends at the first of: the next put or tombstone of its (key, shard); the next DeleteKey of its key; and the first
later SetLifetime that finds the lifetime before it already over, where that one held for the put. All windows run
by key in log order, linear in a key's mutations: nothing is joined pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective(lifetime_lsn: Column, end_epoch: Column, version_lsn: Column, write_epoch: Column) -> Column:
    """Whether a lifetime holds for a version: not if it was over when the version was written."""
    return end_epoch.isNotNull() & ~((lifetime_lsn <= version_lsn) & (end_epoch <= write_epoch))


def visible(end_epoch: Column, at_epoch: Column) -> Column:
    """Whether a live version can be read at an epoch."""
    return end_epoch.isNull() | (end_epoch > at_epoch)


def lifetimes(log: DataFrame) -> DataFrame:
    """log with dg (DeleteKeys of the key so far), and for SetLifetime rows prev_lsn, prev_end, expired_prev and
    extension_count: 0 for a first lifetime or one after expiry, one more for each live extension."""
    by_key = Window.partitionBy("k").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("dg", F.sum(F.when(F.col("op") == "del", 1).otherwise(0)).over(by_key))
    chain = Window.partitionBy("k", "dg").orderBy("lsn")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("op") == "life", F.struct("lsn", "end_epoch"))
    prev = F.last(own, ignorenulls=True).over(before)
    is_life = F.col("op") == "life"
    rows = rows.withColumn("prev", F.when(is_life, prev)).withColumn("prev_lsn", F.col("prev.lsn")).withColumn("prev_end", F.col("prev.end_epoch")).drop("prev")
    rows = rows.withColumn("expired_prev", F.coalesce(F.col("prev_end") <= F.col("epoch"), F.lit(False)))
    reset = F.when(is_life & (F.col("prev_lsn").isNull() | F.col("expired_prev")), 1).otherwise(0)
    so_far = chain.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_island", F.sum(reset).over(so_far))
    island = Window.partitionBy("k", "dg", "_island").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum(F.when(is_life, 1).otherwise(0)).over(island) - 1
    return rows.withColumn("extension_count", F.when(is_life, count)).drop("_island")


def resolve(log: DataFrame) -> DataFrame:
    """A row for each put: lsn, k, shard, write_epoch, retire_lsn (null while live), end_epoch and extension_count (null
    without an effective lifetime)."""
    rows = lifetimes(log)
    key = Window.partitionBy("k").orderBy("lsn")
    shard = Window.partitionBy("k", "shard").orderBy("lsn")
    chain = Window.partitionBy("k", "dg").orderBy("lsn")
    after = (1, Window.unboundedFollowing)
    rows = rows.withColumn("next_same", F.min(F.when(F.col("op").isin("put", "tomb"), F.col("lsn"))).over(shard.rowsBetween(*after)))
    rows = rows.withColumn("next_del", F.min(F.when(F.col("op") == "del", F.col("lsn"))).over(key.rowsBetween(*after)))
    rows = rows.withColumn("next_expiring", F.min(F.when(F.col("expired_prev"), F.col("lsn"))).over(chain.rowsBetween(*after)))
    following = F.first(F.when(F.col("op") == "life", F.struct("lsn", "prev_end", "expired_prev", "next_expiring")), ignorenulls=True).over(chain.rowsBetween(*after))
    last = F.last(F.when(F.col("op") == "life", F.struct("lsn", "end_epoch", "extension_count")), ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("following", following).withColumn("last_life", last)
    # The first lifetime after a put kills it only if the one before held for the put; a later one always does.
    held = F.col("following.expired_prev") & (F.col("following.prev_end") > F.col("epoch"))
    kill = F.when(held, F.col("following.lsn")).otherwise(F.col("following.next_expiring"))
    puts = rows.filter("op = 'put'").withColumn("retire_lsn", F.least("next_same", "next_del", kill))
    holds = F.col("retire_lsn").isNull() & effective(F.col("last_life.lsn"), F.col("last_life.end_epoch"), F.col("lsn"), F.col("epoch"))
    return puts.select(
        "lsn", "k", "shard", F.col("epoch").alias("write_epoch"), "len", "retire_lsn",
        F.when(holds, F.col("last_life.end_epoch")).alias("end_epoch"),
        F.when(holds, F.col("last_life.extension_count")).cast("long").alias("extension_count"),
    )


def versions(log: DataFrame, placed: DataFrame) -> DataFrame:
    """resolve() with segment_id and offset of each record."""
    return resolve(log).join(placed.select("lsn", "segment_id", "offset"), "lsn")


def reduce_without_base(log: DataFrame) -> DataFrame:
    """Partial aggregation where the base is unknown: of each key, the last DeleteKey, the SetLifetimes after it, and the
    last put or tombstone of each shard after it. What resolve() makes of the kept rows for live keys stays the same."""
    key, shard = Window.partitionBy("k"), Window.partitionBy("k", "shard")
    last_del = F.max(F.when(F.col("op") == "del", F.col("lsn"))).over(key)
    last_own = F.max(F.when(F.col("op").isin("put", "tomb"), F.col("lsn"))).over(shard)
    rows = log.withColumn("_del", F.coalesce(last_del, F.lit(-1))).withColumn("_own", last_own)
    kept = (F.col("lsn") >= F.col("_del")) & (F.col("op").isin("del", "life") | (F.col("lsn") == F.col("_own")))
    return rows.filter(kept).drop("_del", "_own")
