"""What a user of the store asks for by hand: reads with parameters, staged writes, counters, reports.

    store = Store.open(spark, "/data/log")          # or Store(log DataFrame)
    store.get(7), store.range(3, 9, at_epoch=12), store.contains([1, 2], shards=[0, 1])
    batch = store.batch(); batch.put(7, shard=0, length=100); batch.delete(8); store = batch.apply()
    store.segment(3), store.stats(), store.garbage(min_bytes=1), store.oldest(10)
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import summaries, versions
from tidemark.sources import events

LOG = "lsn long, k long, shard long, epoch long, op string, end_epoch long, len long"


class Store:
    """A view of a mutation log (columns of LOG) up to an LSN; it never changes."""

    def __init__(self, log: DataFrame, through_lsn: int | None = None):
        self.spark: SparkSession = log.sparkSession
        self.log = log if through_lsn is None else log.filter(F.col("lsn") <= through_lsn)

    @classmethod
    def open(cls, spark: SparkSession, path: str, through_lsn: int | None = None) -> Store:
        return cls(spark.read.schema(LOG).parquet(path), through_lsn)

    @cached_property
    def _records(self) -> DataFrame:
        return events.records(self.log)

    @cached_property
    def _versions(self) -> DataFrame:
        return versions.versions(self.log, self._records)

    @cached_property
    def epoch(self) -> int:
        return self.log.agg(F.max("epoch")).head()[0] or 0

    def resolved(self, at_epoch: int | None = None) -> DataFrame:
        """Versions that can be read at an epoch (the log's last)."""
        now = self.epoch if at_epoch is None else at_epoch
        return self._versions.filter("retire_lsn IS NULL").filter(versions.visible(F.col("end_epoch"), F.lit(now)))

    def _of_keys(self, keys: list[int]) -> Store:
        """Only what these keys did: a point read doesn't resolve the whole log."""
        return Store(self.log.filter(F.col("k").isin(keys)))

    def get(self, key: int, shard: int | None = None, at_epoch: int | None = None) -> DataFrame:
        """k, shard, lsn, len, end_epoch of a key's readable versions."""
        own = versions.resolve(self._of_keys([key]).log).filter("retire_lsn IS NULL")
        own = own.filter(versions.visible(F.col("end_epoch"), F.lit(self.epoch if at_epoch is None else at_epoch)))
        return (own if shard is None else own.filter(F.col("shard") == shard)).select("k", "shard", "lsn", "len", "end_epoch")

    def contains(self, keys: list[int], shards: list[int] | None = None, at_epoch: int | None = None) -> DataFrame:
        """k, present: whether each key can be read (in every one of the shards, if some are named)."""
        own = versions.resolve(self._of_keys(keys).log).filter("retire_lsn IS NULL").filter(versions.visible(F.col("end_epoch"), F.lit(self.epoch if at_epoch is None else at_epoch)))
        if shards is not None:
            own = own.filter(F.col("shard").isin(shards))
        found = own.groupBy("k").agg(F.count_distinct("shard").alias("n"))
        asked = self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "k long")
        return asked.join(found, "k", "left").select("k", (F.coalesce("n", F.lit(0)) >= (len(set(shards)) if shards else 1)).alias("present"))

    def range(self, start: int, end: int, at_epoch: int | None = None) -> DataFrame:
        """Readable versions of keys from start up to but without end, in order."""
        part = Store(self.log.filter((F.col("k") >= start) & (F.col("k") < end)))
        own = versions.resolve(part.log).filter("retire_lsn IS NULL").filter(versions.visible(F.col("end_epoch"), F.lit(self.epoch if at_epoch is None else at_epoch)))
        return own.select("k", "shard", "lsn", "len", "end_epoch").orderBy("k", "shard", "lsn")

    def through(self, lsn: int) -> Store:
        """The store as it was after an LSN."""
        return Store(self.log, lsn)

    def rolled_back(self, lsn: int) -> Store:
        """The store without what was written at an LSN or later."""
        return Store(self.log.filter(F.col("lsn") < lsn))

    def segment(self, segment_id: int) -> DataFrame:
        """lsn, k, shard, offset, len, retire_lsn, end_epoch of a segment's records, in order."""
        return self._versions.filter(F.col("segment_id") == segment_id).select("lsn", "k", "shard", "offset", "len", "retire_lsn", "end_epoch").orderBy("offset")

    @cached_property
    def summaries(self) -> DataFrame:
        return summaries.summarize(self._versions)

    def stats(self) -> DataFrame:
        """One row: keys, records, segments, bytes."""
        s = self.summaries.agg(F.count("*").alias("segments"), F.sum("total_bytes").alias("total_bytes"), F.sum("live_bytes").alias("live_bytes"), F.sum("retired_bytes").alias("retired_bytes"), F.sum("live_refs").alias("live_refs"))
        return s.crossJoin(self.log.agg(F.count("*").alias("mutations"), F.approx_count_distinct("k").alias("keys_about"), F.max("lsn").alias("last_lsn")))  # a row by a row

    def garbage(self, min_bytes: int = 0, min_bps: int = 0) -> DataFrame:
        """Segments with at least so much garbage, the worst first."""
        rows = self.summaries.withColumn("garbage_bytes", F.col("retired_bytes") + F.col("expired_bytes"))
        rows = rows.filter((F.col("garbage_bytes") >= min_bytes) & (F.col("garbage_bytes") * 10_000 >= F.col("total_bytes") * min_bps))
        return rows.select("segment_id", "total_bytes", "live_bytes", "garbage_bytes").orderBy(F.desc("garbage_bytes"), "segment_id")

    def oldest(self, n: int) -> DataFrame:
        return self._versions.groupBy("segment_id").agg(F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"), F.sum("len").alias("bytes")).orderBy("max_lsn", "segment_id").limit(n)

    def payload_ranges(self, segment_id: int, start: int = 0, length: int | None = None):
        """Rows (lsn, first byte, end) of a segment's payloads cut to a range, one after the other, without collecting them."""
        first, stop = F.col("offset") + 64, F.col("offset") + F.col("len") - 4
        lo = F.least(first + start, stop)
        hi = stop if length is None else F.least(lo + length, stop)
        return self.segment(segment_id).select("lsn", lo.alias("first"), hi.alias("end")).toLocalIterator()

    def batch(self) -> Batch:
        return Batch(self)


class Batch:
    """Writes of a few rows by hand, validated and given contiguous LSNs together; larger ones are a DataFrame's."""

    def __init__(self, store: Store):
        self.store, self.rows = store, []

    def put(self, k: int, shard: int, length: int) -> Batch:
        return self._add(k, shard, "put", 0, length)

    def extend(self, k: int, end_epoch: int) -> Batch:
        if end_epoch <= self.store.epoch:
            raise ValueError("a lifetime must end after the epoch that is now")
        return self._add(k, 0, "life", end_epoch, 0)

    def tombstone(self, k: int, shard: int) -> Batch:
        return self._add(k, shard, "tomb", 0, 0)

    def delete(self, k: int) -> Batch:
        return self._add(k, 0, "del", 0, 0)

    def _add(self, k, shard, op, end_epoch, length) -> Batch:
        self.rows.append((k, shard, op, end_epoch, length))
        return self

    def staged(self) -> DataFrame:
        last = self.store.log.agg(F.max("lsn")).head()[0] or 0
        return self.store.spark.createDataFrame([(last + 1 + i, k, s, self.store.epoch, op, e, n) for i, (k, s, op, e, n) in enumerate(self.rows)], LOG)

    def apply(self, path: str | None = None) -> Store:
        """A store that has the writes (read your writes); with a path they are appended there, which makes them durable."""
        rows = self.staged()
        if path is not None:
            rows.write.mode("append").parquet(path)
        return Store(self.store.log.select(*(c.split()[0] for c in LOG.split(", "))).unionByName(rows))
