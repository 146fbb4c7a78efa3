"""The tables that queries read, built lazily for a (session, folder, epoch); and portable SQL over them."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import summaries as S
from tidemark.operators import versions as V
from tidemark.sources import events as E
from tidemark.sources.folders import written

#: The epoch as of which plans are made, and that of the end of the log.
PLAN_EPOCH, LAST_EPOCH = 10, 29
#: Records of a segment where plans need segments of which little is live.
FEW = 4
#: Tables that are derived from versions, some of them more than once.
_DERIVED = {"versions": 1, "summaries": 1, "histogram": 1, "extensions": 1, "segments": 1, "relocations": 1, "claims": 1, "segment_files": 1, "garbage_events": 2, "segment_summaries": 2}


class Model:
    """Domain tables over the log up to an epoch."""

    def __init__(self, spark: SparkSession, sf_dir: str, through_epoch: int | None = None, per_segment: int = E.SEGMENT_RECORDS):
        self.spark, self.sf_dir, self.through, self.per_segment = spark, sf_dir, through_epoch, per_segment

    def settled(self, *names: str) -> Model:
        """The same tables, of which versions and those named are computed once and read by all branches of a plan."""
        out = Model(self.spark, self.sf_dir, self.through, self.per_segment)
        for name in ("versions", *names):
            out.__dict__[name] = written(getattr(out, name), name)
        return out

    @cached_property
    def mutations(self) -> DataFrame:
        return E.mutations(self.spark, self.sf_dir, self.through)

    @cached_property
    def epoch_changes(self) -> DataFrame:
        return E.epoch_changes(self.mutations)

    @cached_property
    def records(self) -> DataFrame:
        return E.records(self.mutations, self.per_segment)

    @cached_property
    def versions(self) -> DataFrame:
        return V.versions(self.mutations, self.records)

    @cached_property
    def summaries(self) -> DataFrame:
        return S.summarize(self.versions)

    @cached_property
    def histogram(self) -> DataFrame:
        return S.end_epoch_histogram(self.versions)

    @cached_property
    def extensions(self) -> DataFrame:
        return S.extension_histogram(self.versions)

    @cached_property
    def segments(self) -> DataFrame:
        """State of each segment: bounds from its records, placement and claims by its number."""
        bounds = self.versions.groupBy("segment_id").agg(
            F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"), F.sum("len").alias("sealed_len"),
            F.max(F.when(F.col("retire_lsn").isNull(), F.col("end_epoch"))).alias("_end"), F.max("write_epoch").alias("_write"),
        )
        last = bounds.agg(F.max("segment_id")).scalar()
        kind = F.col("segment_id") % 3
        return bounds.select(
            "segment_id",
            F.when(F.col("segment_id") == last, "Open").otherwise("Sealed").alias("state"),
            F.when(kind == 0, "Ingest").when(kind == 1, "ExactEpoch").otherwise("Spillover").alias("placement"),
            F.when(kind == 1, F.coalesce("_end", "_write")).alias("placement_epoch"),
            (F.col("segment_id") % 11 == 0).alias("claimed"),
            "min_lsn", "max_lsn", "sealed_len",
        )

    @cached_property
    def segment_summaries(self) -> DataFrame:
        """Segments with their summaries, zeros where there is none."""
        counters = ["total_bytes", "live_bytes", "retired_bytes", "expired_bytes", "live_refs", "unknown_bytes", "unknown_refs"]
        return self.segments.join(self.summaries, "segment_id", "left").fillna(0, counters)

    @cached_property
    def shards(self) -> DataFrame:
        return self.spark.createDataFrame([(0, 0, "Active"), (1, 1, "Active"), (2, 0, "Dropped")], "shard_id long, current_generation long, state string")

    @cached_property
    def relocations(self) -> DataFrame:
        """Live versions of every fifth segment moved to segment + 1000, with their length."""
        moved = self.versions.filter("retire_lsn IS NULL AND segment_id % 5 = 0")
        return moved.select("k", "shard", F.col("lsn").alias("payload_lsn"), (F.col("segment_id") + 1000).alias("to_segment"), F.col("offset").alias("to_offset"), "len")

    @cached_property
    def claims(self) -> DataFrame:
        """Segments that a relocation has claimed: those with copies elsewhere."""
        return self.relocations.select((F.col("to_segment") - 1000).alias("segment_id")).distinct()

    @cached_property
    def segment_files(self) -> DataFrame:
        """Files found on disk by segment: those of the index, and some of writers that died before they were entered."""
        lost = self.segments.filter("segment_id % 7 = 3").select((F.col("segment_id") + 5000).alias("segment_id"))
        return self.segments.select("segment_id").unionByName(lost)

    @cached_property
    def files(self) -> DataFrame:
        """Key ranges of files by level: base files over 16 keys each, patch files over 10 keys and an epoch of three."""
        base = self.mutations.groupBy(F.expr("k div 16").alias("g")).agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"), F.count("*").alias("n"))
        patch = self.mutations.filter("epoch % 3 = 0").groupBy(F.expr("1000 + epoch * 1000 + k div 40").alias("g")).agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"), F.count("*").alias("n"))
        level = lambda df, name: df.select(F.col("g").alias("file_id"), F.lit(name).alias("level"), "first_k", "last_k", "min_lsn", "max_lsn", (F.col("n") * 100).alias("file_len"))
        return level(base, "base").unionByName(level(patch, "patch"))

    @cached_property
    def garbage_events(self) -> DataFrame:
        """What deriving versions emits: a retirement or a lifetime for each record that has one."""
        v = self.versions
        retired = v.filter("retire_lsn IS NOT NULL").select("segment_id", "k", F.col("retire_lsn").alias("event_lsn"), F.lit("Retired").alias("event"), "offset", "len", F.lit(None).cast("long").alias("end_epoch"))
        known = v.filter("end_epoch IS NOT NULL").select("segment_id", "k", F.col("lsn").alias("event_lsn"), F.lit("SetLifecycle").alias("event"), "offset", "len", "end_epoch")
        return retired.unionByName(known)

    def table(self, name: str) -> DataFrame:
        if name in ("orders", "lineitem", "documents", "pages", "events"):
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return getattr(self, name)

    def sql(self, text: str) -> DataFrame:
        """Run portable SQL: {table} is one of the tables above, // is integer division."""
        names = set(re.findall(r"\{(\w+)\}", text))
        own = self.settled() if sum(_DERIVED.get(n, 0) for n in names) > 1 else self
        return self.spark.sql(text.replace("//", " div ").replace("@UTF", ", 'UTF-8'"), **{n: own.table(n) for n in names})


#: The same tables for DuckDB. EPOCHS limits the log.
_DUCK = """
mutations AS MATERIALIZED (
  SELECT * FROM (
    SELECT 2 * event_id + 2 AS lsn, user_id AS k, event_id % 3 AS shard, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS epoch,
           CASE event_type WHEN 'purchase' THEN 'life' WHEN 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'del' ELSE 'tomb' END ELSE 'put' END AS op,
           date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT + 1 + event_id % 12 AS end_epoch, 64 + (1 + (event_id * 7919) % 4096) + 4 AS len
    FROM events) WHERE EPOCHS),
epoch_changes AS (SELECT 0::BIGINT AS lsn, 0::BIGINT AS epoch UNION ALL SELECT min(lsn) - 1, epoch FROM mutations WHERE epoch > 0 GROUP BY epoch),
records AS MATERIALIZED (
  SELECT lsn, k, shard, epoch, len, segment_id, (sum(len) OVER (PARTITION BY segment_id ORDER BY lsn) - len)::BIGINT AS "offset"
  FROM (SELECT *, 1 + (row_number() OVER (ORDER BY lsn) - 1) // PER_SEGMENT AS segment_id FROM mutations WHERE op = 'put')),
log1 AS MATERIALIZED (SELECT *, count(*) FILTER (op = 'del') OVER (PARTITION BY k ORDER BY lsn) AS dg FROM mutations),
life1 AS (SELECT *, lag(lsn) OVER w AS prev_lsn, lag(end_epoch) OVER w AS prev_end FROM log1 WHERE op = 'life' WINDOW w AS (PARTITION BY k, dg ORDER BY lsn)),
life2 AS (SELECT *, coalesce(prev_end <= epoch, false) AS expired_prev, sum(CASE WHEN prev_lsn IS NULL OR prev_end <= epoch THEN 1 ELSE 0 END) OVER (PARTITION BY k, dg ORDER BY lsn) AS island FROM life1),
lives AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k, dg, island ORDER BY lsn) - 1 AS extension_count, row_number() OVER (PARTITION BY k, dg ORDER BY lsn DESC) AS back FROM life2),
put1 AS (
  SELECT log1.*, (SELECT min(lsn) FROM log1 n WHERE n.k = log1.k AND n.lsn > log1.lsn AND ((n.shard = log1.shard AND n.op IN ('put', 'tomb')) OR n.op = 'del')) AS ended,
         (SELECT min(l.lsn) FROM lives l WHERE l.k = log1.k AND l.dg = log1.dg AND l.lsn > log1.lsn AND l.expired_prev AND NOT (l.prev_lsn <= log1.lsn AND l.prev_end <= log1.epoch)) AS kill
  FROM log1 WHERE op = 'put'),
versions AS MATERIALIZED (
  SELECT p.lsn, p.k, p.shard, p.epoch AS write_epoch, p.len, least(p.ended, p.kill) AS retire_lsn,
         CASE WHEN least(p.ended, p.kill) IS NULL AND NOT (l.lsn <= p.lsn AND l.end_epoch <= p.epoch) THEN l.end_epoch END AS end_epoch,
         CASE WHEN least(p.ended, p.kill) IS NULL AND NOT (l.lsn <= p.lsn AND l.end_epoch <= p.epoch) THEN l.extension_count END AS extension_count, r.segment_id, r."offset"
  FROM put1 p JOIN records r USING (lsn) LEFT JOIN lives l ON l.k = p.k AND l.dg = p.dg AND l.back = 1),
summaries AS (
  SELECT segment_id, sum(len)::BIGINT AS total_bytes, coalesce(sum(len) FILTER (retire_lsn IS NULL), 0)::BIGINT AS live_bytes, coalesce(sum(len) FILTER (retire_lsn IS NOT NULL), 0)::BIGINT AS retired_bytes, 0::BIGINT AS expired_bytes,
         count(*) FILTER (retire_lsn IS NULL) AS live_refs, coalesce(sum(len) FILTER (retire_lsn IS NULL AND end_epoch IS NULL), 0)::BIGINT AS unknown_bytes,
         count(*) FILTER (retire_lsn IS NULL AND end_epoch IS NULL) AS unknown_refs, min(end_epoch) FILTER (retire_lsn IS NULL) AS min_end_epoch, max(end_epoch) FILTER (retire_lsn IS NULL) AS max_end_epoch
  FROM versions GROUP BY segment_id),
histogram AS (SELECT segment_id, end_epoch, count(*) AS refs, sum(len)::BIGINT AS bytes FROM versions WHERE retire_lsn IS NULL AND end_epoch IS NOT NULL GROUP BY ALL),
extensions AS (SELECT segment_id, extension_count, count(*) AS refs FROM versions WHERE retire_lsn IS NULL AND end_epoch IS NOT NULL GROUP BY ALL),
segments AS (
  SELECT segment_id, CASE WHEN segment_id = max(segment_id) OVER () THEN 'Open' ELSE 'Sealed' END AS state, ['Ingest', 'ExactEpoch', 'Spillover'][segment_id % 3 + 1] AS placement,
         CASE WHEN segment_id % 3 = 1 THEN coalesce(e, w) END AS placement_epoch, segment_id % 11 = 0 AS claimed, min_lsn, max_lsn, sealed_len
  FROM (SELECT segment_id, min(lsn) AS min_lsn, max(lsn) AS max_lsn, sum(len)::BIGINT AS sealed_len, max(end_epoch) FILTER (retire_lsn IS NULL) AS e, max(write_epoch) AS w FROM versions GROUP BY segment_id)),
segment_summaries AS (SELECT * FROM segments LEFT JOIN summaries USING (segment_id)),
shards AS (SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 'Active'), (1, 1, 'Active'), (2, 0, 'Dropped')) t(shard_id, current_generation, state)),
relocations AS (SELECT k, shard, lsn AS payload_lsn, segment_id + 1000 AS to_segment, "offset" AS to_offset, len FROM versions WHERE retire_lsn IS NULL AND segment_id % 5 = 0),
claims AS (SELECT DISTINCT to_segment - 1000 AS segment_id FROM relocations),
segment_files AS (SELECT segment_id FROM segments UNION ALL SELECT segment_id + 5000 FROM segments WHERE segment_id % 7 = 3),
files AS (
  SELECT k // 16 AS file_id, 'base' AS level, min(k) AS first_k, max(k) AS last_k, min(lsn) AS min_lsn, max(lsn) AS max_lsn, count(*) * 100 AS file_len FROM mutations GROUP BY ALL
  UNION ALL SELECT 1000 + epoch * 1000 + k // 40, 'patch', min(k), max(k), min(lsn), max(lsn), count(*) * 100 FROM mutations WHERE epoch % 3 = 0 GROUP BY ALL),
garbage_events AS (
  SELECT segment_id, k, retire_lsn AS event_lsn, 'Retired' AS event, "offset", len, NULL::BIGINT AS end_epoch FROM versions WHERE retire_lsn IS NOT NULL
  UNION ALL SELECT segment_id, k, lsn, 'SetLifecycle', "offset", len, end_epoch FROM versions WHERE end_epoch IS NOT NULL)
"""


def duck(text: str, through_epoch: int | None = None, per_segment: int = E.SEGMENT_RECORDS) -> str:
    """DuckDB SQL of a portable query, or of SQL written for DuckDB over the same tables."""
    text = text.replace("@UTF", "")
    text = re.sub(r'(?<!")\boffset\b(?!")', '"offset"', re.sub(r"\{(\w+)\}", r"\1", text)).strip()
    prelude = _DUCK.replace("EPOCHS", "true" if through_epoch is None else f"epoch <= {through_epoch}").replace("PER_SEGMENT", str(per_segment)).strip()
    # Its own WITH clauses go on from the shared ones.
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(head):
            return f"{head}{prelude},\n{text[len(head):]}"
    return f"WITH {prelude}\n{text}"
