"""Queries built from the operators' DataFrame functions, each with SQL written for DuckDB on its own terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import control, folds, frontiers, intervals, merge, summaries, versions
from tidemark.operators.planner import Planner, ranked
from tidemark.plans import arithmetic
from tidemark.plans.model import FEW, LAST_EPOCH, PLAN_EPOCH, Model
from tidemark.sources import record_files, tables
from tidemark.sources.events import SEGMENT_RECORDS
from tidemark.sources.folders import fresh_folder
from tidemark.store import Store

#: name: (function of a model, epoch that the log ends at, DuckDB SQL or None, records of a segment).
BUILT: dict[str, tuple[Callable[[Model], DataFrame], int | None, str | None, int]] = {}


def built(name: str, sql: str | None, through: int | None = None, per_segment: int = SEGMENT_RECORDS):
    def add(f):
        BUILT[name] = (f, through, sql, per_segment)
        return f

    return add


@built("sc08_payload_bytes", "SELECT doc_id, hex(encode(text)[11:30]) AS part FROM documents")
@built("sc08_payload_range", "SELECT doc_id, hex(encode(text)[11:30]) AS part FROM documents")
def payload_bytes(m: Model) -> DataFrame:
    """The byte range of all documents, in hex as it may cut characters."""
    return m.table("documents").select("doc_id", F.hex(F.substring(F.encode("text", "UTF-8"), 11, 20)).alias("part"))


@built("sf05_checksum", "SELECT doc_id, md5(text) AS checksum FROM documents")
def checksum(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", F.md5("text").alias("checksum"))


@built("ag31_digests", "SELECT doc_id, sha256(text) AS digest FROM documents")
def digests(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@built("sf02_end_offset", 'SELECT lsn, CASE WHEN lsn % 100 = 0 THEN NULL ELSE "offset" + len END AS end_offset FROM records')
def end_offset(m: Model) -> DataFrame:
    huge = F.when(F.col("lsn") % 100 == 0, F.lit((1 << 63) - 1)).otherwise(F.col("offset"))
    return m.records.select("lsn", F.try_add(huge, F.col("len")).alias("end_offset"))


@built("ag04_partial_merge", """
SELECT lsn, k, op FROM (SELECT *, max(lsn) FILTER (op = 'del') OVER (PARTITION BY k) AS d, max(lsn) FILTER (op IN ('put', 'tomb')) OVER (PARTITION BY k, shard) AS o FROM mutations)
WHERE op = 'del' AND lsn = d OR op = 'life' AND lsn > coalesce(d, -1) OR op IN ('put', 'tomb') AND lsn = o AND lsn > coalesce(d, -1)""")
def partial_merge(m: Model) -> DataFrame:
    return versions.reduce_without_base(m.mutations).select("lsn", "k", "op")


@built("ag09_lifecycle_at", "SELECT k, max(end_epoch) AS end_epoch, max(lsn) AS lsn FROM (SELECT k, lsn, end_epoch, max(lsn) OVER (PARTITION BY k) AS last FROM mutations WHERE op = 'life' AND lsn <= 9000) WHERE lsn = last GROUP BY k")
def lifecycle_at(m: Model) -> DataFrame:
    return m.mutations.filter("op = 'life' AND lsn <= 9000").groupBy("k").agg(F.max_by("end_epoch", "lsn").alias("end_epoch"), F.max("lsn").alias("lsn"))


@built("ag12_summary_from_deltas", """
SELECT segment_id, metric, value::BIGINT AS value FROM (
  SELECT segment_id, unnest(['total_bytes', 'live_bytes', 'retired_bytes', 'live_refs', 'unknown_bytes', 'unknown_refs']) AS metric,
         unnest([total_bytes, live_bytes, retired_bytes, live_refs, unknown_bytes, unknown_refs]) AS value FROM summaries) WHERE value <> 0""")
def summary_from_deltas(m: Model) -> DataFrame:
    return summaries.apply_deltas(summaries.deltas(m.versions)).filter("bucket IS NULL").select("segment_id", "metric", "value")


@built("ag13_histograms_from_deltas", "SELECT segment_id, end_epoch, refs, bytes FROM histogram")
def histograms_from_deltas(m: Model) -> DataFrame:
    got = summaries.apply_deltas(summaries.deltas(m.versions)).filter("metric IN ('epoch_bytes', 'epoch_refs')")
    part = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    return got.groupBy("segment_id", F.col("bucket").alias("end_epoch")).agg(part("epoch_refs").alias("refs"), part("epoch_bytes").alias("bytes"))


LIVE_AFTER = """
SELECT s.segment_id, (unknown_refs + coalesce(l_refs, 0) + greatest(live_refs - unknown_refs - coalesce(h_refs, 0), 0))::BIGINT AS live_refs,
       (unknown_bytes + coalesce(l_bytes, 0) + greatest(live_bytes - unknown_bytes - coalesce(h_bytes, 0), 0))::BIGINT AS live_bytes
FROM summaries s LEFT JOIN (SELECT segment_id, sum(refs) AS h_refs, sum(bytes) AS h_bytes, sum(refs) FILTER (end_epoch > 12) AS l_refs, sum(bytes) FILTER (end_epoch > 12) AS l_bytes FROM histogram GROUP BY segment_id) h USING (segment_id)"""


@built("ag16_live_after_epoch", LIVE_AFTER, PLAN_EPOCH)
def live_after_epoch(m: Model) -> DataFrame:
    return summaries.live_after(m.summaries, m.histogram, 12)


@built("ag17_as_of_epoch", """
SELECT s.segment_id, total_bytes, greatest(live_bytes - coalesce(b, 0), 0)::BIGINT AS live_bytes, greatest(live_refs - coalesce(r, 0), 0)::BIGINT AS live_refs, retired_bytes, (expired_bytes + coalesce(b, 0))::BIGINT AS expired_bytes, lo AS min_end_epoch, hi AS max_end_epoch
FROM summaries s LEFT JOIN (SELECT segment_id, sum(bytes) FILTER (end_epoch <= 12) AS b, sum(refs) FILTER (end_epoch <= 12) AS r, min(end_epoch) FILTER (end_epoch > 12) AS lo, max(end_epoch) FILTER (end_epoch > 12) AS hi FROM histogram GROUP BY segment_id) h USING (segment_id)""", PLAN_EPOCH)
def as_of_epoch(m: Model) -> DataFrame:
    return summaries.as_of_epoch(m.summaries, m.histogram, 12)


@built("ag06_resolve_head", "SELECT k, shard, max(lsn) AS lsn, arg_max(op, lsn) AS op FROM mutations WHERE op IN ('put', 'tomb') GROUP BY k, shard")
def resolve_head(m: Model) -> DataFrame:
    return m.mutations.filter("op IN ('put', 'tomb')").groupBy("k", "shard").agg(F.max("lsn").alias("lsn"), F.max_by("op", "lsn").alias("op"))


@built("ag03_prune_snapshot", "SELECT v.k, v.shard, v.lsn FROM versions v JOIN shards s ON s.shard_id = v.shard WHERE v.retire_lsn IS NULL AND s.state = 'Active' AND s.current_generation = 0 AND (v.end_epoch IS NULL OR v.end_epoch > 29)")
def prune_snapshot(m: Model) -> DataFrame:
    kept = m.shards.filter("state = 'Active' AND current_generation = 0").select(F.col("shard_id").alias("shard"))
    live = m.versions.filter("retire_lsn IS NULL").filter(versions.visible(F.col("end_epoch"), F.lit(LAST_EPOCH)))
    return live.join(F.broadcast(kept), "shard", "left_semi").select("k", "shard", "lsn")  # the registry of shards is three rows here


@built("ag29_summary_difference", """
SELECT coalesce(a.segment_id, b.segment_id) AS segment_id, coalesce(a.end_epoch, b.end_epoch) AS end_epoch, (coalesce(b.bytes, 0) - coalesce(a.bytes, 0))::BIGINT AS delta
FROM (SELECT * FROM histogram WHERE end_epoch % 3 <> 0) a FULL JOIN (SELECT * FROM histogram WHERE end_epoch % 2 = 0) b ON a.segment_id = b.segment_id AND a.end_epoch = b.end_epoch""")
def summary_difference(m: Model) -> DataFrame:
    before = m.histogram.filter("end_epoch % 3 <> 0").select("segment_id", "end_epoch", F.col("bytes").alias("a"))
    after = m.histogram.filter("end_epoch % 2 = 0").select("segment_id", "end_epoch", F.col("bytes").alias("b"))
    return before.join(after, ["segment_id", "end_epoch"], "full").select("segment_id", "end_epoch", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta"))


@built("ag30_reduced_segments", "SELECT segment_id, live_bytes, retired_bytes FROM summaries WHERE retired_bytes > 0")
def reduced_segments(m: Model) -> DataFrame:
    return m.summaries.filter("retired_bytes > 0").select("segment_id", "live_bytes", "retired_bytes")


@built("ag33_folded_garbage", """
WITH r AS (SELECT DISTINCT segment_id, "offset" AS a, "offset" + len AS b FROM garbage_events WHERE event = 'Retired'),
n AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY segment_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY segment_id ORDER BY a, b) AS island FROM n)
SELECT segment_id, min(a)::BIGINT AS start, max(b)::BIGINT AS "end" FROM i GROUP BY segment_id, island""")
def folded_garbage(m: Model) -> DataFrame:
    events = m.garbage_events.filter("event = 'Retired'").select("segment_id", F.col("offset").alias("start"), (F.col("offset") + F.col("len")).alias("end"))
    return intervals.coalesce_ranges(events.dropDuplicates())


@built("wn03_extension_counts", "SELECT lsn, k, extension_count::BIGINT AS extension_count FROM lives")
def extension_counts(m: Model) -> DataFrame:
    return versions.lifetimes(m.mutations).filter("op = 'life'").select("lsn", "k", F.col("extension_count").cast("long").alias("extension_count"))


@built("wn06_greedy_rollover", """
WITH RECURSIVE s AS (SELECT k, lsn, len, row_number() OVER (PARTITION BY k ORDER BY lsn) AS n FROM records),
f AS (SELECT k, lsn, n, len, 0::BIGINT AS segment, 0::BIGINT AS "offset" FROM s WHERE n = 1
  UNION ALL SELECT s.k, s.lsn, s.n, s.len, CASE WHEN f."offset" + f.len + s.len > 20000 THEN f.segment + 1 ELSE f.segment END, CASE WHEN f."offset" + f.len + s.len > 20000 THEN 0 ELSE f."offset" + f.len END FROM f JOIN s ON s.k = f.k AND s.n = f.n + 1)
SELECT k, lsn, segment, "offset" FROM f""")
def greedy_rollover(m: Model) -> DataFrame:
    return folds.greedy_rollover(m.records, 20_000, "k")


_ISLANDS = """
n AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY segment_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY segment_id ORDER BY a, b) AS island FROM n)
SELECT segment_id, min(a)::BIGINT AS start, max(b)::BIGINT AS "end" FROM i GROUP BY segment_id, island"""


def _extents(df: DataFrame) -> DataFrame:
    return df.select("segment_id", F.col("offset").alias("start"), (F.col("offset") + F.col("len")).alias("end"))


@built("wn07_coalesced_ranges", f'WITH r AS (SELECT segment_id, "offset" AS a, "offset" + len AS b FROM versions WHERE retire_lsn IS NOT NULL), {_ISLANDS}')
def coalesced_ranges(m: Model) -> DataFrame:
    """What retired records cover; live ones leave gaps."""
    return intervals.coalesce_ranges(_extents(m.versions.filter("retire_lsn IS NOT NULL")))


@built("wn08_range_difference", f'WITH r AS (SELECT segment_id, "offset" AS a, "offset" + len AS b FROM versions WHERE retire_lsn IS NULL), {_ISLANDS}')
def range_difference(m: Model) -> DataFrame:
    """What all records cover and retired ones don't: the live ranges, which the SQL coalesces without a difference."""
    m = m.settled()
    return intervals.subtract_ranges(_extents(m.records), _extents(m.versions.filter("retire_lsn IS NOT NULL")))


@built("fp11_overlapping_files", "SELECT b.file_id AS base_file, p.file_id AS patch_file FROM files b JOIN files p ON b.level = 'base' AND p.level = 'patch' AND b.first_k <= p.last_k AND p.first_k <= b.last_k")
def overlapping_files(m: Model) -> DataFrame:
    of = lambda level: m.files.filter(F.col("level") == level).select(F.col("file_id").alias("id"), F.col("first_k").alias("first"), F.col("last_k").alias("last"))
    return intervals.overlapping_pairs(of("base"), of("patch"), 64).toDF("base_file", "patch_file")


@built("fp20_protected", "SELECT lsn, coalesce(lsn <= (SELECT max(lsn) FROM epoch_changes WHERE epoch % 10 = 0), false) AS protects FROM mutations")
def protected(m: Model) -> DataFrame:
    """Whether the newest live pin, here of every tenth epoch's beginning, is at or after an LSN; nothing is without one."""
    newest = m.epoch_changes.filter("epoch % 10 = 0").agg(F.max("lsn")).scalar()
    return m.mutations.select("lsn", F.coalesce(newest >= F.col("lsn"), F.lit(False)).alias("protects"))


@built("jn06_expiry", "SELECT e.end_epoch, min(c.lsn) AS lsn FROM (SELECT DISTINCT end_epoch FROM mutations WHERE op = 'life') e LEFT JOIN epoch_changes c ON c.epoch >= e.end_epoch GROUP BY e.end_epoch")
def expiry(m: Model) -> DataFrame:
    """The first epoch change that reaches each end: a running least LSN from the last epoch down, a row for each epoch."""
    return frontiers.first_reaching(m.mutations.filter("op = 'life'").select("end_epoch").distinct(), m.epoch_changes)


@built("st02_manifest_edit", """
SELECT file_id, level FROM files WHERE NOT (level = 'patch' AND max_lsn <= 15000)
UNION ALL SELECT DISTINCT first_k // 80 + 500000, 'base' FROM files WHERE level = 'patch' AND max_lsn <= 15000""")
def manifest_edit(m: Model) -> DataFrame:
    """Patch files that a frontier covers go, a merged file for each 80 keys of theirs comes."""
    merged = m.files.filter("level = 'patch' AND max_lsn <= 15000")
    added = merged.select(F.expr("first_k div 80 + 500000").alias("file_id"), F.lit("base").alias("level")).distinct()
    return frontiers.edit(m.files.select("file_id", "level"), merged.select("file_id", "level"), added)


@built("tk09_bounded_batch", """
SELECT event_lsn, len FROM (SELECT event_lsn, len, sum(len) OVER w AS before, row_number() OVER (ORDER BY event_lsn, segment_id, "offset", event) AS rn FROM garbage_events
  WINDOW w AS (ORDER BY event_lsn, segment_id, "offset", event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE rn <= 256 AND coalesce(before, 0) < 300000""")
def bounded_batch(m: Model) -> DataFrame:
    """The first events of the log, 256 and the one that reaches 300,000 bytes at most; only the least 256 are ever gathered."""
    order = ["event_lsn", "segment_id", "offset", "event"]
    least = m.settled().garbage_events.select(*order, "len").orderBy(*order).limit(256)
    before = F.sum("len").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return least.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < 300_000).select("event_lsn", "len")


CLASSIFY = """
SELECT r.lsn, CASE WHEN v.retire_lsn IS NOT NULL THEN 'retired' WHEN v.end_epoch <= 29 THEN 'expired' ELSE 'live' END AS state FROM records r JOIN versions v USING (lsn)"""


def _classified(m: Model) -> DataFrame:
    m, at = m.settled(), _extents
    retired = intervals.coalesce_ranges(at(m.versions.filter("retire_lsn IS NOT NULL")))
    expired = intervals.coalesce_ranges(at(m.versions.filter(f"retire_lsn IS NULL AND end_epoch <= {LAST_EPOCH}")))
    records = m.records.select("lsn", "segment_id", F.col("offset").alias("start"), (F.col("offset") + F.col("len")).alias("end"), "len")
    return intervals.classify(records, retired, expired)


@built("jn07_classified_records", CLASSIFY)
def classified_records(m: Model) -> DataFrame:
    return _classified(m).select("lsn", "state")


@built("wn09_containment", "SELECT v.segment_id, count(*)::BIGINT AS n FROM versions v WHERE retire_lsn IS NOT NULL GROUP BY v.segment_id")
def containment(m: Model) -> DataFrame:
    return _classified(m).filter("state = 'retired'").groupBy("segment_id").agg(F.count("*").alias("n"))


@built("pl16_copied_records", "SELECT r.segment_id, count(*)::BIGINT AS n, sum(r.len)::BIGINT AS bytes FROM records r JOIN versions v USING (lsn) WHERE v.retire_lsn IS NULL AND (v.end_epoch IS NULL OR v.end_epoch > 29) GROUP BY r.segment_id")
def copied_records(m: Model) -> DataFrame:
    return _classified(m).filter("state = 'live'").groupBy("segment_id").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


@built("jn05_epoch_at_lsn", "SELECT m.lsn, c.epoch AS as_of_epoch FROM mutations m ASOF JOIN epoch_changes c ON m.lsn >= c.lsn")
def epoch_at_lsn(m: Model) -> DataFrame:
    return frontiers.epoch_at(m.mutations.select("lsn"), m.epoch_changes)


@built("fp18_expiry_transition", "SELECT l.lsn, min(c.lsn) AS expires_at FROM mutations l LEFT JOIN epoch_changes c ON c.epoch >= l.end_epoch WHERE l.op = 'life' GROUP BY l.lsn")
def expiry_transition(m: Model) -> DataFrame:
    lives = m.mutations.filter("op = 'life'").select("lsn", "end_epoch")
    reach = frontiers.first_reaching(lives.select("end_epoch").distinct(), m.epoch_changes)
    return lives.join(reach.withColumnRenamed("lsn", "expires_at"), "end_epoch").select("lsn", "expires_at")


@built("jn17_overlap_closure", """
WITH n AS (SELECT *, CASE WHEN first_k > max(last_k) OVER (ORDER BY first_k, last_k, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM files),
i AS (SELECT *, sum(new) OVER (ORDER BY first_k, last_k, file_id) AS g FROM n)
SELECT file_id, level, min(first_k) OVER (PARTITION BY g) AS group_start FROM i""")
def overlap_closure(m: Model) -> DataFrame:
    return frontiers.file_groups(m.files).select("file_id", "level", "group_start")


@built("jn16_forwarded_garbage", """
WITH RECURSIVE hops AS (
  SELECT event_lsn, segment_id, "offset", event, 0 AS hop FROM garbage_events WHERE segment_id % 5 = 0
  UNION ALL SELECT event_lsn, segment_id + 1000, "offset", event, hop + 1 FROM hops WHERE hop < 3 AND ("offset" // 64 + hop) % 2 = 0)
SELECT event_lsn, segment_id, "offset", event FROM hops""")
def forwarded_garbage(m: Model) -> DataFrame:
    """An event goes to every segment along its record's chain of moves; targets only grow, so a chain is bounded.

    A chain's hops are a list in the event's own row, up to the first move that isn't made: Spark's recursive CTEs gather at
    most a million rows, and read the events again for each hop.
    """
    start = m.settled().garbage_events.filter("segment_id % 5 = 0").select("event_lsn", "segment_id", "offset", "event")
    hops = F.expr("filter(sequence(0, 3), h -> forall(sequence(0, 3), i -> i >= h OR (offset div 64 + i) % 2 = 0))")
    out = start.withColumn("hop", F.explode(hops))
    return out.select("event_lsn", (F.col("segment_id") + 1000 * F.col("hop")).alias("segment_id"), "offset", "event")


@built("wn10_blob_patch_tier", """
WITH RECURSIVE s AS (SELECT first_k % 4 AS part, file_id, greatest(file_len, 1) AS len, row_number() OVER (PARTITION BY first_k % 4 ORDER BY min_lsn, max_lsn, file_id) AS n FROM files WHERE level = 'patch'),
f AS (SELECT part, file_id, n, n AS run, len AS lo, len AS hi FROM s WHERE n = 1
  UNION ALL SELECT s.part, s.file_id, s.n, CASE WHEN c THEN f.run ELSE s.n END, CASE WHEN c THEN least(f.lo, s.len) ELSE s.len END, CASE WHEN c THEN greatest(f.hi, s.len) ELSE s.len END
  FROM (SELECT f.*, x.file_id AS next_file, x.len, greatest(f.hi, x.len) <= 4 * least(f.lo, x.len) AS c FROM f JOIN s x ON x.part = f.part AND x.n = f.n + 1) f JOIN s ON s.part = f.part AND s.n = f.n + 1),
g AS (SELECT part, min(run) AS run FROM (SELECT part, run FROM f GROUP BY part, run HAVING count(*) >= 4) GROUP BY part)
SELECT f.part AS "partition", f.file_id FROM f JOIN g ON g.part = f.part AND g.run = f.run WHERE f.n < f.run + 16""")
def blob_patch_tier(m: Model) -> DataFrame:
    files = m.files.filter("level = 'patch'").withColumn("partition", F.col("first_k") % 4)
    return folds.comparable_run(files, "partition")


@built("wn12_smoothed_latency", """
WITH RECURSIVE s AS (SELECT k, lsn, len, row_number() OVER (PARTITION BY k ORDER BY lsn) AS n FROM mutations WHERE op = 'put'),
f AS (SELECT k, lsn, n, len::BIGINT AS average, len::BIGINT AS baseline FROM s WHERE n = 1
  UNION ALL SELECT k, lsn, n, average, CASE WHEN average < old THEN average ELSE old + (average - old) // 64 END FROM (SELECT s.k, s.lsn, s.n, ((7 * f.average + s.len) // 8)::BIGINT AS average, f.baseline AS old FROM f JOIN s ON s.k = f.k AND s.n = f.n + 1))
SELECT k, lsn, average, baseline FROM f""")
def smoothed_latency(m: Model) -> DataFrame:
    return folds.smoothed(m.mutations.filter("op = 'put'"), "k", "lsn", "len")


PLANS = """
WITH u AS (SELECT DISTINCT segment_id FROM extensions WHERE extension_count > 1),
c AS (SELECT segment_id, sum(refs) FILTER (end_epoch > 10) AS l_refs, sum(bytes) FILTER (end_epoch > 10) AS l_bytes, sum(refs) AS h_refs, sum(bytes) AS h_bytes FROM histogram GROUP BY segment_id),
a AS (SELECT s.*, u.segment_id IS NULL AS stable, retired_bytes + expired_bytes AS garbage, unknown_refs + coalesce(l_refs, 0) + greatest(live_refs - unknown_refs - coalesce(h_refs, 0), 0) AS c_refs,
             unknown_bytes + coalesce(l_bytes, 0) + greatest(live_bytes - unknown_bytes - coalesce(h_bytes, 0), 0) AS c_bytes, NOT claimed AND total_bytes > 0 AS ok
      FROM segment_summaries s LEFT JOIN c USING (segment_id) LEFT JOIN u USING (segment_id)),
src AS (SELECT * FROM a WHERE ok AND state = 'Sealed'),
l0 AS (SELECT src.*, coalesce(useful, 0) AS useful FROM src LEFT JOIN (SELECT segment_id, sum(bytes) AS useful FROM histogram WHERE end_epoch - 10 >= 2 GROUP BY segment_id) h USING (segment_id) WHERE placement = 'Ingest'),
l1 AS (SELECT *, useful > 0 AND live_bytes > 0 AND useful * 10000 // greatest(live_bytes, 1) >= 6600 AS worth FROM l0),
jm AS (SELECT end_epoch, src.segment_id, bytes, garbage, row_number() OVER (PARTITION BY end_epoch ORDER BY bytes DESC, src.segment_id) AS n FROM src JOIN histogram h USING (segment_id) WHERE placement <> 'Ingest' AND stable AND bytes = live_bytes AND refs = live_refs AND end_epoch - 10 >= 1 AND bytes >= 500),
je AS (SELECT end_epoch, count(*) AS n, sum(bytes) AS copied, sum(garbage) AS reclaim FROM jm WHERE n <= 8 GROUP BY end_epoch HAVING count(*) >= 2 AND sum(bytes) BETWEEN 1000 AND 60000),
p AS (
  SELECT 'EmptyDelete' AS scenario, 'DeleteSegments' AS action, NULL AS segment_id, 0 AS copied_bytes, sum(total_bytes) AS reclaim_bytes, sum(total_bytes) * 10000 AS score FROM a WHERE ok AND state IN ('Sealed', 'GcRelocating') AND c_refs = 0 HAVING count(*) > 0
  UNION ALL SELECT 'L0Compaction', 'MoveLiveBytes', segment_id, live_bytes, total_bytes, useful * 1500 // greatest(live_bytes, 1) FROM l1 WHERE worth AND live_bytes <= 200000
  UNION ALL SELECT 'L0Compaction', 'ReclassifySegments', NULL, 0, 0, sum(total_bytes) FROM l1 WHERE NOT worth HAVING count(*) > 0
  UNION ALL SELECT 'DeadRef', 'MoveLiveBytes', segment_id, live_bytes, garbage, garbage * 2000 // greatest(live_bytes, 1) FROM src WHERE placement <> 'Ingest' AND garbage >= 20000 AND garbage * 10000 // total_bytes >= 6000 AND live_bytes <= 60000
  UNION ALL SELECT 'JoinMultiple', 'MoveLiveBytesFromSources', end_epoch, copied, reclaim, reclaim * 2500 // greatest(copied, 1) + n FROM je
  UNION ALL SELECT 'PinnedEpochExpiry', CASE WHEN c_bytes <= 60000 THEN 'MoveLiveBytes' ELSE 'ReclassifySegment' END, segment_id, CASE WHEN c_bytes <= 60000 THEN c_bytes ELSE 0 END, CASE WHEN c_bytes <= 60000 THEN total_bytes - c_bytes ELSE 0 END,
         CASE WHEN c_bytes <= 60000 THEN (total_bytes - c_bytes) * 1750 // greatest(c_bytes, 1) ELSE c_bytes END FROM src WHERE placement = 'ExactEpoch' AND placement_epoch <= 10 AND c_bytes > 0),
q AS (SELECT scenario, action, segment_id::BIGINT AS segment_id, copied_bytes::BIGINT AS copied_bytes, reclaim_bytes::BIGINT AS reclaim_bytes, score::BIGINT AS score FROM p)
"""


def planner(m: Model) -> Planner:
    m = m.settled("segment_summaries", "histogram", "extensions")  # one snapshot, which all scenarios read
    return Planner(m.segment_summaries, m.histogram, m.extensions, PLAN_EPOCH, PLAN_EPOCH)


def _scenario(name: str, where: str, method: str, per_segment: int = SEGMENT_RECORDS) -> None:
    built(name, f"{PLANS} SELECT * FROM q WHERE {where}", PLAN_EPOCH, per_segment)(lambda m: getattr(planner(m), method)())


_scenario("pl01_empty_deletes", "scenario = 'EmptyDelete'", "empty_deletes")
_scenario("pl02_l0_candidates", "scenario = 'L0Compaction'", "l0")
_scenario("pl03_dead_refs", "scenario = 'DeadRef'", "dead_refs")
_scenario("pl04_join_multiple", "scenario = 'JoinMultiple'", "joins", FEW)
_scenario("pl05_pinned_epochs", "scenario = 'PinnedEpochExpiry'", "pinned", FEW)
_scenario("pl07_scores", "true", "plans")
_scenario("pl07_scores_few", "true", "plans", FEW)


@built("pl06_routes", """
SELECT s.segment_id, h.end_epoch, CASE WHEN u.segment_id IS NULL AND h.end_epoch - 10 >= 1 AND h.bytes >= 500 THEN 'ExactEpoch' ELSE 'Spillover' END AS destination, h.refs, h.bytes
FROM segment_summaries s JOIN histogram h USING (segment_id) LEFT JOIN (SELECT DISTINCT segment_id FROM extensions WHERE extension_count > 1) u ON u.segment_id = s.segment_id WHERE h.end_epoch > 10
UNION ALL SELECT segment_id, NULL, 'Spillover', unknown_refs, unknown_bytes FROM segment_summaries WHERE unknown_bytes > 0""", PLAN_EPOCH)
def routes(m: Model) -> DataFrame:
    return planner(m).routes()


@built("pl08_ratio_bps", "SELECT segment_id, least((retired_bytes + expired_bytes) * 10000 // total_bytes, 65535)::BIGINT AS bps FROM summaries")
def ratios(m: Model) -> DataFrame:
    from tidemark.operators.planner import ratio_bps

    return m.summaries.select("segment_id", ratio_bps(F.col("retired_bytes") + F.col("expired_bytes"), F.col("total_bytes")).alias("bps"))


@built("pl09_clock_expiry", "SELECT w AS writes_merged, CASE WHEN w IS NULL THEN NULL ELSE least(w, 29) END AS clock_expiry FROM (VALUES (29::BIGINT), (15), (NULL)) t(w)")
def clock_expiry(m: Model) -> DataFrame:
    rows = m.spark.createDataFrame([(29,), (15,), (None,)], "writes_merged long")
    return rows.withColumn("clock_expiry", F.when(F.col("writes_merged").isNotNull(), F.least("writes_merged", F.lit(LAST_EPOCH).cast("long"))))


@built("pl10_clock_live", LIVE_AFTER.replace("12", "10"), PLAN_EPOCH)
def clock_live(m: Model) -> DataFrame:
    return planner(m).all.select("segment_id", F.col("clock_refs").alias("live_refs"), F.col("clock_bytes").alias("live_bytes"))


@built("pl14_control_decisions", """
WITH i AS (SELECT segment_id, live_bytes * 4 AS free_bytes, total_bytes AS capacity_bytes, retired_bytes AS reclaimable, unknown_bytes AS backlog, segment_id % 2 = 0 AS latency FROM summaries),
b AS (SELECT *, least(free_bytes * 10000 // capacity_bytes, 65535)::BIGINT AS free_bps FROM i),
l AS (SELECT *, CASE WHEN free_bytes <= 100000 OR free_bps <= 1000 THEN 3 WHEN free_bytes <= 200000 OR free_bps <= 2000 THEN 2 WHEN free_bytes <= 400000 OR free_bps <= 4000 THEN 1 ELSE 0 END::BIGINT AS level FROM b)
SELECT *, [32, 64, 128, 256][level + 1]::BIGINT AS budget, [20000, 15000, 15000, 5000][level + 1]::BIGINT AS min_reclaim_bytes, level >= 2 AS bypasses_latency, NOT latency OR level >= 2 AS may_run,
       level >= 1 AND (reclaimable > 0 OR backlog > 0) AND (NOT latency OR level >= 2) AS run_now FROM l""")
def control_decisions(m: Model) -> DataFrame:
    rows = m.summaries.select("segment_id", (F.col("live_bytes") * 4).alias("free_bytes"), F.col("total_bytes").alias("capacity_bytes"), F.col("retired_bytes").alias("reclaimable"), F.col("unknown_bytes").alias("backlog"), (F.col("segment_id") % 2 == 0).alias("latency"))
    return control.decide(rows)


for _name, _columns in (("pl12_pressure_level", "level"), ("pl13_effective_thresholds", "min_reclaim_bytes"), ("pl15_free_ratio", "free_bps")):
    built(_name, BUILT["pl14_control_decisions"][2].replace("SELECT *, [32", f"SELECT segment_id, {_columns} FROM (SELECT *, [32") + ") z")(lambda m, c=_columns: control_decisions(m).select("segment_id", c))


@built("pl17_output_segments", "SELECT v.shard, CASE WHEN v.end_epoch IS NULL THEN 'Spillover' ELSE 'ExactEpoch' END AS destination, v.end_epoch, count(*)::BIGINT AS n, sum(v.len)::BIGINT AS bytes FROM versions v WHERE retire_lsn IS NULL GROUP BY ALL", PLAN_EPOCH)
def output_segments(m: Model) -> DataFrame:
    live = m.versions.filter("retire_lsn IS NULL").withColumn("destination", F.when(F.col("end_epoch").isNull(), "Spillover").otherwise("ExactEpoch"))
    return live.groupBy("shard", "destination", "end_epoch").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


@built("pl18_guarded_delete", "SELECT s.segment_id, (s.total_bytes - coalesce(o.bytes, 0))::BIGINT AS net_reclaim FROM segment_summaries s LEFT JOIN (SELECT to_segment - 1000 AS segment_id, sum(len) AS bytes FROM relocations GROUP BY ALL) o USING (segment_id) WHERE s.state = 'Sealed' AND NOT s.claimed")
def guarded_delete(m: Model) -> DataFrame:
    out = m.relocations.groupBy((F.col("to_segment") - 1000).alias("segment_id")).agg(F.sum("len").alias("bytes"))
    rows = m.segment_summaries.filter("state = 'Sealed' AND NOT claimed").join(out, "segment_id", "left")
    return rows.select("segment_id", (F.col("total_bytes") - F.coalesce("bytes", F.lit(0))).alias("net_reclaim"))


@built("pl19_reclaim_attribution", f"{PLANS} SELECT segment_id, sum(reclaim_bytes)::BIGINT AS bytes, CASE WHEN min(scenario) = max(scenario) THEN min(scenario) END AS strategy FROM q WHERE segment_id IS NOT NULL GROUP BY segment_id", PLAN_EPOCH)
def reclaim_attribution(m: Model) -> DataFrame:
    rows = planner(m).plans().filter("segment_id IS NOT NULL").groupBy("segment_id")
    return rows.agg(F.sum("reclaim_bytes").alias("bytes"), F.when(F.min("scenario") == F.max("scenario"), F.min("scenario")).alias("strategy"))


SHAPES = """
WITH t AS (SELECT first_k // 200 AS part, sum(file_len) FILTER (level = 'patch') AS patch, coalesce(sum(file_len) FILTER (level = 'base'), 0) AS base, count(*) FILTER (level = 'patch') AS n FROM files GROUP BY ALL)
SELECT part::BIGINT AS part, CASE WHEN n = 0 THEN NULL WHEN patch >= greatest(DEFAULT, base // DIVISOR) THEN 'Full' WHEN n >= 8 THEN 'OTHER' END AS shape FROM t"""


def _shapes(m: Model, floor: int, divisor: int, other: str) -> DataFrame:
    bytes_of = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, F.col("file_len"))), F.lit(0))
    rows = m.files.groupBy(F.expr("first_k div 200").alias("part")).agg(bytes_of("patch").alias("patch"), bytes_of("base").alias("base"), F.count_if(F.col("level") == "patch").alias("n"))
    full = F.col("patch") >= F.greatest(F.lit(floor).cast("long"), F.call_function("div", F.col("base"), F.lit(divisor).cast("long")))
    return rows.select("part", F.when(F.col("n") > 0, F.when(full, "Full").when(F.col("n") >= 8, other)).alias("shape"))


built("pl20_compaction_shape", SHAPES.replace("DEFAULT", "400000").replace("DIVISOR", "10").replace("OTHER", "Tier"))(lambda m: _shapes(m, 400_000, 10, "Tier"))
built("pl21_relocation_shape", SHAPES.replace("DEFAULT", "900000").replace("DIVISOR", "4").replace("OTHER", "Partial"))(lambda m: _shapes(m, 900_000, 4, "Partial"))


@built("pl22_sweep_bound", "SELECT least(20000, coalesce(min(min_lsn) - 1, 20000))::BIGINT AS bound FROM files WHERE level = 'patch' AND min_lsn > 9000")
def sweep_bound(m: Model) -> DataFrame:
    rows = m.files.filter("level = 'patch' AND min_lsn > 9000").agg(F.min("min_lsn").alias("x"))
    return rows.select(F.least(F.lit(20_000).cast("long"), F.coalesce(F.col("x") - 1, F.lit(20_000).cast("long"))).alias("bound"))


@built("pl23_durability_gate", "SELECT file_id FROM files WHERE level = 'patch' AND min_lsn < (SELECT coalesce(min(min_lsn), 1000000000) FROM files WHERE level = 'patch' AND max_lsn > 15000 AND min_lsn <= 15000) AND max_lsn <= 15000")
def durability_gate(m: Model) -> DataFrame:
    patches = m.files.filter("level = 'patch'")
    cut = patches.filter("max_lsn > 15000 AND min_lsn <= 15000").agg(F.coalesce(F.min("min_lsn"), F.lit(1_000_000_000))).scalar()
    return patches.filter("max_lsn <= 15000").filter(F.col("min_lsn") < cut).select("file_id")


@built("tk01_ranked_plans", f"{PLANS} SELECT * FROM q", PLAN_EPOCH)
def ranked_plans(m: Model) -> DataFrame:
    return ranked(planner(m).plans())


@built("tk02_best_plan", f"{PLANS} SELECT * FROM q ORDER BY scenario = 'EmptyDelete' DESC, score DESC, list_position(['EmptyDelete', 'L0Compaction', 'DeadRef', 'JoinMultiple', 'PinnedEpochExpiry'], scenario), segment_id LIMIT 1", PLAN_EPOCH)
def best_plan(m: Model) -> DataFrame:
    return ranked(planner(m).plans()).limit(1)


@built("rp02_plans_by_scenario", f"{PLANS} SELECT scenario, count(*)::BIGINT AS n, sum(copied_bytes)::BIGINT AS copied_bytes, sum(reclaim_bytes)::BIGINT AS reclaim_bytes FROM q GROUP BY scenario", PLAN_EPOCH)
def plans_by_scenario(m: Model) -> DataFrame:
    return planner(m).plans().groupBy("scenario").agg(F.count("*").alias("n"), F.sum("copied_bytes").alias("copied_bytes"), F.sum("reclaim_bytes").alias("reclaim_bytes"))


@built("rp06_latency_summary", """
WITH s AS (SELECT op, len, row_number() OVER (PARTITION BY op ORDER BY len) - 1 AS i, count(*) OVER (PARTITION BY op) AS n FROM mutations)
SELECT op, max(n)::BIGINT AS n, (sum(len) // count(*))::BIGINT AS average, max(len) FILTER (i = (n - 1) * 50 // 100 + CASE WHEN (n - 1) * 50 % 100 >= 50 THEN 1 ELSE 0 END) AS p50,
       max(len) FILTER (i = (n - 1) * 99 // 100 + CASE WHEN (n - 1) * 99 % 100 >= 50 THEN 1 ELSE 0 END) AS p99, max(len) AS most FROM s GROUP BY op""")
def latency_summary(m: Model) -> DataFrame:
    return stats.timing_summary(m.mutations, "op", "len")


@built("sf08_nearest_rank", """
WITH s AS (SELECT op, len, row_number() OVER (PARTITION BY op ORDER BY len) - 1 AS i, count(*) OVER (PARTITION BY op) AS n FROM mutations)
SELECT op, max(len) FILTER (i = (n - 1) * 95 // 100 + CASE WHEN (n - 1) * 95 % 100 >= 50 THEN 1 ELSE 0 END) AS p95 FROM s GROUP BY op""")
def nearest_rank(m: Model) -> DataFrame:
    return stats.nearest_ranks(m.mutations, "op", "len", {"p95": 95})


@built("sf09_control_p99", "SELECT op, quantile_disc(len, 0.99) AS p99 FROM mutations GROUP BY op")
def control_p99(m: Model) -> DataFrame:
    return m.mutations.groupBy("op").agg(F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY len)").cast("long").alias("p99"))


@built("sf10_bucket_quantile", """
WITH b AS (SELECT op, CASE WHEN len <= 256 THEN 256 WHEN len <= 512 THEN 512 WHEN len <= 1024 THEN 1024 WHEN len <= 2048 THEN 2048 WHEN len <= 4096 THEN 4096 ELSE 8192 END AS bound, count(*) AS n FROM mutations GROUP BY ALL),
c AS (SELECT op, bound, sum(n) OVER (PARTITION BY op ORDER BY bound) AS upto, sum(n) OVER (PARTITION BY op) AS total FROM b)
SELECT op, min(bound)::BIGINT AS p90 FROM c WHERE upto * 100 >= total * 90 GROUP BY op""")
def bucket_quantile(m: Model) -> DataFrame:
    return stats.bucket_quantile(m.mutations, "op", "len", [256, 512, 1024, 2048, 4096, 8192], 90, "p90")


built("sf07_garbage_bps", BUILT["pl08_ratio_bps"][2])(ratios)


@built("sf04_key_partition", arithmetic.XXHASH64_MOD_8)
def key_partition(m: Model) -> DataFrame:
    return m.mutations.select("k").distinct().select("k", F.pmod(F.xxhash64("k"), F.lit(8)).alias("partition"))


@built("sf13_split_words", "SELECT doc_id, len(string_split(source || ' put key', ' '))::BIGINT AS words FROM documents")
def split_words(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", F.size(F.split(F.concat("source", F.lit(" put key")), " ")).cast("long").alias("words"))


@built("sf14_splitmix", arithmetic.SPLITMIX)
def splitmix(m: Model) -> DataFrame:
    return stats.splitmix64(m.mutations.select("lsn"), "lsn", "drawn")


@built("rp08_bytes_by_type", None)
def bytes_by_type(m: Model) -> DataFrame:
    files = m.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(m.sf_dir).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"\.(\w+)$", 1).alias("type")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@built("rp05_expired_still_live", f"""
SELECT v.segment_id, any_value(s.placement_epoch) AS placement_epoch, sum(v.len)::BIGINT AS live_bytes FROM versions v JOIN segments s USING (segment_id)
WHERE s.placement = 'ExactEpoch' AND s.placement_epoch <= {PLAN_EPOCH} AND v.retire_lsn IS NULL AND (v.end_epoch IS NULL OR v.end_epoch > {PLAN_EPOCH}) GROUP BY v.segment_id""", PLAN_EPOCH, FEW)
def expired_still_live(m: Model) -> DataFrame:
    m = m.settled()
    late = m.segments.filter((F.col("placement") == "ExactEpoch") & (F.col("placement_epoch") <= PLAN_EPOCH)).select("segment_id", "placement_epoch")
    live = summaries.live_after(m.summaries, m.histogram, PLAN_EPOCH).filter("live_bytes > 0").select("segment_id", "live_bytes")
    return late.join(live, "segment_id")


# Record format, sinks, logs, merges.
def _encoded(m: Model) -> DataFrame:
    record_files.small_batches(m.spark)
    return m.table("documents").select("doc_id", record_files.encoded(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")), F.lit(7)).alias("record"))


_LENGTHS = "octet_length(encode(doc_id::VARCHAR)) AS key_len, octet_length(encode(coalesce(text, ''))) AS payload_len"


@built("sc02_peeked_headers", f"SELECT doc_id, key_len::BIGINT AS key_len, payload_len::BIGINT AS payload_len, 7::BIGINT AS shard FROM (SELECT doc_id, {_LENGTHS} FROM documents)")
def peeked_headers(m: Model) -> DataFrame:
    return _encoded(m).select("doc_id", record_files.header(F.col("record")).alias("h")).select("doc_id", "h.key_len", "h.payload_len", "h.shard")


@built("sc03_decoded_records", "SELECT doc_id, doc_id::VARCHAR AS key, md5(coalesce(text, '')) AS payload_md5, true AS whole, false AS damaged_is_whole FROM documents")
def decoded_records(m: Model) -> DataFrame:
    """Records decode to what was encoded; with their last byte changed the checksum tells."""
    rows = _encoded(m).withColumn("damaged", F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.lit(b"\x00")))
    rows = rows.select("doc_id", record_files.decoded("record").alias("r"), record_files.decoded("damaged").alias("d"))
    return rows.select("doc_id", F.col("r.key").cast("string").alias("key"), F.md5("r.payload").alias("payload_md5"), F.col("r.whole").alias("whole"), F.col("d.whole").alias("damaged_is_whole"))


@built("sc04_encoded_records", f"SELECT doc_id, (64 + key_len + payload_len)::BIGINT AS encoded_len, '53545230' AS magic FROM (SELECT doc_id, {_LENGTHS} FROM documents)")
def encoded_records(m: Model) -> DataFrame:
    return _encoded(m).select("doc_id", F.octet_length("record").cast("long").alias("encoded_len"), F.hex(F.substring("record", 1, 4)).alias("magic"))


@built("sc17_sorted_table", "SELECT k, shard, lsn, op FROM mutations WHERE k >= 3 AND k < 40")
def sorted_table(m: Model) -> DataFrame:
    """A range read from files written in disjoint, sorted ranges of keys, with a bloom filter for point reads."""
    folder = fresh_folder(m.spark, "sorted")
    tables.write_sorted(m.mutations.select("k", "shard", "lsn", "op"), folder, "k", "lsn", bloom="k")
    return m.spark.read.schema("k long, shard long, lsn long, op string").parquet(folder).filter("k >= 3 AND k < 40")


def _index(m: Model) -> tables.VersionedTable:
    """Newest put of each (k, shard) up to LSN 9000, then batches of later puts and of tombstones, as versions 1 and 2."""
    table = tables.VersionedTable(m.spark, fresh_folder(m.spark, "index"), "entry string, k long, shard long, lsn long", "entry")
    named = lambda rows: rows.groupBy(F.concat_ws("/", "k", "shard").alias("entry"), "k", "shard").agg(F.max("lsn").alias("lsn"))
    table.commit(named(m.mutations.filter("op = 'put' AND lsn <= 9000")))
    late = m.mutations.filter("op IN ('put', 'tomb') AND lsn > 9000").groupBy("k", "shard").agg(F.max_by("op", "lsn").alias("op"), F.max("lsn").alias("lsn"))
    table.commit(named(late.filter("op = 'put'")), removed=late.filter("op = 'tomb'").select(F.concat_ws("/", "k", "shard").alias("entry")))
    return table


@built("sc22_pinned_snapshot", "SELECT k, shard, max(lsn) AS lsn FROM mutations WHERE op = 'put' AND lsn <= 9000 GROUP BY k, shard")
def pinned_snapshot(m: Model) -> DataFrame:
    """Version 1 reads as it did, whatever was committed after it."""
    return _index(m).snapshot(1).select("k", "shard", "lsn")


@built("sc24_index_batch", """
WITH l AS (SELECT k, shard, max(lsn) AS lsn, arg_max(op, lsn) AS op FROM mutations WHERE op IN ('put', 'tomb') AND lsn > 9000 GROUP BY k, shard),
b AS (SELECT k, shard, max(lsn) AS lsn FROM mutations WHERE op = 'put' AND lsn <= 9000 GROUP BY k, shard)
SELECT coalesce(l.k, b.k) AS k, coalesce(l.shard, b.shard) AS shard, coalesce(l.lsn, b.lsn) AS lsn FROM l FULL JOIN b ON l.k = b.k AND l.shard = b.shard WHERE l.op IS NULL OR l.op = 'put'""")
def index_batch(m: Model) -> DataFrame:
    return _index(m).snapshot().select("k", "shard", "lsn")


@built("mu08_group_commit", "SELECT 1 + lsn // 4000 AS version, count(*)::BIGINT AS n FROM mutations WHERE lsn < 12000 GROUP BY ALL")
def group_commit(m: Model) -> DataFrame:
    """Three groups of mutations, each published in one step; every reader sees whole groups."""
    table = tables.VersionedTable(m.spark, fresh_folder(m.spark, "groups"), "lsn long, version long", "lsn")
    for n in range(3):
        table.commit(m.mutations.filter(f"lsn div 4000 = {n}").select("lsn", F.lit(n + 1).cast("long").alias("version")))
    return table.snapshot().groupBy("version").agg(F.count("*").alias("n"))


@built("mu11_durable_frontier", "SELECT 3::BIGINT AS version, max(lsn) AS durable_lsn FROM mutations WHERE lsn < 12000")
def durable_frontier(m: Model) -> DataFrame:
    """What sync() waits for: the newest committed version, and the last LSN in it."""
    table = tables.VersionedTable(m.spark, fresh_folder(m.spark, "durable"), "lsn long, k long", "lsn")
    for n in range(3):
        table.commit(m.mutations.filter(f"lsn div 4000 = {n}").select("lsn", "k"))
    return table.snapshot().agg(F.lit(table.version()).cast("long").alias("version"), F.max("lsn").alias("durable_lsn"))


@built("sc26_log_cursor", """
WITH n AS (SELECT event_lsn, sum(count(*)) OVER (ORDER BY event_lsn) AS upto FROM garbage_events GROUP BY event_lsn),
a AS (SELECT max(event_lsn) AS at FROM n WHERE upto <= 40),
b AS (SELECT max(event_lsn) AS at FROM n WHERE upto - (SELECT max(upto) FROM n WHERE upto <= 40) <= 40)
SELECT CASE WHEN event_lsn <= a.at THEN 1 ELSE 2 END::BIGINT AS batch, segment_id, event_lsn, event FROM garbage_events, a, b WHERE event_lsn <= b.at""")
def log_cursor(m: Model) -> DataFrame:
    """Two batches of at most 40 events from a log, the second from where the first one's cursor ends."""
    folder = fresh_folder(m.spark, "garbage")
    names = ["segment_id", "event_lsn", "event"]
    tables.append_frames(m.settled().garbage_events.select(*names), folder, "event_lsn")
    log = m.spark.read.schema("segment_id long, event_lsn long, event string").parquet(folder)
    first, cursor = tables.read_frames(log, -1, 40, "event_lsn")
    second, _ = tables.read_frames(log, cursor, 40, "event_lsn")
    number = lambda rows, n: rows.select(F.lit(n).cast("long").alias("batch"), *names)
    return number(first, 1).unionByName(number(second, 2))


@built("sc30_summary_dump", "SELECT s.segment_id, s.state, s.placement, s.total_bytes, s.live_bytes, s.retired_bytes, (SELECT count(*) FROM histogram h WHERE h.segment_id = s.segment_id) AS buckets FROM segment_summaries s")
def summary_dump(m: Model) -> DataFrame:
    m = m.settled()
    buckets = m.histogram.groupBy("segment_id").agg(F.count("*").alias("buckets"))
    return m.segment_summaries.join(buckets, "segment_id", "left").select("segment_id", "state", "placement", "total_bytes", "live_bytes", "retired_bytes", F.coalesce("buckets", F.lit(0).cast("long")).alias("buckets"))


@built("rp14_shell_reads", """
SELECT 'get' AS command, k, shard, lsn FROM versions WHERE k = 7 AND retire_lsn IS NULL AND (end_epoch IS NULL OR end_epoch > 29)
UNION ALL SELECT 'range', k, shard, lsn FROM versions WHERE k >= 3 AND k < 20 AND retire_lsn IS NULL AND (end_epoch IS NULL OR end_epoch > 29)
UNION ALL SELECT 'segment', k, shard, lsn FROM versions WHERE segment_id = 3""")
def shell_reads(m: Model) -> DataFrame:
    store = Store(m.mutations)
    each = {"get": store.get(7), "range": store.range(3, 20), "segment": store.segment(3)}
    named = [rows.select(F.lit(x).alias("command"), "k", "shard", "lsn") for x, rows in each.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@built("fp13_bloom", "SELECT DISTINCT k, true AS may_contain FROM mutations WHERE op = 'put'")
def bloom(m: Model) -> DataFrame:
    """A filter of ten bits a key never denies a key that it was built from."""
    puts = m.mutations.filter("op = 'put'").select("k").distinct()
    return frontiers.bloom_probe(puts, frontiers.bloom_bits(puts, "k"), "k")


@built("sf21_key_codec", "SELECT DISTINCT k, lower(lpad(to_hex(k), 16, '0')) AS encoded FROM mutations WHERE k >= 0")
def key_codec(m: Model) -> DataFrame:
    """Big-endian keys with the sign turned, whose bytes sort as the numbers do; in hex, with the sign turned back."""
    from tidemark.functions.codec import decode_key, encode_key

    keys = m.mutations.select("k").distinct().withColumn("code", encode_key(F.col("k")))
    return keys.select(decode_key(F.col("code")).alias("k"), F.lower(F.lpad(F.hex(decode_key(F.col("code"))), 16, "0")).alias("encoded"))


@built("ux01_replace_merge", "SELECT k, max(lsn) AS lsn, count(*) - 1 AS replaced FROM mutations WHERE op = 'put' GROUP BY k")
def replace_merge(m: Model) -> DataFrame:
    """Last write wins through the merge operator, base and patches apart, with what is replaced as its side output."""
    rows = m.mutations.filter("op = 'put'").select("k", "lsn", F.col("len").alias("v"))
    base = merge.latest(rows.filter("lsn <= 9000"), ["k"], "lsn")
    older = rows.filter("lsn <= 9000").groupBy("k").agg((F.count("*") - 1).alias("older"))
    got = merge.merged(base, rows.filter("lsn > 9000"), merge.replace_latest("k", "lsn", "v"), "k", "lsn", "k long, lsn long, v long", "k long, lsn long")
    state, events = got.filter("kind = 'state'").select("k", "lsn"), got.filter("kind = 'event'").groupBy("k").agg(F.count("*").alias("events"))
    return state.join(events, "k", "left").join(older, "k", "left").select("k", "lsn", (F.coalesce("events", F.lit(0)) + F.coalesce("older", F.lit(0))).alias("replaced"))


@built("ux02_blob_merge", "SELECT k, shard, lsn FROM versions WHERE retire_lsn IS NULL")
def blob_merge(m: Model) -> DataFrame:
    """Live versions of each key by the merge operator that folds mutations in order."""
    log = m.mutations.select("k", "lsn", "shard", "epoch", "op", "end_epoch")
    got = merge.merged(m.spark.createDataFrame([], "k long, state string"), log, merge.blob_merge(), "k", "lsn", "k long, state string", "k long, lsn long")
    live = got.filter("kind = 'state'").select("k", F.explode(F.from_json(F.get_json_object("state", "$.live"), "map<string, array<long>>")).alias("shard", "v"))
    return live.select("k", F.col("shard").cast("long").alias("shard"), F.col("v")[0].alias("lsn"))
