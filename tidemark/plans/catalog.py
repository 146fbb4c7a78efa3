"""Queries in portable SQL: one text for Spark (over the model's tables) and for DuckDB. By survey id."""

from __future__ import annotations

from tidemark.plans.model import LAST_EPOCH, PLAN_EPOCH

#: name: (text, epoch that the log ends at).
PORTABLE: dict[str, tuple[str, int | None]] = {}


def query(name: str, text: str, through: int | None = None) -> None:
    PORTABLE[name] = (text.replace("@NOW", str(LAST_EPOCH if through is None else through)), through)


# Scans and sinks.
query("sc01_append_records", "SELECT lsn, k, segment_id, offset, len FROM {records}")
query("sc05_valid_prefix", """
WITH bad AS (SELECT segment_id, min(offset) AS at FROM {records} WHERE lsn % 997 = 0 GROUP BY segment_id)
SELECT r.segment_id, r.offset, r.len FROM {records} r LEFT JOIN bad b ON b.segment_id = r.segment_id WHERE b.at IS NULL OR r.offset < b.at""")
query("sc06_recoverable_prefix", """
WITH bad AS (SELECT segment_id, min(offset) AS at FROM {records} WHERE lsn % 997 = 0 GROUP BY segment_id)
SELECT s.segment_id, CAST(s.sealed_len // 2 AS BIGINT) AS durable_offset, b.at AS damaged_at, b.at IS NOT NULL AND b.at < s.sealed_len // 2 AS corrupt
FROM {segments} s LEFT JOIN bad b ON b.segment_id = s.segment_id""")
query("sc07_read_record", "SELECT lsn, k, len FROM {records} WHERE segment_id = 2 AND offset < 4096")
query("sc09_record_metadata", "SELECT lsn, k, shard, epoch FROM {records} WHERE segment_id BETWEEN 1 AND 3")
query("sc11_record_header", "SELECT segment_id, offset, CAST(len - 68 AS BIGINT) AS payload_len, CAST(4 AS BIGINT) AS key_len FROM {records}")
query("sc12_base_get", "SELECT k, max(lsn) AS lsn FROM {versions} WHERE k = 7 AND retire_lsn IS NULL GROUP BY k")
query("sc13_key_patches", "SELECT lsn, op, shard, end_epoch FROM {mutations} WHERE k = 7")
query("sc14_base_scan", "SELECT k, shard, lsn FROM {versions} WHERE k >= 3 AND k < 9 AND retire_lsn IS NULL")
query("sc15_patch_scan", "SELECT k, lsn, op FROM {mutations} WHERE k >= 3 AND k < 9")
query("sc16_prefix_scan", "SELECT k, lsn, op FROM {mutations} WHERE substring(CAST(k AS VARCHAR(20)), 1, 1) = '1'")
query("sc18_snapshot_scan", "SELECT k, shard, max(lsn) AS lsn FROM {mutations} WHERE lsn <= 5000 AND k BETWEEN 2 AND 11 AND op = 'put' GROUP BY k, shard")
query("sc19_seek", "SELECT k, lsn FROM {mutations} WHERE k >= greatest(3, 6) AND k < 9 AND op = 'put'")
query("sc20_merged_rows", "SELECT k, CAST(count(*) AS BIGINT) AS live FROM {versions} WHERE retire_lsn IS NULL GROUP BY k ORDER BY k")
query("sc21_full_scan", "SELECT segment_id, state, placement, placement_epoch, claimed FROM {segments}")
query("sc23_is_present", "SELECT CAST(count(*) > 0 AS BOOLEAN) AS present FROM {versions} WHERE k = 7 AND retire_lsn IS NULL")
query("sc25_read_your_writes", """
WITH staged AS (SELECT k, shard, lsn, 1 AS staged FROM {mutations} WHERE op = 'put' AND lsn % 50 = 2),
both_of AS (SELECT k, shard, lsn, 0 AS staged FROM {versions} WHERE retire_lsn IS NULL UNION ALL SELECT * FROM staged)
SELECT k, shard, CAST(max(staged * 1000000000000 + lsn) % 1000000000000 AS BIGINT) AS lsn FROM both_of GROUP BY k, shard""")
query("sc27_segment_garbage", "SELECT k, event_lsn, event, offset, len FROM {garbage_events} WHERE segment_id = 3")
query("sc28_wal_replay", "SELECT lsn, op, k, shard FROM {mutations} WHERE lsn > 1000 ORDER BY lsn")
query("sc31_contains", "SELECT k, CAST(count(*) AS BIGINT) AS n FROM {versions} WHERE retire_lsn IS NULL AND (end_epoch IS NULL OR end_epoch > @NOW) GROUP BY k")

# Mutations.
query("mu01_put", "SELECT lsn, k, shard, epoch, len FROM {mutations} WHERE op = 'put'")
query("mu02_set_lifetime", "SELECT lsn, k, end_epoch FROM {mutations} WHERE op = 'life'")
query("mu03_tombstone", "SELECT lsn, k, shard FROM {mutations} WHERE op = 'tomb'")
query("mu04_delete_key", "SELECT lsn, k FROM {mutations} WHERE op = 'del'")
query("mu05_epochs", "SELECT lsn, epoch, CAST(max(epoch) OVER (ORDER BY lsn) AS BIGINT) AS advanced FROM {epoch_changes}")
query("mu06_batches", "SELECT CAST(lsn // 200 AS BIGINT) AS batch, lsn, CAST(row_number() OVER (PARTITION BY lsn // 200 ORDER BY lsn) + 100 AS BIGINT) AS batch_lsn FROM {mutations}")
query("mu07_prepare_batch", """
WITH b AS (SELECT *, lsn // 200 AS batch, op = 'life' AND end_epoch <= epoch + 1 AS bad FROM {mutations}),
j AS (SELECT batch, max(CASE WHEN bad THEN 1 ELSE 0 END) AS rejected FROM b GROUP BY batch)
SELECT CAST(b.batch AS BIGINT) AS batch, b.lsn, b.epoch FROM b JOIN j ON j.batch = b.batch WHERE j.rejected = 0""")
query("mu09_shard_generations", "SELECT shard_id, CAST(current_generation + CASE WHEN state = 'Dropped' THEN 1 ELSE 0 END AS BIGINT) AS next_generation FROM {shards}")
query("mu10_tracked_batches", "SELECT CAST(lsn // 200 AS BIGINT) AS batch_key, min(lsn) AS first_lsn, max(lsn) AS last_lsn, CAST(count(*) AS BIGINT) AS n FROM {mutations} GROUP BY lsn // 200")
query("mu12_rollback", "SELECT lsn, k, op FROM {mutations} WHERE lsn < 15000")

# Predicates.
query("fp01_visible", "SELECT k, shard, lsn FROM {versions} WHERE retire_lsn IS NULL AND (end_epoch IS NULL OR end_epoch > @NOW)")
query("fp02_effective_lifetime", "SELECT k, shard, lsn, end_epoch, CAST(extension_count AS BIGINT) AS extension_count FROM {versions} WHERE retire_lsn IS NULL")
query("fp03_eligible_source", "SELECT segment_id FROM {segment_summaries} WHERE state = 'Sealed' AND NOT claimed AND (max_lsn IS NULL OR max_lsn <= 9000000) AND total_bytes > 0")
query("fp04_empty_delete_source", "SELECT segment_id FROM {segment_summaries} WHERE state IN ('Sealed', 'GcRelocating') AND NOT claimed AND total_bytes > 0")
query("fp05_liveness_complete", "SELECT segment_id, max_lsn IS NULL OR max_lsn <= 10000 AS complete FROM {segments}")
query("fp06_obsolete_generation", """
SELECT v.shard, CAST(count(*) AS BIGINT) AS n, s.shard_id IS NOT NULL AND (s.current_generation > 0 OR s.state = 'Dropped') AS obsolete
FROM {versions} v LEFT JOIN {shards} s ON s.shard_id = v.shard GROUP BY v.shard, s.shard_id, s.current_generation, s.state""")
query("fp07_lifetimes_accounted", "SELECT segment_id, unknown_bytes = 0 OR max_lsn <= 10000 AS accounted FROM {segment_summaries}")
query("fp08_useful_exact_bucket", f"SELECT segment_id, end_epoch, end_epoch - {PLAN_EPOCH} >= 1 AND bytes >= 500 AS useful FROM {{histogram}}", PLAN_EPOCH)
query("fp09_useful_l0_bucket", f"SELECT segment_id, end_epoch, end_epoch - {PLAN_EPOCH} >= 2 AS useful FROM {{histogram}}", PLAN_EPOCH)
query("fp10_stable_lifetimes", "SELECT s.segment_id, coalesce(max(e.extension_count), 0) <= 1 AS stable FROM {segments} s LEFT JOIN {extensions} e ON e.segment_id = s.segment_id GROUP BY s.segment_id")
query("fp12_range_overlap", "SELECT segment_id, offset, len FROM {records} WHERE offset < 8000 AND offset + len > 4000")
query("fp14_readable_segments", "SELECT segment_id FROM {segments} WHERE state <> 'Deleted'")
query("fp15_owned_segments", "SELECT DISTINCT r.segment_id, r.shard FROM {records} r JOIN {segments} s ON s.segment_id = r.segment_id WHERE s.segment_id % 2 = 0 OR r.shard = s.segment_id % 3")
query("fp16_readable_shards", "SELECT shard_id, current_generation FROM {shards} WHERE state = 'Active'")
query("fp17_unsealed", "SELECT segment_id FROM {segments} WHERE state IN ('Open', 'Sealing')")
query("fp19_shard_retirement", """
SELECT v.k, v.shard, v.lsn, CASE WHEN s.state = 'Dropped' THEN CAST(12000 AS BIGINT) WHEN s.current_generation > 0 THEN CAST(20000 AS BIGINT) END AS retired_at
FROM {versions} v LEFT JOIN {shards} s ON s.shard_id = v.shard WHERE v.retire_lsn IS NULL""")

# Joins.
query("jn01_merge_cogroup", """
SELECT k, CAST(sum(base) AS BIGINT) AS base_rows, CAST(sum(patch) AS BIGINT) AS patch_rows FROM (
  SELECT k, 1 AS base, 0 AS patch FROM {mutations} WHERE lsn <= 10000 UNION ALL SELECT k, 0, 1 FROM {mutations} WHERE lsn > 10000) GROUP BY k""")
query("jn02_relocations_for_key", "SELECT v.k, v.shard, v.lsn, r.to_segment FROM {versions} v LEFT JOIN {relocations} r ON r.k = v.k AND r.shard = v.shard AND r.payload_lsn = v.lsn")
query("jn03_healed_refs", "SELECT v.k, v.shard, v.lsn, coalesce(r.to_segment, v.segment_id) AS segment_id, coalesce(r.to_offset, v.offset) AS offset FROM {versions} v LEFT JOIN {relocations} r ON r.k = v.k AND r.shard = v.shard AND r.payload_lsn = v.lsn WHERE v.retire_lsn IS NULL")
query("jn03_orphaned_copies", "SELECT r.k, r.shard, r.payload_lsn, r.to_segment FROM {relocations} r WHERE NOT EXISTS (SELECT 1 FROM {versions} v WHERE v.k = r.k AND v.shard = r.shard AND v.lsn = r.payload_lsn AND v.retire_lsn IS NULL AND (v.end_epoch IS NULL OR v.end_epoch > @NOW))")
query("jn04_gc_snapshot", "SELECT segment_id, state, placement, claimed, total_bytes, live_bytes, retired_bytes, live_refs FROM {segment_summaries}")
query("jn08_destinations", f"""
SELECT v.lsn, CASE WHEN h.end_epoch IS NOT NULL AND h.bytes >= 500 THEN 'ExactEpoch' ELSE 'Spillover' END AS destination
FROM {{versions}} v LEFT JOIN {{histogram}} h ON h.segment_id = v.segment_id AND h.end_epoch = v.end_epoch WHERE v.retire_lsn IS NULL""", PLAN_EPOCH)
query("jn09_copy_selection", "SELECT v.segment_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(v.len) AS BIGINT) AS bytes, CAST(sum(v.len) AS BIGINT) = max(s.live_bytes) AS complete FROM {versions} v JOIN {summaries} s ON s.segment_id = v.segment_id WHERE v.retire_lsn IS NULL GROUP BY v.segment_id")
query("jn10_relocation_lookup", "SELECT r.payload_lsn, max(r.to_segment) AS to_segment FROM {relocations} r JOIN {mutations} m ON m.lsn = r.payload_lsn GROUP BY r.payload_lsn")
query("jn11_live_record_ref", """
SELECT v.k, v.shard, CASE WHEN s.segment_id % 5 = 0 THEN r.to_segment ELSE v.segment_id END AS segment_id
FROM {versions} v JOIN {segments} s ON s.segment_id = v.segment_id LEFT JOIN {relocations} r ON r.k = v.k AND r.shard = v.shard AND r.payload_lsn = v.lsn
WHERE v.retire_lsn IS NULL AND (v.end_epoch IS NULL OR v.end_epoch > @NOW)""")
query("jn12_contains_in_shards", "SELECT k FROM {versions} WHERE retire_lsn IS NULL AND shard IN (0, 1, 2) GROUP BY k HAVING count(DISTINCT shard) = 3")
query("jn13_orphan_files", "SELECT f.segment_id FROM {segment_files} f WHERE NOT EXISTS (SELECT 1 FROM {segments} s WHERE s.segment_id = f.segment_id)")
query("jn14_live_relocations", "SELECT r.k, r.shard, r.payload_lsn FROM {relocations} r WHERE NOT EXISTS (SELECT 1 FROM {segments} s WHERE s.segment_id + 1000 = r.to_segment AND s.claimed)")
query("jn15_redirected_garbage", "SELECT g.k, g.event_lsn, coalesce(r.to_segment, g.segment_id) AS segment_id FROM {garbage_events} g LEFT JOIN {relocations} r ON r.to_segment = g.segment_id + 1000 AND r.to_offset = g.offset")
query("jn18_publish_revalidation", "SELECT r.to_segment, CAST(sum(CASE WHEN v.retire_lsn IS NULL AND (v.end_epoch IS NULL OR v.end_epoch > @NOW) THEN 1 ELSE 0 END) AS BIGINT) AS survivors, CAST(count(*) AS BIGINT) AS copies FROM {relocations} r JOIN {versions} v ON v.lsn = r.payload_lsn GROUP BY r.to_segment")
query("jn19_claimed_flags", "SELECT s.segment_id, EXISTS (SELECT 1 FROM {claims} c WHERE c.segment_id = s.segment_id) AS claimed FROM {segments} s")
query("jn20_publish_fence", "SELECT r.k, r.payload_lsn, s.segment_id AS source, r.to_segment FROM {relocations} r JOIN {segments} s ON s.segment_id + 1000 = r.to_segment")
query("jn21_shard_cleanup", "SELECT DISTINCT v.segment_id, v.shard FROM {versions} v JOIN {shards} s ON s.shard_id = v.shard JOIN {segments} g ON g.segment_id = v.segment_id WHERE s.state = 'Dropped' AND g.max_lsn <= 15000")
query("jn22_shard_metadata_delete", "SELECT r.k, r.shard, r.payload_lsn FROM {relocations} r WHERE EXISTS (SELECT 1 FROM {shards} s WHERE s.shard_id = r.shard AND s.state = 'Dropped')")

# Aggregations.
query("ag01_state_fold", "SELECT k, shard, lsn, write_epoch, len, end_epoch, CAST(extension_count AS BIGINT) AS extension_count FROM {versions} WHERE retire_lsn IS NULL")
query("ag02_apply", "SELECT lsn, retire_lsn FROM {versions}")
query("ag05_replace", "SELECT k, shard, max(lsn) AS lsn FROM {mutations} WHERE op = 'put' GROUP BY k, shard")
query("ag07_compact_through", "SELECT k, shard, max(lsn) AS lsn, CAST('head' AS VARCHAR(4)) AS part FROM {mutations} WHERE op = 'put' AND lsn <= 9000 GROUP BY k, shard UNION ALL SELECT k, shard, lsn, 'tail' FROM {mutations} WHERE op = 'put' AND lsn > 9000")
query("ag08_rollback_tail", "SELECT k, shard, lsn FROM {mutations} WHERE op IN ('put', 'tomb') AND lsn < 9000")
query("ag10_op_at_lsn", "SELECT lsn, op, k FROM {mutations} WHERE lsn = 1242")
query("ag11_garbage_deltas", "SELECT segment_id, k, event_lsn, CASE WHEN event = 'Retired' THEN -len ELSE 0 END AS live_bytes, CASE WHEN event = 'Retired' THEN len ELSE 0 END AS retired_bytes, CASE WHEN end_epoch IS NULL THEN 0 ELSE len END AS epoch_bytes FROM {garbage_events}")
query("ag14_allocation_baseline", "SELECT segment_id, CAST(sum(len) AS BIGINT) AS total_bytes, CAST(sum(len) AS BIGINT) AS live_bytes, CAST(count(*) AS BIGINT) AS live_refs FROM {records} GROUP BY segment_id")
query("ag15_garbage_ratio", "SELECT segment_id, retired_bytes + expired_bytes AS garbage_bytes, CASE WHEN total_bytes = 0 THEN 0 ELSE CAST(retired_bytes + expired_bytes AS DOUBLE) / CAST(total_bytes AS DOUBLE) END AS ratio FROM {summaries}")
query("ag18_live_epoch_bounds", "SELECT segment_id, min(end_epoch) AS min_end_epoch, max(end_epoch) AS max_end_epoch FROM {histogram} GROUP BY segment_id")
query("ag19_merge_applied_through", "SELECT least(max(max_lsn), min(CASE WHEN level = 'base' THEN max_lsn END), min(CASE WHEN level = 'patch' THEN min_lsn - 1 END)) AS lsn FROM {files}")
query("ag20_writes_merged_through", "SELECT least(max(max_lsn), coalesce(min(CASE WHEN level = 'patch' THEN min_lsn - 1 END), max(max_lsn))) AS lsn FROM {files}")
query("ag21_global_writes_merged", """
WITH floors AS (SELECT k, CASE WHEN max(CASE WHEN op = 'put' THEN 1 ELSE 0 END) = 1 THEN NULL ELSE min(CASE WHEN op = 'life' THEN lsn END) END AS at_lsn FROM {mutations} WHERE epoch % 3 = 0 GROUP BY k)
SELECT least((SELECT max(lsn) FROM {mutations}), coalesce(min(at_lsn) - 1, (SELECT max(lsn) FROM {mutations}))) AS lsn FROM floors""")
query("ag22_operand_floor_merge", """
WITH o AS (SELECT k // 10 AS g, lsn, CASE WHEN op = 'del' AND lsn % 7 = 0 THEN 'unknown' WHEN op = 'life' THEN 'at' ELSE 'none' END AS kind FROM {mutations})
SELECT CAST(g AS BIGINT) AS g, CASE WHEN max(CASE WHEN kind = 'unknown' THEN 1 ELSE 0 END) = 1 THEN 'unknown' WHEN min(CASE WHEN kind = 'at' THEN lsn END) IS NULL THEN 'none' ELSE 'at' END AS kind,
       CASE WHEN max(CASE WHEN kind = 'unknown' THEN 1 ELSE 0 END) = 0 THEN min(CASE WHEN kind = 'at' THEN lsn END) END AS at FROM o GROUP BY g""")
query("ag23_operand_floor", "SELECT k, CASE WHEN max(CASE WHEN op = 'put' THEN 1 ELSE 0 END) = 1 THEN NULL ELSE min(CASE WHEN op = 'life' THEN lsn END) END AS floor_lsn FROM {mutations} WHERE lsn > 1800 GROUP BY k")
query("ag24_store_totals", "SELECT CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(live_bytes) AS BIGINT) AS live_bytes, CAST(sum(retired_bytes) AS BIGINT) AS retired_bytes, CAST(sum(live_refs) AS BIGINT) AS live_refs FROM {segment_summaries} WHERE state <> 'Deleted'")
query("ag25_output_bytes_by_source", """
WITH used AS (SELECT DISTINCT to_segment FROM {relocations} WHERE to_offset % 2 = 0)
SELECT r.to_segment - 1000 AS source, CAST(sum(r.len) AS BIGINT) AS bytes FROM {relocations} r WHERE EXISTS (SELECT 1 FROM used u WHERE u.to_segment = r.to_segment) GROUP BY r.to_segment - 1000""")
query("ag26_output_birth", "SELECT r.to_segment, CAST(sum(r.len) AS BIGINT) AS bytes, CAST(sum(CASE WHEN v.end_epoch IS NULL THEN r.len ELSE 0 END) AS BIGINT) AS unknown_bytes, CAST(count(*) AS BIGINT) AS refs FROM {relocations} r JOIN {versions} v ON v.lsn = r.payload_lsn GROUP BY r.to_segment")
query("ag27_output_lsn_bounds", "SELECT to_segment, min(payload_lsn) AS min_lsn, max(payload_lsn) AS max_lsn FROM {relocations} GROUP BY to_segment")
query("ag28_segment_bounds", "SELECT segment_id, min(lsn) AS min_lsn, max(lsn) AS max_lsn, CAST(sum(len) AS BIGINT) AS extent FROM {records} GROUP BY segment_id")
query("ag32_unsealed_count", "SELECT CAST(sum(CASE WHEN state = 'Open' AND placement = 'Ingest' THEN 1 ELSE 0 END) AS BIGINT) AS unsealed_ingest, CAST(sum(CASE WHEN state = 'GcRelocating' THEN 1 ELSE 0 END) AS BIGINT) AS relocating FROM {segments}")
query("ag34_overlay_fold", "SELECT segment_id, offset, len, CASE WHEN max(CASE WHEN event = 'Retired' THEN 1 ELSE 0 END) = 1 THEN 'retired' ELSE 'live' END AS state, max(end_epoch) AS end_epoch FROM {garbage_events} GROUP BY segment_id, offset, len")

# Ordered computations.
query("wn01_latest_version", "SELECT k, shard, lsn FROM (SELECT k, shard, lsn, row_number() OVER (PARTITION BY k, shard ORDER BY lsn DESC) AS rn FROM {mutations} WHERE op IN ('put', 'tomb')) WHERE rn = 1")
query("wn02_retirements", "SELECT lsn, k, shard, retire_lsn FROM {versions} WHERE retire_lsn IS NOT NULL")
query("wn04_lsn_validation", "SELECT CAST(count(*) AS BIGINT) AS violations FROM (SELECT lsn, lag(lsn) OVER (PARTITION BY k ORDER BY lsn) AS before FROM {mutations}) WHERE before >= lsn")
query("wn05_event_conflicts", "SELECT segment_id, k, event_lsn, offset, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT segment_id, k, event_lsn, offset, len, event FROM (SELECT segment_id, k, event_lsn, offset, len, event FROM {garbage_events} UNION ALL SELECT segment_id, k, event_lsn, offset, len + CASE WHEN event_lsn % 15 = 0 THEN 1 ELSE 0 END, event FROM {garbage_events} WHERE event_lsn % 3 = 0) restated WHERE event <> 'SetLifecycle') GROUP BY segment_id, k, event_lsn, offset HAVING count(*) > 1")
query("wn11_relocation_tier", """
WITH p AS (SELECT file_id, file_len, min(file_len) OVER () AS least_len FROM {files} WHERE level = 'patch'),
t AS (SELECT file_id, file_len, row_number() OVER (ORDER BY file_id) AS rn, count(*) OVER () AS n FROM p WHERE file_len <= 4 * greatest(least_len, 1))
SELECT file_id, file_len FROM t WHERE rn <= 16 AND n >= 2""")
query("wn13_epoch_timeline", "SELECT lsn, 1 AS kind, epoch FROM {epoch_changes} UNION ALL SELECT lsn, 0, epoch FROM {mutations}")

# Sorts, limits, sets.
query("tk03_top_sources", "SELECT end_epoch, segment_id, bytes FROM (SELECT end_epoch, segment_id, bytes, row_number() OVER (PARTITION BY end_epoch ORDER BY bytes DESC, segment_id) AS rn FROM {histogram}) WHERE rn <= 8")
query("tk04_oldest_rows", "SELECT segment_id, state, max_lsn FROM {segments} WHERE state = 'Sealed' ORDER BY segment_id LIMIT 10")
query("tk05_stalest_file", "SELECT file_id, max_lsn FROM {files} WHERE level = 'base' ORDER BY max_lsn, file_id LIMIT 1")
query("tk06_garbage_order", "SELECT segment_id, k, event_lsn, offset, len FROM {garbage_events} ORDER BY segment_id, k, event_lsn, offset, len")
query("tk07_latest_sorted", "SELECT k, max(lsn) AS lsn FROM {mutations} GROUP BY k ORDER BY k")
query("tk08_first_claimable", "SELECT segment_id, retired_bytes FROM {segment_summaries} WHERE NOT claimed AND state = 'Sealed' ORDER BY retired_bytes DESC, segment_id LIMIT 1")
query("st01_union_all", "SELECT k, lsn FROM {mutations} WHERE lsn <= 4000 UNION ALL SELECT k, lsn FROM {mutations} WHERE lsn > 4000 AND lsn <= 6000 UNION ALL SELECT k, lsn FROM {mutations} WHERE lsn > 6000")
query("st03_semantic_dedup", "SELECT DISTINCT segment_id, k, event_lsn, event, offset, len FROM (SELECT * FROM {garbage_events} UNION ALL SELECT * FROM {garbage_events} WHERE event_lsn % 3 = 0)")
query("st04_live_indexes", "SELECT segment_id FROM {segments} EXCEPT SELECT segment_id FROM {segments} WHERE claimed")
query("st05_plan_sources", "SELECT DISTINCT segment_id FROM {histogram}")
query("st06_disjoint_claims", "SELECT CAST(count(*) = 0 AS BOOLEAN) AS disjoint FROM (SELECT segment_id FROM {segments} WHERE claimed INTERSECT SELECT segment_id FROM {segments} WHERE placement = 'Ingest')")

# Scalars.
query("sf01_record_len", "SELECT doc_id, CAST(64 + octet_length(encode(text@UTF)) + octet_length(encode(source@UTF)) AS BIGINT) AS encoded_len FROM {documents}")
query("sf03_offsets", "SELECT segment_id, offset, offset + 64 AS key_offset, offset + 68 AS payload_offset FROM {records}")
query("sf06_saturating", "SELECT segment_id, greatest(live_bytes - 100000, 0) AS left_bytes FROM {summaries}")
query("sf11_amplification", "SELECT segment_id, coalesce(CAST(total_bytes AS DOUBLE) / CAST(nullif(live_bytes, 0) AS DOUBLE), 0) AS amplification FROM {summaries}")
query("sf12_labels", "SELECT segment_id, CASE placement WHEN 'Ingest' THEN 'ingest' WHEN 'ExactEpoch' THEN 'exact_epoch' ELSE 'spillover' END AS label FROM {segments}")
query("sf15_writer_count", "SELECT segment_id, CASE WHEN live_bytes > retired_bytes THEN least((total_bytes // 40000) + 1, 16) ELSE greatest((total_bytes // 80000) - 1, 1) END AS writers FROM {summaries}")
query("sf16_assignments", "SELECT k, lsn, end_epoch - epoch AS future_offset FROM {mutations} WHERE op = 'life'")
query("sf17_file_name", "SELECT segment_id, concat(lpad(CAST(segment_id AS VARCHAR(12)), 12, '0'), '.data') AS file_name FROM {segments}")
query("sf18_valid_keys", "SELECT doc_id FROM {documents} WHERE octet_length(encode(source@UTF)) BETWEEN 1 AND 4096")
query("sf19_payload_range", "SELECT lsn, len FROM {records} WHERE 100 + 900 <= len - 68")
query("sf20_log_position", "SELECT lsn, epoch < 12 OR (epoch = 12 AND lsn <= 8000) AS at_or_before FROM {mutations}")

# Reports.
query("rp01_garbage_deciles", "SELECT CAST(least((retired_bytes + expired_bytes) * 10 // total_bytes, 10) AS BIGINT) AS decile, CAST(count(*) AS BIGINT) AS n, CAST(sum(total_bytes) AS BIGINT) AS bytes FROM {segment_summaries} WHERE state = 'Sealed' AND placement <> 'Ingest' AND total_bytes > 0 GROUP BY least((retired_bytes + expired_bytes) * 10 // total_bytes, 10)")
query("rp03_oldest_sealed", "SELECT segment_id, placement, total_bytes, live_bytes FROM {segment_summaries} WHERE state = 'Sealed' ORDER BY segment_id LIMIT 20")
query("rp04_class_state_rollup", """
WITH h AS (SELECT segment_id, sum(CASE WHEN end_epoch <= 29 THEN bytes ELSE 0 END) AS ended, sum(CASE WHEN end_epoch > 29 THEN bytes ELSE 0 END) AS later FROM {histogram} GROUP BY segment_id)
SELECT s.placement, s.state, CAST(count(*) AS BIGINT) AS n, CAST(sum(s.total_bytes) AS BIGINT) AS total_bytes, CAST(sum(s.live_bytes) AS BIGINT) AS live_bytes, CAST(sum(coalesce(h.ended, 0)) AS BIGINT) AS ended_bytes,
       CAST(sum(coalesce(h.later, 0)) AS BIGINT) AS later_bytes, CAST(sum(s.unknown_bytes) AS BIGINT) AS unknown_bytes, CAST(sum(s.live_bytes - s.unknown_bytes - coalesce(h.ended, 0) - coalesce(h.later, 0)) AS BIGINT) AS remainder
FROM {segment_summaries} s LEFT JOIN h ON h.segment_id = s.segment_id GROUP BY s.placement, s.state""")
query("rp07_state_metrics", "SELECT state, CAST(count(*) AS BIGINT) AS n, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(live_bytes) AS BIGINT) AS live_bytes, CAST(sum(retired_bytes) AS BIGINT) AS retired_bytes FROM {segment_summaries} GROUP BY state")
query("rp09_scorecard", "SELECT CAST(count(*) AS BIGINT) AS records, CAST(sum(CASE WHEN retire_lsn IS NOT NULL THEN 1 ELSE 0 END) * 10000 // count(*) AS BIGINT) AS retired_bps, sum(CASE WHEN retire_lsn IS NULL THEN 1 ELSE 0 END) * 100 // count(*) >= 2 AS enough_live FROM {versions}")
query("rp10_lifetime_offsets", "SELECT end_epoch - epoch AS future_offset, CAST(count(*) AS BIGINT) AS n FROM {mutations} WHERE op = 'life' GROUP BY end_epoch - epoch")
query("rp11_delete_backlog", "SELECT CAST(count(*) AS BIGINT) AS due, CAST(coalesce(sum(CASE WHEN end_epoch <= 28 THEN 1 ELSE 0 END), 0) AS BIGINT) AS overdue, max(29 - end_epoch) AS oldest_lag FROM {versions} WHERE retire_lsn IS NULL AND end_epoch <= 29")
query("rp12_reclaim_timeline", "SELECT epoch, CAST(count(*) AS BIGINT) AS mutations, CAST(sum(CASE WHEN op = 'put' THEN len ELSE 0 END) AS BIGINT) AS bytes FROM {mutations} GROUP BY epoch")
query("rp13_model_check", "SELECT CAST(count(*) AS BIGINT) AS checked, CAST(sum(CASE WHEN m.lsn IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM {versions} v LEFT JOIN {mutations} m ON m.op = 'put' AND m.k = v.k AND m.shard = v.shard AND m.lsn = v.lsn WHERE v.retire_lsn IS NULL")
query("live_blobs", "SELECT k, CAST(count(*) AS BIGINT) AS live, CAST(sum(len) AS BIGINT) AS bytes, max(lsn) AS newest FROM {versions} WHERE retire_lsn IS NULL AND (end_epoch IS NULL OR end_epoch > @NOW) GROUP BY k")
