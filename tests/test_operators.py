"""Operators on small hand-made inputs: lifetimes, planner scenarios, ranges, folds, streams."""

import random

import pytest

from tidemark.operators import folds, frontiers, intervals, summaries, versions
from tidemark.operators.merge import fold
from tidemark.operators.planner import Planner, ranked
from tidemark.sources.events import numbered
from tidemark.streaming import sweep
from tidemark.streaming.sweep import LOG_SCHEMA, fold_stream, stream_in_parts

LOG = "lsn long, k long, shard long, epoch long, op string, end_epoch long, len long"


def log_of(spark, rows):
    return spark.createDataFrame([(lsn, k, s, e, op, end, 100) for lsn, k, s, e, op, end in rows], LOG)


def live(spark, rows):
    return {(r.k, r.shard): (r.lsn, r.end_epoch, r.extension_count) for r in versions.resolve(log_of(spark, rows)).collect() if r.retire_lsn is None}


def test_lifetime_rules(spark):
    put, life, tomb, delete = "put", "life", "tomb", "del"
    rows = [
        (2, 1, 0, 0, put, 0), (4, 1, 0, 0, life, 5), (6, 1, 0, 2, life, 9),  # extended while alive
        (2, 2, 0, 0, put, 0), (4, 2, 0, 0, life, 3), (6, 2, 0, 4, life, 9),  # extension after the end can't revive
        (2, 3, 0, 0, life, 3), (4, 3, 0, 4, put, 0),  # a put after the end doesn't inherit it
        (2, 4, 0, 0, put, 0), (4, 4, 1, 0, put, 0), (6, 4, 0, 1, tomb, 0),  # a tombstone is of one shard
        (2, 5, 0, 0, put, 0), (4, 5, 1, 0, life, 9), (6, 5, 0, 1, delete, 0), (8, 5, 0, 1, put, 0),  # DeleteKey clears both
        (2, 6, 0, 0, put, 0), (4, 6, 0, 0, put, 0),
    ]
    assert live(spark, rows) == {(1, 0): (2, 9, 1), (3, 0): (4, None, None), (4, 1): (4, None, None), (5, 0): (8, None, None), (6, 0): (4, None, None)}


def random_log(seed, n=400):
    rng, epoch, rows = random.Random(seed), 0, []
    for i in range(n):
        epoch += rng.random() < 0.08
        op = rng.choices(("put", "life", "tomb", "del"), (6, 3, 1, 1))[0]
        rows.append((2 * i + 2, rng.randrange(6), rng.randrange(3), epoch, op, epoch + rng.randint(1, 4)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_the_fold(spark, seed):
    rows = random_log(seed)
    states = {}
    for lsn, k, s, e, op, end in rows:
        states[k] = fold(states.get(k, {}), [(lsn, s, e, op, end)])
    want = {(k, s): v[0] for k, st in states.items() for s, v in st["live"].items()}
    assert {key: v[0] for key, v in live(spark, rows).items()} == want
    kept = versions.reduce_without_base(log_of(spark, rows))
    assert kept.count() < len(rows)


def test_stream_of_several_files_equals_the_fold(spark, tmp_path):
    rows = random_log(9)
    for k in range(3):
        log_of(spark, rows[k * 140 : (k + 1) * 140]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    got = {r.k: r.live for r in fold_stream(stream).collect()}
    want = {}
    for (k, _), _v in live(spark, rows).items():
        want[k] = want.get(k, 0) + 1
    assert {k: n for k, n in got.items() if n} == want


def test_parts_come_in_many_files_and_keys_share_states(spark, tmp_path, monkeypatch):
    """A part is written in as many tasks as its rows have, and is one batch all the same; a bucket's keys stay apart."""
    rows = random_log(9)
    log = log_of(spark, rows)
    want = {}
    for (k, _), _v in live(spark, rows).items():
        want[k] = want.get(k, 0) + 1
    for buckets in (1, 3):
        monkeypatch.setattr(sweep, "fresh_folder", lambda _, name, n=buckets: f"file://{tmp_path}/{n}/{name}")
        got = {r.k: r.live for r in fold_stream(stream_in_parts(log.repartition(5), "lsn", [240, 500]), buckets).collect()}
        assert set(got) == {r[1] for r in rows} and {k: n for k, n in got.items() if n} == want
        assert len(list((tmp_path / str(buckets) / "parts").glob("*.parquet"))) == 15
        assert sorted(x.name for x in (tmp_path / str(buckets) / "fold/states").iterdir()) == ["batch=0", "batch=1", "batch=2"]


def test_states_do_not_grow_with_keys(spark, tmp_path, monkeypatch):
    """A fold has no more states than buckets, and what is readable by its end epochs is what the versions say."""
    rows = [(lsn + 240 * n, k + 6 * n, s, e, op, end) for n in range(50) for lsn, k, s, e, op, end in random_log(n, 120)]
    at = max(r[3] for r in rows)
    want = dict.fromkeys((r[1] for r in rows), 0)
    for (k, _), (_lsn, end, _n) in live(spark, rows).items():
        want[k] += end is None or end > at
    monkeypatch.setattr(sweep, "fresh_folder", lambda _, name: f"file://{tmp_path}/{name}")
    got = {r.k: r.live - sum(end <= at for end in r.ends) for r in fold_stream(stream_in_parts(log_of(spark, rows), "lsn", [5000]), 4).collect()}
    assert len(want) == 300 and any(want.values()) and got == want
    assert spark.read.format("statestore").load(f"file://{tmp_path}/fold/progress").count() == 4


def test_deltas_below_zero_raise(spark):
    bad = spark.createDataFrame([(1, "live_bytes", None, -5)], "segment_id long, metric string, bucket long, delta long")
    with pytest.raises(Exception, match="below zero"):
        summaries.apply_deltas(bad).collect()


def test_ranges(spark):
    make = lambda rows: spark.createDataFrame(rows, "segment_id long, start long, end long")
    a = make([(1, 0, 10), (1, 10, 20), (1, 30, 40), (2, 5, 6)])
    assert sorted(map(tuple, intervals.coalesce_ranges(a).collect())) == [(1, 0, 20), (1, 30, 40), (2, 5, 6)]
    b = make([(1, 5, 12), (1, 35, 50), (3, 0, 9)])
    assert sorted(map(tuple, intervals.subtract_ranges(a, b).collect())) == [(1, 0, 5), (1, 12, 20), (1, 30, 35), (2, 5, 6)]
    records = make([(1, 0, 10), (1, 10, 20), (2, 5, 6)])
    got = intervals.classify(records, make([(1, 0, 10)]), make([(1, 0, 20)]))
    assert sorted((r.segment_id, r.start, r.state) for r in got.collect()) == [(1, 0, "retired"), (1, 10, "expired"), (2, 5, "live")]
    for cut in ([(1, 5, 10)], [(1, 0, 15)], [(1, 2, 8)]):
        with pytest.raises(Exception, match="part of a record"):
            intervals.classify(records, make(cut), make([])).collect()


SEGMENT = "segment_id long, state string, placement string, placement_epoch long, claimed boolean, max_lsn long, total_bytes long, live_bytes long, retired_bytes long, expired_bytes long, live_refs long, unknown_bytes long, unknown_refs long"
BUCKET = "segment_id long, end_epoch long, refs long, bytes long"


def plans(spark, segments, buckets, extensions=(), merged=10):
    p = Planner(spark.createDataFrame(segments, SEGMENT), spark.createDataFrame(buckets, BUCKET), spark.createDataFrame(list(extensions), "segment_id long, extension_count long, refs long"), 10, merged)
    return [(r.scenario, r.action, r.segment_id, r.copied_bytes, r.reclaim_bytes, r.score) for r in ranked(p.plans()).collect()]


def test_planner_joins_segments_of_one_epoch(spark):
    row = lambda k, live: (k, "Sealed", "Spillover", None, False, 1, 10_000, live, 10_000 - live, 0, 1, 0, 0)
    got = plans(spark, [row(1, 2_000), row(2, 3_000), row(3, 600)], [(1, 12, 1, 2_000), (2, 12, 1, 3_000), (3, 14, 1, 600)])
    assert got == [("JoinMultiple", "MoveLiveBytesFromSources", 12, 5_000, 15_000, 15_000 * 2500 // 5_000 + 2)]
    assert plans(spark, [row(1, 2_000), row(2, 3_000)], [(1, 12, 1, 2_000), (2, 12, 1, 3_000)], [(1, 2, 1)]) == []


def test_planner_scenarios(spark):
    segments = [
        (1, "Sealed", "Ingest", None, False, 1, 1_000, 0, 1_000, 0, 0, 0, 0),  # nothing live
        (2, "Sealed", "Ingest", None, False, 1, 1_000, 800, 200, 0, 2, 0, 0),  # useful lifetimes
        (3, "Sealed", "Ingest", None, False, 1, 1_000, 900, 100, 0, 1, 900, 1),  # none known
        (4, "Sealed", "ExactEpoch", 9, False, 1, 50_000, 10_000, 40_000, 0, 1, 10_000, 1),
        (5, "Sealed", "Spillover", None, True, 1, 1_000, 0, 1_000, 0, 0, 0, 0),  # claimed
        (6, "Open", "Ingest", None, False, 1, 1_000, 0, 1_000, 0, 0, 0, 0),
        (7, "GcRelocating", "Spillover", None, False, 1, 500, 0, 500, 0, 0, 0, 0),
    ]
    got = plans(spark, segments, [(2, 15, 2, 800)])
    assert got[0] == ("EmptyDelete", "DeleteSegments", None, 0, 1_500, 15_000_000)
    assert set(got[1:]) == {
        ("L0Compaction", "MoveLiveBytes", 2, 800, 1_000, 1500), ("L0Compaction", "ReclassifySegments", None, 0, 0, 2_000),
        ("DeadRef", "MoveLiveBytes", 4, 10_000, 40_000, 8_000), ("PinnedEpochExpiry", "MoveLiveBytes", 4, 10_000, 40_000, 7_000),
    }
    assert not any(x[0] == "PinnedEpochExpiry" for x in plans(spark, segments, [(2, 15, 2, 800)], merged=None))


def test_folds(spark):
    records = spark.createDataFrame([(1, n, size) for n, size in enumerate((40, 50, 30, 200, 10))], "g long, lsn long, len long")
    got = sorted((r.lsn, r.segment, r.offset) for r in folds.greedy_rollover(records, 100, "g").collect())
    assert got == [(0, 0, 0), (1, 0, 40), (2, 1, 0), (3, 2, 0), (4, 3, 0)]
    files = spark.createDataFrame([(1, n, n, n, size) for n, size in enumerate((1, 100, 120, 300, 390, 5000))], "g long, file_id long, min_lsn long, max_lsn long, file_len long")
    assert sorted(r.file_id for r in folds.comparable_run(files, "g").collect()) == [1, 2, 3, 4]


def plain_rollover(rows, capacity):
    out, segment, used, n = [], 0, 0, 0
    for lsn, size in rows:
        if n and used + size > capacity:
            segment, used, n = segment + 1, 0, 0
        out.append((lsn, segment, used))
        used, n = used + size, n + 1
    return out


def plain_run(rows, fanout=4, ratio=4, most=16):
    run = []
    for file_id, size in [*rows, (None, None)]:
        own = [max(s, 1) for _, s in run] + [max(size or 0, 1)]
        if run and size is not None and max(own) <= ratio * min(own):
            run.append((file_id, size))
            continue
        if len(run) >= fanout:
            return [f for f, _ in run[:most]]
        run = [(file_id, size)]
    return []


def test_folds_go_on_from_batch_to_batch(spark):
    """Groups over several batches of seven rows, one of them without a key, against plain loops."""
    rng = random.Random(3)
    own = {g: [(n, rng.choice((0, 5, 20, 60, 99, 100, 101, 300))) for n in range(rng.choice((1, 6, 40, 90)))] for g in (1, 2, 3, 4, None)}
    files = {g: [(n, rng.choice((0, 1, 3, 4, 9)) if n % 30 < 9 else rng.randint(100, 399)) for n in range(60)] for g in (1, 2, None)}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(g, *x) for g, xs in own.items() for x in xs], "g long, lsn long, len long")
        got = {(r.g, r.lsn): (r.segment, r.offset) for r in folds.greedy_rollover(rows, 100, "g").collect()}
        assert got == {(g, lsn): (s, o) for g, xs in own.items() for lsn, s, o in plain_rollover(xs, 100)}
        rows = spark.createDataFrame([(g, n, n, n, size) for g, xs in files.items() for n, size in xs], "g long, file_id long, min_lsn long, max_lsn long, file_len long")
        got = sorted((r.g or 0, r.file_id) for r in folds.comparable_run(rows, "g").collect())
        assert got == sorted((g or 0, f) for g, xs in files.items() for f in plain_run(xs)) and got
        rows = spark.createDataFrame([(g, *x) for g, xs in own.items() for x in xs], "g long, at long, v long")
        got = {(r.g, r.at): (r.average, r.baseline) for r in folds.smoothed(rows, "g", "at", "v").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for g, xs in own.items():
        average = baseline = None
        for at, x in xs:
            average = x if average is None else (7 * average + x) // 8
            baseline = average if baseline is None or average < baseline else baseline + (average - baseline) // 64
            assert got.pop((g, at)) == (average, baseline)
    assert not got


def test_numbered(spark):
    rows = spark.createDataFrame([(x,) for x in (5, 7, 100, 130, 131, 900)], "lsn long")
    assert sorted(map(tuple, numbered(rows, "n", block=64).collect())) == [(5, 1), (7, 2), (100, 3), (130, 4), (131, 5), (900, 6)]


def test_overlaps_across_blocks(spark):
    rng = random.Random(5)
    make = lambda n: [(k, a, a + rng.randrange(200)) for k, a in enumerate(rng.randrange(2000) for _ in range(n))]
    a, b = make(80), make(80)
    frame = lambda rows: spark.createDataFrame(rows, "id long, first long, last long")
    got = sorted(map(tuple, intervals.overlapping_pairs(frame(a), frame(b), 64).collect()))
    assert got == sorted((i, j) for i, x, y in a for j, u, v in b if x <= v and u <= y)


def test_classify_rejects_partial_overlap_of_either_kind(spark):
    make = lambda rows: spark.createDataFrame(rows, "segment_id long, start long, end long")
    records = make([(1, 0, 10), (1, 10, 20)])
    for retired, expired in (([(1, 5, 20)], []), ([], [(1, 5, 20)]), ([(1, 0, 10)], [(1, 12, 14)])):
        with pytest.raises(Exception, match="part of a record"):
            intervals.classify(records, make(retired), make(expired)).collect()


def test_manifest_edits(spark):
    make = lambda rows: spark.createDataFrame(rows, "file_id long, level string")
    base = make([(1, "base"), (2, "patch")])
    assert sorted(map(tuple, frontiers.edit(base, make([(2, "patch")]), make([(3, "base")])).collect())) == [(1, "base"), (3, "base")]
    with pytest.raises(Exception, match="isn't in the manifest"):
        frontiers.edit(base, make([(9, "patch")]), make([])).collect()


def test_bloom_denies_most_others(spark):
    keys = spark.range(0, 2000).toDF("k")
    bits = frontiers.bloom_bits(keys, "k")
    assert frontiers.bloom_probe(keys, bits, "k").filter("may_contain").count() == 2000
    assert frontiers.bloom_probe(spark.range(10_000, 12_000).toDF("k"), bits, "k").filter("may_contain").count() < 100
    assert frontiers.bloom_probe(keys.limit(3), frontiers.bloom_bits(keys.limit(0), "k"), "k").filter("may_contain").count() == 0
