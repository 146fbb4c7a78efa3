"""The store's API, versioned tables, logs with a cursor, sweeps that are tried again."""

import pytest

from tests.test_operators import random_log
from tidemark.functions.codec import decode_key, encode_key
from tidemark.operators.merge import fold
from tidemark.plans import registry
from tidemark.sources import tables
from tidemark.store import LOG, Store
from tidemark.streaming.sweep import ProgressListener, forwarded, stream_in_parts, swept


@pytest.fixture(scope="module")
def rows():
    return [(lsn, k, s, e, op, end, 100) for lsn, k, s, e, op, end in random_log(21, 200)]


def held(rows, now):
    """{(k, shard): lsn} that can be read at an epoch."""
    states = {}
    for lsn, k, s, e, op, end, _ in rows:
        states[k] = fold(states.get(k, {}), [(lsn, s, e, op, end)])
    out = {}
    for k, st in states.items():
        for s, (lsn, epoch) in st["live"].items():
            life = st["life"]
            if not life or (life[0] <= lsn and life[1] <= epoch) or life[1] > now:
                out[k, s] = lsn
    return out


def test_reads(spark, rows):
    store = Store(spark.createDataFrame(rows, LOG))
    now = max(r[3] for r in rows)
    want = held(rows, now)
    assert {(r.k, r.shard): r.lsn for r in store.range(0, 10).collect()} == want
    assert {(r.k, r.shard): r.lsn for r in store.get(2).collect()} == {x: v for x, v in want.items() if x[0] == 2}
    assert [(r.k, r.shard, r.lsn) for r in store.range(1, 4).collect()] == sorted((*x, v) for x, v in want.items() if 1 <= x[0] < 4)
    assert {r.k: r.present for r in store.contains([0, 3, 99]).collect()} == {k: any(x[0] == k for x in want) for k in (0, 3, 99)}
    assert {r.k: r.present for r in store.contains([0, 3], shards=[0, 1, 2]).collect()} == {k: all((k, s) in want for s in range(3)) for k in (0, 3)}
    assert {(r.k, r.shard): r.lsn for r in store.through(200).range(0, 10, at_epoch=0).collect()} == held([r for r in rows if r[0] <= 200], 0)
    assert store.rolled_back(200).log.count() == sum(r[0] < 200 for r in rows)
    s = store.stats().head()
    assert s.mutations == 200 and s.last_lsn == 400 and s.total_bytes == 100 * sum(r[4] == "put" for r in rows) == s.live_bytes + s.retired_bytes
    ranges = list(store.payload_ranges(1, 10, 5))
    assert len(ranges) == store.segment(1).count() and all(r.end - r.first == 5 for r in ranges)
    assert store.garbage(min_bytes=1).count() <= store.oldest(10).count()


def test_batches(spark, rows, tmp_path):
    path = f"file://{tmp_path}/log"
    spark.createDataFrame(rows, LOG).write.parquet(path)
    store = Store.open(spark, path)
    batch = store.batch().put(77, 1, 500).put(78, 0, 50).delete(0).extend(78, store.epoch + 3)
    after = batch.apply()  # read your writes
    assert [(r.k, r.shard, r.len) for r in after.get(77).collect()] == [(77, 1, 500)] and after.get(0).count() == 0
    assert store.get(77).count() == Store.open(spark, path).get(77).count() == 0
    batch.apply(path)
    assert [r.end_epoch for r in Store.open(spark, path).get(78).collect()] == [store.epoch + 3]
    with pytest.raises(ValueError):
        store.batch().extend(1, store.epoch)


def test_versions_conflict_and_parts(spark, tmp_path):
    table = tables.VersionedTable(spark, f"file://{tmp_path}/t", "k long, v string", "k")
    make = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    assert table.version() == 0 and table.snapshot().count() == 0
    assert table.commit(make((1, "a"), (2, "b"))) == 1
    assert table.commit(make((1, "c")), removed=make((2, "")).select("k")) == 2
    assert [sorted(map(tuple, table.snapshot(v).collect())) for v in (1, 2)] == [[(1, "a"), (2, "b")], [(1, "c")]]
    with pytest.raises(Exception, match="exist"):  # another writer has published version 2
        table.commit(make((9, "z")), at=1)
    assert sorted(map(tuple, table.snapshot().collect())) == [(1, "c")]
    with pytest.raises(ValueError, match="no such part"):
        table.commit(drop_parts=("data/none",))
    assert table.commit(make((2, "d")), removed=make((2, "")).select("k")) == 3  # what is added counts over what goes
    assert sorted(map(tuple, table.snapshot().collect())) == [(1, "c"), (2, "d")]


def test_cursor(spark, tmp_path):
    rows = [(k // 3, k) for k in range(20)]
    tables.append_frames(spark.createDataFrame(rows, "at long, v long"), f"file://{tmp_path}/log", "at")
    log = spark.read.parquet(f"file://{tmp_path}/log")
    seen, cursor = [], -1
    while True:
        batch, after = tables.read_frames(log, cursor, 7, "at")
        got = sorted(r.v for r in batch.collect())
        if after == cursor:
            break
        assert 0 < len(got) <= 7
        seen, cursor = seen + got, after
    assert seen == list(range(20))
    assert tables.read_frames(log, -1, 1, "at")[1] == 0  # a frame alone is read whole


def test_sorted_files(spark, tmp_path):
    tables.write_sorted(spark.range(1000).selectExpr("(id * 37) % 1000 AS k"), f"file://{tmp_path}/s", "k", bloom="k", parts=4)
    parts = [r.k for r in spark.read.parquet(f"file://{tmp_path}/s").selectExpr("input_file_name() AS f", "k").groupBy("f").agg({"k": "min"}).toDF("f", "k").collect()]
    assert len(parts) == 4 and spark.read.parquet(f"file://{tmp_path}/s").filter("k = 5").count() == 1


def test_codec_keeps_order(spark):
    keys = [-(1 << 63), -5, -1, 0, 1, 255, 256, 1 << 31, 1 << 32, (1 << 63) - 1]
    got = spark.createDataFrame([(k,) for k in keys], "k long")
    got = got.withColumn("c", encode_key(got.k)).withColumn("d", decode_key(encode_key(got.k))).collect()
    assert [r.d for r in got] == keys and sorted(bytes(r.c) for r in got) == [bytes(r.c) for r in got]


def test_sweeps_tried_again_count_once(spark, rows):
    log = spark.createDataFrame(rows, LOG)
    frontier, gone = log.groupBy("k").agg({"lsn": "max"}).toDF("k", "through"), log.select("k").distinct().filter("k = 3")
    told = []
    listener = ProgressListener(lambda name, batch, n: told.append(n))
    spark.streams.addListener(listener)
    once, twice = (swept(stream_in_parts(log, "lsn", [100, 250]), frontier, gone, tries) for tries in (1, 2))
    for name in ("applied", "pending", "dropped"):
        assert sorted(map(tuple, once[name].collect())) == sorted(map(tuple, twice[name].collect()))
    assert sum(r.puts for r in once["applied"].collect()) == sum(r[4] == "put" and r[1] != 3 for r in rows)
    assert sum(r.n for r in once["dropped"].collect()) == sum(r[1] == 3 for r in rows)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(listener)
    assert sum(told) >= 200


def test_forwarding(spark):
    events = spark.createDataFrame([(1, 0, 5), (1, 64, 6), (2, 0, 7)], "segment_id long, offset long, event_lsn long")
    moves = spark.createDataFrame([(1, 64, 1001)], "segment_id long, offset long, to_segment long")
    got = sorted(map(tuple, forwarded(stream_in_parts(events, "event_lsn", [5]), moves).collect()))
    assert got == [(1, 0, 5), (1, 64, 6), (2, 0, 7), (1001, 64, 6)]


@pytest.mark.parametrize("name, order", [("tk06_garbage_order", ["segment_id", "k", "event_lsn", "offset", "len"]), ("tk07_latest_sorted", ["k"]), ("sc20_merged_rows", ["k"]), ("sc28_wal_replay", ["lsn"])])
def test_rows_come_in_order(spark, tiny, name, order):
    got = [tuple(r[c] for c in order) for r in registry.queries()[name](spark, tiny).collect()]
    assert got and got == sorted(got)


def test_plans_come_in_order(spark, tiny):
    scenarios = ["EmptyDelete", "L0Compaction", "DeadRef", "JoinMultiple", "PinnedEpochExpiry"]
    got = [(r.scenario != "EmptyDelete", -r.score, scenarios.index(r.scenario), r.segment_id is None, r.segment_id or 0) for r in registry.queries()["tk01_ranked_plans"](spark, tiny).collect()]
    assert got and got == sorted(got)
