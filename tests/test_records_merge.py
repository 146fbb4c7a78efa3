"""The record format and the merge operator."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.merge import blob_merge, latest, merged, reduced, replace_latest
from tidemark.plans.model import Model
from tidemark.plans.queries import _encoded
from tidemark.sources import record_files as R


def test_record_round_trip_and_damage(spark, tmp_path):
    records = [R.encode(b"k%d" % k, b"x" * k, 3, 7, 9) for k in range(1, 5)]
    data = b"".join(records)
    assert len(records[0]) == 64 + 1 + 2 and R.peek(data)["shard_generation"] == 9
    (tmp_path / "files").mkdir()
    torn, broken = data[:-3], bytearray(data)
    broken[len(records[0]) + 66] ^= 1
    for name, x in (("good", data), ("torn", torn), ("broken", bytes(broken))):
        (tmp_path / "files" / name).write_bytes(x)
    folder = f"file://{tmp_path}/files"
    got = {r.path.rsplit("/", 1)[1]: (r.valid_len, r.file_len) for r in R.valid_prefixes(spark, folder).collect()}
    assert got == {"good": (len(data), len(data)), "torn": (len(data) - len(records[3]), len(torn)), "broken": (len(records[0]), len(data))}
    rows = R.read_records(spark, folder, payloads=True).filter("path LIKE '%good'").orderBy("offset").collect()
    assert [(bytes(r.key), bytes(r.payload), r.shard) for r in rows] == [(b"k%d" % k, b"x" * k, 7) for k in range(1, 5)]
    durable = spark.createDataFrame([(rows[0].path.replace("good", "broken"), len(data))], "path string, durable_len long")
    with pytest.raises(Exception, match="durable"):
        R.valid_prefixes(spark, folder, durable).collect()
    with pytest.raises(ValueError):
        R.encode(b"", b"x")


def test_merge_operator(spark):
    schema = "k long, lsn long, v string"
    base = spark.createDataFrame([(1, 2, "a"), (2, 4, "b")], schema)
    patches = spark.createDataFrame([(1, 8, "d"), (1, 6, "c"), (3, 9, "e")], schema)
    op = replace_latest("k", "lsn", "v")
    got = sorted((r.kind, r.k, r.lsn, r.v) for r in merged(base, patches, op, "k", "lsn", schema, "k long, lsn long").collect())
    assert [x for x in got if x[0] == "state"] == [("state", 1, 8, "d"), ("state", 2, 4, "b"), ("state", 3, 9, "e")]
    assert [x[1:3] for x in got if x[0] == "event"] == [(1, 2), (1, 6)]
    # A partial merge first changes nothing about the state.
    once = merged(base, reduced(patches, op, "k", "lsn"), op, "k", "lsn", schema, "k long, lsn long").filter("kind = 'state'")
    assert sorted((r.k, r.lsn, r.v) for r in once.collect()) == [x[1:] for x in got if x[0] == "state"]
    assert sorted(map(tuple, latest(base.unionByName(patches), ["k"], "lsn").collect())) == [x[1:] for x in got if x[0] == "state"]


def test_blob_states_fold_on(spark):
    """A lifetime of the first part still ends versions in the second: two parts come to what one comes to."""
    rows = [(1, 2, 0, 0, "put", 0), (1, 4, 0, 0, "life", 3), (1, 6, 1, 4, "put", 0), (1, 8, 0, 4, "life", 9), (2, 2, 0, 0, "put", 0), (2, 7, 0, 0, "tomb", 0), (3, 8, 0, 4, "put", 0)]
    log = spark.createDataFrame(rows, "k long, lsn long, shard long, epoch long, op string, end_epoch long")
    state, empty = "k long, state string", spark.createDataFrame([], "k long, state string")
    fold = lambda base, part: merged(base, part, blob_merge(), "k", "lsn", state, "k long, lsn long")
    states = lambda got: got.filter("kind = 'state'").select("k", "state")
    once, first = fold(empty, log), fold(empty, log.filter("lsn <= 5"))
    twice = fold(states(first), log.filter("lsn > 5"))
    assert sorted(map(tuple, states(once).collect())) == sorted(map(tuple, states(twice).collect()))
    gone = lambda *parts: sorted({(r.k, r.lsn) for p in parts for r in p.filter("kind = 'event'").collect()})
    assert gone(once) == gone(first, twice) == [(1, 2), (2, 2)]


def test_long_scans_leave_in_steps(spark, tmp_path, monkeypatch):
    data = b"".join(R.encode(b"k%d" % k, b"x" * k) for k in range(1, 300))
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "one").write_bytes(data)
    monkeypatch.setattr(R, "STEP", 1000)
    got = R.read_records(spark, f"file://{tmp_path}/files", payloads=True).orderBy("offset").collect()
    assert [(bytes(r.key), len(r.payload)) for r in got] == [(b"k%d" % k, k) for k in range(1, 300)]


def test_records_pass_workers_in_steps(spark, tmp_path, monkeypatch):
    """A worker is handed batches by bytes, and rows leave it in steps of bytes."""
    monkeypatch.setattr(R, "STEP", 1000)
    keys, texts = [f"k{n}" for n in range(64)], ["é" * (n % 7) * 20 for n in range(64)]
    batch = pa.array(keys), pa.array(texts), pa.array([7] * 64)
    out = list(R.encoded.func(iter([batch])))
    assert pa.concat_arrays(out).to_pylist() == [R.encode(k.encode(), t.encode(), shard=7) for k, t in zip(keys, texts, strict=True)]
    assert len(out) > 8 and max(len(x) for x in out) < 16
    back = list(R.decoded.func(iter([pa.concat_arrays(out)])))
    assert len(back) > 8 and [(r["key"].decode(), r["payload"].decode(), r["whole"]) for x in back for r in x.to_pylist()] == [(k, t, True) for k, t in zip(keys, texts, strict=True)]
    spark.createDataFrame([(1, "x" * 3000)] * 20_000, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = _encoded(Model(spark, f"file://{tmp_path}"))
    assert rows.select(_bytes_at_once("record").alias("n")).agg(F.max("n")).head()[0] <= 2 * R.BATCH


@F.arrow_udf(T.LongType())
def _bytes_at_once(batch: pa.Array) -> pa.Array:
    return pa.array([batch.nbytes] * len(batch))
