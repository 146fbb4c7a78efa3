"""Every query of the engine against its SQL in DuckDB."""

import pytest

from tests.compare import database, of_duck, of_spark, plain, types
from tidemark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(tiny):
    return database(tiny)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, tiny, con, name):
    frame = QUERIES[name](spark, tiny)
    got = of_spark(frame)
    if name in SQL:
        assert not types(frame, con, SQL[name])
        assert got == of_duck(con, SQL[name])
    else:
        assert got[0]


#: Queries whose rows are in order, with what the SQL has to be ordered by; no two rows are equal in it and differ otherwise.
ORDERED = {
    "sc20_merged_rows": "k",
    "sc28_wal_replay": "lsn",
    "tk01_ranked_plans": "scenario = 'EmptyDelete' DESC, score DESC, list_position(['EmptyDelete', 'L0Compaction', 'DeadRef', 'JoinMultiple', 'PinnedEpochExpiry'], scenario), segment_id NULLS LAST, action",
    "tk06_garbage_order": "segment_id, k, event_lsn, \"offset\", len",
    "tk07_latest_sorted": "k",
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_rows_come_in_order(spark, tiny, name):
    sf_dir = tiny.replace("sf0.001", "sf0.01")  # at the smallest size there is one plan
    con, frame = database(sf_dir), QUERIES[name](spark, sf_dir)
    got = [tuple(map(plain, r)) for r in frame.select(*sorted(frame.columns)).collect()]
    names = ", ".join(f'"{c}"' for c in sorted(frame.columns))
    want = [tuple(map(plain, r)) for r in con.sql(f"SELECT {names} FROM ({SQL[name]}) ORDER BY {ORDERED[name]}").fetchall()]
    assert len(got) > 1 and got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_payload_bytes_are_of_all_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    assert any(not r.text.isascii() for r in docs if r.text)
    want = [(r.doc_id, None if r.text is None else r.text.encode()[10:30].hex().upper()) for r in docs]
    assert sorted(map(tuple, QUERIES["sc08_payload_bytes"](spark, tiny).collect())) == sorted(want)


def test_forwarding_chain_has_no_limit_of_rows(spark, tiny, con):
    name, limit = "jn16_forwarded_garbage", "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, "20")
    try:
        got = of_spark(QUERIES[name](spark, tiny))
    finally:
        spark.conf.unset(limit)
    assert len(got[0]) > 20 and got == of_duck(con, SQL[name])
