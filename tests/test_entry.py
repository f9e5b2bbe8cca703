"""Every query of the entry module against its DuckDB text, and the stream against a plain replay."""

import glob
import os

import __spark_entry__ as entry
import duckdb
import pytest


def plain(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in glob.glob(data + "/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    rel = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).columns == ["tbl", "owner", "kind", "from_ms", "to_ms"]


def test_stream_equals_replay(spark, data):
    from spanloom.plans import folded
    from spanloom.streaming import sessions

    log = spark.read.parquet(f"{data}/sessions.parquet").where("session_id is not null and epoch is not null and seq is not null and last_seen is not null").selectExpr("session_id", "epoch", "seq", "coalesce(position_ms, 0) position_ms", "revision", "unix_millis(last_seen) now_ms").collect()
    want, state = [], {}
    for r in sorted(log, key=lambda r: (r.now_ms, r.epoch, r.seq)):
        state[r.session_id], verdict, revision = sessions.decide(state.get(r.session_id), r.asDict())
        want.append((r.session_id, r.epoch, r.seq, r.now_ms, verdict, revision))
    assert sorted(tuple(r) for r in folded.session_fence(spark, data).collect()) == sorted(want)
