"""What goes through the driver stays small on large graphs, and results stay those of the SQL."""

import duckdb
import pytest

from sparkweave import contract, session
from sparkweave.graph import local, loops

DATA = "/root/testdata/sf0.001"


def test_nothing_of_a_large_table_is_fetched(spark, monkeypatch):
    fetched = []
    real = local.arrays
    monkeypatch.setattr(local, "arrays", lambda df: fetched.append(1) or real(df))
    edges = spark.range(100).selectExpr("id as u", "id + 1 as v")
    assert loops.components(spark.range(101), edges, 50).where("component = 0").count() == 101
    assert not fetched
    assert loops.components(spark.range(101), edges, 200).where("component = 0").count() == 101
    assert fetched


def test_broadcasts_are_bounded_inside_only(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    with session.few_broadcasts(spark, session.SMALL_INPUT + 1):
        assert spark.conf.get(key) == str(session.BROADCAST_BYTES)
    assert spark.conf.get(key) == before
    with session.few_broadcasts(spark, 10):
        assert spark.conf.get(key) == before


@pytest.mark.parametrize("name", ["list_graphs_filtered", "volume_budget"])
def test_large_way_equals_the_sql(spark, monkeypatch, name):
    monkeypatch.setattr(session, "SMALL_INPUT", 0)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    con = duckdb.connect()
    for t in ("nation", "region", "customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(contract.ORACLES[name]).fetchall()
    assert [tuple(r) for r in contract.QUERIES[name](spark, DATA).collect()] == want or name == "volume_budget" and sorted(map(tuple, contract.QUERIES[name](spark, DATA).collect())) == sorted(want)
