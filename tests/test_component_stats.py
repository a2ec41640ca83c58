"""Component statistics are those of the SQL, whatever the sizes at which ids are put together."""

import duckdb

from sparkweave import contract
from sparkweave.operators import stats

DATA = "/root/testdata/sf0.001"


def test_component_stats_do_not_depend_on_the_size_of_a_component(spark, monkeypatch):
    monkeypatch.setattr(stats, "LISTED", 2)
    monkeypatch.setattr(stats, "RANGE", 2)
    con = duckdb.connect()
    for t in ("nation", "region", "customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = contract.QUERIES["component_stats"](spark, DATA)
    want = con.execute(contract.ORACLES["component_stats"]).fetchall()
    assert max(len(r[4].split(", ")) for r in want) > 2
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_large_component_is_listed_whole(spark):
    nodes = spark.range(1, 25_001).selectExpr("id", "'function' as node_type", "1L as file_id")
    members = spark.range(1, 25_001).selectExpr("id", "1L as component", "false as is_dead")
    none = spark.createDataFrame([], "source_id long, target_id long, node_id long, file_id long, line int, rule_name string, path string, is_test boolean")
    (row,) = stats.snapshots(nodes, none, members, none, none, none).collect()
    assert row["root_node_ids"] == list(range(1, 25_001)) and row["node_count"] == 25_000
