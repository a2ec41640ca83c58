"""Graph tables projected from the star-schema test tables, in DataFrames and, for the oracle, in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

E = F.expr


@dataclass
class Graph:
    """Files, nodes, edges, entries and references of one code base."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    entries: DataFrame
    refs: DataFrame


def project(spark: SparkSession, sf_dir: str) -> Graph:
    def t(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    files = (
        t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by the schema's definition
        .select(E("n_nationkey + 1").cast("long").alias("file_id"), F.concat("r_name", F.lit("/"), "n_name", F.lit(".py")).alias("path"), E("n_nationkey % 5 = 4").alias("is_test"))
    )
    k = "c_custkey"
    kind = E(f"case {k} % 10 when 0 then 'class' when 1 then 'method' when 2 then 'method' when 3 then 'field' when 4 then 'variable' else 'function' end")
    qname = E(
        f"concat('p', ({k} div 10) % 7, '.', case when {k} % 10 = 0 then concat('C', {k} div 10) when {k} % 10 <= 3 then concat('C', {k} div 10, '.m', {k} % 10) else concat('f', {k} % 200) end)"
    )
    nodes = t("customer").select(
        E(f"{k} + 1").alias("id"), E("c_nationkey + 1").cast("long").alias("file_id"), F.col("c_name").alias("name"), qname.alias("qualified_name"), kind.alias("node_type"),
        E(f"if({k} % 10 in (1, 2, 3), ({k} div 10) * 10 + 1, 0)").cast("long").alias("parent"), E(f"{k} % 10 = 1").alias("is_special"), F.lit(False).alias("is_public"),
        E(f"cast({k} % 1000 + 1 as int)").alias("line_start"),
    )
    n = t("customer").agg(F.count(F.lit(1)).alias("n"))
    orders = t("orders").where("o_orderkey % 25 = 0").crossJoin(n)
    target = E("(o_orderkey * 7919 + o_custkey * 104729) % n")
    edges = (
        orders.select(
            E("o_custkey + 1").alias("source_id"), (target + 1).alias("target_id"),
            E("case o_orderstatus when 'F' then 'call' when 'O' then 'read' else case o_orderkey % 3 when 0 then 'write' when 1 then 'inherit' else 'decorate' end end").alias("edge_type"),
        )
        .where("source_id <> target_id").distinct()
        .withColumn("file_id", F.lit(0).cast("long")).withColumn("line", E("cast(source_id % 97 as int)"))
    )
    entries = t("customer").where("c_mktsegment = 'MACHINERY' and c_acctbal > 8000").select(
        E("c_nationkey + 1").cast("long").alias("file_id"), E(f"{k} + 1").alias("node_id"), F.lit("segment").alias("rule_name"), F.lit(False).alias("no_propagate"),
    )
    tests = files.where("is_test").select("file_id", F.lit(0).cast("long").alias("node_id"), F.lit("test_file").alias("rule_name"), F.lit(True).alias("no_propagate"))
    kk = "((o_orderkey * 7919 + o_custkey * 104729) % n)"
    refs = orders.select(
        F.col("o_orderkey").alias("ref_id"), E("o_custkey + 1").alias("source_id"),
        E(f"case o_orderkey % 4 when 0 then concat('f', o_orderkey % 250) when 1 then concat('m', o_orderkey % 3 + 1) when 2 then concat('p', ({kk} div 10) % 7, '.f', {kk} % 200) else concat('C', o_orderkey % 200, '.m1') end").alias("target_name"),
        F.lit("call").alias("edge_type"),
    )
    return Graph(files, nodes, edges, entries.unionByName(tests), refs)


#: The same tables as common table expressions for DuckDB.
CTES = {
    "g_files": "g_files AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS file_id, r_name || '/' || n_name || '.py' AS path, n_nationkey % 5 = 4 AS is_test FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "g_nodes": """g_nodes AS (SELECT c_custkey + 1 AS id, CAST(c_nationkey + 1 AS BIGINT) AS file_id, c_name AS name,
      'p' || ((c_custkey // 10) % 7) || '.' || CASE WHEN c_custkey % 10 = 0 THEN 'C' || (c_custkey // 10) WHEN c_custkey % 10 <= 3 THEN 'C' || (c_custkey // 10) || '.m' || (c_custkey % 10) ELSE 'f' || (c_custkey % 200) END AS qualified_name,
      CASE c_custkey % 10 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'method' WHEN 3 THEN 'field' WHEN 4 THEN 'variable' ELSE 'function' END AS node_type,
      CASE WHEN c_custkey % 10 IN (1, 2, 3) THEN (c_custkey // 10) * 10 + 1 ELSE 0 END AS parent, c_custkey % 10 = 1 AS is_special, CAST(c_custkey % 1000 + 1 AS INTEGER) AS line_start FROM customer)""",
    "g_orders": "g_orders AS (SELECT o.*, (o_orderkey * 7919 + o_custkey * 104729) % (SELECT count(*) FROM customer) AS k FROM orders o WHERE o_orderkey % 25 = 0)",
    "g_edges": """g_edges AS (SELECT DISTINCT o_custkey + 1 AS s, k + 1 AS t, CASE o_orderstatus WHEN 'F' THEN 'call' WHEN 'O' THEN 'read' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'write' WHEN 1 THEN 'inherit' ELSE 'decorate' END END AS edge_type
      FROM g_orders WHERE o_custkey <> k)""",
    "g_entries": "g_entries AS (SELECT c_custkey + 1 AS node_id FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 8000)",
    "g_noprop": "g_noprop AS (SELECT id FROM g_nodes JOIN g_files USING (file_id) WHERE is_test)",
    "g_refs": """g_refs AS (SELECT o_orderkey AS ref_id, o_custkey + 1 AS source_id, CASE o_orderkey % 4 WHEN 0 THEN 'f' || (o_orderkey % 250) WHEN 1 THEN 'm' || (o_orderkey % 3 + 1)
      WHEN 2 THEN 'p' || ((k // 10) % 7) || '.f' || (k % 200) ELSE 'C' || (o_orderkey % 200) || '.m1' END AS target_name FROM g_orders)""",
    "g_calls": "g_calls AS (SELECT s, t FROM g_edges WHERE edge_type = 'call' UNION SELECT s, t FROM g_edges JOIN g_nodes ON t = id WHERE edge_type = 'read' AND node_type IN ('class', 'method', 'function') UNION SELECT parent, id FROM g_nodes WHERE is_special AND parent <> 0)",
    "g_adj": "g_adj AS (SELECT s, t FROM g_edges UNION SELECT t, s FROM g_edges UNION SELECT parent, id FROM g_nodes WHERE is_special AND parent <> 0 UNION SELECT id, parent FROM g_nodes WHERE is_special AND parent <> 0)",
    "g_reach": "g_reach AS (SELECT node_id AS id FROM g_entries UNION SELECT t FROM g_reach JOIN g_calls ON s = id)",
    "g_cc": "g_cc AS (SELECT id, id AS c FROM g_nodes UNION SELECT t, c FROM g_cc JOIN g_adj ON s = id WHERE c < t)",
    "g_comp": "g_comp AS (SELECT id, min(c) AS comp FROM g_cc GROUP BY id)",
}


def with_ctes(*names: str, tail: str, ctes: dict[str, str] = CTES) -> str:
    """``WITH RECURSIVE`` the named tables and what they need, then ``tail``; it may start with further tables and a comma."""
    needs = {"g_edges": ("g_orders",), "g_refs": ("g_orders",), "g_noprop": ("g_nodes", "g_files"), "g_calls": ("g_nodes", "g_edges"), "g_adj": ("g_nodes", "g_edges"), "g_reach": ("g_entries", "g_calls"), "g_cc": ("g_nodes", "g_adj"), "g_comp": ("g_cc",)}
    want: set[str] = set()

    def add(x: str) -> None:
        for y in needs.get(x, ()):
            add(y)
        want.add(x)

    for x in names:
        add(x)
    order = [x for x in ctes if x in want]
    return "WITH RECURSIVE " + ",\n".join(ctes[x] for x in order) + tail
