"""Warnings derived from the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave import schema as S
from sparkweave.graph import local, loops


def incoming_types(edges: DataFrame) -> DataFrame:
    """``(id, types)``: the sorted set of types of the edges into a node, those of module-level code among them."""
    return edges.groupBy(F.col("target_id").alias("id")).agg(F.sort_array(F.collect_set("edge_type")).alias("types"))


def _judged(nodes: DataFrame) -> DataFrame:
    """Variables and fields that are judged: not ``_``, not of a public interface, not a field of a dataclass."""
    owners = nodes.where(F.exists("decorators", lambda d: d.rlike(r"(^|\.)dataclass(\(|$)"))).select(F.col("id").alias("parent")) if "decorators" in nodes.columns else None
    out = nodes.where(F.col("node_type").isin(*S.VARIABLES) & (F.col("name") != "_") & ~F.col("is_public"))
    return out if owners is None else out.join(owners, "parent", "left_anti")


def unused_variables(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Judged variables and fields without an edge into them."""
    return _judged(nodes).join(edges.select(F.col("target_id").alias("id")), "id", "left_anti")


def write_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Judged variables and fields that are written and never read."""
    seen = incoming_types(edges).where("array_contains(types, 'write') and not array_contains(types, 'read')")
    return _judged(nodes).join(seen.select("id"), "id", "left_semi")


def cycles(nodes: DataFrame, edges: DataFrame, most_edges: int = local.MOST_EDGES) -> DataFrame:
    """``(id, component)`` of the nodes on a cycle of calls and inheritance; direct recursion is none."""
    pairs = edges.where("edge_type in ('call', 'inherit') and source_id <> 0 and target_id <> 0").select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    return loops.strong_components(pairs, most_edges).join(nodes.select("id"), "id", "left_semi")


def _row(kind: str, severity: str, message: Column, line: Column) -> list[Column]:
    return [F.col("file_id"), F.col("node_id"), F.lit(kind).alias("warn_type"), F.lit(severity).alias("severity"), message.alias("message"), line.cast("int").alias("line"), F.lit(None).cast("map<string,string>").alias("details")]


def graph_warnings(nodes: DataFrame, edges: DataFrame, members: DataFrame, most_edges: int = local.MOST_EDGES) -> DataFrame:
    """Rows of the warnings table from the graph: unused and write-only variables, cycles, dead code."""
    unused = unused_variables(nodes, edges).withColumn("node_id", F.col("id"))
    unread = write_only(nodes, edges).withColumn("node_id", F.col("id"))
    out = unused.select(*_row("unused_variable", "warning", F.concat(F.lit("Variable '"), "name", F.lit("' is never used")), F.col("line_start")))
    out = out.unionByName(unread.select(*_row("write_only", "warning", F.concat(F.lit("Variable '"), "name", F.lit("' is written and never read")), F.col("line_start"))))

    ring = cycles(nodes, edges, most_edges).join(nodes.select("id", "name", "file_id", "line_start"), "id")
    rings = ring.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("id", "name", "file_id", "line_start"))).alias("ring"))
    last = F.element_at("ring", -1)
    rings = rings.select(last["file_id"].alias("file_id"), last["id"].alias("node_id"), F.concat(F.lit("Circular dependency: "), F.array_join(F.reverse("ring.name"), " → ")).alias("message"), last["line_start"].alias("line"))
    out = out.unionByName(rings.select(*_row("circular_ref", "warning", F.col("message"), F.col("line"))))
    return out.unionByName(dead_code(nodes, members))


def dead_code(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """For each dead component its first three ordinary nodes; without any, its first two that the language calls by itself."""
    partial = F.col("is_partial") if "is_partial" in nodes.columns else F.lit(False)
    dead = nodes.join(members.where("is_dead").select("id", "component"), "id").where(~F.col("is_public") & (F.col("name") != "_") & ~F.coalesce(partial, F.lit(False)))
    w = Window.partitionBy("component", "is_special").orderBy("id")
    # The rank's bound is pushed below the shuffle, so a large component does not gather in one task.
    first = dead.withColumn("k", F.row_number().over(w)).where("k <= 3")
    plain = dead.groupBy("component").agg(F.max(~F.col("is_special")).alias("plain"))
    shown = first.join(plain, "component").where("not is_special or (not plain and k <= 2)").withColumn("node_id", F.col("id"))
    return shown.select(*_row("dead_code", "warning", F.concat("node_type", F.lit(" '"), "qualified_name", F.lit("' is not reachable from any entry point")), F.col("line_start")))


#: Collection order of kinds, in which the first of equal warnings wins.
_ORDER = ("unused_import", "syntax_error", "file_too_large", "unused_variable", "write_only", "circular_ref", "dead_code")


def dedupe(warnings: DataFrame, compat: bool = False) -> DataFrame:
    """One warning per (type, file, line), the first collected. ``compat``: cycles have no file there, so that those on equal lines of different files are one."""
    file = F.when(F.col("warn_type") == "circular_ref", F.lit(None).cast("long")).otherwise(F.col("file_id")) if compat else F.col("file_id")
    order = F.array_position(F.array(*[F.lit(x) for x in _ORDER]), F.col("warn_type"))
    w = Window.partitionBy("warn_type", file, "line").orderBy(order, F.coalesce("node_id", F.lit(0)), "message")
    return warnings.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def summary(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("warn_type").agg(F.count(F.lit(1)).alias("n"))
