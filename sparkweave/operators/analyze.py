"""Liveness and components: which symbols an entry point keeps alive, and how the rest falls apart.

Inputs: ``nodes(id, file_id, name, node_type, parent, is_special, is_public)``, ``edges(source_id, target_id, edge_type, line)`` with
source 0 for module-level code, ``entries(file_id, node_id, no_propagate)`` with node 0 for a whole file. ``is_special`` marks names that the
language calls by itself, ``is_public`` names of a public interface; both are decided per language beforehand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave import schema as S
from sparkweave.graph import local, loops
from sparkweave.session import written


def _pairs(df: DataFrame, u: str, v: str) -> DataFrame:
    return df.select(F.col(u).alias("u"), F.col(v).alias("v"))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def special_children(nodes: DataFrame) -> DataFrame:
    """``(u, v)``: a class and each member of it that the language calls by itself."""
    return _pairs(nodes.where("is_special and parent <> 0"), "parent", "id")


def call_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(u, v)``: calls, and reads of what counts as used when read."""
    promoted = nodes.where(F.col("node_type").isin(*S.PROMOTED)).select(F.col("id").alias("target_id"))
    reads = edges.where("edge_type = 'read'").join(promoted, "target_id", "left_semi")
    return _pairs(edges.where("edge_type = 'call'"), "source_id", "target_id").union(_pairs(reads, "source_id", "target_id"))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected ``(u, v)``, one row per pair: edges of any type, special members with their class, public variables with the first other node of their file."""
    drawn = _pairs(edges.where("source_id <> 0 and target_id <> 0"), "source_id", "target_id")
    first = nodes.where("not is_public").groupBy("file_id").agg(F.min("id").alias("first"))
    public = nodes.where(F.col("is_public") & F.col("node_type").isin(*S.VARIABLES)).join(first, "file_id")
    return drawn.union(special_children(nodes)).union(_pairs(public, "id", "first")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def entry_nodes(nodes: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that start a traversal, and nodes that are alive without starting one (all of a file whose entry doesn't propagate)."""
    files = entries.where("node_id = 0").groupBy("file_id").agg(F.max("no_propagate").alias("still"))
    of_files = nodes.select("id", "file_id").join(files, "file_id")
    starts = entries.where("node_id <> 0").select(F.col("node_id").alias("id")).union(of_files.where("not still").select("id")).distinct()
    return starts, of_files.where("still").select("id")


def entry_reach(nodes: DataFrame, edges: DataFrame, entries: DataFrame, most_edges: int = local.MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """``(reachable, still)``: reached along calls and special members; with the nodes that are alive by themselves, variables of
    reachable owners, all owners of what is reachable, and the other fragments of partial types."""
    starts, still = entry_nodes(nodes, entries)
    still = written(still, "still")
    found = loops.reach(starts, call_pairs(nodes, edges).where("u <> 0").union(special_children(nodes)), most_edges).union(still)
    owned = nodes.where(F.col("node_type").isin(*S.VARIABLES) & (F.col("parent") != 0)).select("id", "parent")
    found = found.union(owned.join(found.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi").select("id"))
    found = loops.reach(found, _pairs(nodes.where("parent <> 0"), "id", "parent"), most_edges)
    parts = edges.where("edge_type = 'part_of'")
    if not parts.isEmpty():
        found = loops.reach(found, _both(_pairs(parts, "source_id", "target_id")), most_edges)
    return written(found, "reachable"), still


@dataclass
class Components:
    """``members(id, component, is_dead)``; a component's number is the least id of its first members, so it does not depend on the order of files."""

    members: DataFrame
    reachable: DataFrame
    still: DataFrame
    adjacency: DataFrame


def find_components(nodes: DataFrame, edges: DataFrame, entries: DataFrame, includes: DataFrame | None = None, most_edges: int = local.MOST_EDGES) -> Components:
    """Live and dead components. ``includes(file_id, included)``: direct inclusions of files, where a language has them."""
    reachable, still = entry_reach(nodes, edges, entries, most_edges)
    adj = written(adjacency(nodes, edges), "adjacency")
    whole = written(loops.components(nodes, adj, most_edges), "components")

    # Growth inside components: calls both ways, other uses forwards, special members, and adjacent variables.
    inner = edges.where("source_id <> 0 and target_id <> 0")
    calls = _pairs(inner.where("edge_type = 'call'"), "source_id", "target_id")
    variables = nodes.where(F.col("node_type").isin(*S.VARIABLES)).select(F.col("id").alias("v"))
    grow = _both(calls).union(call_pairs(nodes, inner)).union(special_children(nodes)).union(_both(adj).join(variables, "v", "left_semi").select("u", "v"))
    grow = grow.join(still.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v")
    seeds = reachable.join(still, "id", "left_anti")
    live = written(loops.reach(seeds, grow, most_edges).union(reachable).distinct(), "live")

    node = nodes.select("id", "file_id", "node_type", "is_public").join(whole, "id").join(live.withColumn("live", F.lit(True)), "id", "left").join(still.distinct().withColumn("still", F.lit(True)), "id", "left")
    node = written(node.fillna(False, ["live", "still"]), "node")

    # Module-level uses.
    live_files = nodes.join(seeds, "id", "left_semi").select("file_id").distinct()
    through = live_files if includes is None else loops.reach(live_files.select(F.col("file_id").alias("id")), includes.select(F.col("file_id").alias("u"), F.col("included").alias("v")), most_edges).select(F.col("id").alias("file_id"))
    zero = edges.where("source_id = 0 and edge_type in ('read', 'call')").groupBy(F.col("target_id").alias("id")).agg(F.max(F.coalesce(F.col("line"), F.lit(0)) > 0).alias("used"))
    state = node.groupBy("component").agg(F.max("live").alias("any_live"), F.max(F.col("live") & ~F.col("still")).alias("any_real"))
    touched = node.where("not live").join(zero, "id").join(state, "component")
    touched = touched.join(live_files.withColumn("in_live", F.lit(True)), "file_id", "left").join(through.withColumn("in_through", F.lit(True)), "file_id", "left").fillna(False, ["in_live", "in_through"])
    variable, kind = F.col("node_type").isin(*S.VARIABLES), F.col("node_type").isin(*S.MODULE_KINDS)
    saved = touched.where((F.col("any_real") | ~F.col("any_live")) & ((variable & (F.col("any_real") | F.col("in_live"))) | (kind & F.col("used") & F.col("in_through")))).select("id")
    node = written(node.join(saved.withColumn("saved", F.lit(True)), "id", "left").withColumn("live", F.col("live") | F.coalesce("saved", F.lit(False))).drop("saved"), "node")

    # Public names of a file in which the component has something live.
    alive_in = node.where("live").select("component", "file_id").distinct()
    rescued = node.where("not live and is_public").join(alive_in, ["component", "file_id"], "left_semi").select("id")
    node = node.join(rescued.withColumn("saved", F.lit(True)), "id", "left").withColumn("live", F.col("live") | F.coalesce("saved", F.lit(False))).select("id", "component", "live")
    node = written(node, "node")

    # The live part of a component is one component, its dead rest falls apart.
    dead = node.where("not live").select("id")
    du, dv = dead.select(F.col("id").alias("u")), dead.select(F.col("id").alias("v"))
    parts = loops.components(dead, adj.join(du, "u", "left_semi").join(dv, "v", "left_semi").select("u", "v"), most_edges)
    heads = node.where("live").groupBy("component").agg(F.min("id").alias("head"))
    split = node.where("live").join(heads, "component").select("id", F.col("head").alias("component"), F.lit(False).alias("is_dead"))
    split = written(split.union(parts.select("id", "component", F.lit(True))), "split")
    return Components(merge_dead(split, edges, most_edges), reachable, still, adj)


def merge_dead(members: DataFrame, edges: DataFrame, most_edges: int = local.MOST_EDGES) -> DataFrame:
    """Dead components that inheritance or decoration ties, through others, to a live one become part of the largest live one (of equal ones, the one with the least number)."""
    ties = edges.where("edge_type in ('inherit', 'decorate') and source_id <> 0 and target_id <> 0")
    of = members.select("id", "component")
    tied = ties.join(of.toDF("source_id", "u"), "source_id").join(of.toDF("target_id", "v"), "target_id").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    sizes = members.groupBy("component", "is_dead").agg(F.count(F.lit(1)).alias("n"))
    group = loops.components(sizes.select(F.col("component").alias("id")), tied, most_edges).toDF("component", "bunch")
    bunches = sizes.join(group, "component")
    target = bunches.where("not is_dead").groupBy("bunch").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("target"))
    moved = bunches.where("is_dead").join(target, "bunch").select("component", "target")
    joined = members.join(moved, "component", "left")
    return written(joined.select("id", F.coalesce("target", "component").alias("component"), (F.col("is_dead") & F.col("target").isNull()).alias("is_dead")), "members")
