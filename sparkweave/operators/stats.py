"""Component statistics, snapshots and the relational queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave import schema as S
from sparkweave.session import written


#: Ids of a component whose list is put together as a whole; ids of a range that is put together in larger ones; components that are broadcast.
LISTED, RANGE, BROADCAST = 10_000, 65_536, 100_000


def component_stats(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``(component, is_dead, node_count, variable_count, root_node_ids, component_hash)``; kinds other than those named count in neither column.

    The hash is that of the sorted ids' list. A component of more than :data:`LISTED` nodes is hashed range of ids by range of ids, then over the ranges' hashes, and
    lists its first ids only, so that no task holds all of a component.
    """
    node = nodes.select("id", "node_type").join(members, "id")
    counts = [F.count_if(F.col("node_type").isin("class", "function", "method")).alias("node_count"), F.count_if(F.col("node_type").isin(*S.VARIABLES)).alias("variable_count")]
    key, ids = ["component", "is_dead"], F.sort_array(F.collect_set("id"))
    text = F.concat(F.lit("["), F.array_join(F.col("ids").cast("array<string>"), ", "), F.lit("]"))
    large = written(members.groupBy("component").count().where(F.col("count") > LISTED).select("component"), "large")
    n = large.count()
    if not n:
        whole = node.groupBy(*key).agg(*counts, ids.alias("ids"))
        return whole.select(*key, "node_count", "variable_count", F.col("ids").alias("root_node_ids"), F.sha2(text, 256).alias("component_hash"))
    some = F.broadcast(large) if n <= BROADCAST else large
    whole = node.join(some, "component", "left_anti").groupBy(*key).agg(*counts, ids.alias("ids"))
    small = whole.select(*key, "node_count", "variable_count", F.col("ids").alias("root_node_ids"), F.sha2(text, 256).alias("component_hash"))
    ranges = node.join(some, "component", "left_semi").withColumn("range", F.floor(F.col("id") / RANGE)).groupBy(*key, "range").agg(*counts, ids.alias("ids"))
    ranges = ranges.select(*key, "range", "node_count", "variable_count", F.slice("ids", 1, LISTED).alias("ids"), F.sha2(text, 256).alias("digest"))
    digests = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "digest"))), lambda x: x["digest"]), "")
    return small.unionByName(
        ranges.groupBy(*key).agg(F.sum("node_count").alias("node_count"), F.sum("variable_count").alias("variable_count"), F.min_by("ids", "range").alias("root_node_ids"), F.sha2(digests, 256).alias("component_hash"))
    )


def whole_component_stats(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """As :func:`component_stats`, with all ids and the hash of all their list, however large the component.

    Ids are sorted and put together range by range, then the ranges are joined, which is one path for all sizes. A component's list is a row of the result, so one task holds it.
    """
    counts = [F.count_if(F.col("node_type").isin("class", "function", "method")).alias("node_count"), F.count_if(F.col("node_type").isin(*S.VARIABLES)).alias("variable_count")]
    key = ["component", "is_dead"]
    ranges = nodes.select("id", "node_type").join(members.hint("merge"), "id").groupBy(*key, F.floor(F.col("id") / RANGE).alias("range")).agg(*counts, F.sort_array(F.collect_set("id")).alias("ids"))
    rows = F.sort_array(F.collect_list(F.struct("range", "ids")))
    whole = ranges.groupBy(*key).agg(F.sum("node_count").alias("node_count"), F.sum("variable_count").alias("variable_count"), F.flatten(F.transform(rows, lambda x: x["ids"])).alias("root_node_ids"))
    return whole.withColumn("component_hash", F.sha2(F.concat(F.lit("["), F.array_join(F.col("root_node_ids").cast("array<string>"), ", "), F.lit("]")), 256))


def edge_counts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(component, edge_count)``: an edge counts once in the component of either end; module-level code is in none."""
    ends = F.array_distinct(F.array("a", "b"))
    of = members.select("id", "component")
    at = edges.join(of.toDF("source_id", "a"), "source_id", "left").join(of.toDF("target_id", "b"), "target_id", "left")
    return at.select(F.explode(ends).alias("component")).where("component is not null").groupBy("component").agg(F.count(F.lit(1)).alias("edge_count"))


def component_entries(entries: DataFrame, nodes: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """``(component, entry_file, entry_line, entry_type)``: the first entry outside test files, else the first; entries of nodes come before those of files."""
    of = members.select(F.col("id").alias("node_id"), "component")
    direct = entries.where("node_id <> 0").join(of, "node_id").withColumn("k", F.lit(0))
    by_file = nodes.select(F.col("id").alias("node_id"), "file_id").join(of, "node_id").select("file_id", "component").distinct()
    whole = entries.where("node_id = 0").join(by_file, "file_id").withColumn("k", F.lit(1))
    columns = ["file_id", "component", "rule_name", "line", "k"]
    both = direct.select(*columns).unionByName(whole.select(*columns)).join(files.select("file_id", "path", "is_test"), "file_id")
    first = F.min_by(F.struct("path", "line", "rule_name"), F.struct("is_test", "k", "path", "line", "rule_name"))
    return both.groupBy("component").agg(first.alias("e")).select("component", F.col("e.path").alias("entry_file"), F.col("e.line").alias("entry_line"), F.col("e.rule_name").alias("entry_type"))


def snapshots(nodes: DataFrame, edges: DataFrame, members: DataFrame, warnings: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """One row per component."""
    warned = warnings.join(members.select(F.col("id").alias("node_id"), "component"), "node_id").groupBy("component").agg(F.count(F.lit(1)).alias("warning_count"))
    out = whole_component_stats(nodes, members).join(edge_counts(edges, members), "component", "left").join(warned, "component", "left").join(component_entries(entries, nodes, members, files), "component", "left")
    return out.select(
        F.col("component").alias("graph_id"), "entry_file", F.col("entry_line").cast("int").alias("entry_line"), F.coalesce("entry_type", F.lit("")).alias("entry_type"), "node_count", "variable_count",
        F.coalesce("edge_count", F.lit(0).cast("long")).alias("edge_count"), F.coalesce("warning_count", F.lit(0).cast("long")).alias("warning_count"), F.col("is_dead").alias("is_dead_code"), F.col("is_dead").alias("is_unreachable"), "root_node_ids", "component_hash",
    )


SORTS = {"name": "entry_file"} | {f"{x}s": f"{x}_count" for x in ("warning", "node", "edge")}


def list_graphs(
    snaps: DataFrame, members: DataFrame | None = None, warnings: DataFrame | None = None, files: DataFrame | None = None, *, exclude_clean: bool = False, min_nodes: int | None = None, max_nodes: int | None = None,
    include_tests: bool = True, exclude_unreachable: bool = False, warn_types: list[str] | None = None, sort_by: str = "warnings", limit: int | None = None,
) -> DataFrame:
    """Snapshots that pass all filters, in descending order of the sort column, then by number; an unknown sort column counts as warnings.

    ``warn_types``: the component has, for each of them, a warning on one of its nodes.
    """
    out, size = snaps, F.col("node_count") + F.col("variable_count")
    if exclude_clean:
        out = out.where("warning_count > 0")
    if min_nodes is not None:
        out = out.where(size >= min_nodes)
    if max_nodes is not None:
        out = out.where(size <= max_nodes)
    if not include_tests:
        out = out.join(files.where("is_test").select(F.col("path").alias("entry_file")), "entry_file", "left_anti")
    if exclude_unreachable:
        out = out.where("not is_unreachable")
    if warn_types:
        wanted = sorted(set(warn_types))
        # Merged, as their sizes are those of the graph, and a broadcast goes through the driver.
        has = warnings.where(F.col("warn_type").isin(*wanted)).join(members.select(F.col("id").alias("node_id"), F.col("component").alias("graph_id")).hint("merge"), "node_id")
        out = out.join(has.groupBy("graph_id").agg(F.count_distinct("warn_type").alias("_k")).where(F.col("_k") == len(wanted)).select("graph_id").hint("merge"), "graph_id", "left_semi")
    out = out.select(*snaps.columns).orderBy(F.col(SORTS.get(sort_by, "warning_count")).desc_nulls_last(), "graph_id")
    return out if limit is None else out.limit(limit)


def detail_nodes(nodes: DataFrame, members: DataFrame, files: DataFrame, graph_id: int) -> DataFrame:
    return nodes.join(members.where(F.col("component") == graph_id).select("id"), "id", "left_semi").join(files.select("file_id", "path"), "file_id")


def detail_edges(edges: DataFrame, members: DataFrame, graph_id: int) -> DataFrame:
    """Edges with an end in the component, each row of the edge table once, those of module-level code left out."""
    of = members.where(F.col("component") == graph_id).select("id")
    s, t = of.select(F.col("id").alias("source_id"), F.lit(True).alias("_s")), of.select(F.col("id").alias("target_id"), F.lit(True).alias("_t"))
    return edges.where("source_id <> 0").join(s, "source_id", "left").join(t, "target_id", "left").where("_s or _t").select(*edges.columns)


def detail_warnings(warnings: DataFrame, members: DataFrame, nodes: DataFrame, graph_id: int) -> DataFrame:
    """Warnings on a node of the component, and those without a node in one of its files."""
    of = members.where(F.col("component") == graph_id).select("id")
    on = warnings.join(of.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(*warnings.columns)
    its = nodes.join(of, "id", "left_semi").select("file_id").distinct()
    return on.unionByName(warnings.where("node_id is null or node_id = 0").join(its, "file_id", "left_semi").select(*warnings.columns))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(edges, no_source, no_target)``: edges whose ends are no nodes; source 0 is module-level code."""
    s, t = nodes.select(F.col("id").alias("source_id"), F.lit(1).alias("_s")), nodes.select(F.col("id").alias("target_id"), F.lit(1).alias("_t"))
    at = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    return at.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("_s").isNull() & (F.col("source_id") != 0)).alias("no_source"), F.count_if(F.col("_t").isNull()).alias("no_target"))


def tests_of_dead(nodes: DataFrame, edges: DataFrame, members: DataFrame, files: DataFrame, most_edges: int | None = None) -> DataFrame:
    """``(graph_id, test_file, line, target)``: stored edges from test files into what is tied to a dead component, whichever way edges run.

    What edges tie together is one component of the undirected graph of stored edges, so a node belongs to every dead
    component that its own component of that graph has a node of.
    """
    from sparkweave.graph import local, loops

    stored = edges.where("source_id <> 0")
    tied = loops.components(nodes, stored.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")), local.MOST_EDGES if most_edges is None else most_edges)
    dead = members.where("is_dead").join(tied.withColumnRenamed("component", "bunch"), "id").select(F.col("component").alias("graph_id"), "bunch").distinct()
    target = nodes.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target"))
    tests = stored.join(files.where("is_test").select("file_id", F.col("path").alias("test_file")), "file_id") if "file_id" in stored.columns else stored
    return tests.join(tied.toDF("target_id", "bunch"), "target_id").join(dead, "bunch").join(target, "target_id").select("graph_id", "test_file", "line", "target")


def volume_budget(snaps: DataFrame, limit: int) -> DataFrame:
    """The leading graphs whose summaries fit the limit together: 80 characters and the entry's name each."""
    cost = (F.lit(80) + F.coalesce(F.length("entry_file"), F.lit(0))).cast("long")
    order = [F.col("warning_count").desc(), F.col("graph_id")]
    head = snaps.orderBy(*order).limit(max(0, limit) // 80)  # no more can fit, so the running sum below is over few rows
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return head.withColumn("cost", cost).withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= limit)
