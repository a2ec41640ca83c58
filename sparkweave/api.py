"""``build``, ``query`` and ``configure``: the interface for programs; the command line calls the same."""

from __future__ import annotations

import json
import re
import sys
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave import schema as S
from sparkweave.config import META, Config, InvalidParamError, InvalidPathError, coerced
from sparkweave.operators import stats
from sparkweave.present import Formatter, Text, volume
from sparkweave.sources import scan, storage
from sparkweave.sources.index import Index


#: Warnings of a graph, or tests of dead code, that are returned at most; how many more there are is said.
MOST_ROWS = 1000
#: Upper bound of ``parallel``.
MOST_PARALLEL = 64


def session(spark: SparkSession | None = None) -> SparkSession:
    from sparkweave.session import builder

    return spark or SparkSession.getActiveSession() or builder().getOrCreate()


def _root(path: str) -> str:
    """A local folder's real path, or the URI of a folder on shared storage."""
    real = storage.normal(path)
    if not storage.is_folder(real):
        raise InvalidPathError(path, "no such folder")
    return real


def _index(spark: SparkSession, root: str) -> Index:
    """The index lies below the root; on a cluster the root must be a folder that all executors share, by URI or by mount."""
    return Index(spark, f"{root if '://' in root else 'file:' + root}/{META}/index")


def build(root_dir: str = ".", force_rebuild: bool = False, lang: str = "system", parallel: int = 0, compat: bool = False, extensions: bool = False, public_as_entry: bool = False, spark: SparkSession | None = None) -> dict[str, Any]:
    """Build the index of a folder or bring it up to date; returns counts and the time taken.

    ``parallel`` is checked and otherwise left to Spark. ``compat``: user excludes have no effect and cycles on equal lines are one warning.
    ``extensions``: also warn of deprecated uses, unresolved references and dynamic imports.
    """
    from sparkweave.build import build_index

    root = _root(root_dir)
    _whole("parallel", parallel, 0, MOST_PARALLEL)
    config = Config(root).load()
    for ext, n in scan.unhandled(root).items():
        print(f"{n} {ext} files are not parsed: no parser is registered for them", file=sys.stderr)
    spark = session(spark)
    return build_index(spark, root, _index(spark, root), config, force_rebuild, public_as_entry, compat, extensions)


def _whole(name: str, value: int | None, low: int, high: int | None = None) -> None:
    if value is not None and (value < low or (high is not None and value > high)):
        raise InvalidParamError(name, str(value), f"{low}-{high}" if high is not None else f"at least {low}")


def _one_of(name: str, value: str, known) -> None:
    if value not in known:
        raise InvalidParamError(name, value, f"one of {sorted(known)}")


def _kinds(warn_types: str | None) -> list[str]:
    kinds = re.findall(r"[^\s,]+", warn_types or "")
    for kind in kinds:
        _one_of("warn_types", kind, S.WARN_TYPES)
    return kinds


def _ok(**values: Any) -> dict[str, Any]:
    return {"status": "ok", **values}


def _failed(message: str, **values: Any) -> dict[str, Any]:
    return {"status": "error", "message": message, **values}


def _entry(row: dict) -> str:
    return " ".join(filter(None, [row.get("entry_type"), row.get("entry_file")]))


def query(
    root_dir: str = ".", graph_id: int | None = None, detail_level: str = "auto", dead_code_tests: bool = False, edge_limit: int = 10, exclude_clean: bool = False, file_limit: int = 10, exclude_unreachable: bool = False, json_output: bool = False,
    include_tests: bool = False, lang: str = "system", max_nodes: int | None = None, min_nodes: int = 0, max_results: int = 50, no_scan: bool = False, node_limit: int = 30, path_format: str = "relative", output_limit: int = 8000,
    public_as_entry: bool = False, warn_types: str | None = None, sort_by: str = "warnings", spark: SparkSession | None = None,
) -> str | dict[str, Any]:
    """List graphs, show one (``graph_id``), or list the tests that touch dead code (``dead_code_tests``); text, or a dict with ``json_output``.

    The index is brought up to date first, unless ``no_scan``.
    """
    root = _root(root_dir)
    _whole("graph_id", graph_id, 1)
    _whole("min_nodes", min_nodes, 0)
    _whole("max_nodes", max_nodes, 1)
    _whole("max_results", max_results, 1, 1000)
    _whole("output_limit", output_limit, 100, 100_000)
    _one_of("sort_by", sort_by, stats.SORTS)
    _one_of("path_format", path_format, {"relative", "absolute"})
    kinds = _kinds(warn_types)
    config = Config(root).load()
    if lang == "system":
        lang = config.get("lang") or lang
    spark, began = session(spark), time.time()
    index = _index(spark, root)
    if not no_scan:
        try:
            build(root_dir=root, public_as_entry=public_as_entry, spark=spark)
        except Exception as e:
            if index.current() is None:
                raise
            print(f"The index may be out of date: {e}", file=sys.stderr)
    took = lambda: int((time.time() - began) * 1000)
    form = Formatter(lang, path_format, root)
    if graph_id is not None:
        if no_scan and not validate(index, root, graph_id):
            said = form.t("stale")
            return _failed(said, query_time_ms=took()) if json_output else said
        d = graph_detail(index, graph_id, node_limit, edge_limit, file_limit)
        if d is None:
            said = form.t("no_graph", id=graph_id)
            return _failed(said, query_time_ms=took()) if json_output else said
        if not json_output:
            return form.detail(d)
        d.pop("histogram")
        return _ok(graph=d, root_dir=form.root, query_time_ms=took())
    if dead_code_tests:
        return _dead_tests(index, json_output, form.t, took)
    only = {"exclude_clean": exclude_clean, "include_tests": include_tests, "max_nodes": max_nodes, "exclude_unreachable": exclude_unreachable, "min_nodes": min_nodes}
    r = graph_list(index, max_results, sort_by=sort_by, warn_types=kinds, **only)
    if json_output:
        return _ok(result=r, root_dir=root, path_format=path_format, query_time_ms=took())
    return form.listing(r, *volume(r["graphs"], False, detail_level, output_limit))


def graph_list(index: Index, max_results: int = 50, **filters) -> dict[str, Any]:
    """A page of graphs with the totals that go with it."""
    snaps = index.read("snapshots").withColumn("component_size", F.size("root_node_ids")).drop("root_node_ids")  # lists of ids stay where they are
    frame = stats.list_graphs(snaps, index.read("members"), index.read("warnings"), index.read("files"), limit=max_results + 1, **filters)
    rows = [r.asDict() for r in frame.collect()]  # one page
    page = rows[:max_results]
    kinds: dict[int, list[str]] = {}
    if page:
        of = index.read("members").where(F.col("component").isin([r["graph_id"] for r in page])).select(F.col("id").alias("node_id"), "component")
        for r in index.read("warnings").join(of, "node_id").select("component", "warn_type").distinct().collect():
            kinds.setdefault(r["component"], []).append(r["warn_type"])
    graphs = [
        {"graph_id": r["graph_id"], "entry": _entry(r), "entry_file": r["entry_file"] or "", "entry_line": r["entry_line"], "node_count": r["node_count"], "variable_count": r["variable_count"], "edge_count": r["edge_count"],
         "warning_count": r["warning_count"], "warnings": sorted(kinds.get(r["graph_id"], [])), "is_dead_code": r["is_dead_code"], "is_unreachable": r["is_unreachable"], "component_size": r["component_size"]}
        for r in page
    ]
    summary = {r["warn_type"]: r["n"] for r in index.read("summary").collect()}
    return {"graphs": graphs, "total_graphs": len(graphs), "skipped_clean": sum(g["warning_count"] == 0 for g in graphs), "skipped_oversized": 0, "has_more": len(rows) > max_results, "warnings_summary": summary}


def _head(df: DataFrame, limit: int, order: list) -> tuple[list[dict], int]:
    """The first rows (all for limit 0) and how many more there are."""
    n = df.count()
    rows = df.orderBy(*order) if not limit else df.orderBy(*order).limit(limit)
    out = [r.asDict() for r in rows.collect()]
    return out, n - len(out)


def graph_detail(index: Index, graph_id: int, node_limit: int = 30, edge_limit: int = 10, file_limit: int = 10) -> dict[str, Any] | None:
    snap = index.read("snapshots").drop("root_node_ids").where(F.col("graph_id") == graph_id).first()
    if snap is None:
        return None
    nodes, members, files = index.read("nodes"), index.read("members"), index.read("files").select("file_id", "path")
    mine = stats.detail_nodes(nodes, members, files, graph_id)
    names = nodes.select("id", "qualified_name")
    edges = stats.detail_edges(index.read("edges"), members, graph_id).join(files, "file_id", "left")
    edges = edges.join(names.toDF("source_id", "source_name"), "source_id").join(names.toDF("target_id", "target_name"), "target_id")
    warnings = stats.detail_warnings(index.read("warnings"), members, nodes, graph_id).join(files, "file_id", "left")
    shown, nodes_left = _head(mine, node_limit, ["id"])
    drawn, edges_left = _head(edges, edge_limit, ["path", "line", "source_name", "target_name", "edge_type"])
    paths, files_left = _head(mine.select("path").distinct(), file_limit, ["path"])
    said, said_left = _head(warnings, MOST_ROWS, ["path", "line", "warn_type"])
    out: dict[str, Any] = {
        "graph_id": graph_id, "entry": _entry(snap.asDict()), "files": [r["path"] for r in paths],
        "nodes": [{"node_id": r["id"], "name": r["name"], "qualified_name": r["qualified_name"], "node_type": r["node_type"], "file_path": r["path"], "line_start": r["line_start"], "line_end": r["line_end"], "is_deprecated": r["is_deprecated"], "type_annotation": r["type_annotation"], "decorators": r["decorators"] or []} for r in shown],
        "edges": [{"source_name": r["source_name"], "target_name": r["target_name"], "edge_type": r["edge_type"], "file_path": r["path"], "line": r["line"]} for r in drawn],
        "warnings": [{"warn_type": r["warn_type"], "severity": r["severity"], "message": r["message"], "file_path": r["path"], "line": r["line"]} for r in said],
        "histogram": {r["node_type"]: r["count"] for r in mine.groupBy("node_type").count().collect()},
    }
    for what, n in (("edges", edges_left), ("nodes", nodes_left), ("files", files_left), ("warnings", said_left)):
        if n:
            out[f"{what}_omitted"] = n
    return out


def _dead_tests(index: Index, json_output: bool, t: Text, took) -> str | dict[str, Any]:
    found = stats.tests_of_dead(index.read("nodes"), index.read("edges"), index.read("members"), index.read("files"))
    shown, left = _head(found, MOST_ROWS, ["graph_id", "test_file", "line", "target"])
    rows = [{"test_file": r["test_file"], "line": r["line"], "referenced_symbol": r["target"], "dead_graph_id": r["graph_id"]} for r in shown]
    if json_output:
        return _ok(dead_code_tests=rows, **({"tests_omitted": left} if left else {}), query_time_ms=took())
    more = [f"  … {left}"] if left else []
    return "\n".join([t("tests", count=len(rows) + left), *(f"  {r['test_file']}:{r['line']} → {r['referenced_symbol']} (graph {r['dead_graph_id']})" for r in rows), *more])


def validate(index: Index, root: str, graph_id: int) -> bool:
    """Whether the files of a graph are on disk as they were when they were read."""
    if index.current() is None:
        return False
    mine = index.read("members").where(F.col("component") == graph_id).select("id")
    files = index.read("nodes").join(mine, "id", "left_semi").select("file_id").distinct().join(index.read("files"), "file_id").select("path", "mtime_ns").toLocalIterator()
    return all(storage.modified(root, r["path"]) == r["mtime_ns"] for r in files)


ACTIONS = tuple("show get set copy-from".split()) + tuple(f"{verb}-{what}" for what in ("entry-rule", "exclude") for verb in ("add", "remove"))


def configure(
    action: str, key: str | None = None, value: str | None = None, source: str | None = None, root_dir: str = ".", lang: str | None = None, rule_json: str | None = None, rule_name: str | None = None, exclude_pattern: str | None = None
) -> dict[str, Any]:
    """Read or change the configuration; errors are returned, not raised."""
    config = Config(_root(root_dir))
    needs = {"get": (("key", key),), "set": (("key", key), ("value", value)), "copy-from": (("from", source),), "add-entry-rule": (("rule-json", rule_json),), "remove-entry-rule": (("name", rule_name),), "add-exclude": (("exclude-pattern", exclude_pattern),), "remove-exclude": (("exclude-pattern", exclude_pattern),)}
    if action not in ACTIONS:
        return _failed(f"There is no action {action}")
    missing = [f"--{k}" for k, v in needs.get(action, ()) if v is None or v == ""]
    if missing:
        return _failed(f"{' and '.join(missing)} required")
    try:
        if lang not in (None, "system"):
            config.set("lang", lang)
        if action in ("get", "show"):
            return _ok(key=key, value=config.get(key)) if action == "get" else _ok(config=config.load())
        if action == "set":
            config.set(key, coerced(value))
        elif action == "copy-from":
            config.copy_from(source)
        elif action == "add-entry-rule":
            config.add_rule(json.loads(rule_json))
        elif action == "remove-entry-rule":
            config.remove_rule(rule_name)
        else:
            config.exclude(exclude_pattern, action == "add-exclude")
    except Exception as e:
        return _failed(str(e))
    return _ok(message=f"{action}: {key or source or rule_name or exclude_pattern or rule_json}")
