"""From source files to the index: parse, resolve, analyse, warn, store."""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.graph import local
from sparkweave.operators import analyze, resolve, rules, stats, warn
from sparkweave.parse import LANGUAGES, own
from sparkweave.session import small_batches, small_input, written
from sparkweave.sources import projects, scan, storage
from sparkweave.sources.index import Index, diff

_NODE = (
    "array<struct<local:int,name:string,qualified_name:string,node_type:string,line_start:int,line_end:int,col_offset:int,parent_local:int,is_deprecated:boolean,deprecation_msg:string,"
    "type_annotation:string,is_async:boolean,decorators:array<string>,docstring:string,is_partial:boolean,canonical_name:string,visibility:string,is_special:boolean,is_public:boolean>>"
)
PARSED = (
    f"path string, module string, nodes {_NODE}, refs array<struct<source_qname:string,target_name:string,edge_type:string,line:int>>, marks array<struct<kind:string,name:string,line:int,local:int>>, "
    "imports array<struct<line:int,module:string,names:array<string>,type:string,is_used:boolean>>, said array<struct<warn_type:string,severity:string,message:string,line:int>>"
)
_NODE_FIELDS = [f.split(":")[0] for f in _NODE[len("array<struct<") :].replace("array<string>", "x").rstrip(">").split(",")]


def _row(path: str, lang: str, content: bytes | None, size: int, adapters: dict) -> tuple:
    """A file's row of :data:`PARSED`. A file without content is over the size limit; one that can't be parsed has a warning and no nodes."""
    m = adapters.get(lang) or LANGUAGES[lang]
    if content is None:
        return (path, m.module_of(path), [], [], [], [], [dict(zip(_SAID, ("file_too_large", "info", f"File is {size / 1048576:.1f} MB and was not parsed", 0)))])
    p = m.parse(path, bytes(content))
    empty = dict.fromkeys(_NODE_FIELDS)
    nodes = [{**empty, "is_deprecated": False, "is_async": False, "is_partial": False, **n, "is_special": m.is_special(n["name"]), "is_public": n["name"] in m.PUBLIC} for n in p.nodes]
    imports = [{"line": i["line"], "module": i["module"], "names": i["names"], "type": i["type"], "is_used": i.get("is_used", True)} for i in p.imports]
    refs = [dict(zip(("source_qname", "target_name", "edge_type", "line"), r)) for r in p.refs]
    return (path, p.module, nodes, refs, [dict(zip(("kind", "name", "line", "local"), x)) for x in p.marks], imports, [dict(zip(_SAID, w)) for w in p.warnings])


_SAID = ("warn_type", "severity", "message", "line")
_COLUMNS = ["path", "module", "nodes", "refs", "marks", "imports", "said"]


def parse_files(files: DataFrame) -> DataFrame:
    """``files(path, lang, content, size_bytes)`` -> :data:`PARSED`, one row per file."""
    small_batches(files.sparkSession, 256)
    adapters = own()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_row(*r, adapters) for r in zip(b["path"], b["lang"], b["content"], b["size_bytes"])], columns=_COLUMNS)

    return files.select("path", "lang", "content", "size_bytes").mapInPandas(run, PARSED)


def read_and_parse(files: DataFrame, root: str, config: dict) -> DataFrame:
    """``files(path, lang, size_bytes, mtime_ns, is_test)`` -> :data:`PARSED` with the file's columns and ``hash``; contents never leave the task that reads them."""
    adapters, most = own(), scan.most_bytes(config)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                got = scan.content_of(root, r.path, r.size_bytes, r.mtime_ns, most)
                if got:
                    rows.append((*_row(r.path, r.lang, got[0], r.size_bytes, adapters), r.lang, r.size_bytes, r.mtime_ns, r.is_test, got[1]))
                if len(rows) >= 100:
                    yield pd.DataFrame(rows, columns=_COLUMNS + _FILE)
                    rows = []
            yield pd.DataFrame(rows, columns=_COLUMNS + _FILE)

    return files.select("path", "lang", "size_bytes", "mtime_ns", "is_test").mapInPandas(run, PARSED + ", lang string, size_bytes long, mtime_ns long, is_test boolean, hash string")


_FILE = ["lang", "size_bytes", "mtime_ns", "is_test", "hash"]


@dataclass
class Tables:
    """The tables of one parse, with ids."""

    files: DataFrame
    nodes: DataFrame
    refs: DataFrame
    marks: DataFrame
    imports: DataFrame
    said: DataFrame


def with_ids(parsed: DataFrame) -> Tables:
    """Ids that follow from natural keys: files by path, nodes by (path, order in the file).

    A file's nodes have consecutive ids after those of the files before it, so ids need one row per file in order, not all nodes.
    """
    info = parsed.select("path", "hash", "size_bytes", "mtime_ns", "lang", "is_test", "module", F.size("nodes").alias("n"), F.size("said").alias("w"))
    # Files are numbered within ranges of paths; the counts of the ranges before are added.
    ranges = written(info.repartitionByRange("path").withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_files"), F.sum("n").alias("_nodes"))
    starts = starts.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_files", "_nodes")])
    w = Window.partitionBy("_range").orderBy("path")
    number_of = F.row_number().over(w) + F.col("_files")
    first = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_nodes")
    numbered = ranges.join(starts, "_range").withColumn("file_id", number_of.cast("long")).withColumn("first", first).drop("_range", "_files", "_nodes")
    numbered = written(numbered, "files")
    at = parsed.join(numbered.select("path", "file_id", "first"), "path")
    node = at.select("file_id", "first", F.explode("nodes").alias("x"))
    number = lambda c: F.when(c > 0, F.col("first") + c).otherwise(0).cast("long")
    nodes = node.select(
        number(F.col("x.local")).alias("id"), "file_id", *[f"x.{c}" for c in ("name", "qualified_name", "node_type", "line_start", "line_end", "col_offset")], number(F.coalesce(F.col("x.parent_local"), F.lit(0))).alias("parent"),
        *[f"x.{c}" for c in ("is_deprecated", "deprecation_msg", "type_annotation", "is_async", "decorators", "docstring", "is_partial", "canonical_name", "visibility", "is_special", "is_public")],
    )
    refs = at.select("file_id", F.posexplode("refs").alias("pos", "x")).select("file_id", "pos", "x.*")
    marks = at.select("file_id", "first", F.explode("marks").alias("x")).select("file_id", "x.kind", "x.name", "x.line", number(F.coalesce(F.col("x.local"), F.lit(0))).alias("node_id"))
    imports = at.select("file_id", F.explode("imports").alias("x")).select("file_id", F.col("x.line").alias("import_line"), F.col("x.module").alias("module_path"), F.col("x.names").alias("imported_names"), F.col("x.type").alias("import_type"), "x.is_used")
    said = at.select("file_id", F.explode("said").alias("x")).select("file_id", F.lit(None).cast("long").alias("node_id"), "x.warn_type", "x.severity", "x.message", "x.line", F.lit(None).cast("map<string,string>").alias("details"))
    status = numbered.withColumn("parse_status", F.when((F.col("n") == 0) & (F.col("w") > 0), "failed").otherwise("ok"))
    return Tables(status, nodes, refs, marks, imports, said)


def find_entries(t: Tables, config: dict, public_as_entry: bool = False, root: str | None = None) -> DataFrame:
    """Entries by the configured rules and by the project files below a root, bound to nodes by line."""
    spark = t.nodes.sparkSession
    files = t.files.withColumn("has_nodes", F.col("n") > 0)
    whole = files.select("file_id", F.lit("file").alias("kind"), F.col("path").alias("name"), F.lit(1).alias("line"), F.lit(0).cast("long").alias("node_id"))
    patterns = config.get("test_patterns", {})
    named = F.col("node_type").isin("function", "method") & F.col("name").rlike(rules.any_glob(patterns.get("function_patterns", ["test_*"])))
    testing = t.nodes.where(named | ((F.col("node_type") == "class") & F.col("name").startswith("Test"))).select("file_id")
    # Languages whose tests are calls or attributes mark them themselves; a C file is a test by its name.
    testing = testing.union(t.marks.where("kind = 'test'").select("file_id")).union(files.where("lang = 'c'").select("file_id")).distinct()
    tests = files.where("is_test").join(testing, "file_id", "left_semi").select("file_id", F.lit("test").alias("kind"), F.lit("").alias("name"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("node_id"))
    marks = t.marks.where("kind <> 'test'").unionByName(whole).unionByName(tests)
    active = [r | {"enabled": True} if public_as_entry and str(r.get("ast_pattern", "")).startswith("visibility:") else r for r in config.get("entry_rules", [])]
    found = rules.bind_entries(rules.detect(marks, files, rules.compile_rules(spark, active)), t.nodes)
    own = t.nodes.join(t.files.select("file_id", "path"), "file_id")
    mode = "on" if public_as_entry else config.get("c_library_mode", "auto")
    c_entries = found.join(t.files.where("lang = 'c'").select("file_id"), "file_id", "left_semi")
    found = found.unionByName(rules.program_entries(own, c_entries, mode))
    if public_as_entry:
        shown = t.marks.where("kind in ('export', 'visible') and node_id <> 0").select("file_id", "node_id", F.lit("public").alias("rule_name"), F.col("line").cast("int").alias("line"), F.lit("public item").alias("description"), F.lit(False).alias("no_propagate"))
        found = found.unionByName(shown)
    csharp, binaries = (projects.csharp_projects(root), projects.cargo_binaries(root)) if root else ([], [])
    if csharp or binaries:
        more, skipped = projects.project_entries(spark, t.files, t.nodes, t.marks, csharp, binaries)
        found = found.join(skipped, "file_id", "left_anti").unionByName(more)
    return found.distinct()


@dataclass
class Built:
    nodes: DataFrame
    edges: DataFrame
    entries: DataFrame
    warnings: DataFrame
    snapshots: DataFrame
    members: DataFrame
    summary: DataFrame


def analyse(t: Tables, config: dict, public_as_entry: bool = False, extensions: bool = False, compat: bool = False, most_edges: int = local.MOST_EDGES, root: str | None = None) -> Built:
    """Everything that follows from the parsed tables. ``extensions``: also warn of uses of deprecated nodes and of references that nothing matches."""
    nodes, parts = resolve.merge_partials(t.nodes)
    nodes = written(nodes, "nodes")
    modules = t.files.select("file_id", "module")
    c_files = t.files.where("lang = 'c'").select("file_id", F.col("file_id").alias("c_file"))
    bound = resolve.bind_sources(t.refs, nodes, modules).join(c_files, "file_id", "left")
    bound = written(bound.withColumn("ref_id", F.xxhash64("file_id", "pos")), "refs")
    includes = resolve.resolve_includes(t.imports.where("import_type = 'include'").select("file_id", F.col("module_path").alias("include_path")), t.files)
    closed = resolve.closure(includes.toDF("a", "b")).toDF("file_id", "included")
    # Fragments of partial types are reached by their own names only through the merged node.
    resolved = written(resolve.drop_foreign_static(resolve.resolve(bound, nodes), nodes, closed), "resolved")
    edges = written(resolve.to_edges(resolved, nodes).unionByName(parts), "edges")
    entries = written(find_entries(t, config, public_as_entry, root), "entries")
    c = analyze.find_components(nodes, edges, entries, includes, most_edges)
    warnings = t.said.unionByName(warn.graph_warnings(nodes, edges, c.members, most_edges))
    if extensions:
        old = nodes.where("is_deprecated").select(F.col("id").alias("target_id"), F.col("qualified_name").alias("old"))
        uses = resolved.join(old, "target_id").select("file_id", F.col("source_id").alias("node_id"), F.lit("deprecated_usage").alias("warn_type"), F.lit("warning").alias("severity"), F.concat(F.lit("Use of deprecated '"), "old", F.lit("'")).alias("message"), "line", F.lit(None).cast("map<string,string>").alias("details"))
        lost = resolve.unresolved(bound, resolved).select("file_id", F.col("source_id").alias("node_id"), F.lit("unresolved_ref").alias("warn_type"), F.lit("info").alias("severity"), F.concat(F.lit("Nothing is called '"), "target_name", F.lit("'")).alias("message"), "line", F.lit(None).cast("map<string,string>").alias("details"))
        dynamic = t.refs.where("edge_type = 'call' and target_name in ('__import__', 'importlib.import_module', 'import_module')").select("file_id", F.lit(None).cast("long").alias("node_id"), F.lit("dynamic_import").alias("warn_type"), F.lit("info").alias("severity"), F.lit("Import at run time").alias("message"), "line", F.lit(None).cast("map<string,string>").alias("details"))
        warnings = warnings.unionByName(uses).unionByName(lost).unionByName(dynamic)
    warnings = written(warn.dedupe(warnings, compat), "warnings")
    snaps = stats.snapshots(nodes, edges, c.members, warnings, entries, t.files)
    return Built(nodes, edges, entries, warnings, snaps, c.members, warn.summary(warnings))


def build_index(spark: SparkSession, root: str, index: Index, config: dict, force: bool = False, public_as_entry: bool = False, compat: bool = False, extensions: bool = False) -> dict:
    """Bring the index up to date. Only files that are new, or differ in size or time, are read and parsed; what follows from the tables is
    worked out anew from all of them, so that an incremental build gives just what a full one does."""
    began = time.time()
    root = storage.normal(root)
    now = scan.listed(spark, root, config, compat)
    state = None if force else index.current()
    if state is not None and state.get("public_as_entry") != public_as_entry:
        state = None
    old = None
    if state is not None:
        try:
            old = index.read("parsed")
        except AnalysisException:  # the version that the pointer names is broken: start over
            state = None
    # States by listing first: what has its size and time is unchanged; the others are read, and their hashes tell.
    if old is not None:
        known = old.select("path", F.col("size_bytes").alias("_size"), F.col("mtime_ns").alias("_time"), F.col("hash").alias("_hash"))
        both = now.join(known, "path", "full_outer")
        both = written(both.withColumn("state", F.when(F.col("_hash").isNull(), "added").when(F.col("lang").isNull(), "removed").when((F.col("size_bytes") == F.col("_size")) & (F.col("mtime_ns") == F.col("_time")), "unchanged").otherwise("touched")), "changes")
        count = {r["state"]: r["count"] for r in both.groupBy("state").count().collect()}
        if set(count) <= {"unchanged"} and state.get("config") == _config_mark(config):
            return _result(began, sum(count.values()), count, 0, 0, 0)
        todo = both.where("state in ('added', 'touched')")
    else:
        count, todo = {"added": None}, now
    version = index.begin()
    fresh = read_and_parse(todo, root, config)
    if old is not None:
        kept = old.join(both.where("state = 'unchanged'").select("path"), "path", "left_semi")
        fresh = fresh.unionByName(kept)
    parsed = index.write(version, "parsed", fresh)
    totals = parsed.agg(F.coalesce(F.sum(F.size("nodes") + F.size("refs") + F.size("imports") + F.size("marks")), F.lit(0)), F.count(F.lit(1))).first()
    if old is None:
        count = {"added": totals[1]}
    elif count.get("touched"):
        same = parsed.join(both.where("state = 'touched'").select("path", "_hash"), "path").where("hash = _hash").count()
        count |= {"modified": count.pop("touched") - same, "unchanged": count.get("unchanged", 0) + same}
    with small_input(totals[0]):
        t = with_ids(parsed)
        t = Tables(t.files, written(t.nodes, "nodes"), written(t.refs, "refs"), written(t.marks, "marks"), written(t.imports, "imports"), written(t.said, "said"))
        b = analyse(t, config, public_as_entry, extensions, compat, root=root)
    tables = {
        "files": (t.files, "path"), "nodes": (b.nodes, "id"), "edges": (b.edges, "source_id"), "entries": (b.entries, None), "imports": (t.imports, None), "warnings": (b.warnings, "node_id"), "members": (b.members, "component"),
        "snapshots": (b.snapshots, "graph_id"), "summary": (b.summary, None),
    }
    with ThreadPoolExecutor(4) as pool:  # independent jobs, side by side
        made = dict(zip(tables, pool.map(lambda k: index.write(version, k, *tables[k]), tables)))
    index.commit(version, public_as_entry=public_as_entry, config=_config_mark(config))
    return _result(began, sum(count.get(k, 0) for k in ("added", "modified", "unchanged")), count, t.nodes.count(), made["edges"].count(), made["warnings"].count())


def _config_mark(config: dict) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def _result(began: float, files: int, count: dict, nodes: int, edges: int, warnings: int) -> dict:
    return {
        "status": "ok", "files_scanned": files, "files_changed": count.get("modified", 0), "files_added": count.get("added", 0), "files_removed": count.get("removed", 0), "nodes_added": nodes, "edges_updated": edges,
        "duration_ms": int((time.time() - began) * 1000), "warnings_generated": warnings,
    }



