"""Further queries with SQL for them: graphs with module-level code, public names, partial types and cycles, the remaining rules of name resolution,
and source files written from the test tables, which the parsers read back."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import analyze, resolve, rules, warn
from sparkweave.plans.projections import CTES, Graph, project, with_ctes
from sparkweave.session import written

E = F.expr

_NODES = CTES["g_nodes"].replace("ELSE 'function' END AS node_type", "WHEN 9 THEN 'struct' ELSE 'function' END AS node_type").replace("c_name AS name", "CASE WHEN c_custkey % 70 = 24 THEN '_' ELSE c_name END AS name").replace(" FROM customer)", ", c_custkey % 10 = 4 AND c_custkey % 3 = 1 AS is_public FROM customer)")
_EDGES = CTES["g_edges"].replace("FROM g_orders WHERE o_custkey <> k)", """FROM g_orders WHERE o_custkey <> k
      UNION SELECT o_custkey + 1, (o_orderkey * 17) % (SELECT count(*) FROM customer) + 1, 'part_of' FROM orders WHERE o_orderkey % 125 = 2 AND o_custkey <> (o_orderkey * 17) % (SELECT count(*) FROM customer)
      UNION SELECT c_custkey + 1 + i, c_custkey + 1 + (i + 1) % 3, 'call' FROM customer, range(3) r(i) WHERE c_custkey % 50 = 15)""")
#: The tables of :func:`project_more` for DuckDB, under the names that the other projection has; ``g_edges`` is without module-level code.
MORE = CTES | {
    "g_nodes": _NODES,
    "g_edges": _EDGES,
    "g_calls": CTES["g_calls"].replace("('class', 'method', 'function')", "('class', 'method', 'function', 'struct')"),
    "g_adj": CTES["g_adj"][:-1] + """ UNION SELECT * FROM g_public UNION SELECT t, s FROM g_public)""",
    "g_zero": "g_zero AS (SELECT (o_orderkey * 31 + o_custkey) % (SELECT count(*) FROM customer) + 1 AS t, bool_or(o_orderkey % 3 > 0) AS used FROM orders WHERE o_orderkey % 25 = 1 GROUP BY 1)",
}
MORE = {k: MORE[k] for k in ("g_files", "g_nodes", "g_orders", "g_edges", "g_entries", "g_noprop", "g_refs", "g_calls")} | {
    "g_public": "g_public AS (SELECT id AS s, first AS t FROM g_nodes JOIN (SELECT file_id, min(id) AS first FROM g_nodes WHERE NOT is_public GROUP BY file_id) USING (file_id) WHERE is_public AND node_type IN ('variable', 'field'))",
    "g_adj": MORE["g_adj"], "g_reach": MORE["g_reach"], "g_cc": MORE["g_cc"], "g_comp": MORE["g_comp"], "g_zero": MORE["g_zero"],
}
_INCLUDES = "g_inc AS (SELECT DISTINCT CAST(s_nationkey + 1 AS BIGINT) AS a, CAST((s_suppkey * 7 + s_nationkey) % 25 + 1 AS BIGINT) AS b FROM supplier WHERE s_suppkey % 5 = 0 AND s_nationkey <> (s_suppkey * 7 + s_nationkey) % 25)"


def project_more(spark: SparkSession, sf_dir: str) -> Graph:
    """The star-schema graph with structs, public and unnamed variables, module-level uses, fragments of partial types and cycles of three."""
    g = project(spark, sf_dir)
    orders, customer = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = customer.agg(F.count(F.lit(1)).alias("n"))
    nodes = g.nodes.withColumn("name", E("if((id - 1) % 70 = 24, '_', name)")).withColumn("is_public", E("(id - 1) % 10 = 4 and (id - 1) % 3 = 1")).withColumn("node_type", E("if((id - 1) % 10 = 9, 'struct', node_type)"))
    some = orders.crossJoin(n)  # one row
    zero = some.where("o_orderkey % 25 = 1").select(F.lit(0).cast("long").alias("source_id"), E("(o_orderkey * 31 + o_custkey) % n + 1").alias("target_id"), E("if(o_orderkey % 2 = 0, 'read', 'call')").alias("edge_type"), F.lit(0).cast("long").alias("file_id"), E("cast(o_orderkey % 3 as int)").alias("line"))
    part = some.where("o_orderkey % 125 = 2").select(E("o_custkey + 1").alias("source_id"), E("(o_orderkey * 17) % n + 1").alias("target_id"), F.lit("part_of").alias("edge_type")).where("source_id <> target_id")
    ring = customer.where("c_custkey % 50 = 15").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).select(E("c_custkey + 1 + i").alias("source_id"), E("c_custkey + 1 + (i + 1) % 3").alias("target_id"), F.lit("call").alias("edge_type"))
    inner = g.edges.select("source_id", "target_id", "edge_type").union(part).union(ring).distinct().withColumn("file_id", F.lit(0).cast("long")).withColumn("line", E("cast(source_id % 97 as int)"))
    return Graph(g.files, nodes, inner.unionByName(zero), g.entries, g.refs)


def _includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 5 = 0 and s_nationkey <> (s_suppkey * 7 + s_nationkey) % 25")
    return t.select(E("cast(s_nationkey + 1 as long)").alias("file_id"), E("cast((s_suppkey * 7 + s_nationkey) % 25 + 1 as long)").alias("included"))


_ALIVE = """, a0 AS (SELECT id FROM g_reach UNION SELECT id FROM g_noprop),
a1 AS (SELECT id FROM a0 UNION SELECT id FROM g_nodes WHERE node_type IN ('variable', 'field') AND parent IN (SELECT id FROM a0)),
a2 AS (SELECT id FROM a1 UNION SELECT n.parent FROM a2 JOIN g_nodes n ON n.id = a2.id WHERE n.parent <> 0),
pedge AS (SELECT s, t FROM g_edges WHERE edge_type = 'part_of' UNION SELECT t, s FROM g_edges WHERE edge_type = 'part_of'),
alive AS (SELECT id FROM a2 UNION SELECT t FROM alive JOIN pedge ON s = id)"""
_LIVE = (
    _ALIVE
    + f""", {_INCLUDES},
grow AS (SELECT s, t FROM g_calls UNION SELECT t, s FROM g_edges WHERE edge_type = 'call' UNION SELECT s, t FROM g_adj JOIN g_nodes ON id = t WHERE node_type IN ('variable', 'field')),
grown AS (SELECT id FROM alive WHERE id NOT IN (SELECT id FROM g_noprop) UNION SELECT t FROM grown JOIN grow ON s = id WHERE t NOT IN (SELECT id FROM g_noprop)),
live0 AS (SELECT id FROM grown UNION SELECT id FROM alive),
node AS (SELECT n.id, n.file_id, n.node_type, n.is_public, c.comp, n.id IN (SELECT id FROM live0) AS live, n.id IN (SELECT id FROM g_noprop) AS still FROM g_nodes n JOIN g_comp c USING (id)),
lfiles AS (SELECT DISTINCT file_id AS f FROM node WHERE id IN (SELECT id FROM alive) AND NOT still),
through AS (SELECT f FROM lfiles UNION SELECT b FROM through JOIN g_inc ON a = f),
state AS (SELECT comp, bool_or(live) AS any_live, bool_or(live AND NOT still) AS any_real FROM node GROUP BY comp),
saved AS (SELECT id FROM node JOIN g_zero ON t = id JOIN state USING (comp) WHERE NOT live AND (any_real OR NOT any_live)
  AND ((node_type IN ('variable', 'field') AND (any_real OR file_id IN (SELECT f FROM lfiles))) OR (node_type = 'struct' AND used AND file_id IN (SELECT f FROM through)))),
live1 AS (SELECT id FROM live0 UNION SELECT id FROM saved),
rescued AS (SELECT n.id FROM node n WHERE is_public AND id NOT IN (SELECT id FROM live1) AND (comp, file_id) IN (SELECT (comp, file_id) FROM node WHERE id IN (SELECT id FROM live1))),
live AS (SELECT id FROM live1 UNION SELECT id FROM rescued)"""
)
_SPLIT = (
    _LIVE
    + """,
dead AS (SELECT id FROM g_nodes WHERE id NOT IN (SELECT id FROM live)),
dadj AS (SELECT s, t FROM g_adj WHERE s IN (SELECT id FROM dead) AND t IN (SELECT id FROM dead)),
dcc AS (SELECT id, id AS c FROM dead UNION SELECT t, c FROM dcc JOIN dadj ON s = id WHERE c < t),
split AS (SELECT id, min(id) OVER (PARTITION BY comp) AS component, false AS is_dead FROM g_comp WHERE id IN (SELECT id FROM live) UNION ALL SELECT id, min(c), true FROM dcc GROUP BY id),
tied0 AS (SELECT DISTINCT a.component AS u, b.component AS v FROM g_edges JOIN split a ON a.id = s JOIN split b ON b.id = t WHERE edge_type IN ('inherit', 'decorate') AND a.component <> b.component),
tied AS (SELECT u, v FROM tied0 UNION SELECT v, u FROM tied0),
sizes AS (SELECT component, is_dead, count(*) AS n FROM split GROUP BY ALL),
bunch AS (SELECT component, component AS b FROM sizes UNION SELECT v, b FROM bunch JOIN tied ON u = component WHERE b < v),
bunches AS (SELECT component, min(b) AS b FROM bunch GROUP BY component),
target AS (SELECT b, arg_max(component, (n, -component)) AS target FROM bunches JOIN sizes USING (component) WHERE NOT is_dead GROUP BY b),
moved AS (SELECT component, target FROM bunches JOIN sizes USING (component) JOIN target USING (b) WHERE is_dead),
members AS (SELECT id, coalesce(target, component) AS component, is_dead AND target IS NULL AS is_dead FROM split LEFT JOIN moved USING (component))"""
)
_RINGS = """, d AS (SELECT s, t FROM g_edges WHERE edge_type IN ('call', 'inherit')), r AS (SELECT s, t FROM d UNION SELECT r.s, d.t FROM r JOIN d ON r.t = d.s),
ring AS (SELECT a.s AS id, least(a.s, min(a.t)) AS component FROM r a JOIN r b ON a.s = b.t AND a.t = b.s WHERE a.s <> a.t GROUP BY a.s)"""
_BASE = ("g_noprop", "g_reach", "g_adj", "g_comp", "g_calls", "g_zero", "g_public")
_JUDGED = "node_type IN ('variable', 'field') AND name <> '_' AND NOT is_public"
_INTO = "(SELECT t, edge_type FROM g_edges UNION ALL SELECT (o_orderkey * 31 + o_custkey) % (SELECT count(*) FROM customer) + 1, CASE WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'call' END FROM orders WHERE o_orderkey % 25 = 1)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = project_more(spark, sf_dir)
    return analyze.find_components(g.nodes, g.edges, g.entries, _includes(spark, sf_dir)).members


def _circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = project_more(spark, sf_dir)
    nothing = g.nodes.select("id", F.col("id").alias("component"), F.lit(False).alias("is_dead"))
    return warn.graph_warnings(g.nodes, g.edges, nothing).where("warn_type = 'circular_ref'").select("node_id", "file_id", "line", "message")


# Rules of name resolution that the other projection has no data for.


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).nodes.withColumn("visibility", E("if((id - 1) % 4 = 0, 'static', null)"))


def _foreign_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.count(F.lit(1)).alias("n"))
    found = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 5 = 0").crossJoin(n).select(F.col("o_orderkey").alias("ref_id"), E("cast(o_custkey % 25 + 1 as long)").alias("file_id"), E("(o_orderkey * 7919 + o_custkey * 104729) % n + 1").alias("target_id"), E("if(o_orderkey % 2 = 0, cast(o_custkey % 25 + 1 as long), null)").alias("c_file"))
    return resolve.drop_foreign_static(found, _customer(spark, sf_dir), resolve.closure(_includes(spark, sf_dir))).select("ref_id", "target_id")


def _same_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple names of the C file that refers; every second reference is of another language."""
    g = project(spark, sf_dir)
    refs = g.nodes.where("id % 3 = 0").select(F.col("id").alias("ref_id"), F.lit(0).cast("long").alias("source_id"), F.col("name").alias("target_name"), E("if(id % 2 = 0, file_id, null)").alias("c_file"))
    return resolve.resolve(refs, g.nodes).select("ref_id", "target_id", "tier")


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by the name of their source: a node's, a module's or none's."""
    nodes = project(spark, sf_dir).nodes
    refs = nodes.select(F.col("id").alias("ref_id"), "file_id", E("case id % 4 when 0 then concat('m', file_id) when 1 then concat(qualified_name, '.x') else qualified_name end").alias("source_qname"), E("case id % 3 when 0 then 'read' when 1 then 'call' else 'write' end").alias("edge_type"))
    modules = nodes.select("file_id").distinct().withColumn("module", F.concat(F.lit("m"), "file_id"))
    return resolve.bind_sources(refs, nodes, modules).select("ref_id", "source_id")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = project(spark, sf_dir).nodes.where("node_type = 'class'").select(
        "*", (F.col("line_start") + 5).alias("line_end"), E("array(concat('d', id % 3))").alias("decorators"), F.lit(True).alias("is_partial"), E("concat('T', (id - 1) div 10 % 40)").alias("canonical_name"), F.lit("public").alias("visibility"))
    whole, parts = resolve.merge_partials(nodes)
    of = parts.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("fragments"))
    return whole.join(of, "id").select("id", F.col("qualified_name").alias("name"), "fragments", "line_start", "line_end", F.array_join("decorators", ",").alias("decorators"))


# Source files written from the suppliers: what the parsers make of them.


@dataclass(frozen=True)
class Template:
    """A file's text and the rows that a parser must give, in SQL that both engines read. ``k``: number of the file, ``n``: of its functions, ``i``: of a
    function. ``head`` and ``tail`` are lines, ``each`` is repeated; a row is ``(what, a, b, line)``."""

    lang: str
    path: str
    head: str
    each: str
    tail: str
    rows: tuple[tuple[str, str, str, str], ...]
    of_each: tuple[tuple[str, str, str, str], ...]
    of_even: tuple[tuple[str, str, str, str], ...] = ()


PYTHON = Template(
    "python", "'pkg/f' || k || '.py'",
    "'import os\\nfrom pkg.g' || k || ' import go_' || k || '\\n\\nclass C' || k || ':\\n    limit = ' || k || '\\n\\n    def run(self):\\n        return go_' || k || '()\\n\\n'",
    "'def at_' || i || '():\\n    return helper_' || i || '()\\n\\n'", "'if __name__ == \"__main__\":\\n    C' || k || '()\\n'",
    (
        ("'import absolute'", "'os'", "'os'", "1"), ("'import absolute'", "'pkg.g' || k", "'go_' || k", "2"), ("'unused_import'", "''", "''", "1"), ("'node class'", "'pkg.f' || k || '.C' || k", "''", "4"), ("'node field'", "'pkg.f' || k || '.C' || k || '.limit'", "''", "5"),
        ("'node method'", "'pkg.f' || k || '.C' || k || '.run'", "''", "7"), ("'ref write'", "'pkg.f' || k || '.C' || k", "'limit'", "5"), ("'ref call'", "'pkg.f' || k || '.C' || k || '.run'", "'go_' || k", "8"), ("'ref read'", "'pkg.f' || k || '.C' || k || '.run'", "'go_' || k", "8"),
    ),
    (("'node function'", "'pkg.f' || k || '.at_' || i", "''", "7 + 3 * i"), ("'ref call'", "'pkg.f' || k || '.at_' || i", "'helper_' || i", "8 + 3 * i"), ("'ref read'", "'pkg.f' || k || '.at_' || i", "'helper_' || i", "8 + 3 * i")),
    (("'ref read'", "'pkg.f' || k", "'__name__'", "10 + 3 * n"), ("'ref call'", "'pkg.f' || k", "'C' || k", "11 + 3 * n"), ("'ref read'", "'pkg.f' || k", "'C' || k", "11 + 3 * n")),
)
C = Template(
    "c", "'src/f' || k || '.c'", "'#include \"g' || k || '.h\"\\n\\nstatic int help_' || k || '(int a) {\\n    return a;\\n}\\n\\n'", "'int at_' || i || '(void) {\\n    return help_' || k || '(' || i || ');\\n}\\n\\n'", "'int main(void) {\\n    return at_1();\\n}\\n'",
    (("'import include'", "'g' || k || '.h'", "'g' || k || '.h'", "1"), ("'node function'", "'src.f' || k || '.help_' || k", "'static'", "3"), ("'ref read'", "'src.f' || k || '.help_' || k", "'a'", "4")),
    (("'node function'", "'src.f' || k || '.at_' || i", "''", "3 + 4 * i"), ("'ref call'", "'src.f' || k || '.at_' || i", "'help_' || k", "4 + 4 * i")),
    (("'node function'", "'src.f' || k || '.main'", "''", "7 + 4 * n"), ("'ref call'", "'src.f' || k || '.main'", "'at_1'", "8 + 4 * n")),
)
RUST = Template(
    "rust", "'src/f' || k || '.rs'", "'use crate::g' || k || '::go_' || k || ';\\n\\npub struct S' || k || ' {\\n    x: i32,\\n}\\n\\n'", "'fn at_' || i || '() -> i32 {\\n    go_' || k || '()\\n}\\n\\n'", "'fn main() {\\n    at_1();\\n}\\n'",
    (("'import absolute'", "'crate::g' || k || '::go_' || k", "'go_' || k", "1"), ("'node struct'", "'crate::f' || k || '::S' || k", "''", "3"), ("'node field'", "'crate::f' || k || '::S' || k || '::x'", "''", "4")),
    (("'node function'", "'crate::f' || k || '::at_' || i", "''", "3 + 4 * i"), ("'ref call'", "'crate::f' || k || '::at_' || i", "'go_' || k", "4 + 4 * i")),
    (("'node function'", "'crate::f' || k || '::main'", "''", "7 + 4 * n"), ("'ref call'", "'crate::f' || k || '::main'", "'at_1'", "8 + 4 * n")),
)
CSHARP = Template(
    "csharp", "'src/F' || k || '.cs'", "'using G' || k || ';\\n\\nnamespace N' || k || '\\n{\\n    public class C' || k || '\\n    {\\n        private int x;\\n\\n'", "'        public int At' || i || '()\\n        {\\n            return Help' || i || '();\\n        }\\n\\n'", "'    }\\n}\\n'",
    (("'import absolute'", "'G' || k", "'G' || k", "1"), ("'node class'", "'N' || k || '.C' || k", "'public'", "5"), ("'node field'", "'N' || k || '.C' || k || '.x'", "'private'", "7")),
    (("'node method'", "'N' || k || '.C' || k || '.At' || i", "'public'", "4 + 5 * i"), ("'ref call'", "'N' || k || '.C' || k || '.At' || i", "'Help' || i", "6 + 5 * i")),
)
TYPESCRIPT = Template(
    "typescript", "'src/f' || k || '.ts'", "'import {{ go' || k || ' }} from \"./g' || k || '\";\\n\\nexport class C' || k || ' {\\n  run(): number {\\n    return go' || k || '();\\n  }\\n}\\n\\n'".replace("{{", "{").replace("}}", "}"), "'export function at' || i || '(): number {\\n  return go' || k || '();\\n}\\n\\n'", "'at1();\\n'",
    (("'import absolute'", "'./g' || k", "'go' || k", "1"), ("'node class'", "'C' || k", "''", "3"), ("'node method'", "'C' || k || '.run'", "''", "4"), ("'ref call'", "'C' || k || '.run'", "'go' || k", "5")),
    (("'node function'", "'at' || i", "''", "5 + 4 * i"), ("'ref call'", "'at' || i", "'go' || k", "6 + 4 * i")),
    (("'ref call'", "''", "'at1'", "9 + 4 * n"),),
)
TEMPLATES = (PYTHON, C, RUST, CSHARP, TYPESCRIPT)


#: Files that one task writes and parses: a table of keys is small for the work that follows from it, and would be one task.
FILES_A_TASK = 2_000


def written_files(spark: SparkSession, sf_dir: str, t: Template) -> DataFrame:
    """``(path, lang, content, size_bytes)``: a source file for each supplier, with 1 to 4 functions; every second one has the tail, C# always."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    k = supplier.repartition(supplier.count() // FILES_A_TASK + 1, "s_suppkey").select(E("cast(s_suppkey as string)").alias("k"), E("s_suppkey % 4 + 1").alias("n"), (E("true") if t is CSHARP else E("s_suppkey % 2 = 0")).alias("even"))
    each = E(f"array_join(transform(sequence(1, n), i -> {t.each}), '')")
    text = F.concat(E(t.head), each, F.when(F.col("even"), E(t.tail)).otherwise(""))
    return k.select(E(t.path).alias("path"), F.lit(t.lang).alias("lang"), text.cast("binary").alias("content"), F.length(text).cast("long").alias("size_bytes"))


def _parsed(t: Template):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from sparkweave.build import parse_files

        p = parse_files(written_files(spark, sf_dir, t))
        nodes = p.select("path", F.explode("nodes").alias("x")).select("path", F.concat(F.lit("node "), "x.node_type").alias("what"), F.col("x.qualified_name").alias("a"), F.coalesce("x.visibility", F.lit("")).alias("b"), F.col("x.line_start").alias("line"))
        refs = p.select("path", F.explode("refs").alias("x")).select("path", F.concat(F.lit("ref "), "x.edge_type"), "x.source_qname", "x.target_name", "x.line")
        imports = p.select("path", F.explode("imports").alias("x")).select("path", F.concat(F.lit("import "), "x.type"), "x.module", F.array_join("x.names", ","), "x.line")
        said = p.select("path", F.explode("said").alias("x")).select("path", "x.warn_type", F.lit(""), F.lit(""), "x.line")
        return nodes.union(refs).union(imports).union(said).withColumn("line", F.col("line").cast("int"))

    return run


def _parsed_sql(t: Template) -> str:
    row = lambda r: f"SELECT {t.path} AS path, {r[0]} AS what, {r[1]} AS a, {r[2]} AS b, CAST({r[3]} AS INTEGER) AS line"
    once = [row(r) + " FROM f" for r in t.rows] + [row(r) + " FROM f WHERE even" for r in t.of_even]
    each = [row(r) + " FROM e" for r in t.of_each]
    return "WITH f AS (SELECT s_suppkey AS k, s_suppkey % 4 + 1 AS n, s_suppkey % 2 = 0 AS even FROM supplier), e AS (SELECT k, unnest(range(1, n + 1)) AS i FROM f) " + " UNION ALL ".join(once + each)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that the default rules find in all the written files, bound to nodes by line."""
    from sparkweave.build import find_entries, parse_files, with_ids
    from sparkweave.config import DEFAULTS
    from sparkweave.sources.scan import test_column

    files = written_files(spark, sf_dir, TEMPLATES[0])
    for t in TEMPLATES[1:]:
        files = files.union(written_files(spark, sf_dir, t))
    about = files.select("path", "lang", "size_bytes", F.lit(0).cast("long").alias("mtime_ns"), F.sha2("content", 256).alias("hash"), test_column(F.col("path"), DEFAULTS["test_patterns"]).alias("is_test"))
    t = with_ids(written(parse_files(files).join(about, "path"), "parsed"))  # each file is parsed once
    found = find_entries(t, DEFAULTS).join(t.files.select("file_id", "path"), "file_id")
    names = t.nodes.select(F.col("id").alias("node_id"), "qualified_name")
    return found.join(names, "node_id", "left").select("path", "rule_name", F.coalesce("qualified_name", F.lit("")).alias("name"), "line", "no_propagate")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of a small tree, a file for each supplier: excluded, hidden and test folders, names with an underscore, unknown extensions and files that are too large."""
    import os

    from sparkweave.config import DEFAULTS
    from sparkweave.session import shared_folder
    from sparkweave.sources import scan

    root = f"{shared_folder(spark).removeprefix('file://').removeprefix('file:')}/tree-{uuid.uuid4().hex}"
    folders = ("pkg/_impl", "node_modules/x", ".hidden", "a.egg-info", "tests", "src", "build", "_lib")
    for (k,) in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").collect():  # a table of the tests
        name = ("." if k % 11 == 0 else "") + ("_" if k % 3 == 0 else "") + f"m{k}" + (".py", ".PY", ".txt", ".rs", ".ts")[k % 5]
        path = os.path.join(root, folders[k % 8], name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(f"x = {k}\n" * (k % 13 + 1))
    config = DEFAULTS | {"performance": {"max_file_size_mb": 80 / 1048576}}
    found = scan.scan(spark, root, config)
    return found.select("path", "lang", F.col("size_bytes").cast("long").alias("size"), F.when(F.col("content").isNull(), "large").otherwise(F.col("hash")).alias("hash"), "is_test")


def _globbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of files against glob rules, with their alternatives."""
    files = project(spark, sf_dir).files.withColumn("has_nodes", F.lit(True))
    own = [
        {"name": "one", "file_pattern": "A*/*.py", "ast_pattern": "function_def:Customer#*[05]"}, {"name": "two", "file_pattern": "**/*[!A].py", "ast_pattern": "function_def:*7 | function_def:*8"}, {"name": "off", "file_pattern": "**/*.py", "ast_pattern": "function_def:*", "enabled": False},
        {"name": "file", "file_pattern": "**/*.py", "ast_pattern": "file_match:*/?ND*.py", "no_propagate": True},
    ]
    nodes = project(spark, sf_dir).nodes
    marks = nodes.select("file_id", F.lit("def").alias("kind"), "name", F.col("line_start").alias("line"), F.lit(0).cast("long").alias("node_id")).union(files.select("file_id", F.lit("file"), "path", F.lit(1), F.lit(0).cast("long")))
    return rules.detect(marks, files, rules.compile_rules(spark, own)).select("file_id", "rule_name", "line", "no_propagate")


QUERIES = {
    "modules_components": _members, "modules_circular_ref": _circular, "static_filter": _foreign_static, "resolve_same_file": _same_file, "bind_sources": _bound, "merge_partials": _merged, "rule_globs": _globbed, "rule_entries": _entries, "scan_tree": _tree,
    "modules_alive": lambda s, d: (lambda g: analyze.entry_reach(g.nodes, g.edges, g.entries)[0].select("id").distinct())(project_more(s, d)),
    "modules_adjacency": lambda s, d: (lambda g: analyze.adjacency(g.nodes, g.edges))(project_more(s, d)),
    "modules_scc": lambda s, d: (lambda g: warn.cycles(g.nodes, g.edges))(project_more(s, d)),
    "modules_unused": lambda s, d: (lambda g: warn.unused_variables(g.nodes, g.edges).select("id", "name"))(project_more(s, d)),
    "modules_write_only": lambda s, d: (lambda g: warn.write_only(g.nodes, g.edges).select("id", "name"))(project_more(s, d)),
} | {f"parse_{t.lang}": _parsed(t) for t in TEMPLATES}

_MORE = lambda *names, tail: with_ctes(*names, tail=tail, ctes=MORE)
ORACLES = {
    "modules_components": _MORE(*_BASE, tail=_SPLIT + " SELECT id, component, is_dead FROM members"),
    "modules_alive": _MORE(*_BASE, tail=_ALIVE + " SELECT id FROM alive"),
    "modules_adjacency": _MORE("g_adj", "g_public", tail=" SELECT s AS u, t AS v FROM g_adj WHERE s < t"),
    "modules_scc": _MORE("g_edges", tail=_RINGS + " SELECT id, component FROM ring"),
    "modules_circular_ref": _MORE("g_nodes", "g_edges", tail=_RINGS + " SELECT max(id) AS node_id, arg_max(file_id, id) AS file_id, arg_max(line_start, id) AS line, 'Circular dependency: ' || string_agg(name, ' → ' ORDER BY id DESC) AS message FROM ring JOIN g_nodes USING (id) GROUP BY component"),
    "modules_unused": _MORE("g_nodes", "g_edges", tail=f" SELECT id, name FROM g_nodes WHERE {_JUDGED} AND id NOT IN (SELECT t FROM {_INTO})"),
    "modules_write_only": _MORE("g_nodes", "g_edges", tail=f" SELECT id, name FROM g_nodes WHERE {_JUDGED} AND id IN (SELECT t FROM {_INTO} WHERE edge_type = 'write') AND id NOT IN (SELECT t FROM {_INTO} WHERE edge_type = 'read')"),
    "static_filter": with_ctes(
        "g_nodes",
        tail=f""", {_INCLUDES}, inc AS (SELECT a, b FROM g_inc UNION SELECT inc.a, g_inc.b FROM inc JOIN g_inc ON inc.b = g_inc.a),
r AS (SELECT o_orderkey AS ref_id, CAST(o_custkey % 25 + 1 AS BIGINT) AS f, (o_orderkey * 7919 + o_custkey * 104729) % (SELECT count(*) FROM customer) + 1 AS target_id, o_orderkey % 2 = 0 AS c FROM orders WHERE o_orderkey % 5 = 0)
SELECT ref_id, target_id FROM r JOIN g_nodes n ON n.id = target_id WHERE NOT (c AND (target_id - 1) % 4 = 0 AND n.file_id <> f AND (f, n.file_id) NOT IN (SELECT (a, b) FROM inc))""",
    ),
    "resolve_same_file": with_ctes("g_nodes", tail=" SELECT r.id AS ref_id, n.id AS target_id, 4 AS tier FROM g_nodes r JOIN g_nodes n ON n.file_id = r.file_id AND n.name = r.name WHERE r.id % 6 = 0"),
    "bind_sources": with_ctes(
        "g_nodes",
        tail=""", r AS (SELECT id AS ref_id, file_id, CASE id % 4 WHEN 0 THEN 'm' || file_id WHEN 1 THEN qualified_name || '.x' ELSE qualified_name END AS q, id % 3 AS how FROM g_nodes)
SELECT ref_id, CAST(coalesce(max(CASE WHEN node_type = 'function' THEN n.id END), min(n.id), 0) AS BIGINT) AS source_id FROM r LEFT JOIN g_nodes n ON n.file_id = r.file_id AND n.qualified_name = q GROUP BY ref_id, r.file_id, q, how
HAVING count(n.id) > 0 OR (q = 'm' || r.file_id AND how < 2)""",
    ),
    "merge_partials": with_ctes(
        "g_nodes",
        tail=""", c AS (SELECT *, 'T' || ((id - 1) // 10 % 40) AS canonical FROM g_nodes WHERE node_type = 'class'), o AS (SELECT canonical, 'd' || (id % 3) AS d, min(id) AS f FROM c GROUP BY ALL)
SELECT min(id) + (SELECT max(id) FROM c) AS id, c.canonical AS name, count(*) AS fragments, min(line_start) AS line_start, max(line_start) + 5 AS line_end, (SELECT string_agg(d, ',' ORDER BY f) FROM o WHERE o.canonical = c.canonical) AS decorators FROM c GROUP BY c.canonical""",
    ),
    "rule_globs": with_ctes(
        "g_files", "g_nodes",
        tail=""" SELECT DISTINCT file_id, 'one' AS rule_name, line_start AS line, false AS no_propagate FROM g_nodes JOIN g_files USING (file_id) WHERE path GLOB 'A*/*.py' AND name GLOB 'Customer#*[05]'
UNION ALL SELECT DISTINCT file_id, 'two', line_start, false FROM g_nodes JOIN g_files USING (file_id) WHERE regexp_full_match(path, '.*[^A]\\.py') AND (name GLOB '*7' OR name GLOB '*8')
UNION ALL SELECT file_id, 'file', 1, true FROM g_files WHERE regexp_full_match(path, '.*/.ND.*\\.py')""",
    ),
    "rule_entries": """WITH f AS (SELECT s_suppkey AS k, s_suppkey % 4 + 1 AS n FROM supplier WHERE s_suppkey % 2 = 0)
SELECT 'pkg/f' || k || '.py' AS path, 'python_main' AS rule_name, '' AS name, CAST(10 + 3 * n AS INTEGER) AS line, false AS no_propagate FROM f
UNION ALL SELECT 'src/f' || k || '.c', 'c_main', 'src.f' || k || '.main', CAST(7 + 4 * n AS INTEGER), false FROM f UNION ALL SELECT 'src/f' || k || '.rs', 'rust_main', 'crate::f' || k || '::main', CAST(7 + 4 * n AS INTEGER), false FROM f""",
    "scan_tree": """WITH f AS (SELECT s_suppkey AS k, ['pkg/_impl', 'node_modules/x', '.hidden', 'a.egg-info', 'tests', 'src', 'build', '_lib'][s_suppkey % 8 + 1] AS folder, ['.py', '.PY', '.txt', '.rs', '.ts'][s_suppkey % 5 + 1] AS ext, repeat('x = ' || s_suppkey || chr(10), CAST(s_suppkey % 13 + 1 AS INTEGER)) AS text FROM supplier)
SELECT folder || '/' || CASE WHEN k % 3 = 0 THEN '_' ELSE '' END || 'm' || k || ext AS path, CASE lower(ext) WHEN '.py' THEN 'python' WHEN '.rs' THEN 'rust' ELSE 'typescript' END AS lang, CAST(length(text) AS BIGINT) AS size,
 CASE WHEN length(text) > 80 THEN 'large' ELSE sha256(text) END AS hash, folder = 'tests' AS is_test FROM f WHERE ext <> '.txt' AND k % 11 <> 0 AND k % 8 IN (0, 4, 5, 7)""",
} | {f"parse_{t.lang}": _parsed_sql(t) for t in TEMPLATES}
