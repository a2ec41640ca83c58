"""Entry rules: a rule's patterns compiled to rows, joined to what the parsers saw.

A parser reports marks ``(file_id, kind, name, line, node_id)``: calls, definitions, decorators, ``if __name__`` blocks and so on, node 0
where the rule's entry is found by line. A rule is ``{name, file_pattern, ast_pattern, enabled, description, no_propagate}`` and its pattern a list of
``prefix:glob`` alternatives, so that detection is one join of marks with a small table of compiled alternatives.
"""

from __future__ import annotations

import fnmatch


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.graph import loops

#: Rules to broadcast at most; a longer list is joined without the hint.
BROADCAST_RULES = 10_000
#: Alternatives whose patterns become literals of one expression; longer lists are joined.
LITERAL_RULES = 200

#: Kinds of marks that a prefix looks at, by language; "" stands for languages that are not named.
KINDS = {
    "function_call": {"": "call"}, "class_instantiation": {"": "call", "typescript": "new"}, "function_def": {"": "def"}, "decorator": {"": "decorator"}, "class_definition": {"": "type"}, "if_name_main": {"": "if_name_main"},
    "file_is_program": {"": "program"}, "visibility": {"": "visible"}, "trait_impl": {"": "trait_impl"}, "macro_def": {"": "macro"}, "jsx_element": {"": "jsx"}, "export": {"": "export"},
}


def glob(pattern: str) -> str:
    """A Java regular expression that matches what ``fnmatch`` does: ``*`` crosses ``/``, and case counts."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = k + (pattern[k : k + 1] == "!")
            end = pattern.find("]", end + (pattern[end : end + 1] == "]"))
            if end < 0:
                out += "\\["
            else:
                inner = pattern[k:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
                out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]"
                k = end + 1
        else:
            out += "\\" + c if not c.isalnum() and c != "_" and c < "\x80" else c
    return f"(?s)\\A{out}\\z"


def file_glob(pattern: str) -> str:
    """As :func:`glob`; a leading ``**/`` may also match nothing."""
    return glob(pattern) + ("|" + glob(pattern[3:]) if pattern.startswith("**/") else "")


def any_glob(patterns: list[str]) -> str:
    return "|".join(map(glob, patterns)) or "(?!)"


def matches(name: str, patterns: list[str]) -> bool:
    return any(fnmatch.fnmatchcase(name, p) for p in patterns)


def compile_rules(spark: SparkSession, rules: list[dict], lang: str | None = None) -> DataFrame:
    """``(rule_no, rule_name, file_regex, kind, name_regex, description, no_propagate)`` of the enabled rules' alternatives.

    ``file_match`` in a rule for Python takes the whole rest as one glob; elsewhere ``|`` separates alternatives there too.
    """
    rows = []
    for k, r in enumerate(rules):
        pattern, name = r.get("ast_pattern") or "", r.get("name") or ""
        if not pattern or not name or not r.get("enabled", True):
            continue
        file_pattern = r.get("file_pattern") or "**/*.py"
        python = file_pattern.endswith(".py")
        parts = [pattern] if python and pattern.startswith("file_match:") else list(map(str.strip, pattern.split(" | ")))
        for p in parts:
            prefix, _, rest = p.partition(":")
            kind = "file" if prefix == "file_match" else "test" if prefix == "test_file" else KINDS.get(prefix, {}).get("", "")
            still = bool(r.get("no_propagate", prefix == "test_file"))
            if kind:
                rows.append((k, name, file_glob(file_pattern), kind, (file_glob if not python else glob)(rest) if kind == "file" else glob(rest or "*"), r.get("description") or pattern, still))
    return spark.createDataFrame(rows or [], "rule_no int, rule_name string, file_regex string, kind string, name_regex string, description string, no_propagate boolean")


def detect(marks: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries of the files that have a node (``files.has_nodes``), one per rule and mark; whole files have line 1, or 0 for tests.

    ``marks`` holds a mark of kind ``file`` with the path as name, and one of kind ``test`` for each test file with a test in it.
    """
    rows = rules.limit(LITERAL_RULES + 1).collect()
    at = marks.join(files.where("has_nodes").select("file_id", "path"), "file_id")
    if len(rows) <= LITERAL_RULES:
        # Patterns are literals, which are compiled once; those of paths are tried once a file, those of names by kind.
        spark = rules.sparkSession
        alternatives = spark.createDataFrame([(k, r["rule_name"], r["description"], r["no_propagate"]) for k, r in enumerate(rows)], "alternative int, rule_name string, description string, no_propagate boolean")
        groups: dict[str, list[int]] = {}
        for k, r in enumerate(rows):
            groups.setdefault(r["file_regex"], []).append(k)
        fits = [F.when(F.col("path").rlike(regex), F.array(*map(F.lit, ks))).otherwise(F.array().cast("array<int>")) for regex, ks in groups.items()]
        near = files.where("has_nodes").select("file_id", F.flatten(F.array(*fits) if fits else F.array(F.array().cast("array<int>"))).alias("_fits"))
        named = [F.when((F.col("kind") == r["kind"]) & F.col("name").rlike(r["name_regex"]), F.lit(k)) for k, r in enumerate(rows)]
        hits = F.array_compact(F.array(*named) if named else F.array().cast("array<int>"))
        hit = at.join(near, "file_id").withColumn("alternative", F.explode(F.array_intersect(hits, F.col("_fits")))).join(F.broadcast(alternatives), "alternative")  # at most LITERAL_RULES rows
    else:
        n = rules.count()
        small = F.broadcast(rules) if n <= BROADCAST_RULES else rules
        at = at.withColumnRenamed("kind", "_kind")
        hit = at.join(small, (F.col("_kind") == F.col("kind")) & F.expr("path rlike file_regex") & F.expr("name rlike name_regex"))
    line = F.when(F.col("kind") == "file", 1).when(F.col("kind") == "test", 0).otherwise(F.col("line")).cast("int")
    return hit.select("file_id", "node_id", "rule_name", line.alias("line"), "description", "no_propagate").distinct()


def bind_entries(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries without a node whose line is that of a node get the first such node of the file; other entries stay as they are."""
    first = nodes.groupBy("file_id", F.col("line_start").alias("line")).agg(F.min("id").alias("_first"))
    at = entries.join(first, ["file_id", "line"], "left")
    node = F.when((F.col("node_id") == 0) & (F.col("line") > 0), F.coalesce("_first", F.lit(0).cast("long"))).otherwise(F.col("node_id"))
    return at.withColumn("node_id", node).drop("_first").select(*entries.columns)


def whole_chain(nodes: DataFrame, condition: Column) -> DataFrame:
    """Nodes that meet the condition together with all their owners."""
    held = nodes.withColumn("_ok", F.coalesce(condition, F.lit(False)))
    below = held.where("parent <> 0").select(F.col("parent").alias("u"), F.col("id").alias("v"))
    spoilt = loops.reach(held.where("not _ok").select("id"), below)
    return nodes.join(spoilt, "id", "left_anti")


def program_entries(nodes: DataFrame, entries: DataFrame, mode: str = "auto") -> DataFrame:
    """C library mode: entries for functions and variables of ``.c`` files with external linkage; ``auto``: only if no entry propagates. ``nodes`` has ``path``."""
    outer = nodes.where(F.col("path").endswith(".c") & F.col("node_type").isin("function", "variable") & (F.coalesce("visibility", F.lit("")) != "static") & (F.col("parent") == 0))
    found = outer.select("file_id", F.col("id").alias("node_id"), F.lit("c_library").alias("rule_name"), F.col("line_start").cast("int").alias("line"), F.lit("external linkage").alias("description"), F.lit(False).alias("no_propagate"))
    if mode == "off":
        return found.limit(0)
    if mode == "on":
        return found
    programs = entries.where("not no_propagate").agg(F.count(F.lit(1)).alias("_n"))
    return found.crossJoin(programs).where("_n = 0").drop("_n")


