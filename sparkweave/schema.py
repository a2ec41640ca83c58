"""Column sets of the engine's tables and the value domains they use."""

from __future__ import annotations

FILES = "file_id long, path string, hash string, size_bytes long, mtime_ns long, lang string, is_test boolean, parse_status string, parse_error string"
NODES = (
    "id long, file_id long, name string, qualified_name string, node_type string, line_start int, line_end int, col_offset int, parent long, is_deprecated boolean, deprecation_msg string, "
    "type_annotation string, is_async boolean, decorators array<string>, docstring string, is_partial boolean, canonical_name string, visibility string, is_special boolean, is_public boolean"
)
REFS = "file_id long, source_qname string, target_name string, edge_type string, line int, context string"
EDGES = "source_id long, target_id long, edge_type string, file_id long, line int"
IMPORTS = "file_id long, import_line int, module_path string, imported_names array<string>, import_type string, is_used boolean"
ENTRIES = "file_id long, node_id long, rule_name string, line int, description string, no_propagate boolean"
WARNINGS = "file_id long, node_id long, warn_type string, severity string, message string, line int, details map<string,string>"
SNAPSHOTS = (
    "graph_id long, entry_file string, entry_line int, entry_type string, node_count long, variable_count long, edge_count long, warning_count long, "
    "is_dead_code boolean, is_unreachable boolean, root_node_ids array<long>, component_hash string"
)
MEMBERS = "component_id long, node_id long"

#: A read of one of these is a use, like a call.
PROMOTED = tuple("class delegate enum enum_member event function indexer macro method property record struct type union".split())
#: Kinds that a genuine module-level use keeps alive in a live file.
MODULE_KINDS = ("enum", "macro", "struct", "type", "union")
VARIABLES = ("variable", "field")
WARN_TYPES = ("unused_import", "circular_ref", "syntax_error", "write_only", "dead_code", "unused_variable", "file_too_large", "dynamic_import", "deprecated_usage", "type_mismatch", "unresolved_ref")
SEVERITIES = ("error", "warning", "info")
EDGE_TYPES = ("read", "write", "call", "inherit", "decorate", "part_of", "jsx_element")
