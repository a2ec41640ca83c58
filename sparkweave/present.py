"""Texts and JSON for people and tools; two languages."""

from __future__ import annotations

import os
from locale import getlocale
from typing import Any

MESSAGES = {
    "en": {
        "title": "Dependency graphs", "dir": "Directory", "total": "{count} graphs, {nodes} nodes, {edges} edges", "skipped_clean": "{count} graphs without warnings", "has_more": "There are more graphs; raise --max-results",
        "stats": "Warnings by kind:", "entry": "entry", "no_entry": "no entry", "dead": "dead code", "nodes": "nodes", "vars": "variables", "index": "(index only)", "skipped": "{count} graphs left out", "detail": "Graph {id}", "files": "Files",
        "counts": "{class} classes, {function} functions, {method} methods, {variable} variables, {field} fields", "nodes_title": "Nodes", "edges_title": "Edges", "warnings_title": "Warnings", "no_graph": "There is no graph {id}", "stale": "Files have changed since the index was built",
        "more": "  ... and {count} more {what}", "tests": "Test references to dead code ({count}):",
    },
    "zh_CN": {
        "title": "依赖图", "dir": "目录", "total": "{count} 个图，{nodes} 个节点，{edges} 条边", "skipped_clean": "{count} 个图没有警告", "has_more": "还有更多图，请增大 --max-results", "stats": "警告统计：", "entry": "入口", "no_entry": "无入口", "dead": "死代码",
        "nodes": "节点", "vars": "变量", "index": "（仅索引）", "skipped": "省略 {count} 个图", "detail": "图 {id}", "files": "文件", "counts": "{class} 个类，{function} 个函数，{method} 个方法，{variable} 个变量，{field} 个字段", "nodes_title": "节点", "edges_title": "边",
        "warnings_title": "警告", "no_graph": "不存在图 {id}", "stale": "索引建立后文件已更改", "more": "  …… 另有 {count} 个 {what}", "tests": "测试对死代码的引用（{count}）：",
    },
}


def language(name: str) -> str:
    """A message language; ``system`` follows the locale; an unknown one is English."""
    if name == "system":
        name = os.environ.get("LC_ALL") or os.environ.get("LANG") or (getlocale()[0] or "")
    return "zh_CN" if name.lower().replace("-", "_").startswith("zh") else "en"


class Text:
    def __init__(self, lang: str = "en") -> None:
        self.table = MESSAGES[language(lang)]

    def __call__(self, key: str, **values: Any) -> str:
        return self.table.get(key, key).format(**values)


def volume(graphs: list[dict], json_output: bool = False, detail_level: str = "auto", output_limit: int = 8000, low: int = 3000, high: int = 8000) -> tuple[str, int]:
    """``(mode, left out)``: full, index or truncated, by the length that the summaries would have."""
    if json_output or detail_level == "full":
        return "full", 0
    if detail_level in ("summary", "minimal"):
        return "index", len(graphs) if detail_level == "minimal" else 0
    costs = [80 + 15 * int(g.get("warning_count") or 0) + len(g.get("entry") or "") for g in sorted(graphs, key=lambda g: -int(g.get("warning_count") or 0))]
    total = sum(costs)
    if total <= min(output_limit, low):
        return "full", 0
    if total <= min(output_limit, high):
        return "index", 0
    used = kept = 0
    for c in costs:
        if used + c > output_limit:
            break
        used, kept = used + c, kept + 1
    return "truncated", len(graphs) - kept


class Formatter:
    def __init__(self, lang: str = "en", path_format: str = "relative", root: str = ".") -> None:
        self.t, self.path_format, self.root = Text(lang), path_format, os.path.realpath(root)

    def path(self, path: str | None) -> str:
        if not path:
            return ""
        return os.path.normpath(os.path.join(self.root, path)) if self.path_format == "absolute" else path

    def listing(self, r: dict[str, Any], mode: str, left_out: int) -> str:
        t, graphs = self.t, r["graphs"]
        lines = [t("title"), "", f"{t('dir')}: {self.root}"]
        if mode == "index":
            lines += [t("index"), ""]
            for g in graphs:
                mark = " ☠" if g["is_dead_code"] else ""
                lines.append(f"[{g['graph_id']:>3}] {g['entry'] or g['entry_file'] or t('no_entry')}{mark}    nodes:{g['node_count'] + g['variable_count']}  edges:{g['edge_count']}  ⚠{g['warning_count']}")
            return "\n".join(lines + [t("has_more")] * r["has_more"])
        lines += [t("total", count=r["total_graphs"], nodes=sum(g["node_count"] + g["variable_count"] for g in graphs), edges=sum(g["edge_count"] for g in graphs)), ""]
        for g in graphs:
            head = f"graph{g['graph_id']}: {t('entry') if g['entry_file'] else t('no_entry')} {self.path(g['entry_file'])}"
            head += f" line {g['entry_line']}" if g["entry_line"] else ""
            head += f" — {g['entry']}" if g["entry"] else ""
            lines += [head + (f" [{t('dead')}]" if g["is_dead_code"] else ""), f"  {t('nodes')}: {g['node_count']}, {t('vars')}: {g['variable_count']}", *([f"  ⚠ {', '.join(g['warnings'])}"] if g["warnings"] else []), ""]
        lines += [t("skipped_clean", count=r["skipped_clean"])] * (r["skipped_clean"] > 0) + [t("has_more")] * r["has_more"]
        lines += ["", t("stats"), *(f"  {k}: {n}" for k, n in sorted(r["warnings_summary"].items()) if n)]
        return "\n".join(lines + [t("skipped", count=left_out)] * (mode == "truncated" and left_out > 0))

    def detail(self, d: dict[str, Any]) -> str:
        t = self.t
        more = lambda what, n: [t("more", count=n, what=what)] if n else []
        lines = [t("detail", id=d["graph_id"]), "", f"{t('entry')} {d['entry']}", f"{t('files')}: {', '.join(d['files'])}", *more("files", d.get("files_omitted", 0))]
        lines += [t("counts", **{k: d["histogram"].get(k, 0) for k in ("class", "function", "method", "variable", "field")}), "", t("nodes_title") + ":"]
        lines += [f"  [N{n['node_id']:04d}] {n['node_type']} {n['name']}  {self.path(n['file_path'])}:{n['line_start']}" for n in d["nodes"]] + more("nodes", d.get("nodes_omitted", 0))
        lines += ["", t("edges_title") + ":", *(f"  [E] {e['source_name']} --[{e['edge_type']}]--> {e['target_name']}  {self.path(e['file_path'])}:{e['line']}" for e in d["edges"]), *more("edges", d.get("edges_omitted", 0))]
        lines += ["", t("warnings_title") + ":", *(f"  [{w['warn_type']}] {w['message']}  {self.path(w['file_path'])}:{w['line'] or ''}" for w in d["warnings"])]
        return "\n".join(lines)
