"""Command line: ``query``, ``build`` and ``config``. Exit code 0: done, 1: --fail-on found something, 2: an error."""

from __future__ import annotations

import json
import sys
from argparse import ArgumentParser
from typing import Any

from sparkweave import schema as S
from sparkweave.api import ACTIONS, build, configure, query
from sparkweave.config import WeaveError
from sparkweave.operators.stats import SORTS

_FLAG = {"action": "store_true"}
QUERY: list[tuple[str, dict[str, Any]]] = [
    ("--include-tests", _FLAG), ("--exclude-clean", _FLAG), ("--exclude-unreachable", _FLAG), ("--dead-code-tests", _FLAG), ("--graph-id", {"type": int}), ("--path-format", {"choices": ["absolute", "relative"], "default": "relative"}),
    ("--max-results", {"type": int, "default": 50}), ("--min-nodes", {"type": int, "default": 0}), ("--max-nodes", {"type": int}), ("--warn-types", {}), ("--sort-by", {"choices": sorted(SORTS), "default": "warnings"}),
    ("--detail-level", {"choices": "auto full minimal summary".split(), "default": "auto"}), ("--output-limit", {"type": int, "default": 8000}), ("--edge-limit", {"type": int, "default": 10}), ("--file-limit", {"type": int, "default": 10}),
    ("--node-limit", {"type": int, "default": 30}), ("--no-scan", _FLAG),
]


def parser() -> ArgumentParser:
    p = ArgumentParser(prog="sparkweave", description="Dependency graphs of source code")
    sub = p.add_subparsers(dest="command", required=True)
    shared = ArgumentParser(add_help=False)
    shared.add_argument("--root-dir", default=".")
    shared.add_argument("--lang", default="system")
    q = sub.add_parser("query", parents=[shared], help="list graphs or show one")
    for name, how in QUERY:
        q.add_argument(name, **how)
    q.add_argument("--json", dest="json_output", **_FLAG)
    q.add_argument("--public-as-entry", **_FLAG)
    q.add_argument("--fail-on", help=f"comma-separated warning kinds of {', '.join(S.WARN_TYPES)}")
    b = sub.add_parser("build", parents=[shared], help="build the index or bring it up to date")
    b.add_argument("--force", dest="force_rebuild", **_FLAG)
    b.add_argument("--parallel", type=int, default=0)
    b.add_argument("--public-as-entry", **_FLAG)
    c = sub.add_parser("config", parents=[shared], help="read or change the configuration")
    c.add_argument("action", choices=ACTIONS)
    for name in ("--key", "--value", "--rule-json", "--exclude-pattern"):
        c.add_argument(name)
    c.add_argument("--from", dest="source")
    c.add_argument("--name", dest="rule_name")
    return p


def failing(result: dict[str, Any], kinds: set[str]) -> bool:
    """Whether a JSON result has a warning of these kinds: of the whole index for a list, of the graph for a detail; dead graphs count as dead code."""
    if "graph" in result:
        return any(w["warn_type"] in kinds for w in result["graph"]["warnings"])
    r = result.get("result", {})
    return any(r.get("warnings_summary", {}).get(k) for k in kinds) or ("dead_code" in kinds and any(g["is_dead_code"] for g in r.get("graphs", [])))


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    try:
        if command == "config":
            out = configure(**(args | {"lang": args["lang"] if args["lang"] != "system" else None}))
            print(json.dumps(out, indent=2, ensure_ascii=False))
            return 0 if out["status"] == "ok" else 2
        if command == "build":
            print(json.dumps(build(**args), indent=2))
            return 0
        kinds = {k.strip() for k in (args.pop("fail_on") or "").split(",") if k.strip()}
        out = query(**args)
        print(json.dumps(out, indent=2, ensure_ascii=False) if isinstance(out, dict) else out)
        if isinstance(out, dict) and out.get("status") == "error":
            return 2
        if kinds:
            found = out if isinstance(out, dict) else query(**(args | {"json_output": True, "no_scan": True}))
            return int(failing(found, kinds))
        return 0
    except WeaveError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
