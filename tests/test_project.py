"""Source trees to indexes: the golden project, small probes, and incremental builds that equal full ones."""

import json
import os
from pathlib import Path

import pytest

from sparkweave import api
from sparkweave.config import META, Config, InvalidParamError, InvalidPathError
from sparkweave.sources.index import Index

GOLDEN = {
    "main.py": 'import os\nfrom utils import used_func\n\ndef main():\n    print(used_func())\n\ndef not_called():\n    pass\n\nif __name__ == "__main__":\n    main()\n',
    "utils.py": 'def used_func():\n    return "used"\n\ndef unused_func():\n    return "dead code"\n',
    "cyc.py": "import json, re\nLIMIT = 3\nclass Base:\n    shared = 1\n    def __init__(self):\n        self.a = 0\n        self.b = 1\n    def run(self):\n        return self.a\nclass Child(Base):\n    def ping(self):\n        return pong()\ndef pong():\n    return ping2()\ndef ping2():\n    return pong()\ndef rec(n):\n    return rec(n - 1)\n",
    "tests/test_utils.py": "from utils import unused_func\ndef test_it():\n    assert unused_func()\n",
}


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_bytes(text if isinstance(text, bytes) else text.encode())


def index(spark, root):
    return Index(spark, f"file:{os.path.realpath(root)}/{META}/index")


def graphs(spark, root):
    """``{members by name: (live, nodes, variables, edges, warnings)}``."""
    ix = index(spark, root)
    names = {r["id"]: r["qualified_name"] for r in ix.read("nodes").collect()}
    return {frozenset(names[i] for i in r["root_node_ids"]): (not r["is_dead_code"], r["node_count"], r["variable_count"], r["edge_count"], r["warning_count"]) for r in ix.read("snapshots").collect()}


def warnings(spark, root):
    ix = index(spark, root)
    names = {r["id"]: r["qualified_name"] for r in ix.read("nodes").collect()}
    paths = {r["file_id"]: r["path"] for r in ix.read("files").collect()}
    return sorted((r["warn_type"], names.get(r["node_id"]) or f"{paths.get(r['file_id'])}:{r['line']}") for r in ix.read("warnings").collect())


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("golden"))
    write(root, GOLDEN)
    return root, api.build(root_dir=root, spark=spark)


def test_golden_build(spark, golden):
    root, result = golden
    assert (result["files_scanned"], result["files_added"], result["nodes_added"], result["edges_updated"], result["warnings_generated"]) == (4, 4, 17, 29, 14)
    assert graphs(spark, root) == {
        frozenset({"main.main", "utils.used_func"}): (True, 2, 0, 6, 0),
        frozenset({"main.not_called"}): (True, 1, 0, 1, 0),
        frozenset({"cyc.LIMIT"}): (False, 0, 1, 1, 1),
        frozenset({"cyc.Base", "cyc.Base.shared", "cyc.Base.__init__", "cyc.Base.a", "cyc.Base.b", "cyc.Base.run", "cyc.Child"}): (False, 4, 3, 8, 5),
        frozenset({"cyc.Child.ping", "cyc.pong", "cyc.ping2"}): (False, 3, 0, 8, 4),
        frozenset({"cyc.rec"}): (False, 1, 0, 1, 1),
        frozenset({"tests.test_utils.test_it"}): (True, 1, 0, 3, 0),
        frozenset({"utils.unused_func"}): (False, 1, 0, 3, 1),
    }


def test_golden_warnings(spark, golden):
    root, _ = golden
    assert warnings(spark, root) == sorted(
        [("unused_import", "main.py:1"), ("unused_import", "cyc.py:1"), ("write_only", "cyc.Base.shared"), ("write_only", "cyc.Base.b"), ("circular_ref", "cyc.ping2")]
        + [("dead_code", f"cyc.{n}") for n in ("LIMIT", "Base", "Base.shared", "Base.a", "Child.ping", "pong", "ping2", "rec")]
        + [("dead_code", "utils.unused_func")]
    )


def shown(root, spark, **how):
    out = api.query(root_dir=root, json_output=True, no_scan=True, spark=spark, **how)["result"]
    ix = index(spark, root)
    names = {r["id"]: r["qualified_name"].split(".")[-1] for r in ix.read("nodes").collect()}
    first = {r["graph_id"]: names[min(r["root_node_ids"])] for r in ix.read("snapshots").collect()}
    return [first[g["graph_id"]] for g in out["graphs"]], out


def test_golden_queries(spark, golden):
    root, _ = golden
    order, out = shown(root, spark)
    assert "test_it" not in order and order[:2] == ["Base", "ping"] and len(order) == 7
    assert out["warnings_summary"] == {"circular_ref": 1, "dead_code": 9, "unused_import": 2, "write_only": 2}
    assert out["skipped_clean"] == 2 and not out["has_more"] and out["total_graphs"] == 7
    assert set(shown(root, spark, warn_types="dead_code")[0]) == {"Base", "ping", "unused_func", "rec", "LIMIT"}
    assert shown(root, spark, warn_types="circular_ref")[0] == ["ping"]
    assert shown(root, spark, warn_types="dead_code,circular_ref")[0] == ["ping"]
    assert shown(root, spark, warn_types="unused_import")[0] == []
    assert len(shown(root, spark, exclude_unreachable=True)[0]) == 2
    assert set(shown(root, spark, min_nodes=2)[0]) == {"Base", "ping", "main"}
    order, out = shown(root, spark, max_results=1)
    assert order == ["Base"] and out["has_more"]
    assert len(shown(root, spark, include_tests=True)[0]) == 8
    tests = api.query(root_dir=root, json_output=True, no_scan=True, dead_code_tests=True, spark=spark)["dead_code_tests"]
    assert [(t["test_file"], t["line"], t["referenced_symbol"]) for t in tests] == [("tests/test_utils.py", 3, "utils.unused_func")] * 2


def test_detail_and_text(spark, golden):
    root, _ = golden
    listing = api.query(root_dir=root, json_output=True, no_scan=True, spark=spark)["result"]["graphs"]
    base = listing[0]["graph_id"]
    d = api.query(root_dir=root, graph_id=base, json_output=True, no_scan=True, node_limit=2, edge_limit=1, spark=spark)["graph"]
    assert [n["name"] for n in d["nodes"]] == ["Base", "shared"] and d["nodes_omitted"] == 5 and d["files"] == ["cyc.py"] and d["edges_omitted"] == 5
    assert {w["warn_type"] for w in d["warnings"]} >= {"dead_code", "write_only", "unused_import"}
    text = api.query(root_dir=root, graph_id=base, no_scan=True, lang="en", spark=spark)
    assert "Graph" in text and "cyc.py:3" in text
    full = api.query(root_dir=root, no_scan=True, lang="en", path_format="absolute", spark=spark)
    assert os.path.realpath(root) in full and "dead code" in full and "circular_ref: 1" in full
    assert "死代码" in api.query(root_dir=root, no_scan=True, lang="zh_CN", spark=spark)
    assert "index only" in api.query(root_dir=root, no_scan=True, lang="en", detail_level="summary", spark=spark)
    assert api.query(root_dir=root, graph_id=999_999, json_output=True, no_scan=True, spark=spark)["status"] == "error"


def test_stale_files_are_noticed(spark, tmp_path):
    root = str(tmp_path)
    write(root, {"a.py": "def f():\n    pass\n"})
    api.build(root_dir=root, spark=spark)
    g = api.query(root_dir=root, json_output=True, no_scan=True, spark=spark)["result"]["graphs"][0]["graph_id"]
    assert api.query(root_dir=root, graph_id=g, json_output=True, no_scan=True, spark=spark)["status"] == "ok"
    os.utime(f"{root}/a.py", (1, 1))
    assert api.query(root_dir=root, graph_id=g, json_output=True, no_scan=True, spark=spark)["status"] == "error"


PROBES = [
    ({"lib.py": "def used():\n    pass\ndef dead_caller():\n    used()\ndef other():\n    pass\ndef dead_reader():\n    x = other\n", "main.py": "from lib import used\nif __name__ == '__main__':\n    used()\n"}, None),
    ({"bad.py": "def (:\n"}, [("syntax_error", "bad.py:1")]),
    ({"pkg/__init__.py": "import os\n__version__ = '1'\ndef api():\n    pass\n"}, []),
    ({"pkg/v.py": "__all__ = ['x']\nx = 1\n"}, [("dead_code", "pkg.v.x")]),
    ({"k.py": "def f():\n    x = 1\n    y = 2\n    return y\nif __name__ == '__main__':\n    f()\n"}, [("write_only", "k.f.x")]),
    ({"p.py": "class P:\n    z: int = 3\n    def m(self):\n        self.z += 1\nif __name__ == '__main__':\n    P().m()\n"}, []),
]


@pytest.mark.parametrize("files,want", PROBES[1:])
def test_probes(spark, tmp_path, files, want):
    write(str(tmp_path), files)
    api.build(root_dir=str(tmp_path), spark=spark)
    assert warnings(spark, str(tmp_path)) == want


EDITS = [
    ({"main.py": "from lib import f\ndef go():\n    f()\nif __name__ == '__main__':\n    f()\n", "lib.py": "def f():\n    g()\ndef g():\n    pass\n"}, {"main.py": "def go():\n    pass\nif __name__ == '__main__':\n    pass\n"}, [("dead_code", "lib.f"), ("dead_code", "lib.g")]),
    ({"main.py": "def go():\n    newf()\nif __name__ == '__main__':\n    go()\n", "lib.py": "def f():\n    pass\n"}, {"lib.py": "def f():\n    pass\ndef newf():\n    pass\n"}, [("dead_code", "lib.f")]),
    ({"a.py": "def f():\n    g()\ndef g():\n    f()\n", "b.py": "x = 1\n"}, {"b.py": None, "c.py": "import os\n"}, [("circular_ref", "a.g"), ("dead_code", "a.f"), ("dead_code", "a.g"), ("unused_import", "c.py:1")]),
]


@pytest.mark.parametrize("start,edit,want", EDITS)
def test_incremental_equals_full(spark, tmp_path, start, edit, want):
    root = str(tmp_path)
    write(root, start)
    api.build(root_dir=root, spark=spark)
    for name, text in edit.items():
        if text is None:
            os.unlink(f"{root}/{name}")
    write(root, {k: v for k, v in edit.items() if v is not None})
    result = api.build(root_dir=root, spark=spark)
    assert result["files_changed"] + result["files_added"] + result["files_removed"] == len(edit)
    got = graphs(spark, root), warnings(spark, root)
    api.build(root_dir=root, force_rebuild=True, spark=spark)
    assert got == (graphs(spark, root), warnings(spark, root))
    assert got[1] == sorted(want)
    again = api.build(root_dir=root, spark=spark)
    assert again["nodes_added"] == 0 and again["files_changed"] == 0


def test_names_with_an_underscore_are_read(spark, tmp_path):
    root = str(tmp_path)
    write(root, {"__main__.py": "x = 1\n", "_impl/mod.py": "def f():\n    pass\n", "pkg/__init__.py": "import os\n__version__ = '1'\ndef api():\n    pass\n", "pkg/_private.py": "y = 1\n", "pkg/plain.py": "z = 1\n", "node_modules/no.py": "", "_build/yes.py": ""})
    api.build(root_dir=root, spark=spark)
    at = index(spark, root)
    assert {r["path"] for r in at.read("files").collect()} == {"__main__.py", "_impl/mod.py", "pkg/__init__.py", "pkg/_private.py", "pkg/plain.py", "_build/yes.py"}
    assert {r["qualified_name"] for r in at.read("nodes").collect()} >= {"pkg.__init__.api", "_impl.mod.f", "pkg._private.y"}
    assert at.read("entries").join(at.read("files"), "file_id").where("rule_name = 'python_package'").select("path").first()[0] == "pkg/__init__.py"


def test_index_survives_builds_side_by_side_and_deaths(spark, tmp_path):
    at = Index(spark, f"file:{tmp_path}/index")
    one = spark.range(3)
    first, second, dead = at.begin(), at.begin(), at.begin()
    at.write(first, "t", one)
    at.write(dead, "t", one)  # never committed: its build died, or goes on
    at.commit(first)
    assert at.read("t").count() == 3
    at.write(second, "t", spark.range(5))
    at.commit(second)
    assert at.read("t").count() == 5 and os.path.isdir(f"{tmp_path}/index/{first}") and os.path.isdir(f"{tmp_path}/index/{dead}")
    third = at.begin()
    at.write(third, "t", spark.range(7))
    at.commit(third)
    assert at.current()["version"] == third and not os.path.isdir(f"{tmp_path}/index/{first}") and os.path.isdir(f"{tmp_path}/index/{dead}")
    old = f"v-{'1' * 13}-x"
    at.write(old, "t", one)
    last = at.begin()
    at.write(last, "t", spark.range(1))
    at.commit(last)
    assert not os.path.isdir(f"{tmp_path}/index/{old}") and at.read("t").count() == 1


class Lines:
    """A language whose every line names a function."""

    EXTENSIONS, EXCLUDES, PUBLIC = (".lines",), ("skipped",), frozenset()

    def module_of(self, path):
        return path.removesuffix(".lines")

    def is_special(self, name):
        return False

    def parse(self, path, data):
        from sparkweave.parse import Parsed

        p = Parsed(module=self.module_of(path))
        for k, name in enumerate(data.decode().split(), 1):
            p.node("function", name, f"{p.module}.{name}", k, k)
        return p


def test_languages_of_ones_own(spark, tmp_path):
    from sparkweave import parse

    root = str(tmp_path)
    write(root, {"a.lines": "f g", "skipped/b.lines": "h", "c.py": "x = 1\n"})
    with pytest.raises(TypeError):
        parse.register("lines", object())
    parse.register("lines", Lines())
    try:
        api.build(root_dir=root, spark=spark)
        assert {r["qualified_name"] for r in index(spark, root).read("nodes").collect()} == {"a.f", "a.g", "c.x"}
    finally:
        parse.unregister("lines")


def test_configuration(tmp_path):
    root = str(tmp_path)
    assert api.configure("show", root_dir=root)["config"]["version"] == 1
    assert api.configure("set", key="performance.max_file_size_mb", value="3", root_dir=root)["status"] == "ok"
    assert api.configure("get", key="performance.max_file_size_mb", root_dir=root)["value"] == 3
    rule = {"ast_pattern": "function_def:serve_*", "name": "mine", "file_pattern": "**/*.py"}
    assert api.configure("add-entry-rule", rule_json=json.dumps(rule), root_dir=root)["status"] == "ok"
    assert api.configure("add-entry-rule", rule_json="{", root_dir=root)["status"] == "error"
    assert any(r["name"] == "mine" for r in Config(root).load()["entry_rules"])
    assert api.configure("remove-entry-rule", rule_name="mine", root_dir=root)["status"] == "ok"
    assert api.configure("remove-entry-rule", rule_name="mine", root_dir=root)["status"] == "error"
    assert api.configure("add-exclude", exclude_pattern="gen/", root_dir=root)["status"] == "ok"
    assert Config(root).load()["exclude_patterns"]["user_exclude"] == ["gen/"]
    assert api.configure("remove-exclude", exclude_pattern="gen/", root_dir=root)["status"] == "ok"
    assert api.configure("copy-from", source="/nowhere", root_dir=root)["status"] == "error"
    assert api.configure("get", root_dir=root)["status"] == "error" and api.configure("dance", root_dir=root)["status"] == "error"


def test_excluded_and_hidden_files(spark, tmp_path):
    root = str(tmp_path)
    write(root, {"a.py": "x = 1\n", "gen/b.py": "y = 1\n", "node_modules/c.py": "", ".hidden/d.py": "", ".e.py": "", "f.txt": "", "deep/x.egg-info/g.py": "", "Big.PY": "z = 1\n", "with space+plus%25.py": "w = 1\n"})
    api.configure("add-exclude", exclude_pattern="gen/", root_dir=root)
    api.build(root_dir=root, spark=spark)
    assert {r["path"] for r in index(spark, root).read("files").collect()} == {"a.py", "Big.PY", "with space+plus%25.py"}


def test_size_limit_and_latin(spark, tmp_path):
    root = str(tmp_path)
    write(root, {"big.py": "x = 1\n" * 300_000, "latin.py": "name = '\xe9'\n".encode("latin-1")})
    api.configure("set", key="performance.max_file_size_mb", value="1", root_dir=root)
    api.build(root_dir=root, spark=spark)
    got = warnings(spark, root)
    assert ("file_too_large", "big.py:0") in got and ("dead_code", "latin.name") in got


def test_extensions(spark, tmp_path):
    root = str(tmp_path)
    write(root, {"m.py": "def deprecated(f):\n    return f\n@deprecated\ndef old():\n    pass\ndef go():\n    old()\n    nothing_here()\n    __import__('os')\nif __name__ == '__main__':\n    go()\n"})
    api.build(root_dir=root, spark=spark)
    assert warnings(spark, root) == []
    api.build(root_dir=root, force_rebuild=True, extensions=True, spark=spark)
    assert {w for w, _ in warnings(spark, root)} == {"deprecated_usage", "unresolved_ref", "dynamic_import"}


@pytest.mark.parametrize("wrong", [{"graph_id": 0}, {"min_nodes": -1}, {"max_nodes": 0}, {"max_results": 0}, {"max_results": 1001}, {"output_limit": 99}, {"path_format": "odd"}, {"sort_by": "odd"}, {"warn_types": "odd"}])
def test_parameters_are_checked(tmp_path, wrong):
    with pytest.raises(InvalidParamError):
        api.query(root_dir=str(tmp_path), **wrong)
    with pytest.raises(InvalidPathError):
        api.query(root_dir="/no/such/folder")


def test_command_line(spark, golden, capsys):
    from sparkweave.cli import main

    root, _ = golden
    assert main(["query", "--root-dir", root, "--json", "--no-scan", "--warn-types", "circular_ref"]) == 0
    assert len(json.loads(capsys.readouterr().out)["result"]["graphs"]) == 1
    assert main(["query", "--root-dir", root, "--no-scan", "--fail-on", "circular_ref"]) == 1
    assert main(["query", "--root-dir", root, "--no-scan", "--fail-on", "file_too_large"]) == 0
    assert main(["query", "--root-dir", root, "--max-results", "0"]) == 2
    assert main(["config", "get", "--root-dir", root, "--key", "version"]) == 0
    assert main(["config", "get", "--root-dir", root]) == 2
