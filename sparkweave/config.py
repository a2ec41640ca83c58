"""Configuration of a code base: defaults, and the JSON file that overrides them."""

from __future__ import annotations

import contextlib
import copy
import json
import os
import tempfile
from typing import Any

from sparkweave.sources import storage

META = ".sparkweave"
Settings = dict[str, Any]


class WeaveError(Exception):
    """Any error of this library's interface."""


class ConfigNotFoundError(WeaveError):
    def __init__(self, path: str) -> None:
        super().__init__(f"There is no configuration in {path}")
        self.path = path


class InvalidPathError(WeaveError):
    def __init__(self, path: str, why: str) -> None:
        super().__init__(f"{path}: {why}")
        self.path, self.reason = path, why


class InvalidParamError(WeaveError):
    def __init__(self, param: str, value: str, why: str) -> None:
        super().__init__(f"{param}={value}: {why}")
        self.param, self.value, self.reason = param, value, why


def _rule(name: str, files: str, pattern: str, about: str, enabled: bool = True, **more: Any) -> dict[str, Any]:
    return {"name": name, "file_pattern": files, "ast_pattern": pattern, "enabled": enabled, "description": about, **more}


def _any(prefix: str, names: str) -> str:
    return " | ".join(f"{prefix}:{n}" for n in names.split())


_TS = "**/*.*[tjs][sx]"
_INDEX = " ".join(f"index.{x} */index.{x}" for x in "ts js tsx jsx mts cts mjs cjs".split())
_TESTS = {"no_propagate": True}
RULES = [
    _rule("python_main", "**/*.py", "if_name_main", "Python module run as a program"),
    _rule("python_package", "**/__init__.py", "file_match:**/__init__.py", "Python package interface"),
    _rule("fastapi_app", "**/*.py", "class_instantiation:FastAPI | function_call:uvicorn.run", "FastAPI application"),
    _rule("flask_app", "**/*.py", _any("class_instantiation", "Flask flask.Flask") + " | function_call:*.run", "Flask application"),
    _rule("django_manage", "**/manage.py", "function_call:execute_from_command_line", "Django management script"),
    _rule("click_command", "**/*.py", _any("decorator", "click.command click.group"), "Click command"),
    _rule("typer_app", "**/*.py", "class_instantiation:typer.Typer | decorator:*.command", "Typer command"),
    _rule("celery_app", "**/*.py", _any("class_instantiation", "Celery celery.Celery"), "Celery application"),
    _rule("pytest_plugin", "**/conftest.py", "function_def:pytest_addoption | decorator:pytest.fixture", "pytest plugin"),
    _rule("pytest_test", "**/*.py", "test_file", "pytest tests", **_TESTS),
    _rule("rust_default_bin_path", "**/*.rs", _any("file_match", "src/main.rs src/bin/*.rs"), "Rust binary by its path"),
    _rule("rust_main", "**/*.rs", "function_def:main", "Rust main function"),
    _rule("rust_async_main", "**/*.rs", _any("decorator", "tokio::main actix_rt::main actix_web::main async_std::main rocket::main rocket::launch main"), "Rust main function of an asynchronous runtime"),
    _rule("rust_wasm_entry", "**/*.rs", "decorator:wasm_bindgen", "Rust export to WebAssembly"),
    _rule("rust_proc_macro", "**/*.rs", _any("decorator", "proc_macro proc_macro_derive proc_macro_attribute"), "Rust procedural macro"),
    _rule("rust_ffi_export", "**/*.rs", _any("decorator", "no_mangle export_name"), "Rust export to other languages"),
    _rule("rust_test", "**/*.rs", "test_file", "Rust tests", **_TESTS),
    _rule("rust_pub_api", "**/*.rs", "visibility:pub", "Rust public items", False),
    _rule("csharp_console_app", "**/Program.cs", "function_def:Main | file_is_program", "C# console program"),
    _rule("csharp_xunit", "**/*.cs", _any("decorator", "Fact Theory"), "C# xUnit test"),
    _rule("csharp_nunit", "**/*.cs", _any("decorator", "TestFixture Test TestCase SetUp OneTimeSetUp"), "C# NUnit test"),
    _rule("csharp_mstest", "**/*.cs", _any("decorator", "TestClass TestMethod ClassInitialize TestInitialize"), "C# MSTest test"),
    _rule("csharp_webapi", "**/*.cs", _any("decorator", "ApiController Route HttpGet HttpPost HttpPut HttpDelete HttpPatch"), "ASP.NET controller"),
    _rule("csharp_minimal_api", "**/*.cs", _any("function_call", "MapGet MapPost MapPut MapDelete MapMethods"), "ASP.NET minimal endpoint"),
    _rule("csharp_generic_host", "**/*.cs", _any("function_call", "CreateDefaultBuilder ConfigureWebHostDefaults Run"), ".NET host"),
    _rule("csharp_winforms", "**/*.cs", _any("function_call", "Application.Run Application.EnableVisualStyles"), "Windows Forms program"),
    _rule("csharp_wpf", "**/*.cs", "class_definition:App", "WPF program"),
    _rule("csharp_test", "**/*.cs", "test_file", "C# tests", **_TESTS),
    _rule("typescript_main", _TS, "function_def:main", "TypeScript or JavaScript main function"),
    _rule("typescript_index", _TS, _any("file_match", _INDEX), "TypeScript or JavaScript module index"),
    _rule("typescript_cli", _TS, _any("function_call", "app.listen server.listen express") + " | " + _any("class_instantiation", "Express Koa"), "TypeScript server"),
    _rule("typescript_nextjs", "**pages/" + _TS[3:], "file_match:**pages/**", "Next.js page"),
    _rule("typescript_nestjs", _TS, _any("decorator", "Module Controller Injectable"), "NestJS part"),
    _rule("typescript_react_component", _TS, "jsx_element:*", "React component"),
    _rule("typescript_test", _TS, "test_file", "TypeScript tests"),
    _rule("c_main", "**/*.c", _any("function_def", "main WinMain wWinMain DllMain _tmain"), "C program"),
    _rule("c_test", "**/*.c", "test_file", "C tests", **_TESTS),
]

_EXCLUDED = "__pycache__ .mypy_cache .pytest_cache .tox .venv venv env virtualenv .env node_modules .git .svn .hg .idea .vscode .vs build dist target .cargo *.egg-info"
_TESTED = dict(
    file_patterns=[p + e for e in (".py", ".rs") for p in ("test_*", "*_test")] + [f"*{p}.cs" for p in ("Tests", "Test", ".Tests")],
    dir_patterns=[f"{d}/" for d in "tests test __tests__ Tests Test".split()],
    function_patterns=["test_*"],
    config_files=["conftest.py"],
)
DEFAULTS: dict[str, Any] = {
    "lang": "system",
    "version": 1,
    "entry_rules": RULES,
    "test_patterns": _TESTED,
    "exclude_patterns": {"user_exclude": [], "always_exclude": [f"{x}/" for x in _EXCLUDED.split()] + [f"{META}/"] + [f"*.py{x}" for x in "co"]},
    "performance": dict(max_file_size_mb=10, hash_algorithm="sha256", parallel_workers=0),
    "c_library_mode": "auto",
    "output": dict(default_output_limit=8000, default_max_results=50, default_detail="auto"),
}


def merged(base: dict, over: dict) -> dict:
    """``base`` overridden key by key; lists and plain values are replaced as a whole."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def coerced(text: str) -> Any:
    """A value from a command line: true or false, a number, else the text."""
    if text.lower() in ("true", "yes", "false", "no"):
        return text.lower() in ("true", "yes")
    for kind in (int, float):
        with contextlib.suppress(ValueError):
            return kind(text)
    return text


class Config:
    """The configuration file of a root folder."""

    def __init__(self, root: str) -> None:
        self.root = storage.normal(root)
        self.path = os.path.join(self.root, META, "config.json")

    def load(self) -> Settings:
        """Defaults with the file's values; a missing file is written, an unreadable one ignored."""
        try:
            data = storage.read(self.root, f"{META}/config.json")
        except FileNotFoundError:
            self.save(DEFAULTS)
            return copy.deepcopy(DEFAULTS)
        except OSError:
            return copy.deepcopy(DEFAULTS)
        try:
            return merged(copy.deepcopy(DEFAULTS), json.loads(data.decode()))
        except ValueError:
            return copy.deepcopy(DEFAULTS)

    def save(self, config: Settings) -> None:
        data = json.dumps(config, ensure_ascii=False, indent=2).encode()
        if "://" in self.root:
            storage.write(self.root, f"{META}/config.json", data)
            return
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        handle, temp = tempfile.mkstemp(dir=os.path.dirname(self.path))
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
            os.replace(temp, self.path)
        except BaseException:
            with contextlib.suppress(OSError):
                os.unlink(temp)
            raise

    def get(self, key: str) -> Any:
        value: Any = self.load()
        for part in key.split("."):
            if not isinstance(value, dict) or part not in value:
                return None
            value = value[part]
        return value

    def set(self, key: str, to: Any) -> None:
        config = self.load()
        *way, last = key.split(".")
        at = config
        for part in way:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise InvalidParamError("key", key, "not a section")
        at[last] = to
        self.save(config)

    def copy_from(self, source: str) -> None:
        path = os.path.join(source, META, "config.json") if os.path.isdir(source) else source
        if not os.path.isfile(path):
            raise ConfigNotFoundError(path)
        with open(path, "rb") as f:
            self.save(merged(copy.deepcopy(DEFAULTS), json.loads(f.read())))

    def add_rule(self, rule: Settings) -> None:
        if not isinstance(rule, dict) or not rule.get("name") or not rule.get("ast_pattern"):
            raise InvalidParamError("rule", str(rule), "a rule needs a name and an ast_pattern")
        config = self.load()
        if any(r.get("name") == rule["name"] for r in config["entry_rules"]):
            raise InvalidParamError("rule", rule["name"], "there is such a rule")
        self.save(config | {"entry_rules": [*config["entry_rules"], rule]})

    def remove_rule(self, name: str) -> None:
        config = self.load()
        left = [r for r in config["entry_rules"] if r.get("name") != name]
        if len(left) == len(config["entry_rules"]):
            raise InvalidParamError("name", name, "there is no such rule")
        self.save(config | {"entry_rules": left})

    def exclude(self, pattern: str, add: bool = True) -> None:
        config = self.load()
        user = config["exclude_patterns"]["user_exclude"]
        if add and pattern not in user:
            user.append(pattern)
        elif not add:
            if pattern not in user:
                raise InvalidParamError("exclude_pattern", pattern, "there is no such pattern")
            user.remove(pattern)
        self.save(config)
