"""Parsers: one file's text to nodes, references, imports, name uses, marks and warnings."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field
from types import ModuleType

from pyspark import cloudpickle


@dataclass
class Parsed:
    """What a parser finds in a file. Nodes have local numbers from 1; ``parent`` refers to them, 0 for none."""

    nodes: list[dict] = field(default_factory=list)
    refs: list[tuple[str, str, str, int]] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    marks: list[tuple[str, str, int, int]] = field(default_factory=list)
    warnings: list[tuple[str, str, str, int]] = field(default_factory=list)
    uses: set[str] = field(default_factory=set)
    module: str = ""

    def node(self, kind: str, name: str, qname: str, start: int, end: int, col: int = 0, parent: int = 0, **more) -> int:
        k = len(self.nodes) + 1
        self.nodes.append({"local": k, "node_type": kind, "name": name, "qualified_name": qname, "line_start": start, "line_end": end, "col_offset": col, "parent_local": parent, **more})
        return k

    def ref(self, source: str, target: str, kind: str, line: int) -> None:
        self.refs.append((source, target, kind, line))

    def mark(self, kind: str, name: str, line: int, node: int = 0) -> None:
        self.marks.append((kind, name, line, node))

    def warn(self, kind: str, severity: str, message: str, line: int = 0) -> None:
        self.warnings.append((kind, severity, message, line))


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _languages() -> dict:
    from sparkweave.parse import braces, python

    return {"python": python, **braces.LANGUAGES}


class _Lazy(dict):
    """Language modules by name, imported at first use."""

    def _fill(self) -> None:
        if not dict.__len__(self):
            self.update(_languages())

    def __getitem__(self, k):
        self._fill()
        return dict.__getitem__(self, k)

    def items(self):
        self._fill()
        return dict.items(self)


LANGUAGES = _Lazy()
#: Languages that a program has registered itself; they go to the executors with the job that parses.
_OWN: dict[str, object] = {}
CONTRACT = ("EXTENSIONS", "EXCLUDES", "PUBLIC", "module_of", "parse", "is_special")


def register(name: str, adapter: object) -> None:
    """Parse files of a further language, or replace the reader of a known one.

    An adapter has ``EXTENSIONS`` (such as ``(".x",)``), ``EXCLUDES`` (names of folders that are not entered), ``PUBLIC`` (names that are public
    by themselves), ``module_of(path)``, ``is_special(name)`` and ``parse(path, data)``, which returns :class:`Parsed`.
    """
    missing = [a for a in CONTRACT if not hasattr(adapter, a)]
    if missing:
        raise TypeError(f"the adapter of {name} lacks {', '.join(missing)}")
    home = sys.modules.get(adapter.__name__ if isinstance(adapter, ModuleType) else type(adapter).__module__)
    if home is not None and home.__name__ != "__main__":
        cloudpickle.register_pickle_by_value(home)  # executors need not have it
    _OWN[name] = adapter


def unregister(name: str) -> None:
    _OWN.pop(name, None)


def own() -> dict[str, object]:
    return dict(_OWN)


def language(name: str):
    return _OWN.get(name) or LANGUAGES[name]


def registered() -> list[str]:
    """Names of the languages that files are parsed for."""
    return list(dict.fromkeys([*(k for k, _ in LANGUAGES.items()), *_OWN]))
