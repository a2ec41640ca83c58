"""Project files: what ``.csproj`` and ``Cargo.toml`` say about the sources below them."""

from __future__ import annotations

import contextlib
import os
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions.names import folders
from sparkweave.sources import storage
from sparkweave.sources.scan import COMMON_EXCLUDES

PROJECT = "folder string, project string, is_test boolean, output_type string, framework string, assembly string, namespace string"
_TEST_SDK = re.compile(r"Microsoft\.NET\.Test\.Sdk|<IsTestProject>\s*true\s*</IsTestProject>|PackageReference\s+Include=\"(?:xunit|nunit|MSTest)[^\"]*\"", re.I)
#: Projects whose table is broadcast at most.
BROADCAST_PROJECTS = 100_000


def _text(data: bytes) -> str:
    for code in ("utf-16",) if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf_8_sig", "latin_1"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    return ""


def _walk(root: str, wanted):
    """Folder, name and text of the files wanted below a root; what can't be read is skipped."""
    waiting = [""]
    while waiting:
        folder = waiting.pop()
        for name, is_folder, _, _ in storage.items(root, folder):
            path = f"{folder}/{name}" if folder else name
            if is_folder and name not in COMMON_EXCLUDES and not name.startswith("."):
                waiting.append(path)
            elif not is_folder and wanted(name):
                with contextlib.suppress(OSError):
                    yield folder, name, _text(storage.read(root, path))


def csharp_projects(root: str) -> list[tuple]:
    """Rows of :data:`PROJECT`, one per ``.csproj`` below a folder; folders are relative, "" for the root itself."""
    out = []
    for folder, name, text in _walk(root, lambda f: f.lower().endswith(".csproj")):
        tag = lambda t: m[1].strip() if (m := re.search(rf"<{t}>\s*([^<]*?)\s*</{t}>", text, re.I)) else None  # noqa: B023, E731
        own = name.rsplit(".", 1)[0]
        out.append((folder, own, bool(_TEST_SDK.search(text)), (tag("OutputType") or "Library"), tag("TargetFramework") or tag("TargetFrameworks"), tag("AssemblyName") or own, tag("RootNamespace") or own))
    return out


def cargo_binaries(root: str) -> list[str]:
    """Paths that ``[[bin]]`` sections of the ``Cargo.toml`` files below a folder name; a file that can't be read is skipped."""
    out = []
    for folder, _, text in _walk(root, lambda f: f == "Cargo.toml"):
        try:
            bins = tomllib.loads(text).get("bin", [])
        except tomllib.TOMLDecodeError:
            continue
        out += [os.path.normpath(os.path.join(folder, b["path"])).replace(os.sep, "/") for b in bins if isinstance(b, dict) and isinstance(b.get("path"), str)]
    return sorted(set(out))


def nearest_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """``files(file_id, path)``, ``projects(folder, project, ...)`` -> the files with the project of the closest folder above them.

    Each path is joined on all its leading folders, and the longest match wins (of two projects in a folder, the first by name); files without a project are left out.
    """
    above = F.transform(F.sequence(F.lit(0), F.size(folders(F.col("path")))), lambda n: F.array_join(F.slice(folders(F.col("path")), 1, n), "/"))
    at = files.select("file_id", F.explode(above).alias("folder"))
    first = projects.groupBy("folder").agg(F.min_by(F.struct(*projects.columns), "project").alias("p"))
    found = at.join(first, "folder").groupBy("file_id").agg(F.max_by("p", F.length("folder")).alias("p"))
    return found.select("file_id", *[F.col(f"p.{c}").alias(c) for c in projects.columns])


def project_entries(spark: SparkSession, files: DataFrame, nodes: DataFrame, marks: DataFrame, csharp: list[tuple], binaries: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries that follow from project files, and the files whose own rules are skipped for them.

    A file of a C# test project is a test as a whole; public items of a C# library are entries; so are the binaries that Cargo names.
    """
    projects = spark.createDataFrame(csharp, PROJECT)
    if len(csharp) <= BROADCAST_PROJECTS:
        projects = F.broadcast(projects)
    of = nearest_project(files.where("lang = 'csharp'"), projects)
    entry = lambda df, node, rule, line, about, still: df.select("file_id", node.cast("long").alias("node_id"), F.lit(rule).alias("rule_name"), line.cast("int").alias("line"), F.lit(about).alias("description"), F.lit(still).alias("no_propagate"))
    tests = of.where("is_test").join(files.where("n > 0").select("file_id"), "file_id", "left_semi")
    library = of.where("not is_test and lower(output_type) = 'library'").select("file_id")
    public = marks.where("kind = 'visible' and node_id <> 0").join(library, "file_id", "left_semi")
    cargo = files.where(F.col("path").isin(binaries)) if binaries else files.limit(0)
    out = entry(tests, F.lit(0), "csharp_test_project", F.lit(0), "file of a test project", True)
    out = out.unionByName(entry(public, F.col("node_id"), "csharp_library", F.col("line"), "public item of a library", False))
    out = out.unionByName(entry(cargo, F.lit(0), "cargo_bin", F.lit(1), "binary named in Cargo.toml", False))
    return out, tests.select("file_id")
