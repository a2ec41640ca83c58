"""Source files of a tree as a DataFrame, with content hash, language and test flag."""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.config import META
from sparkweave.functions.names import base_name, folders
from sparkweave.operators.rules import any_glob, matches
from sparkweave.parse import LANGUAGES, language, registered
from sparkweave.sources import storage

COMMON_EXCLUDES = ("build", "dist", META, *".git .hg .idea .svn .vs .vscode node_modules".split())


def extension_column(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language_column(path: Column) -> Column:
    """The language that an extension is registered for; null for others."""
    out = F.lit(None).cast("string")
    for lang in registered():
        out = F.when(extension_column(path).isin(*language(lang).EXTENSIONS), lang).otherwise(out)
    return out


def test_column(path: Column, patterns: dict) -> Column:
    """Whether a path is that of a test file: its name fits a pattern, a folder is a test folder, or it is a test configuration file."""
    base = base_name(path)
    dirs = [d.rstrip("/") for d in patterns.get("dir_patterns", [])]
    named = any_glob(dirs)
    return base.rlike(any_glob(list(patterns.get("file_patterns", [])) + list(patterns.get("config_files", [])))) | (F.exists(folders(path), lambda d: d.rlike(named)) if dirs else F.lit(False))


#: Bytes of files that a task reads, about, and tasks at most for each core.
TASK_BYTES, TASKS_A_CORE = 4_000_000, 8
GONE, LARGE = "0" * 64, "size:{},mtime:{}"


def walk(root: str, config: dict, compat: bool = False) -> list[tuple[str, int, int]]:
    """``(path, size, mtime in ns)`` of the files with a registered extension below a folder, as the file system has them now.

    Excluded and hidden folders are not entered; symbolic links to folders are not followed. Names may start with an underscore.
    ``compat``: user excludes are ignored.
    """
    names = set(COMMON_EXCLUDES).union(*(language(x).EXCLUDES for x in registered()))
    known = {e for x in registered() for e in language(x).EXTENSIONS}
    user = [] if compat else config.get("exclude_patterns", {}).get("user_exclude", [])
    within, whole = [p for p in user if p.endswith("/")], [p for p in user if not p.endswith("/")]

    def enter(rel: str, name: str) -> bool:
        return not (name in names or name.startswith(".") or name.endswith(".egg-info") or any(f"{rel}/".startswith(p) or matches(name, [p[:-1]]) for p in within))

    out, waiting = [], [""]
    while waiting:
        folder = waiting.pop()
        for name, is_folder, size, mtime in storage.items(root, folder):
            rel = f"{folder}/{name}" if folder else name
            if is_folder:
                if enter(rel, name):
                    waiting.append(rel)
            elif not name.startswith(".") and os.path.splitext(name)[1].lower() in known and not (whole and (matches(rel, whole) or matches(name, whole))):
                out.append((rel, size, mtime))
    return sorted(out)


def listed(spark: SparkSession, root: str, config: dict, compat: bool = False) -> DataFrame:
    """``(path, lang, size_bytes, mtime_ns, is_test)`` of what :func:`walk` finds; no file is read."""
    found = walk(root, config, compat)
    cores = spark.sparkContext.defaultParallelism
    tasks = max(1, min(sum(x[1] for x in found) // TASK_BYTES + len(found) // 2000 + 1, TASKS_A_CORE * cores, len(found)))
    order = sorted(found, key=lambda x: -x[1])
    dealt = [x for k in range(tasks) for x in order[k::tasks]]  # each task gets large and small files
    rows = pa.table({"path": pa.array([x[0] for x in dealt], pa.string()), "size_bytes": pa.array([x[1] for x in dealt], pa.int64()), "mtime_ns": pa.array([x[2] for x in dealt], pa.int64())})
    frame = spark.createDataFrame(rows)
    return frame.select("path", language_column(F.col("path")).alias("lang"), "size_bytes", "mtime_ns", test_column(F.col("path"), config.get("test_patterns", {})).alias("is_test"))


def most_bytes(config: dict) -> int:
    """Bytes of the largest file that is read."""
    return int(float((config.get("performance") or {}).get("max_file_size_mb", 10)) * 1024 * 1024)


def content_of(root: str, path: str, size: int, mtime: int, most: int) -> tuple[bytes | None, str] | None:
    """Content and SHA-256 of a file; no content, and a mark of size and time instead of a hash, for one that is too large to be read; None if it is gone.

    A file that is there but can't be read is empty and has a hash of zeros.
    """
    if size > most:
        return None, LARGE.format(size, mtime)
    try:
        data = storage.read(root, path)
    except FileNotFoundError:
        return None
    except OSError:
        return b"", GONE
    return data, hashlib.sha256(data).hexdigest()


def read(files: DataFrame, root: str, config: dict) -> DataFrame:
    """``files(path, lang, size_bytes, mtime_ns, is_test)`` with ``hash`` and ``content``, read by path on the executors."""
    most = most_bytes(config)

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                got = content_of(root, r.path, r.size_bytes, r.mtime_ns, most)
                if got:
                    yield pd.DataFrame([(r.path, r.lang, r.size_bytes, r.mtime_ns, got[1], r.is_test, got[0])], columns=["path", "lang", "size_bytes", "mtime_ns", "hash", "is_test", "content"])

    return files.select("path", "lang", "size_bytes", "mtime_ns", "is_test").mapInPandas(run, "path string, lang string, size_bytes long, mtime_ns long, hash string, is_test boolean, content binary")


def scan(spark: SparkSession, root: str, config: dict, compat: bool = False) -> DataFrame:
    """``(path, lang, size_bytes, mtime_ns, hash, is_test, content)`` of the files with a registered extension below a folder."""
    base = storage.normal(root)
    return read(listed(spark, base, config, compat), base, config)


def unhandled(root: str) -> dict[str, int]:
    """Files per extension of a known but unregistered language."""
    other = {e: n for n, m in LANGUAGES.items() if n not in registered() for e in m.EXTENSIONS}
    found: Counter[str] = Counter()
    waiting = [""] if other else []
    while waiting:
        folder = waiting.pop()
        for name, is_folder, _, _ in storage.items(root, folder):
            if is_folder and not name.startswith(".") and name not in COMMON_EXCLUDES:
                waiting.append(f"{folder}/{name}" if folder else name)
            elif not is_folder and (e := os.path.splitext(name)[1].lower()) in other:
                found[e] += 1
    return dict(found)
