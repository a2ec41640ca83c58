"""The index: versioned Parquet tables of one code base, and what changed since."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("files", "nodes", "refs", "marks", "imports", "parse_warnings", "edges", "entries", "warnings", "snapshots", "members", "summary")
VERSION = 2
#: Age in ms after which a version that never became current is taken for the rest of a build that died.
ORPHAN = 86_400_000


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old(path, hash)``, ``new(path, hash)`` -> ``(path, state)``: added, removed, modified or unchanged; two unknown hashes are a change."""
    both = old.select("path", F.col("hash").alias("_old"), F.lit(True).alias("_o")).join(new.select("path", F.col("hash").alias("_new"), F.lit(True).alias("_n")), "path", "full_outer")
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("modified")
    return both.select("path", state.alias("state"))


class Index:
    """Tables under ``root/v-<id>/``; ``root/_CURRENT`` names the version to read. A version becomes visible only when all of it is written."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_CURRENT")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def current(self) -> dict | None:
        """``{"version", "schema", ...}`` of the version to read; None if there is none or its schema is another."""
        fs, path = self._fs()
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            state = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()
        return state if state.get("schema") == VERSION else None

    def read(self, table: str) -> DataFrame:
        state = self.current()
        if state is None:
            raise FileNotFoundError(f"there is no index in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{state['version']}/{table}")

    def begin(self) -> str:
        return f"v-{int(time.time() * 1000):013d}-{uuid.uuid4().hex}"

    def write(self, version: str, table: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write a table of a version, clustered by a column so that row-group statistics can skip, and read it back."""
        path = f"{self.root}/{version}/{table}"
        (df.sortWithinPartitions(by) if by else df).write.parquet(path)
        return self.spark.read.parquet(path)

    def commit(self, version: str, **extra) -> None:
        """Make a version the one to read, by one renaming that overwrites the pointer: a reader sees the former or the new version, never none.

        The version before stays for its readers, the one before that is dropped, and so are versions that never became current and are
        more than a day old. A version that another build is writing is left alone.
        """
        fs, path = self._fs()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        former = self.current() or {}
        temp = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_CURRENT.{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps({"schema": VERSION, "before": former.get("version"), **extra, "version": version}).encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(temp, path, how)
        now = int(time.time() * 1000)
        for s in fs.listStatus(path.getParent()):
            name = s.getPath().getName()
            if not name.startswith("v-") or name in (version, former.get("version")):
                continue
            begun = name.split("-")[1]
            if name == former.get("before") or not begun.isdigit() or now - int(begun) > ORPHAN:
                fs.delete(s.getPath(), True)
