"""Keep an index up to date from a stream of source files, and parse such a stream.

The stream is a data source of its own, since Spark's file source passes over names that start with an underscore and never tells of files that are
gone. Its offset is the latest change time in the tree with the number of files; a batch has the files that changed since the offset before.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from sparkweave.build import build_index, parse_files
from sparkweave.config import Config
from sparkweave.sources import scan, storage
from sparkweave.sources.index import Index

SOURCE_SCHEMA = "path string, lang string, size_bytes long, mtime_ns long, content binary"
#: Bytes of files in a task, about.
TASK_BYTES = 16_000_000


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int, int]]) -> None:
        self.files = files


class _TreeReader(DataSourceStreamReader):
    def __init__(self, root: str, config: dict) -> None:
        self.root, self.config = root, config

    def _now(self) -> list[tuple[str, int, int]]:
        return scan.walk(self.root, self.config)

    def initialOffset(self) -> dict:
        return {"at": -1, "files": 0, "names": ""}

    def latestOffset(self) -> dict:
        found = self._now()
        names = hashlib.sha256("\n".join(x[0] for x in found).encode("utf-8", "surrogateescape")).hexdigest()  # tells of files that are gone or moved
        return {"at": max((x[2] for x in found), default=-1), "files": len(found), "names": names}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        languages = {e: n for n in scan.registered() for e in scan.language(n).EXTENSIONS}
        changed = [(p, languages[os.path.splitext(p)[1].lower()], size, mtime) for p, size, mtime in self._now() if start["at"] < mtime]
        out, size = [[]], 0
        for f in changed:
            if out[-1] and size + f[2] > TASK_BYTES:
                out.append([])
                size = 0
            out[-1].append(f)
            size += f[2]
        return [_Files(x) for x in out]

    def read(self, partition: _Files):
        most = scan.most_bytes(self.config)
        for path, lang, size, mtime in partition.files:
            got = scan.content_of(self.root, path, size, mtime, most)
            if got:
                yield path, lang, size, mtime, got[0]

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    """Stream of the new and changed source files below a folder. Options: ``root``; ``config`` as JSON."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SOURCE_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TreeReader(storage.normal(self.options["root"]), json.loads(self.options.get("config", "{}")))


def source_stream(spark: SparkSession, root: str, config: dict | None = None) -> DataFrame:
    """New and changed files below a folder, ``(path, lang, size_bytes, mtime_ns, content)``, as they appear; excluded and unknown ones are left out.

    Contents of files beyond the size limit are null. When files disappear a batch comes that may have no row.
    """
    spark.dataSource.register(SourceTree)
    return spark.readStream.format("source_tree").option("root", root).option("config", json.dumps(config or {})).load()


def parsed_stream(spark: SparkSession, root: str) -> DataFrame:
    """The stream of files, parsed: one row per version of a file."""
    return parse_files(source_stream(spark, root))


def keep_indexed(spark: SparkSession, root: str, checkpoint: str, once: bool = False, public_as_entry: bool = False) -> StreamingQuery:
    """Rebuild the index incrementally after each batch of changes. ``once``: take what is there and stop.

    The build finds out itself what differs from the index, so a batch that is delivered twice changes nothing; only changed files are read.
    """
    from sparkweave.api import _index

    root = storage.normal(root)
    index: Index = _index(spark, root)

    def refresh(_batch: DataFrame, _number: int) -> None:
        build_index(spark, root, index, Config(root).load(), public_as_entry=public_as_entry)

    writer = source_stream(spark, root, Config(root).load()).select("path").writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
