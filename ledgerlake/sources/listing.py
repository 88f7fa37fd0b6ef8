"""A relation of the files below some folders, empty files included (S3).

Spark's own file sources drop zero-length files before any task runs, so a check of
uploads cannot be built on them. ``FileListing`` is a Python data source: each folder
given is listed by a task of its own, folder by folder, and only path, length and
modification time cross to Spark. Names that begin with ``_`` or ``.`` are skipped, as
Spark's sources do. A folder that does not exist has no files.
"""

from __future__ import annotations

import json
from datetime import UTC

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FileListing(DataSource):
    """``format("file_listing")`` with option ``paths``, a JSON list of folders or files."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, length bigint, modified timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths] or [InputPartition(None)]

    def read(self, partition: InputPartition):
        from pyarrow import fs

        if partition.value is None:
            return
        system, root = fs.FileSystem.from_uri(_uri(partition.value))
        scheme = partition.value.split("://")[0] + "://" if "://" in partition.value else "file:"
        todo = [root]
        while todo:
            here = todo.pop()
            info = system.get_file_info(here)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(
                fs.FileSelector(here, allow_not_found=True))
            for f in found:
                if f.base_name.startswith(("_", ".")) and f.path != root:
                    continue
                if f.type == fs.FileType.Directory:
                    todo.append(f.path)
                elif f.type == fs.FileType.File:
                    yield scheme + f.path, f.size, f.mtime.astimezone(UTC) if f.mtime else None


def _uri(path: str) -> str:
    """``file:/a`` and ``file:///a`` name the same folder; plain paths stay as they are."""
    return "file://" + path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path``, ``length``, ``modified`` of every file below ``paths``."""
    spark.dataSource.register(FileListing)
    return (spark.read.format("file_listing")
            .option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).load())
