"""File trees, hidden and empty files included.

Folders are listed in tasks, a level of the tree at a time; no path comes to the driver.
The file systems are those that pyarrow opens (local or shared folders, object stores).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatch
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.sources.shared import settle

MANIFEST = "path string, length bigint, modified timestamp, is_folder boolean"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system, and the path in it. A local path may have spaces and ``%``."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema(
        [
            ("path", pa.string()),
            ("length", pa.int64()),
            ("modified", pa.timestamp("us", "UTC")),
            ("is_folder", pa.bool_()),
        ]
    )
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            system, path = _open(folder)
            rows = [
                {
                    "path": f"{folder.rstrip('/')}/{i.base_name}",
                    "length": i.size or 0,
                    "modified": i.mtime_ns and datetime.fromtimestamp(i.mtime_ns / 1e9, timezone.utc),
                    "is_folder": i.type == fs.FileType.Directory,
                }
                for i in system.get_file_info(fs.FileSelector(path))
            ]
            yield pa.RecordBatch.from_pylist(rows, kind)


def manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, modified) of all files below ``root`` whose name fits ``glob``. File
    contents are not read. A level of the tree is a job and a written table."""
    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    levels = []
    while True:
        found = settle(level.mapInArrow(_listed, MANIFEST))
        levels.append(found.filter("not is_folder").drop("is_folder"))
        folders = found.filter("is_folder").select("path")
        if folders.isEmpty():
            break
        # folders of one listing are dealt out to tasks
        level = folders.repartition(spark.sparkContext.defaultParallelism, "path")
    files = reduce(DataFrame.unionByName, levels)
    if glob == "*":
        return files

    @F.udf("boolean")
    def fits(path):
        return fnmatch(path.rsplit("/", 1)[-1], glob)

    return files.filter(fits("path"))


def contents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content) of all files below ``root``. A file is a row, so it must be smaller
    than 2 GB."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, own = _open(path)
                with system.open_input_file(own) as f:
                    yield pa.RecordBatch.from_pydict(
                        {"path": [path], "content": pa.array([f.read()], pa.binary())}
                    )

    files = manifest(spark, root, glob).select("path")
    spread = files.repartition(4 * spark.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(read, "path string, content binary")


def write_files(files: DataFrame, root: str) -> None:
    """Write rows of (path below ``root``, content) as files, each from the task that has it."""

    def write(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, own = _open(f"{root.rstrip('/')}/{path}")
                system.create_dir(own.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(own) as f:
                    f.write(content)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    files.select("path", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
