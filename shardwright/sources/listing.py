"""Files below a folder as a table, made by tasks.

The folders of one depth are listed by tasks and written; the next round lists those found.  Only
counts reach the driver, so a corpus may hold any number of files.  Tasks open stores through
``pyarrow.fs``; ``known_store`` tells whether that works (else callers leave the listing to Spark's
own readers).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.session import store

FOLDERS_PER_TASK = 64
MOST_FOLDERS_PER_TASK = 1 << 14  # where there are many folders: each task writes a file of what it found
ROWS_PER_BATCH = 10_000
LISTED = "path string, length bigint, is_folder boolean"


def open_store(uri: str):
    """(pyarrow file system, path in it) of a decoded URI, as Hadoop prints paths."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    system, path = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    return system, unquote(path) if "%" in path else path


def known_store(uri: str) -> bool:
    try:
        open_store(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...], hidden: bool = False) -> DataFrame:
    """``(path, length)`` of the files below ``root`` (a qualified, decoded path) whose names end with
    one of ``suffixes``.  Names that begin with ``.`` or ``_`` are left out, as Spark's readers do,
    unless ``hidden``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def out(rows: list[tuple[str, int, bool]]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["path", "length", "is_folder"])

        for b in batches:
            for folder in b.column(0).to_pylist():
                system, path = open_store(folder)
                rows = []
                for info in system.get_file_info(fs.FileSelector(path, recursive=False)):
                    is_folder = info.type == fs.FileType.Directory
                    if (hidden or info.base_name[:1] not in "._") and (is_folder or info.base_name.endswith(suffixes)):
                        rows.append((f"{folder.rstrip('/')}/{info.base_name}", 0 if is_folder else info.size, is_folder))
                    if len(rows) == ROWS_PER_BATCH:
                        yield out(rows)
                        rows = []
                yield out(rows)

    found: list[DataFrame] = []
    level, n = spark.createDataFrame([(root,)], "folder string"), 1
    while n:
        tasks = max(min(-(-n // FOLDERS_PER_TASK), spark.sparkContext.defaultParallelism * 4), -(-n // MOST_FOLDERS_PER_TASK))
        spread = level.repartition(tasks, "folder") if tasks > 1 else level
        listed = store(spread.mapInArrow(look, LISTED), "listing")
        found.append(listed.where(~F.col("is_folder")).select("path", "length"))
        level = listed.where("is_folder").select(F.col("path").alias("folder"))
        n = level.count()
    return reduce(DataFrame.unionAll, found)


def read_files(files: DataFrame, bytes_per_task: int = 32 << 20) -> DataFrame:
    """``(path, length)`` -> ``(path, content)``: every file's bytes, files of no bytes too."""
    total = files.agg(F.coalesce(F.sum(F.col("length") + F.lit(1 << 16)), F.lit(0)).alias("n")).collect()[0]["n"]
    tasks = max(1, -(-total // bytes_per_task), min(files.sparkSession.sparkContext.defaultParallelism, total >> 20))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.large_binary()).cast(pa.binary())], names=["path", "content"])

        for b in batches:
            rows, size = [], 0
            for uri in b.column(0).to_pylist():
                system, path = open_store(uri)
                with system.open_input_stream(path) as f:
                    rows.append((uri, f.read()))
                size += len(rows[-1][1])
                if size >= 16 << 20:
                    yield out(rows)
                    rows, size = [], 0
            yield out(rows)

    return files.select("path").repartition(int(tasks), "path").mapInArrow(read, "path string, content binary")
