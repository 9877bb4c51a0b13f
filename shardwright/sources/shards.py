"""Binary shard sink / source and the manifest file.

A shard is a headerless little-endian array of fixed-width unsigned ids named
``{split}_{index:05d}.bin``; its width lives in the manifest.  Shards are written
by the executors (one task per group of shard rows, atomic rename so a retried task
cannot leave a torn file); the driver only writes the small manifest.  On a cluster
``out_dir`` must be shared storage (any URI ``pyarrow.fs`` understands).
"""

from __future__ import annotations

import io
import json
import os
import uuid
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.operators.packing import TOKENS_PER_PART, dtype_for_vocab

MANIFEST = "manifest.json"
MANIFEST_VERSION = 1
SHARD_INFO_SCHEMA = "filename string, split string, num_tokens bigint"
_NP = {"uint16": "<u2", "uint32": "<u4"}


def _fs(path: str):
    """(pyarrow file system, path in it); ``file:/x`` and a path without a scheme are local."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + path[len("file:") :].lstrip("/"))
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _shared(spark: SparkSession, path: str) -> None:
    """A path without a scheme is each executor's own disk: refused on a cluster."""
    if ":" not in path.split("/")[0] and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{path}: name a shared folder by its full URI on a cluster")


def write_shards(shards: DataFrame, out_dir: str, dtype: str) -> DataFrame:
    """One ``.bin`` per shard row; returns ShardInfo rows ``(filename, split, num_tokens)``.

    Narrow (``mapInArrow``, no shuffle; one shard at a time is copied).  Ids outside the dtype's range fail the task.
    """
    if dtype not in _NP:
        raise ValueError(f"unsupported shard dtype {dtype!r}")
    np_dtype = _NP[dtype]
    limit = 1 << (16 if dtype == "uint16" else 32)
    _shared(shards.sparkSession, out_dir)
    filesystem, base = _fs(out_dir)
    filesystem.create_dir(base, recursive=True)

    def write(batches):
        filesystem_, base_ = _fs(out_dir)
        for b in batches:
            lists = b.column(2)
            if lists.null_count:
                raise ValueError("a shard without tokens")
            edges, values, sizes = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False), []
            for i, name in enumerate(b.column(0).to_pylist()):
                arr = values[edges[i] : edges[i + 1]]
                if arr.size and not (arr.min() >= 0 and arr.max() < limit):
                    raise ValueError(f"token id out of range for {dtype} in {name}")
                tmp = f"{base_}/.{name}.{uuid.uuid4().hex}.tmp"
                with filesystem_.open_output_stream(tmp) as f:
                    f.write(arr.astype(np_dtype).tobytes())
                filesystem_.move(tmp, f"{base_}/{name}")
                sizes.append(arr.size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["filename", "split", "num_tokens"])

    return shards.select("filename", "split", "tokens").mapInArrow(write, SHARD_INFO_SCHEMA)


def read_shards(spark: SparkSession, shard_dir: str, dtype: str) -> DataFrame:
    """``(split, shard_idx, filename, tokens ARRAY<INT>)`` from ``*.bin`` files."""
    if dtype not in _NP:
        raise ValueError(f"unsupported shard dtype {dtype!r}")
    np_dtype = _NP[dtype]
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(shard_dir)
    named = raw.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        "content",
    ).select(
        F.regexp_extract("filename", r"^(.*)_(\d+)\.bin$", 1).alias("split"),
        F.regexp_extract("filename", r"^(.*)_(\d+)\.bin$", 2).cast("int").alias("shard_idx"),
        "filename",
        "content",
    )

    def convert(batches):
        for b in batches:
            names, run, size = [b.column(i) for i in range(3)], [], 0
            for i, data in enumerate(b.column(3)):
                run.append(np.frombuffer(data.as_buffer(), np_dtype).astype(np.int32))
                size += len(run[-1])
                if size >= TOKENS_PER_PART or i + 1 == b.num_rows:
                    tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, run)]), pa.int32()), pa.array(np.concatenate(run)))
                    yield pa.RecordBatch.from_arrays([*(c.slice(i + 1 - len(run), len(run)) for c in names), tokens], names=["split", "shard_idx", "filename", "tokens"])
                    run, size = [], 0

    return named.mapInArrow(convert, "split string, shard_idx int, filename string, tokens array<int>")


def write_manifest(manifest_rows: DataFrame, out_dir: str) -> str:
    """``manifest.json`` from the K7 table (one row per split).

    Shard names are generated from ``n_shards`` while streaming the file, so the
    driver never holds the shard list.
    """
    rows = manifest_rows.collect()  # one row per split
    if not rows:
        raise ValueError("empty manifest: no shards")
    first = rows[0]
    system, base = _fs(out_dir)
    system.create_dir(base, recursive=True)
    path = f"{base}/{MANIFEST}"
    with system.open_output_stream(path) as raw, io.TextIOWrapper(raw, encoding="utf-8") as f:
        f.write("{\n")
        f.write(f'  "version": {MANIFEST_VERSION},\n  "dtype": {json.dumps(first["dtype"])},\n')
        f.write(f'  "vocab_size": {int(first["vocab_size"])},\n  "shard_size": {int(first["shard_size"])},\n')
        f.write('  "splits": {')
        order = sorted(rows, key=lambda r: (r["split"] != "train", r["split"]))
        for si, r in enumerate(order):
            f.write(("," if si else "") + f"\n    {json.dumps(r['split'])}: {{\n      \"shards\": [")
            for i in range(int(r["n_shards"])):
                f.write(("," if i else "") + f"\n        {json.dumps('%s_%05d.bin' % (r['split'], i))}")
            f.write(f"\n      ],\n      \"num_tokens\": {int(r['num_tokens'])}\n    }}")
        f.write("\n  }\n}\n")
    return path


def load_manifest(path: str) -> dict:
    """S9 read: the manifest as a dict (a directory or the file itself)."""
    system, name = _fs(path)
    if not name.endswith(".json"):
        name = f"{name.rstrip('/')}/{MANIFEST}"
    with system.open_input_stream(name) as f:
        return json.loads(f.read())


def manifest_shards(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's shard list as a table ``(split, shard_idx, filename)``."""
    m = load_manifest(path)
    rows = [(s, i, name) for s, e in m["splits"].items() for i, name in enumerate(e["shards"])]
    return spark.createDataFrame(rows, "split string, shard_idx int, filename string")


__all__ = ["dtype_for_vocab", "write_shards", "read_shards", "write_manifest", "load_manifest", "manifest_shards"]
