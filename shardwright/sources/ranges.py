"""S8 and X1-X3 on shard files by byte ranges: a shard is never read whole.

``read_examples`` cuts every shard file into runs of whole examples; a task reads a run and the one token after it, so
one large shard spreads over many tasks.  ``examples_at`` reads the T + 1 tokens of each example asked for.
Files are sized by tasks (a listing, or the open file); the driver sees no shard names.

Defined cases: a file whose bytes are no whole number of ids is an error, as is one with fewer than T + 1 tokens
(``on_small="drop"``: it yields nothing); an index outside the examples, or a shard without a file, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.sources.corpus import hadoop_path
from shardwright.sources.listing import list_files, open_store

WIDTH = {"uint16": 2, "uint32": 4}
TOKENS_PER_READ = 1 << 20
BYTES_PER_TASK = 32 << 20
EXAMPLE = "split string, shard_idx int, example_idx int, x array<int>, y array<int>"


def _width(dtype: str) -> int:
    if dtype not in WIDTH:
        raise ValueError(f"unsupported shard dtype {dtype!r}")
    return WIDTH[dtype]


def _check_context(context_length: int) -> None:
    if context_length < 1:
        raise ValueError(f"a context holds at least one token, not {context_length}")


def _tokens(f, first: int, n: int, width: int) -> np.ndarray:
    """``n`` ids of an open file from number ``first`` on."""
    f.seek(first * width)
    got = f.read(n * width)
    if len(got) != n * width:
        raise ValueError(f"a shard file ends before id {first + n}")
    return np.frombuffer(got, f"<u{width}").astype(np.int32)


def _lists(values: np.ndarray, size: int) -> pa.Array:
    """The values as lists of ``size`` each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size, dtype=np.int32)), pa.array(values))


def shard_sizes(spark: SparkSession, shard_dir: str, dtype: str) -> DataFrame:
    """``(split, shard_idx, path, num_tokens)`` of the ``.bin`` files of a folder, listed by tasks."""
    width = _width(dtype)
    files = list_files(spark, hadoop_path(spark, shard_dir)[1].toString(), (".bin",))
    name = F.regexp_extract("path", r"([^/]+)\.bin$", 1)
    odd = F.raise_error(F.format_string("%s: %d bytes are no whole number of ids", F.col("path"), F.col("length"))).cast("bigint")
    return files.select(
        F.regexp_extract(name, r"^(.*)_(\d+)$", 1).alias("split"),
        F.regexp_extract(name, r"^(.*)_(\d+)$", 2).cast("int").alias("shard_idx"),
        "path",
        F.when(F.col("length") % width == 0, (F.col("length") / width).cast("bigint")).otherwise(odd).alias("num_tokens"),
    )


def read_examples(spark: SparkSession, shard_dir: str, dtype: str, context_length: int, on_small: str = "error", tokens_per_read: int = TOKENS_PER_READ) -> DataFrame:
    """X1 / X2 from shard files: ``(split, shard_idx, example_idx, x, y)`` of every example.  A read takes
    ``tokens_per_read`` tokens at most (one example at least); about 32 MB of them are a task."""
    _check_context(context_length)
    if on_small not in ("error", "drop"):
        raise ValueError("on_small must be 'error' or 'drop'")
    width, T = _width(dtype), int(context_length)
    per_read = max(1, tokens_per_read // T)
    k = F.floor((F.col("num_tokens") - 1) / T).cast("int")
    if on_small == "error":
        msg = F.format_string("%s: %d tokens are too few for an example of %d and its successor", F.col("path"), F.col("num_tokens"), F.lit(T))
        k = F.when(k < 1, F.raise_error(msg).cast("int")).otherwise(k)
    sized = shard_sizes(spark, shard_dir, dtype).withColumn("k", k)
    firsts = F.when(F.col("k") >= 1, F.sequence(F.lit(0), F.col("k") - 1, F.lit(per_read))).otherwise(F.array().cast("array<int>"))
    runs = sized.select("split", "shard_idx", "path", "k", F.explode(firsts).alias("first"))
    runs = runs.select("split", "shard_idx", "path", "first", F.least(F.lit(per_read), F.col("k") - F.col("first")).alias("n"))
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0] * T * width
    tasks = max(1, -(-total // BYTES_PER_TASK), min(spark.sparkContext.defaultParallelism, total >> 20))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                system, path = open_store(r["path"])
                with system.open_input_file(path) as f:
                    t = _tokens(f, r["first"] * T, r["n"] * T + 1, width)
                index = np.arange(r["first"], r["first"] + r["n"], dtype=np.int32)
                same = [pa.repeat(pa.scalar(v, kind), r["n"]) for v, kind in ((r["split"], pa.string()), (r["shard_idx"], pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(index), _lists(t[:-1], T), _lists(t[1:], T)], names=["split", "shard_idx", "example_idx", "x", "y"])

    return runs.repartition(int(tasks), "path", "first").mapInArrow(read, EXAMPLE)


def examples_at(requests: DataFrame, shard_dir: str, dtype: str, context_length: int) -> DataFrame:
    """X3 from shard files: the example of each row of ``requests(split, shard_idx, index)``; a negative index counts
    from the shard's end.  Rows stay in their tasks; each costs one read of T + 1 tokens."""
    _check_context(context_length)
    width, T = _width(dtype), int(context_length)
    root = hadoop_path(requests.sparkSession, shard_dir)[1].toString().rstrip("/")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, x, y = [], [], []
            for split, shard, i in zip(*(c.to_pylist() for c in b.columns)):
                system, path = open_store(f"{root}/{split}_{shard:05d}.bin")
                with system.open_input_file(path) as f:
                    n = f.size()
                    if n % width:
                        raise ValueError(f"{path}: {n} bytes are no whole number of ids")
                    k = (n // width - 1) // T
                    real = i + k if i < 0 else i
                    if not 0 <= real < k:
                        raise IndexError(f"no example {i} among {k} of {path}")
                    t = _tokens(f, real * T, T + 1, width)
                index.append(real)
                x.append(t[:-1])
                y.append(t[1:])
            both = [_lists(np.concatenate([*v, np.zeros(0, np.int32)]), T) for v in (x, y)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(index, pa.int32()), *both], names=["split", "shard_idx", "example_idx", "x", "y"])

    return requests.select(F.col("split").cast("string"), F.col("shard_idx").cast("int"), F.col("index").cast("int")).mapInArrow(look, EXAMPLE)
