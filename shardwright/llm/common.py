"""Small helpers that the operators share.

Texts travel to Python as UTF-8 bytes (``cast("binary")``): ``bytes.split()`` cuts at
exactly the characters U+0020 and U+0009..U+000D, ``bytes.lower()`` changes only A-Z.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.session import checkpoint_dir

#: One word: a run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back: lineage
    is cut, later branches read only the columns they need, and a lost executor costs a reread."""
    spark, out = df.sparkSession, new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def text_bytes(col: Column | str = "text") -> Column:
    """The text as UTF-8 bytes; null stays null."""
    return (F.col(col) if isinstance(col, str) else col).cast("string").cast("binary")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def id_bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo ``n``; a null id has bucket null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(c.cast("string").cast("binary")) % F.lit(n)).cast("int")


def py_id_bucket(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table of very few scan partitions one per task slot (rows of a few files)."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, *keys) if df.rdd.getNumPartitions() * 2 <= slots else df


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (SplitMix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


FILTER_BITS = 1 << 24


def id_filter(ids: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS bits (2 MB whatever the input) with the hashed ids set: a document whose bit
    is clear is in no pair.  When it fills up it only lets more documents through."""
    h = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bits = ids.select(h.alias("h")).distinct().withColumn("part", (F.col("h") / 65_536).cast("int"))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(65_536, np.uint8)
        x[pdf["h"].to_numpy() % 65_536] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(x).tobytes()]})

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.groupBy("part").applyInPandas(fill, "part int, bits binary").collect():
        out[r["part"] * 8192 : (r["part"] + 1) * 8192] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


class Memo(dict):
    """A dict that makes missing values with ``make(key)``; ``trim`` empties it beyond ``most`` keys."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut rows of these sizes into runs of at most ``most`` in all (a single larger row is a run)."""
    start = total = 0
    end = 0
    for at, n in enumerate(sizes):
        if total and total + n > most:
            yield start, at
            start, total = at, 0
        total, end = total + n, at + 1
    if start < end:
        yield start, end
