"""Session helpers: a tuned local session for tests/bench, and the checkpoint folder.

Library operators never create a session themselves; they take DataFrames.  These
helpers are only used by tests, ``bench.py`` and ``__spark_entry__.py``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "shardwright") -> SparkSession:
    """A local-mode session with AQE on and the web UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SHARDWRIGHT_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    The cluster names it in ``spark.checkpoint.dir``.  Only when it is unset *and*
    the master is local (tests, bench) do we create a scratch folder of our own; a
    machine-local folder would be wrong on a cluster, so there we refuse instead.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder for iterative jobs "
            "(BPE training cuts its lineage there)"
        )
    folder = tempfile.mkdtemp(prefix="shardwright-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def materialize(df, how: str | None = "checkpoint"):
    """Materialise an expensive intermediate once so later branches read it instead
    of recomputing it.  ``checkpoint``: reliable, in the shared checkpoint folder
    (lineage cut, survives executor loss); ``persist``: memory and disk; ``None``:
    leave lazy."""
    from pyspark import StorageLevel

    if how is None:
        return df
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    raise ValueError(f"unknown materialisation {how!r}")


def store(df, label: str, rows_per_group: int | None = None):
    """Write ``df`` as Parquet in a new folder below the shared checkpoint folder and read it back:
    later branches read only the columns they need, and a lost executor costs a reread.
    ``rows_per_group`` is for rows with long arrays, see ``store_at``."""
    return store_at(df, f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}", rows_per_group)


LONG_ARRAYS = 8 << 20  # bytes of a row group of long arrays, as encoded


def store_at(df, out: str, rows_per_group: int | None = None):
    """A scan decodes up to 4,096 rows of one row group at once, and token ids take some eight times the
    memory that they take encoded: rows with long arrays go to groups of so many rows and LONG_ARRAYS
    bytes at most, so that a reading task holds a group of that size, whatever the file's."""
    w = df.write
    if rows_per_group:
        w = w.option("parquet.block.size", LONG_ARRAYS).option("parquet.block.row.count.limit", rows_per_group)
    w.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


BATCH_BYTES = 8 << 20  # of an Arrow batch while token ids go through Python


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def keep_batches_small(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most from now on, unless the session names a size of its own."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_BYTES at most in the actions inside: one of Spark's usual 64 MB takes several times
    that in the JVM and in each Python worker of a task."""
    key = BATCH_KEY
    saved = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if saved is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, saved)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``store_at`` made."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
