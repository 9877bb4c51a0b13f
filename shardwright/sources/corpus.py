"""Corpus scans, configured acquisition and export.

A document is a row ``(doc_key STRING, text STRING, ...)``.  DataFrames have no order,
so corpus order is an explicit key made of the file's path below the corpus folder and
of the row inside the file: path components and the zero-padded row number, joined by
U+0000.  Comparing such keys compares paths component by component (``a/b.txt`` comes before
``a.txt``), and a key depends on nothing but its own file: adding a file moves no document.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.operators.packing import prefix_offsets
from shardwright.operators.prep import normalize_v0
from shardwright.sources.listing import known_store, list_files, open_store, read_files

SEP = "\x00"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, qualified path) of Spark's Hadoop configuration."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def same_form(uri: Column) -> Column:
    """``file:///x`` and ``file:/x`` name one file; other URIs stay as they are."""
    return F.regexp_replace(uri, "^file:/+", "file:/")


def order_key(path: Column, row_index: Column, root: str) -> Column:
    """The order key of a row of a file below ``root`` (both as decoded, qualified paths)."""
    below = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30))
    name = F.coalesce(below, F.substring_index(path, "/", -1))
    return F.concat_ws(SEP, F.replace(name, F.lit("/"), F.lit(SEP)), F.lpad(row_index.cast("string"), 19, "0"))


def decoded_path(uri: Column) -> Column:
    """A listed (percent-encoded) URI as the path that the scan reports."""
    return F.url_decode(F.replace(same_form(uri), F.lit("+"), F.lit("%2B")))


def read_text_files(spark: SparkSession, path: str, hidden: bool = False, files: DataFrame | None = None) -> DataFrame:
    """Every file with suffix exactly ``.txt`` under ``path`` is one document.

    Strict UTF-8 (malformed input fails the job), ``\\r\\n`` / lone ``\\r`` become ``\\n`` as
    Python's text mode does; a BOM is kept, a file of no bytes is an empty document.  Hidden files
    and folders (``.x``, ``_x``) are skipped unless ``hidden``.  Tasks list the folders and read the files;
    ``files`` (path, length) is such a listing, if there is one.

    In a store that only Spark's readers know, Spark lists on the driver, hidden files are always
    skipped, and files of no bytes, which a scan gives no row, are taken from that listing.
    """
    fs, root = hadoop_path(spark, path)
    if not fs.exists(root):
        raise FileNotFoundError(f"no such folder: {path}")
    if known_store(root.toString()):
        raw = read_files(list_files(spark, root.toString(), (".txt",), hidden) if files is None else files)
        texts = raw.select("path", normalize_v0(F.decode(F.col("content"), "UTF-8")).alias("text"))
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
        listed = spark.createDataFrame([(f,) for f in raw.inputFiles()], "uri string").select(decoded_path(F.col("uri")).alias("path"))
        empty = listed.join(raw.select("path"), "path", "left_anti").select("path", F.lit("").alias("text"))
        texts = raw.select("path", normalize_v0(F.decode(F.col("content"), "UTF-8")).alias("text")).union(empty)
    zero = F.lit(0).cast("bigint")
    return texts.select(order_key(F.col("path"), zero, root.toString()).alias("doc_key"), F.col("path").alias("file_path"), zero.alias("row_index"), "text")


def _check_text_column(spark: SparkSession, df: DataFrame, root: str, files: DataFrame | None) -> None:
    """Every Parquet file must have a string column ``text``.  Spark takes a table's schema from one
    file and reads others as null, so tasks read the footers of the files that tasks list."""

    def look(batches):
        import pyarrow.parquet as pq

        for b in batches:
            out = []
            for uri in b.column(0).to_pylist():
                system, name = open_store(uri)
                schema = pq.read_schema(name, filesystem=system)
                kind = str(schema.field("text").type) if "text" in schema.names else "missing"
                if kind not in ("string", "large_string"):
                    out.append((uri, kind))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], names=["uri", "kind"])

    if not known_store(root):  # a store that only Spark's readers know: footer by footer
        for f in df.inputFiles():
            types = dict(spark.read.parquet(f).dtypes)
            if types.get("text") != "string":
                raise ValueError(f"{f}: column 'text' is {types.get('text', 'missing')}, expected a string")
        return
    if files is None:
        is_file = root.endswith(".parquet") and hadoop_path(spark, root)[0].getFileStatus(hadoop_path(spark, root)[1]).isFile()
        files = spark.createDataFrame([(root,)], "path string") if is_file else list_files(spark, root, (".parquet",))
    files = files.select("path")
    tasks = max(1, min(files.count() // 16, spark.sparkContext.defaultParallelism * 4))
    bad = files.repartition(tasks, "path").mapInArrow(look, "uri string, kind string").limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"{r['uri']}: column 'text' is {r['kind']}, expected a string" for r in bad))


MOST_NAMED = 10_000  # files that Spark is told by name
GLOB_MARKS = r"[\\{}\[\]*?]"


def _named(files: DataFrame | None) -> list[str]:
    """The files of a listing by name, so that Spark does not list the folders again, among which may be
    one for each text file; none if there are very many, or if Spark would take a name for a pattern."""
    if files is None or not files.where(F.col("path").rlike(GLOB_MARKS)).isEmpty():
        return []
    names = [r["path"] for r in files.select("path").limit(MOST_NAMED + 1).collect()]
    return sorted(names) if len(names) <= MOST_NAMED else []


def read_parquet_text(spark: SparkSession, path: str, extra_cols: Iterable[str] = (), files: DataFrame | None = None) -> DataFrame:
    """Only column ``text`` (plus ``extra_cols``), nulls dropped.

    Column pruning and the null filter reach the Parquet reader (ReadSchema / PushedFilters).  Any
    file without ``text``, or with one that isn't a string, is an error (Spark's cast and
    Python's ``str()`` disagree for other types).
    """
    _, root = hadoop_path(spark, path)
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(*(_named(files) or [path]))
    _check_text_column(spark, df, root.toString(), files)
    path_col = decoded_path(F.col("_metadata.file_path"))
    row = F.col("_metadata.row_index").cast("bigint")
    return df.where(F.col("text").isNotNull()).select(
        order_key(path_col, row, root.toString()).alias("doc_key"), path_col.alias("file_path"), row.alias("row_index"), F.col("text").cast("string").alias("text"), *extra_cols
    )


def read_corpus(spark: SparkSession, path: str, hidden: bool = False) -> DataFrame:
    """S1 + S2 + S3: ``.txt`` and ``.parquet`` files under ``path`` in corpus order.

    Returns ``(doc_key, file_path, row_index, text)``; sort by ``doc_key`` for the order, or number
    the rows by ``ranked``.  ``hidden`` holds for text files.
    """
    fs, root = hadoop_path(spark, path)
    if not fs.exists(root):
        raise FileNotFoundError(f"no such folder: {path}")

    text, table, parts = None, None, []
    if known_store(root.toString()):
        listed = list_files(spark, root.toString(), (".txt", ".parquet"), hidden)
        below = F.substring("path", len(root.toString().rstrip("/")) + 1, 1 << 30)
        text = listed.where(F.col("path").endswith(".txt"))
        table = listed.where(F.col("path").endswith(".parquet") & ~below.rlike("/[._]"))  # Spark's reader skips hidden ones

    def some(files: DataFrame | None, suffix: str) -> bool:
        if files is not None:
            return not files.isEmpty()
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path).inputFiles())

    if some(text, ".txt"):
        parts.append(read_text_files(spark, path, hidden, text))
    if some(table, ".parquet"):
        parts.append(read_parquet_text(spark, path, files=table))
    if not parts:
        raise FileNotFoundError(f"{path} holds no .txt and no .parquet file")
    return reduce(DataFrame.unionByName, parts)


def ranked(docs: DataFrame, key: str = "doc_key", out: str = "rank") -> DataFrame:
    """S3 as a dense rank from 0: every row's place in the order of the unique ``key``.

    Rows are range-ordered into slices, slices' sizes are added up, rows are numbered inside their
    slice (``packing.prefix_offsets``): select what is needed first, all columns move once.
    """
    return prefix_offsets(docs.withColumn("_one", F.lit(1).cast("bigint")), [], key, "_one", out).drop("_one")


def read_sources(spark: SparkSession, sources: list[Mapping[str, str]], raw_dir: str | None = None) -> DataFrame:
    """Configured multi-source acquisition -> (source_no, source_id, file_path, text).

    Each source is ``{type: "fixture", path, id}``; the file becomes one document tagged with
    ``source_id``, an empty file an empty one; ``source_no`` is its place in the list.  Empty list,
    unknown type, missing key or repeated id -> ``ValueError``; missing file -> ``FileNotFoundError``.
    With ``raw_dir`` the result is also written there as Parquet partitioned by ``source_id``.
    """
    if not sources:
        raise ValueError("no sources are configured")
    rows = []
    for i, src in enumerate(sources):
        if src.get("type") != "fixture":
            raise ValueError(f"source {i}: type {src.get('type')!r} is not known")
        if lacks := [k for k in ("path", "id") if k not in src]:
            raise ValueError(f"source {i} lacks {', '.join(lacks)}")
        if str(src["id"]) in {r[1] for r in rows}:
            raise ValueError(f"source id {src['id']!r} is used twice")
        fs, p = hadoop_path(spark, str(src["path"]))
        if not fs.exists(p) or not fs.getFileStatus(p).isFile():
            raise FileNotFoundError(f"source {i}: no such file: {src['path']}")
        rows.append((i, str(src["id"]), p.toString()))
    table = spark.createDataFrame(rows, "source_no int, source_id string, file_path string")
    read = spark.read.format("binaryFile").load(sorted({r[2] for r in rows}))
    texts = read.select(F.col("path").alias("file_path"), normalize_v0(F.decode(F.col("content"), "UTF-8")).alias("text"))
    out = table.join(texts, "file_path", "left").select("source_no", "source_id", "file_path", F.coalesce("text", F.lit("")).alias("text"))
    if raw_dir is not None:
        export_parquet(out, raw_dir, ["source_id"])
    return out


def export_parquet(df: DataFrame, out: str, partition_by: Iterable[str] = ()) -> None:
    """Write a processed corpus as Parquet."""
    w = df.write.mode("overwrite")
    cols = list(partition_by)
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(out)


def balance(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan that yields fewer partitions than the cluster has task slots.

    A single large Parquet row group is one input split, so every per-document
    expression before the first shuffle would run in one task.  A big corpus
    arrives in many splits and passes through unchanged (no extra shuffle); a thin
    one is hash-partitioned on ``keys`` (deterministic under recomputation).
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    current = df.rdd.getNumPartitions()
    if current >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)
