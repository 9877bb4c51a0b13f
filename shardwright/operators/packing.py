"""K1-K7: boundary markers, token offsets, fixed-size shards, id width, manifest."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardwright.session import checkpoint_dir, drop_folder, small_batches, store, store_at

UINT16_MAX_VOCAB = 1 << 16
ROWS_PER_SLICE = 50_000  # documents per slice of the prefix sums
TOKENS_PER_SLICE = 8 << 20  # of a range of documents that a task packs
TOKENS_PER_PART = 1 << 20  # that Python gives on at once
ROWS_PER_GROUP = 1024  # documents of a stored row group
TOKENS_PER_GROUP = 4 << 20  # of the shards of a stored row group
MOST_SLICES = 1 << 16  # bounds the offsets that every task gets; beyond it slices are larger


def add_boundaries(ids: Column, bos_id: int | None = None, eos_id: int | None = None) -> Column:
    """K1: optional bos first, optional eos last; an empty document still gets them."""
    parts = []
    if bos_id is not None:
        parts.append(F.array(F.lit(int(bos_id))))
    parts.append(ids)
    if eos_id is not None:
        parts.append(F.array(F.lit(int(eos_id))))
    return F.concat(*parts) if len(parts) > 1 else ids


def range_slices(sized: DataFrame, order_col: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``sized`` with ``_slice``: numbers of ranges of ``order_col`` in ascending order, about
    ``rows_per_slice`` rows each, whatever the type and density of the keys.  Written once
    in the shared checkpoint folder: the ranges are drawn once and later reads are pruned."""
    sized = store(sized, "sizes")
    n = max(1, -(-sized.count() // rows_per_slice))
    ranged = sized.repartitionByRange(n, order_col) if n > 1 else sized.coalesce(1)
    return store(ranged.withColumn("_slice", F.spark_partition_id()), "slices")


def prefix_offsets(
    df: DataFrame,
    part_cols: Sequence[str],
    order_col: str,
    size_col: str,
    out_col: str = "start",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """K3: exclusive running sum of ``size_col`` within ``part_cols`` ordered by
    ``order_col`` (any orderable key, unique within the partition).

    Never one window over all rows: rows are range-ordered by key into slices; the slices'
    totals get offsets in a window of one row per slice, and each row adds a running
    sum inside its slice.  ``df`` should hold nothing but keys and sizes.
    """
    part_cols = list(part_cols)
    rows = range_slices(df, order_col, rows_per_slice)
    before = lambda cols, by: Window.partitionBy(*cols).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*part_cols, "_slice").agg(F.sum(size_col).cast("bigint").alias("_t"))
    offsets = sums.withColumn("_o", F.coalesce(F.sum("_t").over(before(part_cols, "_slice")), F.lit(0))).drop("_t")
    joined = rows.join(offsets, [*part_cols, "_slice"])
    inside = F.coalesce(F.sum(size_col).over(before([*part_cols, "_slice"], order_col)), F.lit(0))
    return joined.withColumn(out_col, (F.col("_o") + inside).cast("bigint")).drop("_slice", "_o")


def token_offsets(docs: DataFrame, key: str = "doc_key", split: str = "split", ids: str = "ids") -> DataFrame:
    """K3: ``(key, split, n, start)``: tokens of each document and its place in its split's stream."""
    sized = docs.select(key, split, F.size(ids).cast("bigint").alias("n"))
    return prefix_offsets(sized, [split], key, "n", "start")


def shard_name(split: Column, shard_idx: Column) -> Column:
    """K6: ``{split}_{index:05d}.bin``."""
    return F.format_string("%s_%05d.bin", split, shard_idx)


def cut_shards(placed: DataFrame, shard_size: int, split: str = "split", ids: str = "ids") -> DataFrame:
    """K4: ``(split, start, ids)`` -> ``(split, shard_idx, filename, num_tokens, tokens)``.

    Each document contributes one fragment per shard it overlaps; a shard regroups
    its fragments by stream position.  Shards hold exactly ``shard_size`` tokens,
    only the last one per split is shorter; no gaps, no overlap; an empty stream
    has no shard.  A group never exceeds ``shard_size`` tokens.
    """
    if shard_size < 1:
        raise ValueError(f"a shard holds at least one token, not {shard_size}")
    S = F.lit(int(shard_size)).cast("bigint")
    n = F.size(ids).cast("bigint")
    start = F.col("start")

    def fragment(shard: Column) -> Column:
        lo = F.greatest(shard * S, start)
        hi = F.least((shard + 1) * S, start + n)
        return F.struct(
            shard.alias("shard_idx"),
            F.struct(lo.alias("pos"), F.slice(ids, (lo - start + 1).cast("int"), (hi - lo).cast("int")).alias("frag")).alias("f"),
        )

    # one fragment per overlapped shard, built in a single transform (a document is
    # never copied whole into each of its fragment rows)
    shards_of_doc = F.sequence(F.floor(start / S), F.floor((start + n - 1) / S))
    frags = (
        placed.where(F.size(ids) > 0)
        .select(split, F.explode(F.transform(shards_of_doc, fragment)).alias("g"))
        .select(split, "g.shard_idx", "g.f")
    )
    grouped = frags.groupBy(split, "shard_idx").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    tokens = F.flatten(F.transform("fs", lambda f: f["frag"]))
    return grouped.select(
        split,
        F.col("shard_idx").cast("int").alias("shard_idx"),
        shard_name(F.col(split), F.col("shard_idx")).alias("filename"),
        F.size(tokens).cast("bigint").alias("num_tokens"),
        tokens.alias("tokens"),
    )


def dtype_for_vocab(vocab_size: int) -> str:
    """K5: ``uint16`` when every id < 65536 fits, else ``uint32``."""
    if vocab_size < 1:
        raise ValueError(f"a vocabulary has at least one id, not {vocab_size}")
    return "uint16" if vocab_size <= UINT16_MAX_VOCAB else "uint32"


def manifest(shards: DataFrame, vocab_size: int, shard_size: int) -> DataFrame:
    """K7 as a table: one row per split present (empty splits are absent).

    The shard list itself is ``{split}_{i:05d}.bin`` for ``i < n_shards`` (K4 makes
    the indices contiguous), so the aggregate never gathers a list into one row.
    """
    return shards.groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_shards"),
        F.sum("num_tokens").cast("bigint").alias("num_tokens"),
    ).select(
        "split",
        "n_shards",
        "num_tokens",
        F.lit(dtype_for_vocab(vocab_size)).alias("dtype"),
        F.lit(int(vocab_size)).alias("vocab_size"),
        F.lit(int(shard_size)).alias("shard_size"),
    )


def pack_documents(
    docs: DataFrame,
    shard_size: int,
    key: str = "doc_key",
    split: str = "split",
    ids: str = "ids",
    bos_id: int | None = None,
    eos_id: int | None = None,
) -> DataFrame:
    """K1 + K3 + K4: tokenized, split-assigned documents -> shards, as ``cut_shards`` makes them.

    The tokens are bytes of two or four an id until shards are cut: a reader copies them instead of decoding them.
    They cross one exchange: they are range-ordered by (split, key) into slices and written with
    each document's place in its slice.  The slices' totals, a row each and at most MOST_SLICES, give every
    slice its offset; then tasks cut what they read into shards.  A shard that lies whole in a task's
    rows is done; only the heads and tails of those rows move again, to be joined.
    """
    if shard_size < 1:
        raise ValueError(f"a shard holds at least one token, not {shard_size}")
    marked = docs.select(F.col(key).alias("key"), F.col(split).alias("split"), add_boundaries(F.col(ids), bos_id, eos_id).alias("ids"))
    marked = marked.where(F.size("ids") > 0)
    packed = T.StructType([*marked.schema.fields[:2], T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    with small_batches(spark):
        marked = store_at(marked.mapInArrow(_pack, packed), folder, ROWS_PER_GROUP)
    total = marked.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    n_slices = min(MOST_SLICES, max(1, -(-total // TOKENS_PER_SLICE), min(spark.sparkContext.defaultParallelism, total >> 20)))
    ranged = marked.repartitionByRange(n_slices, "split", "key") if n_slices > 1 else marked.coalesce(1)
    kind = marked.schema["split"].dataType.simpleString()
    placed = ranged.sortWithinPartitions("split", "key").select("split", "n", "ids").mapInArrow(_place, f"split {kind}, n bigint, ids binary, slice int, at bigint")
    with small_batches(spark):
        placed = store(placed, "slices", ROWS_PER_GROUP)
    drop_folder(spark, folder)
    sums = placed.groupBy("slice", "split").agg(F.sum("n").alias("n")).collect()
    offsets, seen = {}, {}
    for r in sorted(sums, key=lambda r: r["slice"]):
        offsets[r["slice"], r["split"]] = seen.get(r["split"], 0)
        seen[r["split"]] = seen.get(r["split"], 0) + r["n"]
    shared = spark.sparkContext.broadcast(offsets)
    parts = f"split {kind}, shard_idx int, at bigint, tokens array<int>"
    rows = placed.select("split", "n", "ids", "slice", "at")
    whole, pieces = (rows.mapInArrow(_cutter(shared, shard_size, w), parts) for w in (True, False))
    joined = pieces.groupBy("split", "shard_idx").agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("fs"))
    rest = joined.select("split", "shard_idx", F.flatten(F.transform("fs", lambda f: f["tokens"])).alias("tokens"))
    shards = whole.select("split", "shard_idx", "tokens").unionByName(rest)
    return shards.select(
        F.col("split").alias(split),
        "shard_idx",
        shard_name(F.col("split"), F.col("shard_idx")).alias("filename"),
        F.size("tokens").cast("bigint").alias("num_tokens"),
        "tokens",
    )


def store_shards(shards: DataFrame, shard_size: int) -> DataFrame:
    """The shard table written once, in row groups of few shards: no reader holds more than one group."""
    with small_batches(shards.sparkSession):
        return store(shards, "shards", max(1, TOKENS_PER_GROUP // shard_size))


def _pack(batches):
    """(key, split, ids) -> (key, split, n, ids as bytes), in slices of TOKENS_PER_PART tokens, one row at least."""
    for b in batches:
        lists = b.column(2)
        if lists.values.null_count:
            raise ValueError("a token id is null")
        edges, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        cuts = (np.flatnonzero(np.diff((edges[1:] - edges[0]) // TOKENS_PER_PART)) + 1).tolist()
        for x, y in zip([0, *cuts], [*cuts, b.num_rows]):
            if y > x:
                data = [_to_bytes(values[edges[i] : edges[i + 1]]) for i in range(x, y)]
                columns = [b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), pa.array(np.diff(edges[x : y + 1])), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "split", "n", "ids"])


def _to_bytes(ids: np.ndarray) -> bytes:
    """Little-endian ids, two bytes each where that holds them all, else four (the number of ids tells which): all
    lowest bytes first, then all of the next, which compress better apart."""
    width = 2 if ids.min() >= 0 and ids.max() < UINT16_MAX_VOCAB else 4
    return b"".join((ids >> 8 * i).astype(np.uint8).tobytes() for i in range(width))


def _from_bytes(data: pa.Buffer, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    ids = planes[0].astype(np.int32)
    for i, plane in enumerate(planes[1:], 1):
        ids |= plane.astype(np.int32) << 8 * i
    return ids


def _place(batches):
    """Adds a slice's number and each document's place in it, counted per split."""
    number, at = TaskContext.get().partitionId(), {}
    for b in batches:
        places = []
        for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            places.append(at.get(s, 0))
            at[s] = places[-1] + n
        columns = [b.column(0), b.column(1), b.column(2), pa.array([number] * len(places), pa.int32()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["split", "n", "ids", "slice", "at"])


def _cutter(shared, shard_size: int, whole: bool):
    """Rows in stream order -> the shards that lie whole in a run of neighbouring documents, or the
    pieces at the run's ends that belong to shards shared with other tasks."""

    def cut(batches):
        offsets, kind = shared.value, None
        split, start, end, held = None, 0, 0, []  # the run's tokens that are in no part yet
        out, size = [], 0

        def take(upto: int) -> None:
            nonlocal start, held, size
            if upto > start:
                done = (start % shard_size == 0) and upto - start == shard_size
                tokens = held[0] if len(held) == 1 else np.concatenate(held)
                if done == whole:
                    out.append((split, start // shard_size, start, tokens[: upto - start]))
                    size += upto - start
                held = [tokens[upto - start :]]
                start = upto

        def ready() -> pa.RecordBatch:
            edges = np.concatenate([[0], np.cumsum([len(o[3]) for o in out])]).astype(np.int32)
            values = np.concatenate([o[3] for o in out]) if out else np.zeros(0, np.int32)
            columns = [pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64())]
            tokens = pa.ListArray.from_arrays(pa.array(edges), pa.array(values, pa.int32()))
            return pa.RecordBatch.from_arrays([*columns, tokens], names=["split", "shard_idx", "at", "tokens"])

        for b in batches:
            kind = b.column(0).type
            rows = zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), b.column(2))
            for s, n, number, at, data in rows:
                place = offsets[number, s] + at
                if s != split or place != end:
                    take(end)
                    split, start, end, held = s, place, place, []
                ids = _from_bytes(data.as_buffer(), n)
                held.append(ids)
                end += len(ids)
                while (edge := (start // shard_size + 1) * shard_size) <= end:
                    take(edge)
                if size >= TOKENS_PER_PART:
                    yield ready()
                    out, size = [], 0
        take(end)
        if out:
            yield ready()

    return cut
