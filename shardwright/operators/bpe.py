"""Byte-level BPE with the corpus kept in DataFrames.

Id layout (fixed): 0..255 are the bytes, 256..256+S-1 the specials in declaration
order, then one id per learned merge in learning order.

Training keeps a table ``state(s, w)`` of *distinct* plain chunks (``w`` = how many
times the chunk occurs) where ``s`` holds one code point per token (see
``functions.codepoints``).  A pass over it learns many merges: the frequent pairs of the moment
cut the corpus into short pieces that repeat, so that the distinct pieces, of bounded size, tell
the next merges exactly (``_train_loop``).  The driver sees the pairs it considers and the merges.

Encoding applies all merges once, in learned order: a merge of rank r only creates
pairs containing its new id, and every merge using that id has a higher rank, so
this equals "repeatedly merge the lowest-ranked present pair".
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardwright.functions.arrow_encode import slices_of
from shardwright.functions.codepoints import MAX_VOCAB, byte_string, cp_to_id, ids_of, tok
from shardwright.functions.symbols import Joins, Merger, learn, pair_sums, pieces
from shardwright.operators.specials import special_ids, split_special
from shardwright.session import checkpoint_dir, drop_folder, store_at

log = logging.getLogger(__name__)

KEY_SHIFT = 21  # 2**21 > 0x10FFFF: a pair of code points packs into one BIGINT
KEY_MUL = 1 << KEY_SHIFT
BYTES_PER_PARTITION = 32 << 20  # of the training state


# --------------------------------------------------------------------------- model


@dataclass(frozen=True)
class BPEModel:
    """Vocabulary-sized metadata: specials, ordered merges, declared vocab size."""

    specials: tuple[str, ...] = ()
    merges: tuple[tuple[int, int], ...] = ()
    vocab_size: int | None = None
    pair_counts: tuple[int, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        special_ids(self.specials)
        if self.vocab_size is None:
            object.__setattr__(self, "vocab_size", self.first_merge_id + len(self.merges))

    @property
    def first_merge_id(self) -> int:
        return 256 + len(self.specials)

    @property
    def special_ids(self) -> dict[str, int]:
        return special_ids(self.specials)

    @property
    def known_ids(self) -> int:
        """Ids with bytes: bytes, specials, learned merges (ids up to vocab_size may be unused)."""
        return self.first_merge_id + len(self.merges)

    def vocab_bytes(self) -> list[bytes]:
        """Bytes of every known id, replaying the merges."""
        out = [bytes([i]) for i in range(256)]
        out += [s.encode("utf-8") for s in self.specials]
        for a, b in self.merges:
            out.append(out[a] + out[b])
        return out

    def merges_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (r, a, b, self.first_merge_id + r, self.pair_counts[r] if r < len(self.pair_counts) else None)
            for r, (a, b) in enumerate(self.merges)
        ]
        schema = "rank int, left_id int, right_id int, new_id int, pair_count bigint"
        return spark.createDataFrame(rows, schema)

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        kinds = ["byte"] * 256 + ["special"] * len(self.specials) + ["merge"] * len(self.merges)
        rows = [(i, k, bytearray(b)) for i, (k, b) in enumerate(zip(kinds, self.vocab_bytes()))]
        return spark.createDataFrame(rows, "token_id int, kind string, bytes binary")


# ------------------------------------------------------------------ T2 / T3 / T4


def chunk_table(docs: DataFrame, specials: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """Distinct non-empty plain chunks with multiplicity, as byte strings ``(s, w)``.

    Identical chunks collapse into one row with a weight, which also absorbs a hot
    duplicate (a text repeated across a third of the corpus is one row).
    """
    if specials:
        segs = docs.select(F.explode(split_special(F.col(text_col), specials)).alias("seg"))
        plain = segs.where(~F.col("seg.is_special")).select(F.col("seg.chunk").alias("chunk"))
    else:
        plain = docs.select(F.col(text_col).alias("chunk"))
    plain = plain.where(F.col("chunk").isNotNull() & (F.col("chunk") != F.lit("")))
    return plain.groupBy("chunk").agg(F.count(F.lit(1)).alias("w")).select(byte_string(F.col("chunk")).alias("s"), "w")


def pair_counts(state: DataFrame) -> DataFrame:
    """T3 over ``state(s, w)``: ``(k BIGINT, n BIGINT)`` with k = packed code-point pair.

    One regex pass with a lookahead capture yields every overlapping two-token
    string; they are summed by a partial + final aggregate and packed into keys only
    after the aggregation (at most one row per distinct pair).
    A zero-width match steps over one UTF-16 unit, so strings with supplementary code points are cut
    into symbols first.
    """
    cut = F.split("s", "")
    zipped = F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda c, i: F.concat(c, F.get(cut, i + 1)))
    by_regex = F.regexp_extract_all("s", F.lit("(?s)(?=(..))"), F.lit(1))
    pair = F.when(F.col("s").rlike("[\\x{10000}-\\x{10FFFF}]"), zipped).otherwise(by_regex)
    pairs = state.select(F.explode(pair).alias("p"), "w")
    summed = pairs.groupBy("p").agg(F.sum("w").alias("n"))
    left = F.ascii(F.substring("p", 1, 1)).cast("bigint")
    right = F.ascii(F.substring("p", 2, 1)).cast("bigint")
    return summed.select((left * F.lit(KEY_MUL) + right).alias("k"), "n")


def unpack_pair(k: Column) -> tuple[Column, Column]:
    """(left_id, right_id) of a packed code-point pair."""

    def to_id(cp: Column) -> Column:
        return F.when(cp > F.lit(0xDFFF), cp - F.lit(0x800)).otherwise(cp).cast("int")

    return to_id(F.shiftright(k, KEY_SHIFT)), to_id(k.bitwiseAND(F.lit(KEY_MUL - 1)))


def best_pair(counts: DataFrame) -> DataFrame:
    """T4: most frequent pair, ties to the smallest (left, right) -- a top-1, not a sort."""
    left, right = unpack_pair(F.col("k"))
    return (
        counts.select(left.alias("left_id"), right.alias("right_id"), F.col("n"))
        .orderBy(F.desc("n"), F.asc("left_id"), F.asc("right_id"))
        .limit(1)
    )


# ---------------------------------------------------------------- T5 / T6 (train)


TOP_PAIRS = 1 << 16  # pairs that a pass may consider
HELD_SYMBOLS = 1 << 20  # symbols of the distinct pieces that a task holds before it gives them on
MOST_SYMBOLS = 1 << 20  # symbols of the distinct pieces that one pass learns from


@dataclass
class TrainReport:
    rounds: int = 0
    passes: int = 0
    seconds_round0: float = 0.0
    seconds_rounds: float = 0.0
    piece_symbols: int = 0  # the most that a pass learned from
    merges_of_passes: list[int] = field(default_factory=list)


def train_bpe(
    docs: DataFrame,
    vocab_size: int,
    specials: Sequence[str] = (),
    text_col: str = "text",
    checkpoint_every: int = 1,
    num_partitions: int | None = None,
    report: TrainReport | None = None,
    speculate: bool = True,
) -> BPEModel:
    """Learn ``vocab_size - 256 - len(specials)`` merges (fewer only if no pair is left).

    Deterministic and independent of row order.  Merges cross spaces and newlines
    (no pre-tokenisation); pairs never cross a special token or a document.

    The state is written every ``checkpoint_every`` passes and cached in between.  Without
    ``speculate`` a pass learns one merge.
    """
    specials = tuple(specials)
    first = 256 + len(special_ids(specials))
    if vocab_size < first:
        raise ValueError(
            f"{vocab_size} ids cannot hold the bytes and {len(specials)} specials, which take {first}"
        )
    if vocab_size > MAX_VOCAB:
        raise ValueError(f"vocab_size {vocab_size} exceeds the supported maximum {MAX_VOCAB}")
    num_merges = vocab_size - first
    report = report if report is not None else TrainReport()
    spark = docs.sparkSession
    if num_merges == 0:
        return BPEModel(specials, (), vocab_size)

    if not num_partitions:  # as many as the input needs, and one per slot at least
        size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).collect()[0]["n"]
        num_partitions = max(spark.sparkContext.defaultParallelism, 1, -(-size // BYTES_PER_PARTITION))

    # without AQE the chunk grouping yields exactly that many hash partitions: the state is
    # spread over the cluster without a second shuffle
    conf = spark.conf
    saved = {k: conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    conf.set("spark.sql.adaptive.enabled", "false")
    conf.set("spark.sql.shuffle.partitions", str(num_partitions))
    try:
        return _train_loop(chunk_table(docs, specials, text_col), specials, num_merges, vocab_size, checkpoint_every, report, speculate)
    finally:
        for k, v in saved.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)


def _train_loop(chunks, specials, num_merges, vocab_size, checkpoint_every, report, speculate) -> BPEModel:
    """Passes over ``state(s, w)``, each of which learns as many merges as it can prove.

    A pass counts all pairs and takes the first h of them in merge order (count, then ids).  Every
    chunk is cut wherever two neighbours are none of these h; pieces of one symbol go, equal pieces
    are one row with the sum of their weights.  Inside the pieces learning goes on as if they were the
    corpus, as long as the best pair comes before e, the first pair left out.  That is exact:

    * an occurrence of a considered pair is never cut, so its count is the corpus's;
    * a new symbol X made of (a, b) always ends in the same symbol z of the pass's alphabet, so (X, c)
      occurs only where (z, c) did: all its occurrences are in the pieces, or all are cut, and then its
      count is at most that of (z, c), which doesn't come before e; nor does (X, c), being no more
      frequent and having the greater ids.  The same holds for (c, X) and (X, Y).

    h is chosen so that the pieces have at most MOST_SYMBOLS symbols in all (re-cut with a smaller
    h if they have more, down to the best pair alone), so one task can learn from them.
    The corpus itself is only scanned: to count, to cut and to apply the merges of a pass.
    """
    t0 = time.time()
    spark = chunks.sparkSession
    first = 256 + len(specials)
    state = _State(chunks, checkpoint_every)
    merges: list[tuple[str, str, int]] = []
    share = 0.3  # of the best pair's count, down to which pairs are considered
    report.seconds_round0 = time.time() - t0
    t1 = time.time()
    while len(merges) < num_merges:
        rows = symbol_pairs(state.df).orderBy(F.desc("n"), F.asc("k")).limit(TOP_PAIRS + 1).collect()
        if not rows:
            break  # no pair left anywhere
        pairs = [(int(r["n"]), chr(r["k"] >> KEY_SHIFT) + chr(r["k"] & (KEY_MUL - 1))) for r in rows]
        most = min(TOP_PAIRS, len(pairs))
        h = max(1, sum(n >= share * pairs[0][0] for n, _ in pairs[:most]), _surely(pairs[:most]))
        if not speculate:
            h = 1
        kept, folder = _pieces(state.df, pairs[:h])
        while (size := kept.agg(F.coalesce(F.sum(F.char_length("s")), F.lit(0)).alias("n")).collect()[0]["n"]) > MOST_SYMBOLS and h > 1:
            h = max(1, h // 2)
            share = min(0.9, max(share, pairs[h - 1][0] / pairs[0][0]))
            fewer = _pieces(kept, pairs[:h])
            drop_folder(spark, folder)
            kept, folder = fewer
        if size * 8 < MOST_SYMBOLS:
            share = max(0.02, share * 0.6)
        wanted = min(num_merges - len(merges), 1 if not speculate else num_merges)
        new = [tok(first + len(merges) + i) for i in range(wanted)]
        learned = _learned(kept, new, pairs[h] if h < len(pairs) else None)
        drop_folder(spark, folder)
        report.passes += 1
        report.piece_symbols = max(report.piece_symbols, size)
        report.merges_of_passes.append(len(learned))
        log.debug("pass %d: %d of %d pairs, %d symbols, %d merges", report.passes, h, len(pairs), size, len(learned))
        merges += learned
        if len(merges) < num_merges:
            state.apply([(a, b, x) for (a, b, _), x in zip(learned, new)])
    state.drop()
    report.rounds = len(merges)
    report.seconds_rounds = time.time() - t1
    ids = tuple((cp_to_id(ord(a)), cp_to_id(ord(b))) for a, b, _ in merges)
    return BPEModel(specials, ids, vocab_size, tuple(n for _, _, n in merges))


def _surely(pairs: list[tuple[int, str]]) -> int:
    """How many of the first pairs make pieces that fit whatever repeats: two symbols an occurrence."""
    total = h = 0
    for n, _ in pairs:
        total += 2 * n
        if total > MOST_SYMBOLS:
            break
        h += 1
    return h


class _State:
    """The chunks ``(s, w)`` as merged so far: written to the shared folder every ``every`` passes
    (one state is kept there), cached in between."""

    def __init__(self, chunks: DataFrame, every: int):
        self.spark, self.every, self.age, self.folder, self.cached = chunks.sparkSession, max(1, every), 0, "", []
        self._write(chunks)

    def _write(self, df: DataFrame) -> None:
        old, self.folder = self.folder, f"{checkpoint_dir(self.spark)}/bpe-state-{uuid.uuid4().hex}"
        self.df = store_at(df, self.folder)
        for c in self.cached:
            c.unpersist()
        self.cached, self.age = [], 0
        if old:
            drop_folder(self.spark, old)

    def apply(self, merges: list[tuple[str, str, str]]) -> None:
        def work(batches):
            merger = Merger(merges)
            for b in (part for batch in batches for part in slices_of(batch, 0)):
                s = [merger.merge(x) for x in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), b.column(1)], names=["s", "w"])

        merged = self.df.select("s", "w").mapInArrow(work, "s string, w bigint").where(F.char_length("s") > 1)
        self.age += 1
        if self.age >= self.every:
            self._write(merged)
        else:
            self.df = merged.persist(StorageLevel.MEMORY_AND_DISK)
            self.cached.append(self.df)

    def drop(self) -> None:
        for c in self.cached:
            c.unpersist()
        drop_folder(self.spark, self.folder)


def symbol_pairs(state: DataFrame) -> DataFrame:
    """T3 over ``state(s, w)`` in Arrow batches: ``(k BIGINT, n BIGINT)`` like ``pair_counts``, for any alphabet."""

    def work(batches):
        for b in (part for batch in batches for part in slices_of(batch, 0)):
            for k, n in pair_sums(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["k", "n"])

    return state.select("s", "w").mapInArrow(work, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))


def _pieces(state: DataFrame, pairs: list[tuple[int, str]]) -> tuple[DataFrame, str]:
    """Distinct pieces ``(s, w)`` of the strings, cut wherever two neighbours are none of ``pairs``; their folder."""
    keys = np.array(sorted((ord(p[0]) << KEY_SHIFT) | ord(p[1]) for _, p in pairs), np.int64)

    def work(batches):
        joins, held, size = Joins(keys), {}, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["s", "w"])

        for b in (part for batch in batches for part in slices_of(batch, 0)):
            for s, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x, y in pieces(s, joins):
                    piece = s[x:y]
                    if (n := held.get(piece)) is None:
                        size += y - x
                        held[piece] = w
                    else:
                        held[piece] = n + w
                if size > HELD_SYMBOLS:
                    yield out()
                    held, size = {}, 0
        yield out()

    cut = state.select("s", "w").mapInArrow(work, "s string, w bigint").groupBy("s").agg(F.sum("w").alias("w"))
    folder = f"{checkpoint_dir(state.sparkSession)}/bpe-pieces-{uuid.uuid4().hex}"
    return store_at(cut, folder), folder


def _learned(kept: DataFrame, new: list[str], until: tuple[int, str] | None) -> list[tuple[str, str, int]]:
    """The merges that a pass's pieces (at most MOST_SYMBOLS symbols, so one task's) allow."""

    def work(batches):
        strings, weights = [], []
        for b in batches:
            strings += b.column(0).to_pylist()
            weights += b.column(1).to_pylist()
        out = learn(strings, weights, new, until, len(new))
        columns = [pa.array(range(len(out)), pa.int64()), *(pa.array([m[i] for m in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64())))]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "a", "b", "n"])

    rows = kept.select("s", "w").coalesce(1).mapInArrow(work, "i bigint, a string, b string, n bigint").collect()
    return [(r["a"], r["b"], int(r["n"])) for r in sorted(rows, key=lambda r: r["i"])]


# ------------------------------------------------------------------- T8 (encode)

FOLD_LIMIT = 64  # merges applied as a nested replace() chain inside whole-stage codegen


def apply_merges(s: Column, model: BPEModel, method: str = "auto") -> Column:
    """Apply every merge once, in learned order, to a token string."""
    pairs = [tok(a) + tok(b) for a, b in model.merges]
    news = [tok(model.first_merge_id + r) for r in range(len(model.merges))]
    if not pairs:
        return s
    if method == "auto":
        method = "fold" if len(pairs) <= FOLD_LIMIT else "aggregate"
    if method == "fold":
        for p, x in zip(pairs, news):
            s = F.replace(s, F.lit(p), F.lit(x))
        return s
    if method == "aggregate":
        table = F.arrays_zip(F.lit(pairs).alias("p"), F.lit(news).alias("x"))
        return F.aggregate(table, s, lambda acc, e: F.replace(acc, e["p"], e["x"]))
    raise ValueError(f"unknown merge method {method!r}")


def encode(text: Column, model: BPEModel, allow_specials: bool = True, method: str = "auto") -> Column:
    """Text -> ARRAY<INT> token ids (JVM-side)."""
    specials = model.specials if allow_specials else ()
    if not specials:
        return ids_of(apply_merges(byte_string(text), model, method))
    ids = model.special_ids
    id_map = F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), F.lit(v))])
    segs = split_special(text, specials)
    return F.flatten(
        F.transform(
            segs,
            lambda seg: F.when(seg["is_special"], F.array(F.element_at(id_map, seg["chunk"]).cast("int"))).otherwise(
                ids_of(apply_merges(byte_string(seg["chunk"]), model, method))
            ),
        )
    )


def encode_documents(
    docs: DataFrame,
    model: BPEModel,
    text_col: str = "text",
    out_col: str = "ids",
    allow_specials: bool = True,
    method: str = "auto",
) -> DataFrame:
    """T8 over a DataFrame.  ``method="arrow"`` applies the merges in Arrow batches
    (``mapInArrow``, merge list shipped once per task), and so does ``"auto"`` beyond
    ``FOLD_LIMIT`` merges, where JVM expressions of that many calls are several times slower."""
    if method == "auto" and len(model.merges) > FOLD_LIMIT:
        method = "arrow"
    if method != "arrow":
        return docs.withColumn(out_col, encode(F.col(text_col), model, allow_specials, method))
    from shardwright.functions.arrow_encode import encode_partitions

    schema = T.StructType(docs.schema.fields + [T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(encode_partitions(model, docs.columns.index(text_col), out_col, allow_specials), schema)


# ------------------------------------------------------------------- T9 (decode)


def decode(ids: Column, model: BPEModel) -> Column:
    """Ids -> text; bytes concatenated, invalid UTF-8 replaced by U+FFFD.

    The vocabulary (bounded by vocab_size) travels as one literal array; unknown ids
    (including ids between the last learned merge and vocab_size) raise.
    """
    hexes = [b.hex().upper() for b in model.vocab_bytes()]
    vocab = F.lit(hexes)
    n = len(hexes)
    unknown = F.exists(ids, lambda i: (i < F.lit(0)) | (i >= F.lit(n)))
    joined = F.array_join(F.transform(ids, lambda i: F.try_element_at(vocab, i + 1)), "")
    valid = F.make_valid_utf8(F.unhex(joined).cast("string"))
    bad = F.filter(ids, lambda i: (i < F.lit(0)) | (i >= F.lit(n)))
    return F.when(
        unknown, F.raise_error(F.concat(F.lit("no bytes for token id "), F.element_at(bad, 1).cast("string")))
    ).otherwise(F.coalesce(valid, F.lit("")))


def decode_documents(docs: DataFrame, model: BPEModel, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """T9 over a DataFrame, in Arrow batches: ``docs`` with ``out_col`` (not among its columns), null ids as an
    empty text.  The vocabulary goes to the tasks as one flat table of bytes with offsets, so the plan is
    as small for any vocabulary; unknown ids raise, as in ``decode``."""
    from shardwright.functions.arrow_encode import decode_partitions

    if out_col in docs.columns:
        raise ValueError(f"column {out_col!r} is there already")
    schema = T.StructType(docs.schema.fields + [T.StructField(out_col, T.StringType())])
    return docs.mapInArrow(decode_partitions(model, docs.columns.index(ids_col), out_col), schema)
