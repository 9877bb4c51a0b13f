"""Operator 3: mixing sources to target weights, in blocks joined by index.

1. ``source_targets``: weights share ``ratio`` times all words; a source's target stops
   at ``most`` times its size and the excess is shared out anew (exact fractions).
2. Every source's documents, in the order of (doc_id, size), are one stream of words cut
   into blocks of ``block`` words (the last may be shorter).
3. A source takes the slots that its target needs.  The output is a row of shards of
   ``shard_slots`` slots; the counts of each source per shard are multinomial draws
   conditioned on those totals (a multivariate hypergeometric law).  They are drawn down a
   binary tree of shard ranges, so every task finds any shard's counts, and the number of
   the source's first slot in it, in logarithmic time from the seed alone.
4. Slot j of a source means block ``perm(j mod n_blocks)`` of pass ``j div n_blocks``; perm is
   a keyed pseudorandom permutation of the index (Feistel rounds with cycle walking), so no
   block comes twice in a pass and none more than ``ceil(most)`` times in all.
5. Slots and documents' pieces are joined on (source, block).  Nothing is shuffled but
   indices and spans; a hot source is spread over its blocks.

The last slot of a source is cut where its target ends, so the words taken are the target
rounded to a whole word.

Defined cases: null and empty texts have size 0 and take 0; a null source is a source of its
own, last in order; rows may repeat (each is a piece of the stream of its own); an empty
table, or one without words, gives targets of 0; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm.common import WORD, slices, stored

WEIGHTS = (5, 2, 1)
SLICE = 2 << 20  # bytes of texts that are cut at once


def n_words(text: Column) -> Column:
    """Words of a text, null: none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def share_out(sizes: dict[str | None, int], weights=WEIGHTS, ratio: Fraction = Fraction(3, 2), most: int = 2) -> dict[str | None, Fraction]:
    """Targets by source.  Sources by code point, null last, weigh ``weights`` in turn; targets above
    ``most`` times the size are cut to it and the rest is shared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = ratio * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > most * sizes[s]}
        for s in full or free:
            out[s] = Fraction(most * sizes[s]) if full else unit * weight[s]
        left -= sum(out[s] for s in full)
        free = free - full if full else set()
    return out


# ---------------------------------------------------------------- index permutation


def _keys(seed: int, *parts, rounds: int = 6) -> np.ndarray:
    raw = hashlib.sha256(repr((seed, *parts)).encode()).digest() + hashlib.sha256(repr((seed, *parts, 1)).encode()).digest()
    return np.frombuffer(raw, "<u8")[:rounds]


def permute(i: np.ndarray, n: int, keys: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Images (or preimages) of the indices ``i`` under a keyed permutation of range(n)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def scramble(r: np.ndarray, k) -> np.ndarray:
        f = (r + k) * np.uint64(0x9E3779B97F4A7C15)
        f ^= f >> np.uint64(29)
        f *= np.uint64(0xBF58476D1CE4E5B9)
        return (f >> np.uint64(40)) & mask

    x, todo = i.astype(np.uint64), np.ones(len(i), bool)
    while todo.any():  # images outside range(n) walk on; fewer than 4 steps each on average
        left, right = x[todo] >> shift, x[todo] & mask
        for k in keys[::-1] if inverse else keys:
            left, right = (right ^ scramble(left, k), left) if inverse else (right, left ^ scramble(right, k))
        x[todo] = (left << shift) | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


# ---------------------------------------------------------------- counts per shard


def _split(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among ``n`` drawn without replacement from ``have``."""
    out, rest = np.zeros_like(have), int(have.sum())
    for i, good in enumerate(have.tolist()):
        bad = rest - good
        if rest <= 900_000_000:
            out[i] = rng.hypergeometric(good, bad, n) if n and good else 0
        else:  # beyond numpy's range: the same law's normal limit, within what is possible
            mean = n * good / rest
            sd = (mean * (1 - good / rest) * (rest - n) / max(1, rest - 1)) ** 0.5
            out[i] = min(max(round(rng.normal(mean, sd)), max(0, n - bad)), min(good, n))
        n, rest = n - int(out[i]), bad
    return out


def shard_counts(quota: np.ndarray, shard: int, n_shards: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots in it).  Halves the range of shards with
    conditioned multinomial draws until one shard is left; the same at every call."""
    low, high, have, before = 0, n_shards, quota.copy(), np.zeros_like(quota)
    while high - low > 1:
        mid = (low + high) // 2
        first = _split(np.random.default_rng([seed, low, high]), have, min(int(have.sum()), (mid - low) * size))
        if shard < mid:
            have, high = first, mid
        else:
            before, have, low = before + first, have - first, mid
    return before, have


# ---------------------------------------------------------------- the operator


def placed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs(key, source, size) -> with ``start``, the words of the source before this row.

    Two short windows instead of one over a source: inside buckets of consecutive keys, and over
    one row per bucket.  With b buckets a source, neither sees more than max(rows/b, b) rows."""
    rows = docs.count()
    b = max(16, int(rows**0.5))
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(b)).cast("int")
    d = docs.withColumn("_b", bucket)
    sums = d.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    over = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_sb"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "_b").orderBy(key, "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
    return d.withColumn("start", F.col("_before") + F.col("_in")).drop("_b", "_sb", "_s", "_before", "_in")


class Plan:
    """Sizes, targets, blocks and slots of every source: a few numbers a source, on the driver.
    ``max_sources`` bounds it; a table with more sources is refused."""

    def __init__(self, sized: DataFrame, block: int, weights=WEIGHTS, ratio=Fraction(3, 2), most: int = 2, seed: int = 11, max_sources: int = 100_000):
        got = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
        if len(got) > max_sources:
            raise ValueError(f"more than {max_sources} sources: mix by a coarser source column")
        self.block, self.seed = block, seed
        self.sizes = {r["source"]: int(r["n"] or 0) for r in got}
        self.targets = share_out(self.sizes, weights, ratio, most)
        self.order = sorted(self.sizes, key=lambda s: (s is None, s or ""))
        self.n_blocks, self.slots, self.last = [], [], []
        for k, s in enumerate(self.order):
            n, want = self.sizes[s], round(self.targets[s])
            blocks = -(-n // block)
            self.n_blocks.append(blocks)
            full, rest = divmod(want, n) if n else (0, 0)  # whole passes, then a part of one
            used, cut = 0, 0
            if rest:
                used = -(-rest // block)
                short = blocks * block - n  # words that the last block lacks
                short_at = permute(np.array([blocks - 1]), blocks, _keys(seed, k, full), inverse=True)[0]
                have = used * block - short * int(short_at < used)
                if have < rest:  # the short block is among them: one block more, at most
                    have += min(block, n - have)
                    used += 1
                cut = have - rest
            self.slots.append(full * blocks + used)
            self.last.append(cut)  # words not taken at the end of the last slot

    def table(self, spark) -> DataFrame:
        rows = [(s, k, self.sizes[s], float(self.targets[s])) for k, s in enumerate(self.order)]
        return spark.createDataFrame(rows, "source string, source_no int, source_size long, target double")


def slot_table(spark, plan: Plan, shard_slots: int = 4096) -> DataFrame:
    """The mix: shard, slot (place in the shard), source_no, pass_no, block, cut (words left off its end).
    Tasks make their shards' slots from the plan and the seed."""
    quota = np.array(plan.slots, np.int64)
    total = int(quota.sum())
    n_shards = max(1, -(-total // shard_slots))
    blocks, last, seed = plan.n_blocks, plan.last, plan.seed

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                before, have = shard_counts(quota, shard, n_shards, shard_slots, seed)
                order = np.random.default_rng([seed, shard]).permutation(int(have.sum()))
                at, cols = 0, []
                for k in np.flatnonzero(have).tolist():
                    j = before[k] + np.arange(have[k])
                    turn = j // blocks[k]
                    block = np.empty_like(j)
                    for t in np.unique(turn).tolist():
                        block[turn == t] = permute(j[turn == t] % blocks[k], blocks[k], _keys(seed, k, t))
                    cut = np.where(j == quota[k] - 1, last[k], 0)
                    cols.append((order[at : at + len(j)], np.full(len(j), k), turn, block, cut))
                    at += len(j)
                if cols:
                    slot, no, turn, block, cut = map(np.concatenate, zip(*cols))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(slot), shard)), pa.array(slot), pa.array(no.astype(np.int32)), pa.array(turn.astype(np.int32)), pa.array(block), pa.array(cut)],
                        names=["shard", "slot", "source_no", "pass_no", "block", "cut"],
                    )

    tasks = min(n_shards, max(spark.sparkContext.defaultParallelism, n_shards // 64))
    return spark.range(0, n_shards, 1, tasks).mapInArrow(make, "shard long, slot long, source_no int, pass_no int, block long, cut long")


class Mix:
    """docs(key, text, source) planned and placed.

    ``rows``: key, source_no, source_size, target, size, start; a row per row of docs.
    ``spans()``: the mix, a row per piece of a document that a slot takes; in the order of
    (shard, slot, a) the pieces are the mixed text."""

    def __init__(self, docs: DataFrame, block: int = 128, seed: int = 11, shard_slots: int = 4096, key: str = "doc_id"):
        self.key, self.block, self.shard_slots = key, block, shard_slots
        sized = stored(docs.select(key, F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "mix-sizes")
        self.plan = Plan(sized, block, seed=seed)
        names = self.plan.table(docs.sparkSession).withColumnRenamed("source", "_s")
        at = placed(sized, key).join(names, F.col("source").eqNullSafe(F.col("_s")))
        self.rows = stored(at.select(key, "source_no", "source_size", "target", "size", "start"), "mix-rows")

    def spans(self) -> DataFrame:
        """shard, slot, pass_no, key, source_no, start, size, a, from_word, words: a slot takes the document's
        ``words`` words from number ``from_word`` on; they begin at word ``a`` of the block."""
        b = self.block
        at = self.rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
        first = F.greatest(F.col("start"), F.col("block") * b)
        end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        at = at.withColumns({"a": first - F.col("block") * b, "_end": end - F.col("block") * b, "from_word": first - F.col("start")})
        # Spark takes the slots for as small as the range that they are made from: without the hint it broadcasts them
        slots = slot_table(self.rows.sparkSession, self.plan, self.shard_slots).hint("merge")
        mix = at.join(slots, ["source_no", "block"])
        in_block = F.least(F.lit(b).cast("bigint"), F.col("source_size") - F.col("block") * b)
        mix = mix.withColumn("words", F.least(F.col("_end"), in_block - F.col("cut")) - F.col("a")).where("words > 0")
        return mix.select("shard", "slot", "pass_no", self.key, "source_no", "start", "size", "a", "from_word", "words")


def taken_words(docs: DataFrame, block: int = 128, seed: int = 11, key: str = "doc_id") -> DataFrame:
    """key, size, source_size, target, taken for every row of docs."""
    mix = Mix(docs, block, seed, key=key)
    # rows with words have starts of their own within a source; rows without take nothing
    got = mix.spans().groupBy("source_no", "start").agg(F.sum("words").alias("_taken")).withColumn("_some", F.lit(True))
    out = mix.rows.withColumn("_some", F.col("size") > 0).join(got, ["source_no", "start", "_some"], "left")
    return out.select(key, "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("bigint").alias("taken"))


def _word_edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    solid = np.concatenate([[False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


def cut_text(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """The words that cuts (first word, number) name, in order; spans that touch keep the white
    space between them, others are joined by a newline; the whole text if every word is named."""
    runs: list[list[int]] = []
    for at, n in sorted(cuts):
        if runs and runs[-1][1] == at:
            runs[-1][1] += n
        else:
            runs.append([at, at + n])
    start, end = _word_edges(text)
    if runs == [[0, len(start)]]:
        return text
    return b"\n".join(text[start[x] : end[y - 1]] for x, y in runs)


def runs(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE bytes in field ``at`` of its first column, one row at least: the Python
    objects made of them at once are bounded, whatever the batch."""
    for a, b in slices(pc.fill_null(pc.binary_length(batch.column(0).flatten()[at]), 0).to_pylist(), SLICE):
        yield batch.slice(a, b - a)


def row_digest(docs: DataFrame) -> Column:
    """SHA-256 of a row: each column is a null mark or its length and value, so rows that hold the
    same values in other columns, or nulls in other places, differ."""
    texts = [F.col(f"`{c}`").cast("string") for c in docs.columns]
    parts = [F.when(x.isNull(), "n").otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def mixed_documents(docs: DataFrame, block: int = 128, seed: int = 11) -> DataFrame:
    """The mix as documents: a row per row of docs and pass that took some of it, with the
    words taken as text; other columns unchanged, a column ``n_chars`` counted anew.

    Spans are gathered per document (a list bounded by its own length), so the texts are
    shuffled once, by a digest of the whole row; identical rows share one text."""
    cols = docs.columns
    keyed = docs.select(row_digest(docs).alias("_row"), F.struct(*cols).alias("_doc"))
    spans = Mix(keyed.select("_row", "_doc.text", "_doc.source"), block, seed, key="_row").spans()
    passes = spans.groupBy("_row", "start", "pass_no").agg(F.collect_list(F.struct("from_word", "words")).alias("cuts"))
    cuts = passes.groupBy("_row").agg(F.sort_array(F.collect_list("cuts")).alias("_cuts"))
    both = keyed.dropDuplicates(["_row"]).join(cuts, "_row").select("_doc", "_cuts")
    at, chars = cols.index("text"), cols.index("n_chars") if "n_chars" in cols else None

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in runs(batch, at)):
            row, texts, have = [], [], b.column(0).flatten()
            for i, (text, lists) in enumerate(zip(have[at].cast(pa.binary()).to_pylist(), b.column(1).to_pylist())):
                for c in lists:
                    row.append(i)
                    texts.append(cut_text(text, [(x["from_word"], x["words"]) for x in c]).decode("utf-8", "replace"))
            out = [x.take(pa.array(row, pa.int64())) for x in have]
            out[at] = pa.array(texts, pa.string())
            if chars is not None:
                out[chars] = pa.array([len(x) for x in texts], out[chars].type)
            yield pa.RecordBatch.from_arrays(out, names=cols)

    return both.mapInArrow(write, docs.schema)
