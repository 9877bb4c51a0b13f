"""Operator 11: phrase collocations, counted in counting quotient filters.

Words are cut out of pieces of text; everything is counted per language.  The steps:

1. Tasks cut texts into words and number them as they come, a few MB of text (a shard) at a time: a
   shard is a list of word numbers, with 0 between pieces, and one row a distinct word.  Both are
   written once.
2. Words are counted from those rows; the words that occur ``least`` times get dense ids over all
   languages, and every shard gets back the ids of its own words (a cogroup by shard): no task and no
   broadcast holds the vocabulary.  A phrase with a rarer word is rarer still, so other words
   become breaks.
3. Two words: each run of about ``RUN_WORDS`` words packs its pairs of ids into integers, permutes them
   and sums them up as counting quotient filters (``quotient_filter``), one a section of the permuted
   keys.  Filters of a section are merged across runs, which are sorted alike; a section holds a bounded
   number of entries whatever the key, since a run sends each key once.  Counts are exact.
4. Three and four words: the same, over those places where all pairs of neighbours are frequent; a bitmap of bounded
   size tells (a full one lets more places through and changes no count).
5. Counts are joined as a table of phrases: each cut's parts, the longer phrases that cover one, scores.

Lost executors cost a reread: every step reads tables written to the shared folder, which are
deleted as soon as no later step needs them.

Defined cases: a null text is empty; a null language is ``und``; null and repeated ids and
repeated rows count like all others; ties are ordered by phrase in UTF-8 byte order; an empty
table, or one without phrases, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm import quotient_filter
from shardwright.llm.common import mix64, new_folder, spread, text_bytes
from shardwright.session import drop_folder

SHARD_BYTES = 8 << 20  # text of a shard
CHUNK_WORDS = 1 << 16  # word numbers of a stored row
RUN_WORDS = 3 << 20  # words counted at a time
SECTION_ENTRIES = 1 << 21  # bound of a section's entries, repeated keys of runs apart
FAN = 4096  # filters merged at a time
MOST_BITS = 28  # of the bitmap of frequent pairs: 32 MB
SALTS = 16  # copies of a word's count, which very many phrases ask for
ROW_GROUP = 16 << 20

#: A-Z lower-cased, tabs as spaces, all that ends a piece as line feeds.
BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))

OUT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


class Numbers(dict):
    """Words numbered from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class Shard:
    """The words of some texts of one language."""

    def __init__(self):
        self.numbers, self.codes = Numbers(), array("I")

    def add(self, text: bytes) -> None:
        number, codes = self.numbers.__getitem__, self.codes
        for piece in text.translate(BYTES).split(b"\n"):
            if words := piece.split():
                codes.extend(map(number, words))
                codes.append(0)

    def rows(self, shard: int, lang: str) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer(self.codes, np.uint32)
        n = np.bincount(codes, minlength=len(self.numbers) + 1)[1:]
        words, m = pa.array(list(self.numbers), pa.binary()), len(self.numbers)
        yield _batch(shard, lang, "word", np.arange(1, m + 1), words, n, pa.nulls(m, pa.binary()))
        parts = [codes[i : i + CHUNK_WORDS] for i in range(0, len(codes), CHUNK_WORDS)]
        for k in range(0, len(parts), 32):
            some = parts[k : k + 32]
            sizes = np.array([np.count_nonzero(p) for p in some])
            yield _batch(shard, lang, "codes", np.arange(k, k + len(some)), pa.nulls(len(some), pa.binary()), sizes, pa.array([p.tobytes() for p in some], pa.binary()))


def _batch(shard: int, lang: str, kind: str, local: np.ndarray, word: pa.Array, n: np.ndarray, codes: pa.Array) -> pa.RecordBatch:
    m = len(local)
    columns = [pa.array(np.full(m, shard)), pa.array([lang] * m, pa.string()), pa.array(local.astype(np.int32)), word, pa.array(n.astype(np.int64)), codes, pa.array([kind] * m, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "local", "word", "n", "codes", "kind"])


SHARD_SCHEMA = "shard long, lang string, local int, word binary, n long, codes binary, kind string"


def _kept(df: DataFrame, label: str, *by: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder in small row groups and read back, and its folder."""
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).partitionBy(*by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def _own_number(made: Iterator[int]) -> int:
    """A number that no other task of this job makes."""
    return (TaskContext.get().partitionId() << 24) + next(made)


def word_shards(docs: DataFrame) -> DataFrame:
    """Rows of kind ``word`` (shard, lang, local, word, n) and ``codes`` (shard, lang, local: place in
    the shard, n: words, codes: little-endian 32-bit word numbers, 0 after each piece)."""
    rows = spread(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_bytes().alias("text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size, shards = count(), 0, {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, s in shards.items():
                if s.codes:
                    yield from s.rows(_own_number(made), lang)
            shards.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text:
                    shards.setdefault(lang, Shard()).add(text)
                    size += len(text)
                if size >= SHARD_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows.mapInArrow(work, SHARD_SCHEMA)


def numbered_words(words: DataFrame, least: int) -> tuple[DataFrame, list[str]]:
    """(lang, word, f, id) of the words that occur ``least`` times or more, ids dense from 1; folders to drop."""
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    counted, first = _kept(frequent.withColumn("bucket", F.spark_partition_id()), "phrase-counts")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a written partition
    offsets = counted.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    numbered = counted.withColumn("place", place).join(offsets, "bucket").select("lang", "word", "f", (F.col("offset") + F.col("place")).alias("id"))
    out, second = _kept(numbered, "phrase-words")
    return out, [first, second]


def recoded(codes: DataFrame, words: DataFrame, numbered: DataFrame) -> DataFrame:
    """The shards' codes as rows (codes binary) of ids, 0 for breaks; runs of breaks are one, and words
    that stand alone between breaks are gone."""
    ids = words.select("lang", "word", F.col("shard").alias("owner"), F.col("local").alias("place")).join(numbered.select("lang", "word", "id"), ["lang", "word"]).select("owner", "place", "id")

    def recode(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left["local"].to_numpy())
        raw = left["codes"].to_pylist()
        local = np.frombuffer(b"".join(raw[i] for i in order), "<u4")
        table = np.zeros(int(local.max(initial=0)) + 1, np.uint32)
        table[right["place"].to_numpy()] = right["id"].to_numpy()
        x = table[local]
        word = np.concatenate([[False], x != 0, [False]])
        beside = word[1:-1] & (word[:-2] | word[2:])  # words with a neighbour
        x = x[beside | (np.concatenate([[False], beside[:-1]]) & ~beside)] if len(x) else x
        return pa.table({"codes": pa.array([c.tobytes() for c in _chunks(x)], pa.binary())})

    return codes.select("shard", "local", "codes").groupBy("shard").cogroup(ids.groupBy("owner")).applyInArrow(recode, "codes binary")


def _chunks(x: np.ndarray) -> Iterator[np.ndarray]:
    """Cut ids at breaks, into chunks of CHUNK_WORDS or a little more; each ends with a break."""
    breaks, a = np.flatnonzero(x == 0), 0
    while a < len(x):
        at = np.searchsorted(breaks, a + CHUNK_WORDS)
        b = int(breaks[at]) + 1 if at < len(breaks) else len(x)
        yield x[a:b] if x[b - 1] == 0 else np.append(x[a:b], np.uint32(0))
        a = b


def _slot(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Place of a pair of ids in the bitmap."""
    return (mix64((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def pair_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.uint64)
    at = np.flatnonzero((x[:-1] != 0) & (x[1:] != 0))
    return x[at], x[at + 1]


def longer_keys(x: np.ndarray, width: int, frequent: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Three and four words, all of whose pairs of neighbours have their bit set."""
    at = np.flatnonzero((x[:-1] != 0) & (x[1:] != 0))
    slot = _slot(x[at], x[at + 1], bits)
    ok = np.zeros(len(x) + 2, bool)
    ok[at] = (frequent[slot >> 3] >> (7 - (slot & 7))) & 1 == 1
    three = np.flatnonzero(ok[:-2] & ok[1:-1])
    four = three[ok[three + 2]]
    x, w = x.astype(np.uint64), np.uint64(width)
    hi = (x[three] << w) | x[three + 1]
    last = x[three + 2] << w
    return np.concatenate([hi, (x[four] << w) | x[four + 1]]), np.concatenate([last, (x[four + 2] << w) | x[four + 3]])


def run_filters(codes: DataFrame, half: int, top: int, width: int, shared=None, bits: int = 0) -> DataFrame:
    """(section, run, filter): the filters of runs of words; of pairs, or with a bitmap of longer phrases."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = None if shared is None else np.frombuffer(shared.value, np.uint8)
        made, held, size = count(), [], 0

        def flush() -> pa.RecordBatch:
            x = np.concatenate(held)
            hi, lo = pair_keys(x) if frequent is None else longer_keys(x, width, frequent, bits)
            out, run = quotient_filter.sections(hi, lo, half, top), _own_number(made)
            columns = [pa.array([s for s, _ in out], pa.int64()), pa.array([run] * len(out), pa.int64()), pa.array([f for _, f in out], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["section", "run", "filter"])

        for batch in batches:
            for raw in batch.column(0):
                held.append(np.frombuffer(raw.as_py(), "<u4"))
                size += len(held[-1])
                if size >= RUN_WORDS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return codes.mapInArrow(work, "section long, run long, filter binary")


def counted_keys(filters: DataFrame, runs: int, least: int, width: int, bits: int) -> DataFrame:
    """(w1, w2, w3, w4, a, slot) of the keys that occur ``least`` times or more; runs are merged in a
    tree of at most FAN filters at a time."""

    def merge(table: pa.Table) -> pa.Table:
        (hi, lo, n), half, top = quotient_filter.merged(table["filter"].to_pylist())
        return pa.table({"section": pa.array([table["section"][0].as_py()], pa.int64()), "run": pa.array([table["group"][0].as_py()], pa.int64()), "filter": pa.array([quotient_filter.encoded(hi, lo, n, half, top)], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        (hi, lo, n), half, _ = quotient_filter.merged(table["filter"].to_pylist())
        many = n >= least
        hi, lo = quotient_filter.inverted(hi[many], lo[many], half)
        zero, w, low = np.zeros(len(hi), np.int64), np.uint64(width), np.uint64((1 << width) - 1)
        cut = lambda x: ((x >> w).astype(np.int64), (x & low).astype(np.int64))
        ids = (hi.astype(np.int64), lo.astype(np.int64), zero, zero) if half == width else (*cut(hi), *cut(lo))
        slot = _slot(ids[0], ids[1], bits)
        return pa.table({"w1": ids[0], "w2": ids[1], "w3": ids[2], "w4": ids[3], "a": n[many].astype(np.int64), "slot": slot})

    while runs > FAN:
        runs = -(-runs // FAN)
        grouped = filters.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(runs)))
        filters = grouped.groupBy("section", "group").applyInArrow(merge, "section long, run long, filter binary")
    return filters.groupBy("section").applyInArrow(finish, "w1 long, w2 long, w3 long, w4 long, a long, slot long")


def pair_bitmap(pairs: DataFrame, bits: int) -> bytes:
    """The frequent pairs' bits; at most 2^MOST_BITS of them, so bounded whatever the input."""
    part_bits = min(16, bits)

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(1 << part_bits, np.uint8)
        x[pdf["slot"].to_numpy() & ((1 << part_bits) - 1)] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(x).tobytes()]})

    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    parts = pairs.select("slot", F.shiftright("slot", part_bits).alias("part")).distinct()
    for r in parts.groupBy("part").applyInPandas(fill, "part long, bits binary").toLocalIterator():
        size = len(r["bits"])
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


KEY = ["w1", "w2", "w3", "w4"]


def _phrase(*ids: str) -> Column:
    """A struct of four ids, 0 beyond its end."""
    named = [F.col(i) if i else F.lit(0).cast("bigint") for i in (*ids, *[""] * (4 - len(ids)))]
    return F.struct(*[c.alias(f"p{k}") for k, c in enumerate(named, 1)])


#: (cut, side, part) of a phrase by its number of words.
CUTS = {m: [(k, s, KEY[:k] if s == "l" else KEY[k:m]) for k in range(1, m) for s in "lr"] for m in (2, 3, 4)}
#: Shorter phrases of two words or more inside a phrase.
INSIDE = {m: [KEY[i : i + k] for k in range(2, m) for i in range(m - k + 1)] for m in (2, 3, 4)}

def scored_phrases(phrases: DataFrame, numbered: DataFrame, scale: int, cover: int) -> DataFrame:
    """(w1..w4, a, lang, l, r, score) of the phrases that no longer one covers."""
    m = F.when(F.col("w3") == 0, 2).when(F.col("w4") == 0, 3).otherwise(4).alias("m")
    pick = lambda rows: F.when(F.col("m") == 2, rows(2)).when(F.col("m") == 3, rows(3)).otherwise(rows(4))
    part = lambda k, s, ids: F.struct(F.lit(f"{s}{k}").alias("part"), _phrase(*ids).alias("p"))
    asked = phrases.select(*KEY, m).select(*KEY, F.explode(pick(lambda n: F.array(*[part(*c) for c in CUTS[n]]))).alias("x")).select(*KEY, "x.part", "x.p.*")
    salt = F.when(F.col("p2") == 0, F.pmod(F.xxhash64(*KEY), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))
    none = F.lit(0).cast("bigint")
    words = numbered.select(F.col("id").alias("p1"), none.alias("p2"), none.alias("p3"), none.alias("p4"), F.col("f"), "lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    known = phrases.where(F.col("w4") == 0).select(*[F.col(w).alias(f"p{i}") for i, w in enumerate(KEY, 1)], F.col("a").alias("f"), F.lit(None).cast("string").alias("lang"), none.alias("salt"))
    got = asked.withColumn("salt", salt).join(words.unionByName(known), ["p1", "p2", "p3", "p4", "salt"]).select(*KEY, "part", "f", "lang")
    own = phrases.select(*KEY, F.lit("a").alias("part"), F.col("a").alias("f"), F.lit(None).cast("string").alias("lang"))
    inside = phrases.select(*KEY, "a", m).where("m > 2")
    covers = inside.select(F.explode(F.when(F.col("m") == 3, F.array(*[_phrase(*i) for i in INSIDE[3]])).otherwise(F.array(*[_phrase(*i) for i in INSIDE[4]]))).alias("p"), F.col("a").alias("f"))
    longer = covers.select(*[F.col(f"p.p{i}").alias(w) for i, w in enumerate(KEY, 1)], F.lit("longer").alias("part"), "f", F.lit(None).cast("string").alias("lang"))
    names = ["a", "longer", *[f"{s}{k}" for k in (1, 2, 3) for s in "lr"]]
    facts = own.unionByName(got).unionByName(longer).groupBy(*KEY).agg(
        *[F.max(F.when(F.col("part") == p, F.col("f"))).alias(p) for p in names], F.max(F.when(F.col("part") == "l1", F.col("lang"))).alias("lang")
    )
    left = facts.where(F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(cover).cast("decimal(20,0)") * F.col("a")))
    score = lambda k: F.expr(f"(CAST({scale} AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l{k} AS DECIMAL(19,0)) + CAST(r{k} AS DECIMAL(19,0)))")
    cut = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    return left.select(*KEY, "a", "lang", F.least(cut(1), cut(2), cut(3)).alias("c")).select(*KEY, "a", "lang", "c.l", "c.r", "c.score")


def named_phrases(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """``rows`` with ``phrase``: their words, joined by spaces."""
    asked = rows.select(*KEY, F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("place"), F.col(w).alias("id")) for i, w in enumerate(KEY)]), lambda x: x["id"] > 0)).alias("x")).select(*KEY, "x.place", "x.id")
    words = asked.join(numbered.select("id", F.col("word").cast("string").alias("word")), "id")
    text = words.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("x"))
    return rows.join(text.select(*KEY, F.array_join(F.transform("x", lambda e: e["word"]), " ").alias("phrase")), KEY)


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, scale: int = 2_000_000, cover: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    spark = docs.sparkSession
    shards, raw = _kept(word_shards(docs), "phrase-shards", "kind")
    words, codes = shards.where("kind = 'word'"), shards.where("kind = 'codes'")
    totals, _ = _kept(codes.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    numbered, folders = numbered_words(words, least)
    size, n_words = numbered.count(), totals.agg(F.sum("n")).collect()[0][0] or 0
    if size >= 1 << 32:
        raise ValueError(f"{size} words occur {least} times or more, ids have 32 bits")
    if not size:
        return spark.createDataFrame([], OUT)
    ids, recoded_folder = _kept(recoded(codes, words, numbered), "phrase-codes")
    drop_folder(spark, raw)
    drop_folder(spark, folders[0])
    width = int(size).bit_length()
    runs = n_words // RUN_WORDS + ids.rdd.getNumPartitions()
    top = lambda entries, half: min(half, max(0, (entries // SECTION_ENTRIES).bit_length()))
    pairs, _ = _kept(counted_keys(run_filters(ids, width, top(n_words, width), width), runs, least, width, MOST_BITS), "phrase-pairs")
    n_pairs = pairs.count()
    bits = min(MOST_BITS, max(16, (16 * n_pairs).bit_length()))
    shared = spark.sparkContext.broadcast(pair_bitmap(pairs.withColumn("slot", F.shiftright("slot", MOST_BITS - bits)), bits))
    filters = run_filters(ids, 2 * width, top(2 * n_words, 2 * width), width, shared, bits)
    longer, _ = _kept(counted_keys(filters, runs, least, width, MOST_BITS), "phrase-longer")
    drop_folder(spark, recoded_folder)
    scored, _ = _kept(scored_phrases(pairs.drop("slot").unionByName(longer.drop("slot")), numbered, scale, cover), "phrase-scores")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    edge = scored.select("lang", "score", "a", F.row_number().over(best).alias("place")).where(F.col("place") <= most)
    edge = edge.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("edge"))
    some = scored.join(edge, "lang").where(F.struct("score", "a") >= F.col("edge")).drop("edge")
    named = named_phrases(some, numbered).join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return named.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
