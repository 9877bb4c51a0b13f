"""Normalisation, exact deduplication, seeded train/val split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_v0(text: Column) -> Column:
    """P1 ``v0``: newline canonicalisation only (``\\r\\n`` and lone ``\\r`` -> ``\\n``).

    No trimming, case folding or Unicode normalisation: leading/trailing spaces are
    content, and the tokenizer must stay lossless.
    """
    return F.regexp_replace(text, "\r\n?", "\n")


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def dedup_exact(docs: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """P2, document unit: keep the smallest key of each distinct text, with ``n_copies``.

    A null text has no content to compare: such documents are no copies of each other and all
    stay, with ``n_copies`` 1.  The grouping is a partial + final aggregate, so a text copied across
    a third of the corpus is combined map-side; the survivors are matched back on the unique
    document key (evenly spread), never on the hot digest.
    """
    same = F.coalesce(text_digest(F.col(text)), F.concat(F.lit("null "), F.col(key).cast("string")))
    firsts = docs.groupBy(same.alias("_digest")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n_copies"))
    return docs.join(firsts.select(key, "n_copies"), key, "inner")


def line_table(docs: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """Documents as ``(key, line_no, line)``; ``line_no`` is 0-based, split on ``\\n``.  A null text has no line."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def first_lines(lines: DataFrame, key: str = "doc_key") -> DataFrame:
    """P2, line unit: first occurrence ``(key, line_no)`` of each distinct non-empty line, its md5
    ``digest`` and ``n_copies``."""
    firsts = (
        lines.where(F.col("line") != F.lit(""))
        .groupBy(text_digest(F.col("line")).alias("_digest"))
        .agg(F.min(F.struct(key, "line_no")).alias("_first"), F.min(F.md5("line")).alias("digest"), F.count(F.lit(1)).alias("n_copies"))
    )
    return firsts.select(F.col(f"_first.{key}").alias(key), F.col("_first.line_no").alias("line_no"), "digest", "n_copies")


def dedup_lines(docs: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """P2, line unit: drop every non-empty line already seen earlier in the corpus
    (corpus order = key, then line number); empty lines are kept.

    Returns every document with ``text`` rebuilt: one whose lines were all seen earlier has an
    empty text, a null text stays null.  Lines are grouped as 128-bit digests with their (key, line
    number), combined before the shuffle; a document gets back the numbers of the lines that stay,
    and is cut where its text is: no line's text is shuffled, and each text moves once.
    """
    lines = F.split(F.col(text), "\n", -1)
    digest = lambda x: F.when(x != F.lit(""), F.substring(F.unhex(text_digest(x)), 1, 16))
    digests = docs.select(key, F.posexplode(F.transform(lines, digest)).alias("_no", "_d")).where(F.col("_d").isNotNull())
    firsts = digests.groupBy("_d").agg(F.min(F.struct(key, "_no")).alias("_first"))
    stay = firsts.groupBy(F.col(f"_first.{key}").alias(key)).agg(F.collect_list("_first._no").alias("_stay"))
    cut = docs.join(stay, key, "left").withColumn("_lines", lines)
    none = F.array().cast("array<int>")
    blank = F.filter(F.transform("_lines", lambda x, i: F.when(x == F.lit(""), i)), lambda i: i.isNotNull())
    numbers = F.array_sort(F.concat(F.coalesce("_stay", none), F.coalesce(blank, none)))
    kept = F.array_join(F.transform(numbers, lambda i: F.get(F.col("_lines"), i)), "\n")
    return cut.withColumn(text, F.when(F.col(text).isNotNull(), kept)).drop("_lines", "_stay")


def split_draw(key: Column, seed: int) -> Column:
    """Uniform draw in [0, 1) from ``md5(seed:key)``: order-independent and re-computable."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(str(int(seed))), F.lit(":"), key.cast("string"))), 1, 8), 16, 10)
    return h.cast("double") / F.lit(4294967296.0)


def assign_split(
    docs: DataFrame, fraction: float, seed: int = 1337, key: str = "doc_key", out: str = "split"
) -> DataFrame:
    """One draw per document (empty ones too); ``val`` if draw < fraction.

    Deviation, stated: the draw is a keyed hash instead of one sequential random
    stream in file order, so it parallelises.  It depends on the key alone: with keys made from a
    document's own file and row (``sources.corpus``), adding a file moves no document.
    """
    fraction = float(fraction)
    if not 0.0 <= fraction < 1.0:
        raise ValueError(f"the validation share {fraction} is outside [0, 1)")
    return docs.withColumn(
        out, F.when(split_draw(F.col(key), seed) < F.lit(fraction), F.lit("val")).otherwise(F.lit("train"))
    )
