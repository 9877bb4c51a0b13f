"""The dealt operators' queries: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.llm import context_mixing, embed_dedup, fill_middle, license_scan, mixing, parity_join, phrases, quality, segtree_bpe, simple8b, token_counts, toxicity, url_reputation
from shardwright.llm.common import id_bucket


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"))


def op2_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = simple8b.encoded_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, specials=True)
    return simple8b.read_documents(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, bad: the label of the document that the page shows (the last number of its path)."""
    number = F.regexp_extract(F.col("url"), r"/(\d{1,18})(?:\.html|/)?(?:[?#].*)?$", 1)
    pages = _table(spark, sf_dir, "pages").select("page_id", number.try_cast("bigint").alias("doc_id"))
    labels = _table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0)
    return pages.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_reputation.judge_urls(_table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scores(_table(spark, sf_dir, "documents"), held_out=7, held=2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, _table(spark, sf_dir, "labels"), held_out=5)
    held = F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.toxicity_scores(docs, machine).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.section_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), specials=True)


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_documents(_table(spark, sf_dir, "documents"))


def op10_segtree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = segtree_bpe.encoded_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["first_word"])
    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        license_scan.labels_of(base).alias("base_labels"),
        license_scan.labels_of(F.col("hits")).alias("labels"),
        "score",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_embed_dedup": op2_embed_dedup,
    "op3_mixing": op3_mixing,
    "op4_simple8b": op4_simple8b,
    "op5_url_reputation": op5_url_reputation,
    "op6_context_mixing": op6_context_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_parity_join": op9_parity_join,
    "op10_segtree_bpe": op10_segtree_bpe,
    "op11_phrases": op11_phrases,
    "op12_fill_middle": op12_fill_middle,
    "op13_license_scan": op13_license_scan,
}
