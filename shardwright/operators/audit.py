"""Corpus-wide tokenizer audits (row-local, one pass, no join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.operators.bpe import BPEModel, decode, encode


def roundtrip_audit(docs: DataFrame, model: BPEModel, group: str, text: str = "text", method: str = "auto") -> DataFrame:
    """``decode(encode(t)) == t`` for every document, counted per group."""
    # the ids are a column of their own: decode refers to its input several times
    coded = docs.select(F.col(group).alias("g"), F.col(text).alias("t"), encode(F.col(text), model, method=method).alias("ids"))
    return coded.groupBy(F.col("g").alias(group)).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_docs"),
        F.count_if(~decode(F.col("ids"), model).eqNullSafe(F.col("t"))).cast("bigint").alias("n_mismatch"),
    )


def compression(docs: DataFrame, model: BPEModel, group: str, text: str = "text", ids: str | None = None, method: str = "auto") -> DataFrame:
    """UTF-8 bytes, tokens and bytes per token per group."""
    tok = F.col(ids) if ids else encode(F.col(text), model, method=method)
    agg = docs.groupBy(group).agg(
        F.sum(F.octet_length(text)).cast("bigint").alias("n_bytes"),
        F.sum(F.size(tok)).cast("bigint").alias("n_tokens"),
    )
    return agg.withColumn("bytes_per_token", F.round(F.col("n_bytes") / F.col("n_tokens"), 6))
