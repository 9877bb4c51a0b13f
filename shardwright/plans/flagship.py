"""The flagship job: raw documents -> packed shards and their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.operators import bpe, packing, prep
from shardwright.plans.queries import SEED, SPECIALS, VAL_FRACTION, documents

FLAGSHIP_MERGES = 16
FLAGSHIP_SHARD = 16384


def flagship(spark: SparkSession, sf_dir: str, merges: int = FLAGSHIP_MERGES, shard_size: int = FLAGSHIP_SHARD) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("text", prep.normalize_v0(F.col("text")))
    kept = prep.dedup_exact(docs, key="doc_id")
    model = bpe.train_bpe(kept, 256 + len(SPECIALS) + merges, SPECIALS)
    eos = model.special_ids["<|eos|>"]
    enc = prep.assign_split(kept, VAL_FRACTION, SEED, key="doc_id").select(
        "doc_id", "split", bpe.encode(F.col("text"), model).alias("ids")
    )
    shards = packing.pack_documents(enc, shard_size, key="doc_id", eos_id=eos)
    return packing.manifest(shards, model.vocab_size, shard_size)
