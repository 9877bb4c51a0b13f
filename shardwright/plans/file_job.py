"""The file-to-file job: a folder of text and Parquet files in; tokenizer, shard files and manifest out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.functions.codepoints import digest
from shardwright.operators import bpe, packing, prep
from shardwright.operators.specials import special_id
from shardwright.sources import shards as shard_files
from shardwright.sources.artifacts import load_tokenizer, save_tokenizer
from shardwright.sources.corpus import read_corpus


def pack_folder(
    spark: SparkSession,
    folder: str,
    out: str,
    merges: int,
    specials: Sequence[str],
    shard_size: int,
    validation_fraction: float = 0.0,
    seed: int = 1337,
    bos: str | None = None,
    eos: str | None = None,
    hidden: bool = False,
) -> str:
    """Train a tokenizer on the corpus below ``folder`` (S1-S3, T6), save it (S6), encode every document by
    the saved one (T8), split (K2), pack in corpus order (K1, K3, K4) and write shard files (S7) and their
    manifest (S9) below ``out``; returns the manifest's path.  An unknown boundary token is an error."""
    bos_id, eos_id = (None if name is None else special_id(specials, name) for name in (bos, eos))
    docs = read_corpus(spark, folder, hidden).select("doc_key", "text")
    saved = save_tokenizer(spark, bpe.train_bpe(docs, 256 + len(specials) + merges, specials), f"{out}/tokenizer")
    model = load_tokenizer(spark, saved)
    coded = bpe.encode_documents(prep.assign_split(docs, validation_fraction, seed), model).select("doc_key", "split", "ids")
    shards = packing.store_shards(packing.pack_documents(coded, shard_size, bos_id=bos_id, eos_id=eos_id), shard_size)
    written = shard_files.write_shards(shards, f"{out}/shards", packing.dtype_for_vocab(model.vocab_size))
    written.write.format("noop").mode("overwrite").save()
    return shard_files.write_manifest(packing.manifest(shards, model.vocab_size, shard_size), f"{out}/shards")


def packed_shards(spark: SparkSession, out: str) -> DataFrame:
    """(split, shard_idx, filename, num_tokens, digest) of the shard files that the manifest below ``out`` names."""
    folder = f"{out}/shards"
    read = shard_files.read_shards(spark, folder, shard_files.load_manifest(folder)["dtype"])
    # tokens stay out of the join
    short = read.select("split", "shard_idx", "filename", F.size("tokens").cast("bigint").alias("num_tokens"), digest(F.col("tokens")).alias("digest"))
    named = shard_files.manifest_shards(spark, folder).join(short, ["split", "shard_idx", "filename"])
    return named.select("split", "shard_idx", "filename", "num_tokens", "digest")
