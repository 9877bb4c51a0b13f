"""A tokenizer as two small tables, so that any store Spark can reach will do.

``merges``: rank, left_id, right_id, new_id.  ``about``: one row with the format's version, the
declared vocabulary size and the special tokens in the order of their ids.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from shardwright.operators.bpe import BPEModel

FORMAT = 1


def save_tokenizer(spark: SparkSession, model: BPEModel, out: str) -> str:
    about = [(FORMAT, model.vocab_size, list(model.specials))]
    spark.createDataFrame(about, "version int, vocab_size int, specials array<string>").coalesce(1).write.mode("overwrite").parquet(f"{out}/about")
    model.merges_df(spark).drop("pair_count").coalesce(1).write.mode("overwrite").parquet(f"{out}/merges")
    return out


def load_tokenizer(spark: SparkSession, path: str) -> BPEModel:
    about = spark.read.parquet(f"{path}/about").collect()
    if len(about) != 1 or about[0]["version"] != FORMAT:
        raise ValueError(f"{path} is no tokenizer of format {FORMAT}")
    specials = tuple(about[0]["specials"])
    rows = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()  # as many as the vocabulary
    if [r["new_id"] for r in rows] != list(range(256 + len(specials), 256 + len(specials) + len(rows))):
        raise ValueError(f"{path}: merges are not numbered as their ranks say")
    return BPEModel(specials, tuple((r["left_id"], r["right_id"]) for r in rows), about[0]["vocab_size"])
