"""Token-level evaluation over next-token examples.

The reference scores examples with a neural model (not built here); the same
``(x, y)`` contract is scored with an additive-smoothed bigram table learned on
``train``: p(y | x) = (c(x, y) + a) / (c(x) + a * V).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bigram_table(examples: DataFrame, group: str | None = "split") -> DataFrame:
    """Count of ``(x_i, y_i)`` over all example positions.

    Every position explodes to a row, but the partial aggregate collapses each task
    to at most vocab^2 rows before the shuffle.
    """
    keys = [group] if group else []
    pos = examples.select(*keys, F.explode(F.arrays_zip("x", "y")).alias("p"))
    return pos.groupBy(*keys, F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n")
    )


def bigram_xent(examples: DataFrame, vocab_size: int, alpha: float = 1.0, train_split: str = "train") -> DataFrame:
    """Per split, token-weighted mean of -ln p(y | x) and its perplexity."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    sums = bigram_nll(examples, vocab_size, alpha, train_split)
    mean = F.col("nll_sum") / F.col("n_tokens")
    return sums.select("split", "n_tokens", mean.alias("nll"), F.exp(mean).alias("ppl"))


def bigram_nll(examples: DataFrame, vocab_size: int, alpha: float = 1.0, train_split: str = "train") -> DataFrame:
    """Per split: ``n_tokens`` and ``nll_sum``.  The tokens are read once: the pair table holds at most
    splits * vocab^2 rows, and the train counts of a pair and of its first token are sums over it."""
    pairs = bigram_table(examples, "split")
    train = F.when(F.col("split") == F.lit(train_split), F.col("n")).otherwise(F.lit(0))
    c_xy, c_x = (F.sum(train).over(Window.partitionBy(*by)) for by in (("x", "y"), ("x",)))
    nll = -F.log((c_xy + F.lit(float(alpha))) / (c_x + F.lit(float(alpha) * int(vocab_size))))
    scored = pairs.select("split", "n", nll.alias("nll"))
    return scored.groupBy("split").agg(F.sum("n").cast("bigint").alias("n_tokens"), F.sum(F.col("n") * F.col("nll")).alias("nll_sum"))


def perplexity(scores: DataFrame, group: str, nll_col: str = "nll_sum", n_col: str = "n_tokens") -> DataFrame:
    """Token-weighted perplexity ``exp(sum(nll) / sum(tokens))`` per group."""
    return scores.groupBy(group).agg(
        F.sum(n_col).cast("bigint").alias("n_tokens"),
        F.exp(F.sum(nll_col) / F.sum(n_col)).alias("ppl"),
    )
