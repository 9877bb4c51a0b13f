"""Next-token examples, lookup, batches and token checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _check_context(context_length: int) -> None:
    if context_length < 1:
        raise ValueError(f"a context holds at least one token, not {context_length}")


def num_examples(tokens_col: str, context_length: int):
    """(n - 1) div T blocks per shard."""
    return F.floor((F.size(tokens_col) - F.lit(1)) / F.lit(int(context_length))).cast("int")


def cut_examples(shards: DataFrame, context_length: int, on_small: str = "error") -> DataFrame:
    """Per shard, block i is ``x = t[iT, iT+T)``, ``y = t[iT+1, iT+T+1)``.

    Consecutive blocks share one boundary token; the remainder is dropped; examples
    never cross shards.  A shard with fewer than T+1 tokens raises (``on_small=
    "error"``, the reference behaviour) or yields nothing (``"drop"``).
    """
    _check_context(context_length)
    if on_small not in ("error", "drop"):
        raise ValueError("on_small must be 'error' or 'drop'")
    T = int(context_length)
    k = num_examples("tokens", T)
    src = shards
    if on_small == "error":
        msg = F.format_string(
            "%s: %d tokens are too few for an example of %d and its successor",
            F.col("filename"),
            F.size("tokens"),
            F.lit(T),
        )
        k = F.when(k < 1, F.raise_error(msg).cast("int")).otherwise(k)
    idx = F.when(k >= 1, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    # build the (x, y) pairs inside one transform and explode those: exploding the
    # index alone would copy the whole shard array into every example row
    blocks = F.transform(
        idx,
        lambda i: F.struct(
            i.alias("example_idx"),
            F.slice("tokens", i * F.lit(T) + 1, F.lit(T)).alias("x"),
            F.slice("tokens", i * F.lit(T) + 2, F.lit(T)).alias("y"),
        ),
    )
    ex = src.select("split", "shard_idx", F.explode(blocks).alias("b"))
    return ex.select("split", "shard_idx", "b.example_idx", "b.x", "b.y")


def example_at(shards: DataFrame, split: str, shard_idx: int, index: int, context_length: int) -> DataFrame:
    """One example by index; negative counts from the end; out of range raises."""
    _check_context(context_length)
    T = int(context_length)
    one = shards.where((F.col("split") == F.lit(split)) & (F.col("shard_idx") == F.lit(int(shard_idx))))
    k = num_examples("tokens", T)
    i = F.lit(int(index))
    real = F.when(i < 0, i + k).otherwise(i)
    msg = F.format_string("no example %d among %d", i, k)
    checked = F.when((real < 0) | (real >= k), F.raise_error(msg).cast("int")).otherwise(real)
    sel = one.select("split", "shard_idx", "tokens", checked.alias("example_idx"))
    start = F.col("example_idx") * F.lit(T)
    return sel.select(
        "split",
        "shard_idx",
        "example_idx",
        F.slice("tokens", start + 1, F.lit(T)).alias("x"),
        F.slice("tokens", start + 2, F.lit(T)).alias("y"),
    )


def first_train_shard(shards: DataFrame) -> DataFrame:
    """Shard 0 of split ``train``; absent -> error (checked eagerly, one row)."""
    first = shards.where((F.col("split") == F.lit("train")) & (F.col("shard_idx") == F.lit(0)))
    if first.isEmpty():
        raise ValueError("the shards have no first one of the split train")
    return first


def batches(examples: DataFrame, batch_size: int, first_only: bool = True) -> DataFrame:
    """Stack B consecutive examples of a shard into ``x, y: ARRAY<ARRAY<INT>>``.

    ``first_only`` gives the reference's fixed batch (the first B examples); else
    every complete batch ``batch_id = example_idx div B`` (an incomplete last batch is
    dropped).  A group holds at most B examples.  Fewer than B examples -> error.
    """
    if batch_size < 1:
        raise ValueError(f"a batch holds at least one example, not {batch_size}")
    B = int(batch_size)
    ex = examples.where(F.col("example_idx") < F.lit(B)) if first_only else examples
    grouped = ex.groupBy("split", "shard_idx", F.floor(F.col("example_idx") / F.lit(B)).cast("int").alias("batch_id")).agg(
        F.array_sort(F.collect_list(F.struct("example_idx", "x", "y"))).alias("rows")
    )
    xs = F.transform("rows", lambda r: r["x"])
    if first_only:
        msg = F.format_string("a batch of %d is more than the %d examples of the shard", F.lit(B), F.size("rows"))
        xs = F.when(F.size("rows") < F.lit(B), F.raise_error(msg)).otherwise(xs)
    else:
        grouped = grouped.where(F.size("rows") == F.lit(B))
    return grouped.select(
        "split",
        "shard_idx",
        "batch_id",
        xs.alias("x"),
        F.transform("rows", lambda r: r["y"]).alias("y"),
    )


def token_id_audit(df: DataFrame, cols: list[str], vocab_size: int, group: str | None = None) -> DataFrame:
    """Min / max id and the number of rows holding an id outside ``[0, vocab_size)``.

    Row-level ``array_min`` / ``array_max`` (codegen, no per-element lambda) feed a
    partial + final aggregate.
    """
    V = int(vocab_size)
    _require_integers(df, cols)
    ids = F.concat(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])
    lo, hi = F.array_min(ids), F.array_max(ids)
    aggs = [
        F.min(lo).alias("min_id"),
        F.max(hi).alias("max_id"),
        F.count_if((lo < F.lit(0)) | (hi >= F.lit(V))).cast("bigint").alias("n_bad"),
    ]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)


INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _require_integers(df: DataFrame, cols: list[str]) -> None:
    types = dict(df.dtypes)
    for c in cols:
        if types[c] not in [f"array<{t}>" for t in INTEGERS]:
            raise TypeError(f"token ids must have an integer dtype, column {c} is {types[c]}")


def example_audit(df: DataFrame, cols: list[str], vocab_size: int, context_length: int, group: str) -> DataFrame:
    """X6 and X7 of the same rows in one scan and one aggregate."""
    _require_integers(df, cols)
    _check_context(context_length)
    ids = F.concat(*[F.col(c) for c in cols])
    lo, hi = F.array_min(ids), F.array_max(ids)
    return df.groupBy(group).agg(
        F.min(lo).alias("min_id"),
        F.max(hi).alias("max_id"),
        F.count_if((lo < F.lit(0)) | (hi >= F.lit(int(vocab_size)))).cast("bigint").alias("n_bad"),
        F.count_if(F.size(cols[0]) > F.lit(int(context_length))).cast("bigint").alias("n_too_long"),
    )


def context_audit(df: DataFrame, col: str, context_length: int, group: str | None = None) -> DataFrame:
    """Sequences longer than the allowed context."""
    _check_context(context_length)
    agg = F.count_if(F.size(col) > F.lit(int(context_length))).cast("bigint").alias("n_too_long")
    return df.groupBy(group).agg(agg) if group else df.agg(agg)


def strict(audit: DataFrame, vocab_size: int | None = None) -> DataFrame:
    """Strict mode: a failing audit row raises at run time.

    The check guards an output column, so the optimizer cannot prune it.
    """
    checks = []
    if "n_bad" in audit.columns:
        msg = F.format_string(
            "ids outside [0, %d): they run from %d to %d",
            F.lit(int(vocab_size or 0)),
            F.col("min_id"),
            F.col("max_id"),
        )
        checks.append((F.col("n_bad") > 0, msg))
    if "n_too_long" in audit.columns:
        checks.append((F.col("n_too_long") > 0, F.lit("a sequence exceeds the context")))
    target = audit.columns[-1]
    guarded = F.col(target)
    for cond, msg in checks:
        guarded = F.when(cond, F.raise_error(msg)).otherwise(guarded)
    return audit.withColumn(target, guarded)
