"""Operator 2: near-duplicate embeddings by Euclidean p-stable hashing.

1. Equal vectors become one (smallest id, number of rows): copies never meet again.
2. Normalised vectors x are hashed by ``floor((a.x + b) / w)``, a from the normal (2-stable) law;
   K such values are a table's key, and L tables are kept.  A pair at cosine c has distance
   ``sqrt(2 - 2c)`` and shares a table's key with probability p(distance)^K.  K follows from
   the number of vectors (a bucket is to hold about ``company`` unrelated ones), L from the share of
   pairs at exactly the threshold that may be missed (``miss``); pairs above it are found more surely.
3. Only ids and keys are shuffled to find the buckets with company; only their vectors follow.  A
   bucket of more than ``block`` members is dealt over pairs of sub-blocks, so no task holds it whole.
4. A task computes the exact cosines of a block in double precision and gives a star for each
   of the components that its links form: rows in proportion to members, not pairs.
5. The stars' components hold all links between them.  The cosines inside each component, again in
   blocks, give the number of links of every vector, each pair once; so a pair that shares no bucket
   counts as well if other links connect it.

Defined cases: a vector that is null, empty, zero, or has null or non-finite parts links with
nothing and is its own component.  A null id links with nothing, has no component and is kept.
Rows of equal id are one node of the component graph, and each counts as a vector among links.
Vectors of different length never link.  Empty tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import mix64, spread, stored
from shardwright.llm.components import components


def collision(distance: float, w: float) -> float:
    """Probability that two points at this distance share one quantised normal projection."""
    t = w / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


@dataclass(frozen=True)
class Tables:
    k: int
    n: int
    w: float
    seed: int

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) 64-bit keys of normalised rows."""
        rng = np.random.default_rng([self.seed, x.shape[1]])
        a = rng.standard_normal((x.shape[1], self.n * self.k))
        b = rng.random(self.n * self.k) * self.w
        salt = rng.integers(1, 2**63, self.k, dtype=np.uint64) | np.uint64(1)
        q = np.floor((x @ a + b) / self.w).astype(np.int64).astype(np.uint64).reshape(len(x), self.n, self.k)
        return mix64((q * salt).sum(2, dtype=np.uint64)).view(np.int64)


def plan_tables(rows: int, threshold: float, w: float = 2.5, company: float = 256.0, miss: float = 0.01, seed: int = 5) -> Tables:
    near, far = collision(math.sqrt(2 - 2 * threshold), w), collision(math.sqrt(2), w)
    k = max(8, math.ceil(math.log(max(rows, 1) / company) / -math.log(far)))
    return Tables(k, math.ceil(math.log(miss) / math.log1p(-(near**k))), w, seed)


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def block_roots(x: np.ndarray, threshold: float) -> np.ndarray:
    """The first row of each row's component, of the links inside a block."""
    near = x @ x.T >= threshold
    np.fill_diagonal(near, True)
    root = np.arange(len(x))
    while True:  # labels run along links; each round also jumps to the label's own label
        new = np.where(near, root[None, :], len(x)).min(1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _runs(key: np.ndarray) -> list[np.ndarray]:
    """Places of equal keys."""
    order = np.argsort(key, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1)


def dealt_rows(groups: DataFrame, size: str, block: int) -> int:
    """Rows that ``in_blocks`` deals for groups of these sizes: a member goes to each sub-block of its group."""
    return groups.agg(F.sum(F.col(size) * F.ceil(F.col(size) / block)).alias("n")).first()["n"] or 0


def in_blocks(rows: DataFrame, by: list[str], size: str, block: int, per_task: int, total: int) -> DataFrame:
    """Deal rows(by, rep, size of the group) over the blocks of their group: a group of s sub-blocks has
    a block for every pair of them, and a row goes to the s blocks of its own.  Adds ``blk`` (the
    block), ``side`` (0: the sub-block of lower number) and ``g`` (what a task takes at a time: about
    ``per_task`` of the ``total`` rows dealt, whole blocks)."""
    s = F.ceil(F.col(size) / block).cast("int")
    dealt = rows.withColumn("_s", s).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_s")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    dealt = dealt.withColumn("blk", F.xxhash64(*by, F.least("_own", "_other"), F.greatest("_own", "_other")))
    dealt = dealt.withColumn("side", (F.col("_own") > F.col("_other")).cast("int"))
    return dealt.withColumn("g", F.pmod("blk", F.lit(max(16, total // per_task)))).select("g", "blk", "rep", "side")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = 1024, tables: Tables | None = None, per_task: int = 20_000) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept, a row per row."""
    e = F.col("embedding").cast("array<double>")
    good = (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    ok = F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.when(ok, F.xxhash64("embedding")).alias("h1"), F.when(ok, F.hash("embedding")).alias("h2"))
    first = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "embedding")).alias("f"), F.count(F.lit(1)).alias("copies"))
    reps = stored(first.select("h1", "h2", F.col("f.vec_id").alias("rep"), "copies", F.col("f.embedding").alias("x")), "lsh-vectors")
    n = reps.count()
    t = tables or plan_tables(n, threshold)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ids = b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False)
            for dim in sorted(set(map(len, xs))):
                at = [i for i, v in enumerate(xs) if len(v) == dim]
                keys = t.keys(_unit([xs[i] for i in at]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[at], t.n)), pa.array(np.tile(np.arange(t.n, dtype=np.int32), len(at))), pa.array(keys.ravel()), pa.array(np.full(keys.size, dim, np.int32))],
                    names=["rep", "t", "key", "dim"],
                )

    sig = stored(spread(reps.select("rep", "x"), "rep").mapInArrow(hash_rows, "rep long, t int, key long, dim int"), "lsh-keys")
    full = stored(sig.groupBy("t", "key", "dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lsh-buckets")
    dealt = in_blocks(sig.join(full, ["t", "key", "dim"]), ["t", "key", "dim"], "n", block, per_task, dealt_rows(full, "n", block))

    def connect(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, out = pdf["rep"].to_numpy(), pdf["x"].to_numpy(), []
        for at in _runs(pdf["blk"].to_numpy()):
            at = at[np.argsort(ids[at])]
            root = ids[at][block_roots(_unit(list(x[at])), threshold)]
            some = root != ids[at]
            out.append(np.stack([ids[at][some], root[some]], 1))
        return pd.DataFrame(np.concatenate(out), columns=["u", "v"])

    stars = dealt.join(reps.select("rep", "x"), "rep").groupBy("g").applyInPandas(connect, "u long, v long")
    cc = stored(components(stars), "lsh-components")
    sizes = stored(cc.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "lsh-sizes")
    inside = in_blocks(cc.withColumnRenamed("node", "rep").join(sizes, "component"), ["component"], "n", block, per_task, dealt_rows(sizes, "n", block))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, side, copies, out = *(pdf[c].to_numpy() for c in ("rep", "x", "side", "copies")), []
        for at in _runs(pdf["blk"].to_numpy()):
            unit = _unit(list(x[at]))
            near = unit @ unit.T >= threshold
            np.fill_diagonal(near, False)
            if side[at].min() != side[at].max():  # a block of two sub-blocks: pairs inside one are another block's
                near &= side[at][:, None] != side[at][None, :]
            out.append(np.stack([ids[at], near @ copies[at]], 1))
        return pd.DataFrame(np.concatenate(out), columns=["rep", "links"])

    links = inside.join(reps.select("rep", "x", "copies"), "rep").groupBy("g").applyInPandas(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    by_rep = reps.select("h1", "h2", "rep", "copies").join(links, "rep", "left")
    marked = rows.select("vec_id", "h1", "h2").join(by_rep, ["h1", "h2"], "left")
    marked = stored(marked.select("vec_id", "rep", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links")), "lsh-rows")
    # a row's component is that of its vector; rows of one id may join several
    by_id = marked.where("rep is not null and vec_id <> rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v")).distinct()
    joined = components(by_id.union(cc.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    out = marked.join(joined, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
