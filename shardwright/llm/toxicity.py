"""Operator 7: toxicity by a factorization machine over hashed terms.

A term is a word, A-Z lower-cased, without ASCII marks at its ends, hashed to ``2**BITS`` slots; a
text is the set of its slots.  Features are the slots that carry evidence beyond what so many show
by chance (log-likelihood ratio), however many these are: evidence of their own, by the document counts by label
over all labelled training rows, or in a pair whose labels neither term alone explains, by the
counts of all pairs in the fit rows.  A machine of rank ``RANK``

    z(x) = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,     score = 1 / (1 + exp(-z))

is fitted by Adam to about ``fit_rows`` labelled rows of about ``fit_terms`` terms at most (drawn by a hash of
their id; all of them if there are fewer): pairs of terms add what no sum of single weights can.

Defined cases: a null or empty text has no terms and the score of w0; labels other than 0 and 1, null
ids and repeated labels (the greater holds) are no special case; without labels of both kinds every
score is the share of 1 among them (0 if there are none); repeated rows are scored one by one; an
empty table gives an empty result; ``toxic_filter`` keeps all columns as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.llm.common import FILTER_BITS, Memo, id_bucket, id_filter, slices, spread, stored, text_bytes

BITS, RANK = 22, 8
WORDS = 100_000  # that a task remembers
SLICE = 2 << 20  # bytes of a batch that are worked on at once
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def slot(word: bytes) -> int:
    """Slot of a lower-case word, -1 if it is marks only."""
    bare = word.strip(MARKS)
    return zlib.crc32(bare) & ((1 << BITS) - 1) if bare else -1


def slots_of(text: bytes, memo: Memo) -> np.ndarray:
    """Sorted distinct slots of a text."""
    got = set(map(memo.__getitem__, set(text.lower().split())))
    got.discard(-1)
    return np.sort(np.fromiter(got, np.uint32, len(got)))


def runs(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE bytes in column ``at``, one row at least: what is copied or sorted
    at once is bounded, whatever the batch (64 MB at most)."""
    for a, b in slices(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), SLICE):
        yield batch.slice(a, b - a)


def document_slots(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, slots (binary, little-endian uint32) of the documents of ids(id), and a few more."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bits = Memo(slot, WORDS), np.frombuffer(shared.value, np.uint8)
        for b in (part for batch in batches for part in runs(batch, 1)):
            bit = b.column(2).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array((bits[bit >> 3] >> (7 - (bit & 7))) & 1 > 0))
            out = []
            for text in b.column(1):  # one at a time
                out.append(slots_of(text.as_py() or b"", memo).astype("<u4").tobytes())
                memo.trim()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "slots"])

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit")
    rows = spread(docs.select("doc_id", text_bytes().alias("text"), bit), "doc_id")
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, slots binary")


@dataclass(frozen=True)
class Machine:
    """features: sorted slots; w0; w: a weight each; v: RANK factors each."""

    features: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, at: np.ndarray) -> float:
        """Score of a text with these features (positions in ``features``)."""
        v = self.v[at]
        total = v.sum(0)
        z = self.w0 + self.w[at].sum() + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def evidence(counts: DataFrame, n: float, positive: float, seen: np.ndarray) -> np.ndarray:
    """Slots of ``seen`` by log-likelihood ratio G2 of counts(slot, n, pos): those above twice the logarithm of the
    number of slots (what the best of so many reach by chance), at least 8 if there are so many.  At most
    ``2**BITS`` slots reach the driver; one that no fit row holds could get no weight."""
    n, positive = float(n), float(positive)

    def part(k, expected):  # k * ln(k / expected), 0 at k = 0
        return F.when(k > 0, k * F.log(k / expected)).otherwise(F.lit(0.0))

    a, m = F.col("pos").cast("double"), F.col("n").cast("double")
    g2 = 2 * (
        part(a, m * (positive / n)) + part(m - a, m * ((n - positive) / n))
        + part(positive - a, (n - m) * (positive / n)) + part(n - m - positive + a, (n - m) * ((n - positive) / n))
    )
    ranked = counts.select("slot", g2.alias("g"))
    bar = 2 * np.log(max(2, counts.count()))
    best = [r["slot"] for r in ranked.orderBy(F.desc("g"), "slot").limit(8).collect()]
    above = ranked.where(F.col("g") > float(bar)).select("slot").toArrow().column(0).to_numpy()
    return np.intersect1d(np.union1d(above.astype(np.int64), np.array(best, np.int64)), seen)


def _surprise(k: np.ndarray, n: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """G2 of k among n where n * rate are expected."""
    rate = np.clip(rate, 1e-12, 1 - 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        yes = np.where(k > 0, k * np.log(k / (n * rate)), 0)
        no = np.where(n > k, (n - k) * np.log((n - k) / (n * (1 - rate))), 0)
    return 2 * (yes + no)


@dataclass(frozen=True)
class Fit:
    """The fit rows' terms, equal rows once: places of row i are ``at[start[i]:start[i + 1]]``, ascending, in
    ``slots`` (most rows first); y: a label each; n, pos: rows and rows of label 1 of every slot; bar: the G2 that
    the best of so many pairs reach by chance; support: the rows of one label that exceed it."""

    slots: np.ndarray
    at: np.ndarray
    start: np.ndarray
    y: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    support: int
    bar: float


def fit_terms_of(rows: list[bytes], y: list[int]) -> Fit | None:
    """The rows' slots that lie in at least ``support`` rows; fewer rows could not tell anything of a pair."""
    once = sorted(set(zip(rows, y)))
    label = np.array([b for _, b in once], np.int64)
    parts = [np.frombuffer(a, "<u4") for a, _ in once]
    size = np.array([len(x) for x in parts], np.int64)
    slots, at = np.unique(np.concatenate([*parts, np.zeros(0, "<u4")]), return_inverse=True)
    n = np.bincount(at, minlength=len(slots))
    share = float(label.mean()) if len(label) else 0.0
    if not 0 < share < 1:
        return None
    bar = 2 * np.log(max(2.0, len(slots) * (len(slots) - 1.0) / 2))
    support = int(np.ceil(bar / (-2 * np.log(min(share, 1 - share)))))
    keep = np.flatnonzero(n >= support)
    keep = keep[np.lexsort((slots[keep], -n[keep]))]
    place = np.full(len(slots), -1, np.int64)
    place[keep] = np.arange(len(keep))
    row, new = np.repeat(np.arange(len(parts)), size), place[at]
    row, new = row[new >= 0], new[new >= 0]
    order = np.lexsort((new, row))
    row, new = row[order], new[order]
    pos = np.bincount(new, label[row], len(keep)).astype(np.int64)
    start = np.searchsorted(row, np.arange(len(parts) + 1))
    return Fit(slots[keep].astype(np.int64), new.astype(np.int32), start, label, n[keep], pos, support, bar)


PAIR_BLOCK = 128


def paired_places(fit: Fit, block: int) -> np.ndarray:
    """Places a in the ``block``-th PAIR_BLOCK of them, and b > a, of pairs whose rows' labels neither the rate of a nor
    that of b explains.  Counts of all such pairs: PAIR_BLOCK rows of as many numbers as there are slots."""
    lo, m = block * PAIR_BLOCK, len(fit.slots)
    hi = min(m, lo + PAIR_BLOCK)
    both = np.zeros((2, hi - lo, m - lo), np.min_scalar_type(len(fit.y)))
    mine = np.flatnonzero((fit.at >= lo) & (fit.at < hi))
    row = np.searchsorted(fit.start, mine, side="right") - 1
    edge = np.flatnonzero(np.diff(row, prepend=-1, append=len(fit.start)))
    for a, b in zip(edge[:-1], edge[1:]):
        r = row[a]
        own, rest = fit.at[mine[a] : mine[b - 1] + 1] - lo, fit.at[mine[a] : fit.start[r + 1]] - lo
        both[fit.y[r]][np.ix_(own, rest)] += 1  # no place twice in a row
    rate = fit.pos / np.maximum(1, fit.n)
    out = []
    for i in range(hi - lo):  # a first term at a time: many pairs may be frequent
        n = both[0, i].astype(np.int64) + both[1, i]
        b = np.flatnonzero(n >= fit.support)
        b = b[b > i]
        k, n = both[1, i, b].astype(float), n[b].astype(float)
        b = b[np.minimum(_surprise(k, n, rate[lo + i]), _surprise(k, n, rate[lo + b])) > fit.bar] + lo
        out += [b, [lo + i]] if len(b) else []
    return np.unique(np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.int64))


def pair_evidence(spark: SparkSession, fit: Fit | None) -> np.ndarray:
    """Sorted slots of pairs that tell what their terms alone do not; a task takes blocks of first terms.  The
    broadcast is bounded by the fit rows' terms."""
    if fit is None or len(fit.slots) < 2:
        return np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast(fit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(paired_places(shared.value, block), pa.int64())], names=["place"])

    blocks = -(-len(fit.slots) // PAIR_BLOCK)
    # the first blocks, of the most frequent terms, have most to do: dealt round
    dealt = spark.range(blocks).repartition(min(blocks, 256), "id")
    places = dealt.mapInArrow(work, "place long").distinct().toArrow().column(0).to_numpy()
    shared.destroy()
    return np.sort(fit.slots[places])


def fit_machine(rows: list[np.ndarray], y: np.ndarray, features: np.ndarray, epochs: int = 60, seed: int = 3) -> Machine:
    """Adam on the logistic loss with a quadratic penalty; rows: positions in ``features``."""
    rng = np.random.default_rng(seed)
    m = len(features)
    theta = {"w0": np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))]), "w": np.zeros(m), "v": rng.normal(0, 0.05, (m, RANK))}
    moment = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in theta.items()}
    step, size = 0, 256
    for _ in range(max(epochs, -(-1500 * size // max(1, len(rows))))):  # few rows: more rounds over them
        order = rng.permutation(len(rows))
        for a in range(0, len(order), size):
            pick = order[a : a + size]
            parts = [rows[r] for r in pick]
            cols, at = np.unique(np.concatenate(parts), return_inverse=True)  # only features of these rows
            x = np.zeros((len(pick), len(cols)), np.float32)
            x[np.repeat(np.arange(len(pick)), list(map(len, parts))), at] = 1
            v = theta["v"][cols]
            vx = x @ v
            z = theta["w0"] + x @ theta["w"][cols] + 0.5 * ((vx**2).sum(1) - x @ (v**2).sum(1))
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]) / len(pick)
            ex = err @ x
            grad = {"w0": np.array([err.sum()]), "w": 1e-5 * theta["w"], "v": 1e-4 * theta["v"]}
            grad["w"][cols] += ex
            grad["v"][cols] += x.T @ (err[:, None] * vx) - ex[:, None] * v
            step += 1
            for k, g in grad.items():
                one, two = moment[k]
                one += 0.1 * (g - one)
                two += 0.001 * (g * g - two)
                theta[k] = theta[k] - 0.03 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return Machine(features, float(theta["w0"][0]), theta["w"], theta["v"])


def _constant(share: float) -> Machine:
    return Machine(np.zeros(0, np.int64), float(np.log((share + 1e-12) / (1 - share + 1e-12))), np.zeros(0), np.zeros((0, RANK)))


def train(docs: DataFrame, labels: DataFrame, held_out: int = 5, fit_rows: int = 20_000, fit_terms: int = 20_000_000) -> Machine:
    """A machine from docs(doc_id, text) and labels(doc_id, toxic) whose ``id_bucket(held_out)`` isn't 0, fitted to about
    ``fit_rows`` of them, fewer if these would hold more than about ``fit_terms`` terms."""
    known = labels.where(F.col("toxic").isin(0, 1) & (id_bucket("doc_id", held_out) != 0)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    known = stored(known, "toxicity-labels")
    # texts become slots before the shuffle, and only those with a label; a merge join at every size
    slots = document_slots(docs.where(id_bucket("doc_id", held_out) != 0).select(F.col("doc_id").cast("bigint"), "text"), known.select(F.col("doc_id").alias("id")))
    rows = stored(slots.join(known.hint("merge"), "doc_id").select("doc_id", "slots", "y"), "toxicity-rows")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).collect()[0]
    if not positive or positive == n:
        return _constant(positive / n if n else 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per run of rows, so that a frequent term is a row a run."""
        for b in (part for batch in batches for part in runs(batch, 0)):
            parts = [np.frombuffer(x, "<u4") for x in b.column(0).to_pylist()]
            all_, label = np.concatenate(parts), np.repeat(b.column(1).to_numpy(zero_copy_only=False), list(map(len, parts)))
            slots, at = np.unique(all_, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots.astype(np.int32)), pa.array(np.bincount(at, minlength=len(slots))), pa.array(np.bincount(at, label, len(slots)).astype(np.int64))], names=["slot", "n", "pos"]
            )

    counts = rows.select("slots", "y").mapInArrow(count, "slot int, n long, pos long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    counts = stored(counts, "toxicity-counts")
    terms = counts.agg(F.sum("n")).collect()[0][0] or 0
    wanted = min(fit_rows, max(1, int(n * fit_terms / max(1, terms))))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(max(n, 1))) < wanted).select("doc_id", "slots", "y").toArrow()
    got = sorted(zip(drawn.column(0).to_pylist(), drawn.column(1).to_pylist(), drawn.column(2).to_pylist()))
    if not got:
        return _constant(positive / n)
    held = [np.frombuffer(x, "<u4") for _, x, _ in got]
    alone = evidence(counts, n, positive, np.unique(np.concatenate([*held, np.zeros(0, "<u4")])).astype(np.int64))
    features = np.union1d(alone, pair_evidence(docs.sparkSession, fit_terms_of([x for _, x, _ in got], [y for _, _, y in got])))
    place = np.full(1 << BITS, -1, np.int64)
    place[features] = np.arange(len(features))
    at = [np.sort(p[p >= 0]) for p in (place[x] for x in held)]
    return fit_machine(at, np.array([y for _, _, y in got], float), features)


def _scorer(machine: Machine):
    """bytes -> score, with memos of this task."""
    place = {int(s): i for i, s in enumerate(machine.features.tolist())}
    memo = Memo(lambda w: place.get(slot(w), -1), WORDS)
    none = machine.score(np.zeros(0, np.int64))

    def score(text: bytes | None) -> float:
        at = set(map(memo.__getitem__, set((text or b"").lower().split())))
        at.discard(-1)
        memo.trim()
        return machine.score(np.sort(np.fromiter(at, np.int64, len(at)))) if at else none

    return score


def toxicity_scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score for every row of docs(doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(machine)
        for b in (part for batch in batches for part in runs(batch, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(x.as_py()) for x in b.column(1)], pa.float64())], names=["doc_id", "score"])

    rows = spread(docs.select("doc_id", text_bytes().alias("text")), "doc_id")
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def toxic_filter(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, all columns unchanged."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(machine)
        for b in (part for batch in batches for part in runs(batch, at)):
            yield b.filter(pa.array([score(x.as_py()) < threshold for x in b.column(at).cast(pa.binary())], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
