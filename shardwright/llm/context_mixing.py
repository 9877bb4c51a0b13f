"""Operator 6: a text's probability by online logistic mixing of hashed-context bit predictors.

The scored stream of a text is its words (A-Z lower-cased), a space after each, and a newline as the end.
Bytes are coded bit by bit, most significant first.  A predictor is a table of zero and one
counts, addressed by a hash of its context and of the bits of this byte so far; it votes with
``ln((n1 + D) / (n0 + D))``.  Inside a word the contexts are the last 2, 3 and 4 bytes of the word
and all of its bytes so far; a word's first byte has the order-0 context of word starts, the last
two bytes of the word before, and the whole word before.  The votes are summed with the weights of
a gate (how much the long contexts have seen, and how far into the word the bit is), squashed, and
refined by an adaptive probability map, whose answer is averaged in.

Learning is online and prequential: a task codes each run of its words with the counts of the
runs before, then counts it; weights and map learn from the predictions of all its words and word
starts.  The tasks' counts add up by slot, their weights are averaged by bits, their
maps add up.  Tables have a fixed number of slots, so the model is bounded and every task may hold
it; all training documents are counted.  Distinct words of a run are coded once, weighted by how
often they occur.

The add-one unigram base needs exact counts of an unbounded vocabulary: word hashes (64 bits)
and counts are summed by bucket; the ``HOT`` most frequent words go to every task, the rest of a
text's words meet their counts in the bucket, and come back as one sum per document and bucket.

Defined cases: a null or empty text is the end symbol alone; null ids are never held out; rows may repeat;
without training text N and V are 0 (an add-one score of log10(1) a token); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import id_bucket, mix64, slices, spread, stored, text_bytes

D = 0.2
#: log2 of the slots of each predictor: four inside a word, three at its start.
INNER, START = (18, 20, 21, 22), (16, 18, 20)
SLOTS = INNER + START
OFFSET = np.concatenate([[0], np.cumsum([1 << b for b in SLOTS])])
GATES = (48, 4)  # inside a word, at its start
MAP = 33  # steps of the probability map, over stretched probabilities -8..8
PART = 1 << 16  # slots that travel together
HOT = 1 << 18
SLICE = 4 << 20  # bytes of text that a task takes at a time
KEPT = 1 << 18  # bytes whose slots are kept from coding to counting (33 MB)
END = 10
_NODES = np.array([[(1 << k) | (v >> (8 - k)) for k in range(8)] for v in range(256)], np.uint64)
_BITS = np.array([[(v >> (7 - k)) & 1 for k in range(8)] for v in range(256)], np.uint8)
_NODE_SALT = mix64(np.arange(256, dtype=np.uint64) + np.uint64(77))[_NODES]
_PHI = np.uint64(0x9E3779B97F4A7C15)


word_hash = xxhash.xxh3_64_intdigest


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash, words), np.uint64, len(words))


# ---------------------------------------------------------------- contexts


def inner_contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the bytes after the first of each word and the space behind it: values, contexts
    (bytes, 4), place in the word, number of the word."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    s = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
    which = np.repeat(np.arange(len(words)), n + 1)
    j = np.arange(len(s)) - first[which]
    last = []
    for k in range(1, 5):
        p = np.zeros_like(s)
        p[k:] = s[:-k]
        last.append(np.where(j >= k, p, np.uint64(0)))
    power = np.cumprod(np.full(int(n.max()) + 2, _PHI))
    run = np.cumsum((s + np.uint64(1)) * power[j], dtype=np.uint64)
    before = np.concatenate([[np.uint64(0)], run])
    prefix = before[:-1] - before[first[which]]
    two = last[0] | last[1] << np.uint64(8)
    three = two | last[2] << np.uint64(16)
    ctx = np.stack([two, three, three | last[3] << np.uint64(24), prefix], 1)
    keep = j > 0
    return s[keep].astype(np.uint8), ctx[keep], j[keep], which[keep]


def slots(ctx: np.ndarray, values: np.ndarray, kind: int) -> np.ndarray:
    """(predictors, bytes * 8) places in the joint table; kind 0: inside a word, 1: at its start."""
    node = _NODE_SALT[values]
    first, bits = (0, INNER) if kind == 0 else (len(INNER), START)
    out = np.empty((len(bits), len(values), 8), np.uint64)
    for k, b in enumerate(bits):
        np.bitwise_xor(mix64(ctx[:, k] + np.uint64(first + k + 1))[:, None], node, out=out[k])
        out[k] *= _PHI
        out[k] >>= np.uint64(64 - b)
        out[k] += np.uint64(OFFSET[first + k])
    return out.reshape(len(bits), -1).view(np.int64)


def merged(ctx: np.ndarray, values: np.ndarray, place: np.ndarray, run: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes inside words that nothing tells apart, as those of a prefix that neighbours share: the first place of
    each kind, ascending, and the kind of every byte.  With ``run``, bytes of different runs stay apart."""
    order = np.argsort(np.minimum(place, 65_535).astype(np.uint16), kind="stable")  # the same place of neighbours
    new = np.ones(len(order), bool)
    apart = np.zeros(max(len(order) - 1, 0), bool)
    # the last four bytes hold the last two and three; the gate asks for the first four places
    for x in (ctx[:, 2], ctx[:, 3], values, np.minimum(place, 4), *([np.arange(len(order)) // run] if run else [])):
        x = x[order]
        apart |= x[1:] != x[:-1]
    new[1:] = apart
    which = np.empty(len(order), np.int64)
    first = order[new]
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    which[order] = rank[np.cumsum(new) - 1]
    return np.sort(first), which


# ---------------------------------------------------------------- the model


@dataclass
class Mixer:
    """Counts, weights and map.  ``weights[kind]``: (gates, predictors + 1)."""

    n: np.ndarray = field(default_factory=lambda: np.zeros(2 * OFFSET[-1], np.uint32))  # zeros and ones of a slot side by side
    weights: list[np.ndarray] = field(default_factory=lambda: [np.full((GATES[k], len(b) + 1), 0.35, np.float32) for k, b in enumerate((INNER, START))])
    maps: np.ndarray = field(default_factory=lambda: np.zeros((2, 8, MAP, 2)))
    bits: float = 0.0
    moment: list = field(default_factory=lambda: [None, None])
    steps: list = field(default_factory=lambda: [0, 0])
    frozen: tuple | None = None

    def __post_init__(self):
        for w in self.weights:
            w[:, -1] = 0

    def votes(self, at: np.ndarray, kind: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Votes (predictors + 1, bits) and gates of bits at these slots."""
        x = np.empty((len(at) + 1, at.shape[1]), np.float32)
        seen = []
        pairs = self.n.view(np.uint64)
        for k, a in enumerate(at):
            if self.frozen is not None:
                x[k] = self.frozen[0].take(a)
                if k >= len(at) - 2:
                    seen.append(self.frozen[1].take(a))
                continue
            both = pairs.take(a).view(np.uint32).reshape(-1, 2)
            zeros, ones = both[:, 0].astype(np.float32), both[:, 1].astype(np.float32)
            if k >= len(at) - 2:
                seen.append(self.level(zeros + ones))
            ones += np.float32(D)
            zeros += np.float32(D)
            np.log(np.divide(ones, zeros, out=ones), out=x[k])
        x[-1] = 1
        gate = seen[1].astype(np.int64)
        if kind == 0:
            gate = (gate * 3 + np.minimum(seen[0], 2)) * 4 + np.repeat(np.minimum(place, 4) - 1, 8)
        return x, gate

    @staticmethod
    def level(seen: np.ndarray) -> np.ndarray:
        """How often a context was seen: never, once or twice, up to 15 times, more."""
        return (seen > 0).astype(np.uint8) + (seen > 2) + (seen > 15)

    def freeze(self) -> None:
        pairs = self.n.reshape(-1, 2)
        votes, level = np.empty(len(pairs), np.float32), np.empty(len(pairs), np.uint8)
        for a in range(0, len(pairs), 1 << 20):
            both = pairs[a : a + (1 << 20)].astype(np.float32)
            votes[a : a + len(both)] = np.log((both[:, 1] + np.float32(D)) / (both[:, 0] + np.float32(D)))
            level[a : a + len(both)] = self.level(both.sum(1))
        self.frozen, self.n = (votes, level), self.n[:2].copy()

    def refine(self, z: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of a one after the map; also the map's row and step of each bit."""
        p = 1 / (1 + np.exp(-z))
        row = np.tile(np.arange(8), len(z) // 8)
        step = np.clip(np.rint(z * 2 + MAP // 2), 0, MAP - 1).astype(np.int64)
        m = self.maps[kind]
        centre = 1 / (1 + np.exp(-(np.arange(MAP) - MAP // 2) / 2))
        q = (m[..., 1] + 30 * centre) / (m.sum(2) + 30)  # little evidence leaves the probability as it is
        return np.clip(0.5 * p + 0.5 * q[row, step], 1e-6, 1 - 1e-6), row, step

    def code(self, ctx: np.ndarray, values: np.ndarray, kind: int, place: np.ndarray, times: np.ndarray | None = None, run: int = 2048) -> np.ndarray:
        """ln probability of each byte.  With ``times`` (occurrences), weights and map learn from the bytes instead, and
        all are counted once the last is coded.  Bytes that can't differ are worked on once."""
        which, edges = None, np.arange(0, len(values), run)
        if kind == 0:
            first, which = merged(ctx, values, place, run if times is not None else None)
            ctx, values, place = ctx[first], values[first], place[first]
            if times is not None:
                times, edges = np.bincount(which, times, len(first)).astype(np.int64), np.searchsorted(first, edges)
            else:
                edges = np.arange(0, len(first), run)
        out, runs = np.empty(len(values) if times is None else 0), []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(values)]):
            v = values[a:b]
            at = slots(ctx[a:b], v, kind)
            x, gate = self.votes(at, kind, place[a:b])
            w = self.weights[kind][gate]
            z = np.clip(np.einsum("kn,nk->n", x, w), -12, 12)
            bit = _BITS[v].ravel()
            p, row, step = self.refine(z, kind)
            if times is None:
                out[a:b] = np.log(np.where(bit, p, 1 - p)).reshape(-1, 8).sum(1)
            else:
                runs.append((a, b, at.astype(np.int32) if a < KEPT else None))
                self.learn(kind, x, gate, z, bit, row, step, np.repeat(times[a:b], 8))
        if times is not None:
            self.count(runs, ctx, values, kind, times)
            return out
        return out if which is None else out[which]

    def learn(self, kind, x, gate, z, bit, row, step, times) -> None:
        err = (bit - 1 / (1 + np.exp(-z))) * times
        g = np.stack([np.bincount(gate, err * v, GATES[kind]) for v in x], 1) / np.maximum(np.bincount(gate, times, GATES[kind]), 1)[:, None]
        one, two = self.moment[kind] or (np.zeros_like(g), np.zeros_like(g))
        one, two = 0.9 * one + 0.1 * g, 0.99 * two + 0.01 * g * g
        self.moment[kind], self.steps[kind] = (one, two), self.steps[kind] + 1
        t = self.steps[kind]
        rate = 0.05 / (1 + t / 400)
        self.weights[kind] = (self.weights[kind] + rate * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        flat = np.bincount((row * MAP + step) * 2 + bit, times, 8 * MAP * 2)
        self.maps[kind] += flat.reshape(8, MAP, 2)
        self.bits += float(times.sum())

    def count(self, runs: list[tuple[int, int, np.ndarray | None]], ctx: np.ndarray, values: np.ndarray, kind: int, times: np.ndarray) -> None:
        """Count bytes, run by run (start, end, slots if they were kept): zeros in the low half of a slot's 64 bits, ones in the high."""
        pairs = self.n.view(np.uint64)
        for a, b, at in runs:
            t = (times[a:b, None].astype(np.uint64) << (_BITS[values[a:b]].astype(np.uint64) * np.uint64(32))).ravel()
            for k in slots(ctx[a:b], values[a:b], kind) if at is None else at:
                np.add.at(pairs, k.astype(np.int64), t)


@dataclass
class Tokens:
    """Words of texts as numbers: ``words`` distinct, ``at`` the number of each word, ``n`` words by text."""

    words: list[bytes]
    at: np.ndarray
    n: np.ndarray

    @cached_property
    def hashes(self) -> np.ndarray:
        return word_hashes(self.words)

    def sequence(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens with the end symbols (numbered len(words)), the token before each (len(words) + 1
        at a text's beginning), the number of the text."""
        text = np.repeat(np.arange(len(self.n)), self.n + 1)
        last = np.cumsum(self.n + 1) - 1
        seq = np.empty(len(text), np.int64)
        inside = np.ones(len(text), bool)
        inside[last] = False
        seq[inside], seq[last] = self.at, len(self.words)
        before = np.concatenate([[0], seq[:-1]])
        before[last - self.n] = len(self.words) + 1
        return seq, before, text


def tokens_of(texts: pa.Array) -> Tokens:
    """Texts (binary, without nulls), A-Z lower-cased and cut at white space, by array operations."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    edge = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().view(pa.binary()).dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    edge = edge - edge[0]
    if b"" in words:  # from white space at an end of a text
        gone = words.index(b"")
        keep = at != gone
        edge = np.concatenate([[0], np.cumsum(keep)])[edge]
        at = at[keep]
        at -= at > gone
        del words[gone]
    return Tokens(words, at, np.diff(edge))


class Starts:
    """First bytes of tokens by the token before: the distinct ones, and which of them each token has."""

    def __init__(self, t: Tokens):
        seq, before, self.text = t.sequence()
        # behind the words: the end, and what stands before a text
        size = np.fromiter(map(len, t.words), np.int64, len(t.words))
        raw = np.frombuffer(b"".join([b" ", *t.words]), np.uint8)
        last = np.cumsum(size)
        first = np.append(raw[last - size + 1], np.uint8(END))
        tail = np.where(size > 1, raw[last - 1], 32) + raw[last].astype(np.uint64) * np.uint64(256)
        tail, whole = (np.append(x, np.zeros(2, np.uint64)) for x in (tail.astype(np.uint64), t.hashes))
        coded = pa.array(before * 256 + first[seq]).dictionary_encode()
        both = coded.dictionary.to_numpy()
        order = np.argsort(both)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        both, self.which = both[order], rank[coded.indices.to_numpy()]
        self.times = np.bincount(self.which, minlength=len(both))
        b, self.first = both >> 8, (both & 255).astype(np.uint8)
        self.ctx = np.stack([np.zeros(len(b), np.uint64), tail[b] + np.uint64(1), whole[b]], 1)
        self.place = np.zeros(len(b), np.int64)


class Learner:
    """A task's online model.  Words wait until a run is full, are coded by what was counted before, then counted."""

    def __init__(self):
        self.mixer, self.words, self.run = Mixer(), {}, 2_000

    def add(self, t: Tokens) -> None:
        seen = self.words.get
        self.words.update([(w, c + seen(w, 0)) for w, c in zip(t.words, np.bincount(t.at, minlength=len(t.words)).tolist())])
        s = Starts(t)
        self.mixer.code(s.ctx, s.first, 1, s.place, s.times)
        if len(self.words) >= self.run:
            self.flush()

    def flush(self) -> None:
        words = sorted(self.words)  # neighbours share their first bytes, and so the slots of those
        times = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        for a, b in slices([len(w) + 1 for w in words], 1 << 18):
            values, ctx, place, which = inner_contexts(words[a:b])
            self.mixer.code(ctx, values, 0, place, times[a:b][which])
        self.words.clear()
        self.run = min(self.run * 4, 200_000)


@dataclass
class Model:
    """A mixer that learns no more: votes and what contexts have seen are looked up ready-made."""

    mixer: Mixer

    def __post_init__(self):
        self.mixer.freeze()
        self.forget()

    def forget(self) -> None:
        """Words scored so far (``names``), and by their places: ln probability, count (-1: not hot), hash."""
        self.names = pa.array([], pa.binary())
        self.known, self.count, self.hashes = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def places(self, names: list[bytes], hot: np.ndarray, hot_n: np.ndarray) -> np.ndarray:
        """Places of distinct words; new ones are scored.  Kept from task to task of a Python worker."""
        if len(self.names) > 1_000_000:
            self.forget()
        column = pa.array(names, pa.binary())
        place = pc.index_in(column, value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            new = [names[i] for i in fresh.tolist()]
            h = word_hashes(new)
            at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
            c = np.where(hot[at] == h, hot_n[at], -1) if len(hot) else np.full(len(new), -1)
            spelled = self.word_scores(new)
            spelled[[i for i, w in enumerate(new) if w == b"\n"]] = 0
            place[fresh] = len(self.names) + np.arange(len(new))
            self.names = pa.concat_arrays([self.names, column.take(pa.array(fresh))])
            self.known, self.count, self.hashes = np.concatenate([self.known, spelled]), np.concatenate([self.count, c]), np.concatenate([self.hashes, h])
        return place

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """ln probability of each word after its first byte, its space included."""
        out, order = np.zeros(len(words)), sorted(range(len(words)), key=words.__getitem__)
        words = [words[i] for i in order]
        for a, b in slices([len(w) + 1 for w in words], 1 << 18):
            values, ctx, place, which = inner_contexts(words[a:b])
            out[order[a:b]] = np.bincount(which, self.mixer.code(ctx, values, 0, place), b - a)
        return out

    def start_scores(self, t: Tokens) -> np.ndarray:
        """ln probability of all word starts and the end, by text."""
        s = Starts(t)
        return np.bincount(s.text, self.mixer.code(s.ctx, s.first, 1, s.place)[s.which], len(t.n))


# ---------------------------------------------------------------- the job


def _zip(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unzip(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _word_parts(hashes: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its hashes), hashes ascending inside each."""
    bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    edge = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(order) else []
    for a, b in zip(edge, [*edge[1:], len(order)]):
        yield int(bucket[order[a]]), order[a:b]


PARTS = "kind int, part int, x binary, y binary"
SUMMED = {"kind": "int", "part": "int", "g": "int", "x": "binary", "y": "binary"}
FAN = 256  # tasks or sums that are added up at a time


def _row(kind: int, part: int, x: bytes, y: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([x], pa.binary()), pa.array([y], pa.binary())], names=["kind", "part", "x", "y"])


def learn(docs: DataFrame, n_buckets: int) -> DataFrame:
    """What docs(text) teach, summed: kind 0: word hashes and counts of a bucket; 1: zero and one
    counts of a part of the table; 2: weights times bits, and maps."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, some = Learner(), False
        for b in batches:
            raw = b.column(0).fill_null(b"")
            for a, z in slices(pc.binary_length(raw).to_pylist(), SLICE):
                t = tokens_of(raw.slice(a, z - a))
                learner.add(t)
                some = True
                h = np.append(t.hashes, np.uint64(word_hash(b"\n")))
                n = np.append(np.bincount(t.at, minlength=len(t.words)), len(t.n))  # the end symbols last
                for part, at in _word_parts(h, n_buckets):
                    yield _row(0, part, h[at].tobytes(), n[at].astype("<u4").tobytes())
            pa.default_memory_pool().release_unused()
        if some:
            learner.flush()
            m = learner.mixer
            for k in range(0, len(m.n), PART):
                if m.n[k : k + PART].any():
                    yield _row(1, k // PART, _zip(m.n[k : k + PART]), b"")
            weights = np.concatenate([w.ravel().astype(float) * m.bits for w in m.weights] + [[m.bits]])
            yield _row(2, TaskContext.get().partitionId() % 32, weights.tobytes(), m.maps.tobytes())

    def total(first: bool):
        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            kind, part, g = map(int, key)
            if kind == 0:
                if len(pdf) == 1 and not first:
                    return pdf.assign(g=g)[[*SUMMED]]
                h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["x"]])
                n = np.concatenate([np.frombuffer(y, "<u4" if first else "<i8") for y in pdf["y"]])
                u, at = np.unique(h, return_inverse=True)
                x, y = u.tobytes(), np.bincount(at, n, len(u)).astype("<i8").tobytes()
            elif kind == 1:
                all_ = np.zeros(len(_unzip(pdf["x"].iloc[0], np.uint32)), np.uint64)
                for v in pdf["x"]:
                    all_ += _unzip(v, np.uint32)
                x, y = _zip(all_.clip(0, 2**31).astype(np.uint32)), b""
            else:
                x, y = (np.sum([np.frombuffer(v) for v in pdf[c]], axis=0).tobytes() for c in "xy")
            return pd.DataFrame({"kind": [kind], "part": [part], "g": [g], "x": [x], "y": [y]})

        return add

    # a tree: what FAN tasks learned is summed first, then FAN of those sums, then the rest
    rows = docs.mapInArrow(work, PARTS).withColumn("g", F.spark_partition_id())
    schema = ", ".join(f"{c} {t}" for c, t in SUMMED.items())
    for level in range(3):
        up = F.floor(F.col("g") / FAN) if level < 2 else F.lit(0)
        rows = rows.withColumn("g", up.cast("int")).groupBy("kind", "part", "g").applyInPandas(total(level == 0), schema)
    return rows.drop("g")


def _model_bytes(learned: DataFrame) -> dict:
    """The bounded model: table parts (SLOTS), weights and maps, on the driver."""
    parts = {(r["kind"], r["part"]): (bytes(r["x"]), bytes(r["y"])) for r in learned.where("kind = 1").collect()}
    sums = [(np.frombuffer(r["x"]), np.frombuffer(r["y"])) for r in learned.where("kind = 2").collect()]
    w = np.sum([x for x, _ in sums], axis=0) if sums else None
    return {"parts": {p: v for (_, p), v in parts.items()}, "weights": w, "maps": np.sum([y for _, y in sums], axis=0) if sums else None}


_LOADED: dict[str, Model] = {}


def _load(shared) -> Model:
    """The model of a broadcast, built once in a Python worker."""
    if shared.value["id"] not in _LOADED:
        _LOADED.clear()
        m, got = Mixer(), shared.value
        for part, (x, _) in got["parts"].items():
            m.n[part * PART : part * PART + PART] = _unzip(x, np.uint32)
        if got["weights"] is not None and got["weights"][-1]:
            w = (got["weights"][:-1] / got["weights"][-1]).astype(np.float32)
            cut = m.weights[0].size
            m.weights = [w[:cut].reshape(m.weights[0].shape), w[cut:].reshape(m.weights[1].shape)]
            m.maps = got["maps"].reshape(m.maps.shape).copy()
        _LOADED[got["id"]] = Model(m)
    return _LOADED[shared.value["id"]]


def _hot_words(learned: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(N, V, hashes, counts) with the words of the greatest counts, at most HOT of them, hashes ascending."""

    def sizes(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.concatenate([np.frombuffer(y, "<i8") for y in pdf["y"]])
        c, m = np.unique(n, return_counts=True)
        return pd.DataFrame({"c": c, "m": m})

    words = learned.where("kind = 0")
    each = words.groupBy("part").applyInPandas(sizes, "c long, m long").groupBy("c").agg(F.sum("m").alias("m"))
    got = sorted(((r["c"], r["m"]) for r in each.collect()), reverse=True)  # distinct counts: at most sqrt(2 N)
    total, distinct, bar, many = sum(c * m for c, m in got), sum(m for _, m in got), None, 0
    for c, m in got:
        if many + m > HOT:
            break
        bar, many = c, many + m
    if bar is None:
        return total, distinct, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, n = np.frombuffer(x, np.int64), np.frombuffer(y, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([h[n >= bar].tobytes()], pa.binary()), pa.array([n[n >= bar].tobytes()], pa.binary())], names=["h", "n"])

    rows = words.select("x", "y").mapInArrow(above, "h binary, n binary").collect()
    h = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rows])
    n = np.concatenate([np.frombuffer(r["n"], np.int64) for r in rows])
    order = np.argsort(h)
    return total, distinct, h[order], n[order]


def scores(docs: DataFrame, held_out: int = 7, held: int = 2, bucket_words: int = 1 << 19) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.
    Learns from the documents whose ``id_bucket(held_out)`` isn't ``held``."""
    spark = docs.sparkSession
    is_held = F.coalesce(id_bucket("doc_id", held_out) == held, F.lit(False))
    rows = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")), "doc_id")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    n_buckets = int(max(spark.sparkContext.defaultParallelism * 2, size // 40 // bucket_words))
    learned = stored(learn(rows.where(~is_held).select("text"), n_buckets), "mixing-learned")
    n_all, n_distinct, hot, hot_n = _hot_words(learned)
    model = _model_bytes(learned)
    model["id"] = uuid.uuid4().hex  # workers outlive a call: never the id of another call's model
    shared, shared_hot = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast((hot, hot_n))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = _load(shared)
        hot, hot_n = shared_hot.value
        batch = TaskContext.get().partitionId() << 32
        for b in batches:
            keys, raw, marks = b.column(0), b.column(1).fill_null(b""), b.column(2)
            for a, z in slices(pc.binary_length(raw).to_pylist(), SLICE):
                t = tokens_of(raw.slice(a, z - a))
                names = [*t.words, b"\n"]  # the end symbol is numbered as in its sequence
                place = lm.places(names, hot, hot_n)
                known, count, hashes = lm.known, lm.count, lm.hashes
                n = t.n + 1
                seq, _, doc = t.sequence()
                token = place[seq]
                c = count[token]
                score = np.bincount(doc, known[token], len(n)) + lm.start_scores(t)
                base = np.bincount(doc, np.where(c >= 0, np.log10(np.maximum(c, 0) + 1.0), 0), len(n))
                seen = np.bincount(doc, c > 0, len(n)).astype(np.int64)
                long = np.array([len(w) + 1 for w in t.words] + [1])
                size = np.bincount(doc, long[seq], len(n)).astype(np.int64)
                head = pd.DataFrame({"doc_id": keys.slice(a, z - a).fill_null(0).to_numpy(zero_copy_only=False), "no_id": keys.slice(a, z - a).is_null().to_numpy(zero_copy_only=False), "held": marks.slice(a, z - a).to_pandas(), "n": n, "size": size, "score": score, "base": base, "seen": seen})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, (table := pa.Table.from_pandas(head, preserve_index=False)).schema) as w:
                    w.write_table(table)
                yield _entry(batch % n_buckets, 0, batch, sink.getvalue().to_pybytes(), b"", b"")
                cold = c < 0
                word, at = np.unique(token[cold], return_inverse=True)
                owner = doc[cold].astype("<u4")
                order = np.argsort(at, kind="stable")
                ends = np.cumsum(np.bincount(at, minlength=len(word)))
                for part, which in _word_parts(hashes[word], n_buckets):
                    pieces = np.concatenate([owner[order[ends[i - 1] if i else 0 : ends[i]]] for i in which.tolist()])
                    times = np.diff(ends, prepend=0)[which].astype("<u4")
                    yield _entry(part, 1, batch, hashes[word[which]].tobytes(), times.tobytes(), pieces.tobytes())
                batch += 1

    asked = rows.withColumn("held", is_held).mapInArrow(work, "part int, kind int, batch long, x binary, y binary, z binary")

    def answer(key: tuple, pdf: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        out = [(r.batch, 0, r.x, b"") for r in pdf[pdf["kind"] == 0].itertuples()]
        h, n = (np.frombuffer(words["x"].iloc[0], np.uint64), np.frombuffer(words["y"].iloc[0], "<i8")) if len(words) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for r in pdf[pdf["kind"] == 1].itertuples():
            q, times, owner = np.frombuffer(r.x, np.uint64), np.frombuffer(r.y, "<u4"), np.frombuffer(r.z, "<u4")
            at = np.minimum(np.searchsorted(h, q), max(len(h) - 1, 0))
            c = np.where(h[at] == q, n[at], 0) if len(h) else np.zeros(len(q), np.int64)
            each = np.repeat(c, times)
            out.append((r.batch, 1, np.bincount(owner, np.log10(each + 1.0)).tobytes(), np.bincount(owner, each > 0).tobytes()))
        return pd.DataFrame(out, columns=["batch", "kind", "x", "y"])

    counted = learned.where("kind = 0").select("part", "x", "y")
    answers = asked.groupBy("part").cogroup(counted.groupBy("part")).applyInPandas(answer, "batch long, kind int, x binary, y binary")
    rest = float(np.log10(n_all + n_distinct + 1))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "x"], kind="stable")  # sums in one order: reruns agree to the last bit
        head = pa.ipc.open_stream(pdf["x"].iloc[0]).read_pandas()
        base, seen = head["base"].to_numpy(copy=True), head["seen"].to_numpy(copy=True)
        for x, y in pdf.loc[pdf["kind"] == 1, ["x", "y"]].itertuples(index=False):
            b, s = np.frombuffer(x), np.frombuffer(y)
            base[: len(b)] += b
            seen[: len(s)] += s.astype(np.int64)
        score = head["score"] / np.log(10)
        return pd.DataFrame({
            "doc_id": head["doc_id"].astype("Int64").mask(head["no_id"]), "held_out": head["held"], "n_tokens": head["n"], "n_known": seen, "train_tokens": n_all,
            "base_score": base - head["n"] * rest, "score": score, "bits_per_byte": -score * np.log2(10) / head["size"],
        })

    return answers.groupBy("batch").applyInPandas(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    )


def _entry(part: int, kind: int, batch: int, x: bytes, y: bytes, z: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([batch], pa.int64()), *(pa.array([v], pa.binary()) for v in (x, y, z))], names=["part", "kind", "batch", "x", "y", "z"]
    )
