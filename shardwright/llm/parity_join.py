"""Operator 9: exact n-gram Jaccard join by parity sketches.

A document's set is its distinct k-word shingles (64-bit hashes; A-Z lower-cased).  Sets A, B with
``100 |A and B| >= 80 |A or B|`` differ in at most ``(|A| + |B|) / 9`` shingles.

Sketch.  Size bands have borders that grow by ``RATIO``; scheme b serves pairs whose smaller
set lies in band b.  There at most d shingles differ.  The scheme deals shingles by hash over
s = d + 1 + e segments and XORs the hashes of a segment into 64 bits.  A shingle sits in one segment,
so the number of segments that differ is a lower bound of the symmetric difference, and at least
e + 1 segments of a linking pair agree (pigeonhole).  A document with at most e empty segments thus
agrees with every partner in one that isn't empty: only those are joined.  A document with more
empties also joins in the next round, under another seed, where it can only lack partners that
had too many as well; after ``ROUNDS`` rounds what is left joins on the scheme alone.  No pair is lost.

Join.  The texts are read once: a task gives every document's size, fingerprint and a sketch of one-bit
parities, and the segment signatures as packed arrays, dealt by signature over buckets whose number
follows from the input.  In a part of a batch equal sets are one, and a signature that several documents share
is sent once, so a hot group sends as many entries as there are parts (some MB of text each).  A signature's documents
give a star around the least id, and are written as a group.

Verify.  A pair whose sizes rule it out, or whose parity sketches differ in more bits than shingles may
(their Hamming distance never exceeds the symmetric difference), is dropped; whole sets are made for
what is left.  1. Each document against the centre it shares most signatures with; links are joined to
components.  2. All star pairs whose ends lie in different components.  3. Groups that still span
components: all pairs across them, block by block (no task holds a hot group).  Links are exact.

Defined cases: fewer than k words: the whole sequence is the one shingle; no words or a null text: no
shingles, no links; a null id has no component; rows of one id are one node; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import FILTER_BITS, Memo, id_filter, mix64, slices, spread, stored, text_bytes
from shardwright.llm.components import components

SHINGLE = 5
RATIO = 1.5
ROUNDS = 6
BITS = 2048  # of the smallest one-bit parity sketch
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, 400_000)


def shingles(text: bytes, memo: Memo, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles."""
    words = text.lower().split()
    n = len(words)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    memo.trim()
    if not n:
        return h
    m = min(n, k)
    total = h[: n - m + 1] * _MULT[0]
    for j in range(1, m):
        total = mix64(total) + h[j : n - m + 1 + j] * _MULT[j % len(_MULT)]
    return np.unique(mix64(total + np.uint64(m)))


# ---------------------------------------------------------------- schemes


def borders(largest: int) -> list[int]:
    out = [4]  # sets of fewer than four shingles link only if equal
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


def most_different(larger_border: int) -> int:
    """Shingles that differ at most when the smaller set is below this border: (a + a/0.8) / 9."""
    return (larger_border - 1) // 4


def segments(d: int) -> tuple[int, int]:
    """(number of segments, empties e that a document may have)."""
    e = 1 + d // 5
    return d + 1 + e, e


def schemes_of(n: int) -> list[tuple[int, int]]:
    """(scheme, d) in which a set of n shingles takes part: its band's, and the one below if a set
    there can be so small and still link (n <= smaller / 0.8)."""
    if n < 4:
        return []
    b = borders(n)
    own = len(b) - 2
    out = [(own, most_different(b[own + 1]))]
    if own and 4 * n <= 5 * (b[own] - 1):
        out.append((own - 1, most_different(b[own])))
    return out


def signatures(h: np.ndarray) -> np.ndarray:
    """64-bit signatures of a set's segments, over its schemes and rounds."""
    out = []
    for scheme, d in schemes_of(len(h)):
        s, e = segments(d)
        for turn in range(ROUNDS + 1):
            salt = mix64(np.array([scheme * 64 + turn + 1], np.uint64))
            if turn == ROUNDS:
                out.append(salt)
                break
            g = mix64(h ^ salt[0]) if turn else h
            seg = ((g >> np.uint64(32)) * np.uint64(s)) >> np.uint64(32)
            order = np.argsort(seg.astype(np.uint16) if s < 65_536 else seg, kind="stable")
            seg = seg[order]
            start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            xor = np.bitwise_xor.reduceat(g[order], start)
            out.append(mix64(xor + seg[start] * _MULT[0] + salt[0]))
            if s - len(start) <= e:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """The contract's test on two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    inside = int((both[1:] == both[:-1]).sum())
    return 100 * inside >= 80 * (len(a) + len(b) - inside) and len(a) > 0


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """Bits (packed), each the parity of the shingles that hash to it; four to eight a shingle, BITS at least."""
    m = max(BITS, 1 << (4 * len(h) - 1).bit_length()) if len(h) else BITS
    bit = np.bincount(((h >> np.uint64(7)) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bit.astype(np.uint8))


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch (bytes) as one of ``size`` bytes: parities of bits that are the same modulo the smaller size."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def hamming(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, at the size of the smaller."""
    n = min(len(a), len(b))
    x, y = (folded(np.frombuffer(v, np.uint8), n) for v in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


# ---------------------------------------------------------------- the job


def _packed(bucket: int, kind: int, *arrays: np.ndarray) -> pa.RecordBatch:
    head = [pa.array([bucket], pa.int32()), pa.array([kind], pa.int32())]
    return pa.RecordBatch.from_arrays([*head, *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=["bucket", "kind", "x", "y", "z"])


def _stars(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries (group, id) -> (first of each group's ids; pairs centre, id, times; entries of groups of two or more)."""
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])]) if len(g) else np.zeros(0, bool)
    g, i = g[fresh], i[fresh]
    start = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    at = np.cumsum(start) - 1
    first = np.flatnonzero(start)
    size = np.bincount(at, minlength=len(first))
    centre = i[first][at] if len(g) else i
    rest = ~start
    pairs, times = np.unique(np.stack([centre[rest], i[rest]], 1), axis=0, return_counts=True) if rest.any() else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    many = size[at] > 1 if len(g) else rest
    return first, np.stack([g, i], 1) if len(g) else np.zeros((0, 2), np.int64), np.column_stack([pairs, times]), g[many], i[many]


def prepared(docs: DataFrame, n_buckets: int) -> DataFrame:
    """docs(doc_id, text) -> packed rows (bucket, kind, x, y, z); kind 0: entries (signature, id) of a bucket;
    of a batch alone, 1: star pairs (centre, id, times), 2: groups (group, id), 3: documents (``information``)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for b in batches:
            raw = b.column(1).fill_null(b"")
            for x, y in slices(pc.binary_length(raw).to_pylist(), 6 << 20):
                yield from part(b.column(0).slice(x, y - x).to_pylist(), raw.slice(x, y - x).to_pylist(), memo)
            pa.default_memory_pool().release_unused()

    def part(keys: list, texts: list[bytes], memo: Memo) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        about, sketches, whole = [], [], {}
        for key, text in zip(keys, texts):
            h = shingles(text, memo)
            print_ = xxhash.xxh3_128_digest(h.tobytes())
            sketches.append(parity_sketch(h).tobytes())
            about.append((key or 0, key is None, len(h), *np.frombuffer(print_, np.int64).tolist(), len(sketches[-1])))
            if key is not None and len(h) >= 4:  # equal sets: the least id stands for them
                if print_ not in least:
                    whole[print_] = signatures(h)
                least[print_] = min(key, least.get(print_, key))
        anywhere = int(about[0][0]) % n_buckets  # rows of this part alone may go to any bucket
        yield _packed(anywhere, 3, np.array(about, "<i8"), np.frombuffer(b"".join(sketches), np.uint8), np.zeros(0))
        if not whole:
            return
        own = np.repeat(np.array([least[p] for p in whole], np.int64), list(map(len, whole.values())))
        sig = np.concatenate(list(whole.values()))
        group = ((sig % np.uint64(n_buckets)) << np.uint64(32) | (sig >> np.uint64(32))).astype(np.int64)
        first, entries, pairs, g, i = _stars(group, own)
        lone = entries[first]
        cut = np.flatnonzero(np.concatenate([[True], lone[1:, 0] >> 32 != lone[:-1, 0] >> 32]))
        for x, y in zip(cut, [*cut[1:], len(lone)]):
            yield _packed(int(lone[x, 0] >> 32), 0, (lone[x:y, 0] & 0xFFFFFFFF).astype("<u4"), lone[x:y, 1].astype("<i8"), lone[:0, 1])
        for kind, arrays in ((1, (pairs[:, 0], pairs[:, 1], pairs[:, 2])), (2, (g, i, i[:0]))):
            if len(arrays[0]):
                yield _packed(anywhere, kind, *(np.ascontiguousarray(x).astype("<i8") for x in arrays))

    return docs.mapInArrow(send, "bucket int, kind int, x binary, y binary, z binary")


def candidates(sent: DataFrame) -> DataFrame:
    """kind 0: (a, b, n) b shares n signatures with the centre a; kind 1: (a, b) id b is of group a."""

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []

        def give(kind, a, b, n):
            out.append(pd.DataFrame({"kind": np.full(len(a), kind, np.int32), "a": a, "b": b, "n": n}))

        entries = pdf[pdf["kind"] == 0]
        if len(entries):
            sig = np.concatenate([np.frombuffer(x, "<u4") for x in entries["x"]]).astype(np.int64)
            ids = np.concatenate([np.frombuffer(x, "<i8") for x in entries["y"]])
            _, _, pairs, g, i = _stars((np.int64(key[0]) << 32) | sig, ids)
            give(0, pairs[:, 0], pairs[:, 1], pairs[:, 2])
            give(1, g, i, np.ones(len(g), np.int64))
        for x, y, z in pdf.loc[pdf["kind"] == 1, ["x", "y", "z"]].itertuples(index=False):
            give(0, *(np.frombuffer(v, "<i8") for v in (x, y, z)))
        for x, y in pdf.loc[pdf["kind"] == 2, ["x", "y"]].itertuples(index=False):
            a = np.frombuffer(x, "<i8")
            give(1, a, np.frombuffer(y, "<i8"), np.ones(len(a), np.int64))
        return pd.concat(out) if out else pd.DataFrame({"kind": [], "a": [], "b": [], "n": []})

    return sent.where("kind < 3").groupBy("bucket").applyInPandas(meet, "kind int, a long, b long, n long")


def information(sent: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), sketch for every document row."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = np.frombuffer(x, "<i8").reshape(-1, 6)
                offsets = np.concatenate([[0], np.cumsum(t[:, 5])]).astype(np.int32)
                sketch = pa.Array.from_buffers(pa.binary(), len(t), [None, pa.py_buffer(offsets), pa.py_buffer(y)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[:, 0], mask=t[:, 1] > 0), *(pa.array(t[:, k]) for k in (2, 3, 4)), sketch], names=["doc_id", "n_shingles", "f1", "f2", "sketch"]
                )

    return sent.where("kind = 3").select("x", "y").mapInArrow(unpack, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary")


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of pairs(a, b, ...) that set sizes and parity sketches(id, size, sketch) don't rule out."""
    left, right = (sketches.select(F.col("id").alias(x), F.col("size").alias(f"_s{x}"), F.col("sketch").alias(f"_k{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select(*pairs.columns, "_sa", "_sb", "_ka", "_kb")
    names, m = pairs.columns, len(pairs.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sa, sb = (b.column(m + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            near = 9 * np.abs(sa - sb) <= sa + sb
            far = [hamming(x, y) if c else 0 for c, x, y in zip(near.tolist(), b.column(m + 2).to_pylist(), b.column(m + 3).to_pylist())]
            ok = near & (9 * np.array(far) <= sa + sb)
            yield pa.RecordBatch.from_arrays(b.columns[:m], names=names).filter(pa.array(ok))

    return both.mapInArrow(keep, pairs.schema).distinct()


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, h (its set, packed) of the documents whose ids(id) are asked for (and a few more)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(id_filter(ids))
    keep = docs.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8))
        for b in batches:
            at = np.flatnonzero(bits[b.column(2).to_numpy(zero_copy_only=False)])
            for x in range(0, len(at), 2000):
                part = b.take(pa.array(at[x : x + 2000]))
                sets = [shingles(t or b"", memo).astype("<u8").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["doc_id", "h"])

    sets = keep.mapInArrow(work, "doc_id long, h binary")
    return sets.repartition("doc_id").dropDuplicates(["doc_id", "h"])  # rows of one id may differ


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) whose sets link."""
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("h").alias(f"h{x}")) for x in "ab")
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ha", "hb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [links(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(work, "a long, b long")


def _classes(pairs: DataFrame, cc: DataFrame) -> DataFrame:
    """pairs(a, b) whose ends lie in different components."""
    ca, cb = (cc.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    both = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def across(groups: DataFrame, cc: DataFrame, sketches: DataFrame, block: int = 1024, per_task: int = 5000, most: int = 200_000) -> DataFrame:
    """groups(g, id) that span components: pairs of different components that set size and the Hamming
    distance of parity sketches don't rule out."""
    c = cc.select(F.col("node").alias("id"), "component")
    rows = stored(groups.join(c, "id", "left").select("g", "id", F.coalesce("component", "id").alias("c")), "parity-groups")
    prints = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"f{k}") for k in (1, 2)]
    open_ = rows.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("id").alias("lead"), *prints).where("m > 2 and c0 < c1")
    # groups of the same documents: one will do
    open_ = stored(open_.groupBy("m", "f1", "f2", "lead").agg(F.min("g").alias("g")).select("g", "m", "lead"), "parity-open")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [folded(np.frombuffer(x, np.uint8), BITS // 8).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["id", "size", "sketch"])

    sketches = sketches.select("id", "size", "sketch").mapInArrow(small, "id long, size long, sketch binary")
    s = F.ceil(F.col("m") / block).cast("int")
    dealt = rows.join(open_, "g").withColumn("s", s).withColumn("own", F.pmod(F.xxhash64("id"), F.col("s")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.select("g", "lead", "id", "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    # blocks of groups with one least id go together, so that a pair that they share is given once.  A least
    # id with more than ``most`` rows (about 80 MB) is dealt by group; each part may give a pair again, so
    # ``most`` is as large as a task's memory allows, and the pairs are made distinct after
    rows_dealt = F.sum(F.col("m") * F.ceil(F.col("m") / block))
    total = open_.agg(rows_dealt.alias("n")).first()["n"] or 0
    tasks = int(max(16, total // per_task))
    parts = open_.groupBy("lead").agg(F.ceil(rows_dealt / most).alias("parts"))
    part = open_.join(parts, "lead").select("g", F.pmod(F.xxhash64("g", F.lit(3)), F.col("parts")).alias("part"))
    t = F.pmod(F.xxhash64("lead", "part", "i", "j"), F.lit(tasks))
    filled = dealt.join(part, "g").join(sketches, "id").withColumn("t", t).drop("part")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        for at in pdf.groupby(["g", "i", "j"], sort=False).indices.values():
            ids, cs, size, side = (pdf[x].to_numpy()[at] for x in ("id", "c", "size", "side"))
            bits = np.frombuffer(b"".join(pdf["sketch"].to_numpy()[at]), np.uint64).reshape(len(at), BITS // 64)
            mixed = side.min() != side.max()
            for x in range(len(at) - 1):
                y = np.arange(x + 1, len(at))
                y = y[(cs[y] != cs[x]) & (9 * np.abs(size[y] - size[x]) <= size[y] + size[x])]
                if mixed:
                    y = y[side[y] != side[x]]
                if len(y):
                    far = np.bitwise_count(bits[y] ^ bits[x]).sum(1)
                    y = y[9 * far <= size[y] + size[x]]
                    found.update((min(ids[x], k), max(ids[x], k)) for k in ids[y].tolist())
        return pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    return filled.groupBy("t").applyInPandas(compare, "a long, b long").distinct()


def similar_documents(docs: DataFrame, entries_per_bucket: int = 1 << 20) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id for every row of docs."""
    rows = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")), "doc_id")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    n_buckets = int(max(rows.sparkSession.sparkContext.defaultParallelism * 2, size // 12 // entries_per_bucket))  # about an entry per 12 bytes
    sent = stored(prepared(rows, n_buckets), "parity-sent", ("kind",))
    about = information(sent)
    # equal sets: one representative, the least id (aggregated before the shuffle)
    sets = about.drop("sketch")
    reps = sets.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    marked = stored(sets.join(reps, ["n_shingles", "f1", "f2"], "left").select("doc_id", "n_shingles", "rep"), "parity-marked")
    same = marked.where("rep is not null and doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    sketches = about.where("doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "sketch")

    found = stored(candidates(sent), "parity-candidates", ("kind",))
    pairs = stored(possible(found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")), sketches), "parity-pairs")
    known = rows.where("doc_id is not null")
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    whole = stored(sets_of(known, ends(pairs)), "parity-whole")
    linked = lambda p, w, label: stored(verified(p, w).select(F.col("b").alias("u"), F.col("a").alias("v")), label)
    # 1. each document and its best centre
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    edges = linked(best, whole, "parity-links").union(same)
    cc = stored(components(edges), "parity-components")
    # 2. the other star pairs, 3. groups, as far as they span components
    groups = found.where("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("id")).distinct()
    for step in ("stars", "groups"):
        rest = stored(_classes(pairs, cc) if step == "stars" else possible(across(groups, cc, sketches), sketches), f"parity-{step}-left")
        if rest.isEmpty():
            continue
        if step == "groups":
            whole = stored(sets_of(known, ends(rest)), "parity-whole")
        more = linked(rest, whole, f"parity-{step}")
        if not more.isEmpty():
            edges = edges.union(more)
            cc = stored(components(edges), "parity-components")
    out = marked.join(cc, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents whose class has a smaller id; identical rows of one id become one."""
    gone = similar_documents(docs).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    some = F.coalesce(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.where(~some).unionByName(kept.where(some).dropDuplicates(["doc_id", "text"])).select(*docs.columns)
