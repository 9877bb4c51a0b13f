"""Operator 10: byte-level BPE encoding and decoding with a segment tree per piece.

A piece is a match of the pre-tokeniser's pattern.  Over its byte positions stands a segment
tree; the leaf of a live position holds the rank of the pair that begins there, every inner
node the leftmost minimum below it (rank and position in one integer).  The root names the
next merge; it changes three leaves: the merged position, its dead right neighbour, and the
live neighbour on the left.  Each is a point update of log2(width) nodes, so a piece of n bytes
costs O(n log n) whatever its text.

Distinct short pieces of a batch are merged in lockstep, a numpy row per piece; long ones one by one.

Defined cases: null and empty texts have no ids and decode to empty; ids may be null or repeat (each
row is encoded by itself); empty tables give empty results; other columns are ignored, or
kept by ``encoded_documents``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shardwright.llm.chunks import ChunkCoder, Codes, text_slices
from shardwright.llm.common import spread, text_bytes

NONE = np.int64(1) << np.int64(62)
LONG = 128  # bytes; wider trees are walked one by one


class Ranks:
    """Tokens and the rank of every pair of tokens whose concatenation is a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = dict(zip(self.rank.values(), self.rank))
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.size = np.zeros(max(self.token) + 1, np.int64)  # bytes of each token, 0 if there is none
        for r, token in self.token.items():
            self.size[r] = len(token)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.token.get(r, b"") for r in range(len(self.size))), np.uint8)
        self.pair: dict[tuple[int, int], int] = {}
        for token, r in self.rank.items():
            for i in range(1, len(token)):
                left, right = self.rank.get(token[:i]), self.rank.get(token[i:])
                if left is not None and right is not None:
                    self.pair[left, right] = r
        keys = np.array([(a << 32) | b for a, b in self.pair], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(self.pair.values()), np.int64)[order]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)


def merge_rows(pieces: list[bytes], width: int, ranks: Ranks) -> list[list[int]]:
    """Token ids of pieces of 2..width bytes, all merged in lockstep; width: a power of two."""
    n = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    sym = ranks.byte[raw]
    place = np.arange(width)
    nxt = np.broadcast_to(place + 1, (n, width)).copy()
    prv = np.broadcast_to(place - 1, (n, width)).copy()
    live = place < size[:, None]
    tree = np.full((n, 2 * width), NONE)
    r = ranks.pairs(sym[:, :-1], sym[:, 1:])
    r[~live[:, 1:]] = NONE
    tree[:, width : 2 * width - 1] = np.where(r < NONE, r * width + place[:-1], NONE)
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    row = np.flatnonzero(tree[:, 1] < NONE)
    while len(row):
        top = tree[row, 1]
        pos, new = top % width, top // width
        dead = nxt[row, pos]
        after = nxt[row, dead]
        before = prv[row, pos]
        sym[row, pos] = new
        live[row, dead] = False
        nxt[row, pos] = after
        right = after < size[row]
        prv[row[right], after[right]] = pos[right]
        leaf = np.full(len(row), NONE)
        x = ranks.pairs(new[right], sym[row[right], after[right]])
        leaf[right] = np.where(x < NONE, x * width + pos[right], NONE)
        tree[row, width + pos] = leaf
        tree[row, width + dead] = NONE
        left = before >= 0
        lr, lb = row[left], before[left]
        x = ranks.pairs(sym[lr, lb], new[left])
        tree[lr, width + lb] = np.where(x < NONE, x * width + lb, NONE)
        for rows, at in ((row, width + pos), (row, width + dead), (lr, width + lb)):
            at = at >> 1
            while len(at) and at[0]:  # all leaves are on one level, so all reach the root together
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
                at = at >> 1
        row = row[tree[row, 1] < NONE]
    flat, ends = sym[live].tolist(), np.cumsum(live.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """The same for one piece of any length, in plain integers."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    none, pair = int(NONE), ranks.pair
    sym = ranks.byte[np.frombuffer(piece, np.uint8)].tolist()
    nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    tree = [none] * (2 * width)

    def leaf(i: int, j: int) -> int:
        r = pair.get((sym[i], sym[j])) if 0 <= i and j < n else None
        return none if r is None else r * width + i

    for i in range(n - 1):
        tree[width + i] = leaf(i, i + 1)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            value = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == value:
                return
            tree[i] = value
            i >>= 1

    while tree[1] < none:
        new, pos = divmod(tree[1], width)
        dead = nxt[pos]
        after = nxt[dead]
        sym[pos], live[dead], nxt[pos] = new, False, after
        if after < n:
            prv[after] = pos
        put(dead, none)
        put(pos, leaf(pos, after))
        if prv[pos] >= 0:
            put(prv[pos], leaf(prv[pos], pos))
    return [s for s, alive in zip(sym, live) if alive]


def encode_pieces(pieces: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Token ids of every piece.  A piece that is a token is that token."""
    out: list[list[int]] = [[]] * len(pieces)
    wide: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        r = ranks.rank.get(p)
        if r is not None:
            out[i] = [r]
        elif len(p) > LONG:
            out[i] = merge_long(p, ranks)
        elif p:
            wide.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
    for width, which in wide.items():
        step = max(1, (1 << 19) // width)
        for a in range(0, len(which), step):
            part = which[a : a + step]
            for i, ids in zip(part, merge_rows([pieces[i] for i in part], width, ranks)):
                out[i] = ids
    return out


@lru_cache(2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(2)
def coder_of(path: str, pattern: str) -> ChunkCoder:
    """Kept in the Python worker: later tasks find the chunks that earlier ones have coded."""
    ranks, find = ranks_of(path), regex.compile(pattern).findall

    def encode_many(chunks: list[str]) -> Codes:
        cut = [find(x) for x in chunks]
        distinct = list(dict.fromkeys(chain.from_iterable(cut)))
        ids = dict(zip(distinct, encode_pieces([p.encode() for p in distinct], ranks)))
        each = [list(chain.from_iterable(map(ids.__getitem__, x))) for x in cut]
        n = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.int32, int(n.sum())), n

    return ChunkCoder(encode_many)


def decoded_array(ids: np.ndarray, ends: np.ndarray, ranks: Ranks) -> pa.Array:
    """The bytes of each run ends[i]..ends[i + 1] of ids, by one gather from the vocabulary's bytes."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(ranks.size) or not ranks.size[ids].all()):
        raise ValueError("an id that no token has")
    n = ranks.size[ids]
    at = np.concatenate([[0], np.cumsum(n)])
    shift, out = (ranks.start[ids] - at[:-1]), np.empty(int(at[-1]), np.uint8)
    for a in range(0, len(ids), 1 << 19):
        b = min(a + (1 << 19), len(ids))
        out[at[a] : at[b]] = ranks.flat[np.repeat(shift[a:b], n[a:b]) + np.arange(at[a], at[b])]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].astype(np.int32)), pa.py_buffer(out)])


def encoded_documents(docs: DataFrame, path: str, pattern: str, decode: bool = False) -> DataFrame:
    """docs with ``ids`` (array of int) in the place of ``text``; decode: also ``decoded``, the
    bytes that those ids stand for.  Columns of docs with those names are replaced."""
    others = [c for c in docs.columns if c not in ("text", "ids", "decoded")]
    rows = spread(docs.select(*others, text_bytes().alias("text")), *others[:1])
    fields = [f"`{n}` {t}" for n, t in docs.select(*others).dtypes] + ["ids array<int>"] + ["decoded binary"] * decode

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, ranks = coder_of(path, pattern), ranks_of(path)
        for b in batches:
            for part, texts in text_slices(b, len(others)):
                ids, n = coder.code(texts)
                ends = np.concatenate([[0], np.cumsum(n)])
                cols = [*part.columns[: len(others)], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
                if decode:
                    cols.append(decoded_array(ids, ends, ranks))
                yield pa.RecordBatch.from_arrays(cols, names=[*others, "ids", "decoded"][: len(cols)])

    return rows.mapInArrow(work, ", ".join(fields))


def decoded_documents(rows: DataFrame, path: str) -> DataFrame:
    """rows with ``ids`` -> the same with ``decoded`` (replaced if there); null ids decode to empty, an
    unknown id is an error."""
    rows = rows.drop("decoded")
    at = rows.columns.index("ids")
    fields = [f"`{n}` {t}" for n, t in rows.dtypes] + ["decoded binary"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        for b in batches:
            lists = [np.array(x or [], np.int64) for x in b.column(at).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)])
            out = decoded_array(np.concatenate([np.zeros(0, np.int64), *lists]), ends, ranks)
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "decoded"])

    return rows.mapInArrow(work, ", ".join(fields))
