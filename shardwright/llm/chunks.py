"""Coding texts chunk by chunk, each distinct chunk once.

The byte-level pre-tokeniser's pattern always starts a new match at a single space that
stands between two characters that aren't white space.  Texts may therefore be cut before such
spaces, and chunks be coded apart: a corpus has far fewer distinct chunks than chunks.
Runs of white space stay inside a chunk.  Cutting, numbering of distinct chunks and putting the
codes together are array operations; Python sees the distinct chunks of a slice alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shardwright.llm.common import slices

#: Codes of several chunks: all ids, and how many each chunk has.
Codes = tuple[np.ndarray, np.ndarray]


def glued(parts: list[str]) -> Iterator[str]:
    """Chunks of a text that has white space beside a cut: parts around it stay together."""
    held: list[str] = []
    for part in parts:
        if held and part and held[-1] and not part[0].isspace() and not held[-1][-1].isspace():
            yield " ".join(held)
            held = [part]
        else:
            held.append(part)
    yield " ".join(held)


def _tight(words: list[str]) -> np.ndarray:
    """Which words have no white space at their ends, and are not empty."""
    return np.fromiter(map(eq, map(str.strip, words), words), bool, len(words)) & np.fromiter(map(bool, words), bool, len(words))


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for n items at least, doubled if it has to grow."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


class _Codes:
    """Known chunks and their codes, one after the other.  The chunks are an Arrow array: a few bytes
    each, looked up by its hash join.  What ``lend`` adds is overwritten by the next call."""

    def __init__(self):
        self.names, self.used = pa.array([], pa.string()), 0
        self.ids, self.start, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def lend(self, codes: Codes) -> int:
        """Put codes behind the known ones; the place of the first."""
        ids, n = codes
        a, b = len(self.names), len(self.names) + len(n)
        self.ids, self.start, self.n = _room(self.ids, self.used + len(ids)), _room(self.start, b), _room(self.n, b)
        self.ids[self.used : self.used + len(ids)] = ids
        self.n[a:b], self.start[a:b] = n, self.used + np.cumsum(n) - n
        return a

    def add(self, names: pa.Array, codes: Codes) -> int:
        a = self.lend(codes)
        self.names, self.used = pa.concat_arrays([self.names, names]), self.used + len(codes[0])
        return a

    def places(self, names: pa.Array) -> np.ndarray:
        """Place of each name, -1 if it isn't known."""
        return pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False).copy()

    def gather(self, place: np.ndarray) -> np.ndarray:
        """The codes of these places, one after the other."""
        n = self.n[place]
        ends = np.cumsum(n, dtype=np.int64)
        out = np.empty(int(ends[-1]), np.int32)
        for a in range(0, len(place), 1 << 20):
            b = min(a + (1 << 20), len(place))
            at, to = int(ends[a - 1]) if a else 0, int(ends[b - 1])
            shift = self.start[place[a:b]] - (ends[a:b] - at - n[a:b]).astype(np.int32)
            out[at:to] = self.ids[np.repeat(shift, n[a:b]) + np.arange(to - at, dtype=np.int32)]
        return out


class ChunkCoder:
    """``encode_many(list of str) -> Codes`` codes chunks; codes are kept for about ``most`` of them."""

    def __init__(self, encode_many: Callable[[list[str]], Codes], most: int = 1_000_000):
        self.encode_many, self.most = encode_many, most
        self.inner = _Codes()  # of " " + word, for words without white space at their ends

    def _inner(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words as chunks; -1: white space at an end, or empty."""
        if len(self.inner.names) > self.most:
            self.inner = _Codes()
        place = self.inner.places(words)
        new = np.flatnonzero(place < 0)
        if len(new):
            names = words.take(pa.array(new))
            text = names.to_pylist()
            ok = _tight(text)
            first = self.inner.add(names.filter(pa.array(ok)), self.encode_many(list(map(" ".__add__, compress(text, ok.tolist())))))
            place[new[ok]] = first + np.arange(int(ok.sum()))
        return place

    def code(self, texts: list[str] | pa.Array) -> Codes:
        """All ids of the texts, and how many each text has."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lists = pc.split_pattern(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, " ")
        edge = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary
        edge = edge - edge[0]
        first = edge[:-1]
        place = self._inner(words)[at]
        n_chunks = np.diff(edge)
        glue = np.flatnonzero((np.minimum.reduceat(place, first) < 0) & (n_chunks > 1))
        # chunks that begin a text, and those of texts with white space beside a cut, are coded for this call
        heads = words.take(pa.array(at[first])).to_pylist()
        parts = {i: list(glued(words.take(pa.array(at[edge[i] : edge[i + 1]])).to_pylist())) for i in glue.tolist()}
        others = [x for i, h in enumerate(heads) for x in ([parts[i][0], *(" " + y for y in parts[i][1:])] if i in parts else [h])]
        distinct = {x: k for k, x in enumerate(dict.fromkeys(others))}
        known = self.inner.lend(self.encode_many(list(distinct)))
        other = known + np.fromiter(map(distinct.__getitem__, others), np.int32, len(others))
        if parts:
            pieces, k = np.split(place, edge[1:-1]), 0
            for i in range(len(heads)):
                m = len(parts[i]) if i in parts else 1
                pieces[i] = np.concatenate([other[k : k + m], pieces[i][n_chunks[i] if i in parts else 1 :]])
                k += m
            n_chunks = np.fromiter(map(len, pieces), np.int64, len(pieces))
            place = np.concatenate(pieces)
            first = np.cumsum(n_chunks) - n_chunks
        else:
            place[first] = other
        return self.inner.gather(place), np.add.reduceat(self.inner.n[place], first, dtype=np.int64)


def text_slices(batch: pa.RecordBatch, column: int, most: int = 6 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows with their texts (a binary column; null: empty); about ``most`` bytes of text each."""
    raw = batch.column(column).fill_null(b"")
    for a, b in slices(pc.binary_length(raw).to_pylist(), most):
        part = raw.slice(a, b - a)
        try:
            texts = part.cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8
            texts = pa.array([x.decode("utf-8", "replace") for x in part.to_pylist()], pa.string())
        yield batch.slice(a, b - a), texts
        pa.default_memory_pool().release_unused()
