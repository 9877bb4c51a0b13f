"""Merging token strings inside tasks: one code point per token (see ``functions.codepoints``).

``Merger`` applies an ordered list of merges to strings.  A merge joins a left token's last base symbol to a
right token's first one, so a string can be cut wherever two neighbours are no such junction: no
merge ever crosses the cut.  The pieces are short and repeat, so each distinct one is merged once
(a bounded memo), by a linked list with a heap of ranks: O(n log n) whatever the number of merges.

``learn`` is byte-pair learning over distinct pieces with weights and an index from pair to pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

import numpy as np

SHIFT = 21  # two code points pack into one 64-bit key: 2^21 > 0x10FFFF
DENSE = 1 << 11  # code points below it are looked up and counted in tables
MEMO_SYMBOLS = 2_000_000  # symbols of remembered pieces, input and output


def codes_of(s: str) -> np.ndarray:
    """Code points of a string."""
    try:
        return np.frombuffer(s.encode("latin-1"), np.uint8).astype(np.int64)
    except UnicodeEncodeError:
        pass
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def pair_keys(x: np.ndarray) -> np.ndarray:
    return (x[:-1] << SHIFT) | x[1:]


def merge_symbols(symbols: Sequence[str], ranks: dict[str, tuple[int, str]]) -> str:
    """Merge the pair of the lowest rank, leftmost first, until no pair has one."""
    sym = list(symbols)
    n = len(sym)
    if n < 2:
        return "".join(sym)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(found[0], i) for i in range(n - 1) if (found := ranks.get(sym[i] + sym[i + 1]))]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = right[i]
        if not sym[i] or j >= n:
            continue  # merged into another, or the last one now
        found = ranks.get(sym[i] + sym[j])
        if found is None or found[0] != rank:
            continue  # a neighbour was merged since
        sym[i], sym[j] = found[1], ""
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if new := ranks.get(sym[i] + sym[k]):
                heapq.heappush(heap, (new[0], i))
        h = left[i]
        if h >= 0 and (new := ranks.get(sym[h] + sym[i])):
            heapq.heappush(heap, (new[0], h))
    return "".join(sym)


class Merger:
    """Ordered merges (left, right, new), single-character strings, over base symbols."""

    def __init__(self, merges: Iterable[tuple[str, str, str]]):
        self.ranks: dict[str, tuple[int, str]] = {}
        first: dict[str, str] = {}
        last: dict[str, str] = {}
        joins = set()
        for rank, (a, b, x) in enumerate(merges):
            self.ranks.setdefault(a + b, (rank, x))
            first[x], last[x] = first.get(a, a), last.get(b, b)
            joins.add((ord(last.get(a, a)) << SHIFT) | ord(first.get(b, b)))
        self.joins = Joins(np.array(sorted(joins), np.int64))
        self.memo: dict[str, str] = {}
        self.held = 0

    def merge(self, s: str) -> str:
        """``s`` with all merges applied."""
        if len(s) < 2 or not len(self.joins.keys):
            return s
        out, at = [], 0
        for a, b in pieces(s, self.joins):
            piece = s[a:b]
            done = self.memo.get(piece)
            if done is None:
                done = self._new(piece)
            out.append(s[at:a])
            out.append(done)
            at = b
        out.append(s[at:])
        return "".join(out)

    def _new(self, piece: str) -> str:
        done = merge_symbols(piece, self.ranks)
        if self.held > MEMO_SYMBOLS:
            self.memo.clear()
            self.held = 0
        if len(piece) <= 1000:
            self.memo[piece] = done
            self.held += len(piece) + len(done)
        return done


def among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``some``."""
    if not len(some):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(some, keys)
    at[at == len(some)] = 0
    return some[at] == keys


class Joins:
    """A set of pairs (sorted keys): a table where all their code points are small, else a search."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.dim = keys, 0
        if len(keys):
            left, right = keys >> SHIFT, keys & ((1 << SHIFT) - 1)
            if (top := int(max(left.max(), right.max())) + 1) <= DENSE:
                self.dim = top
                table = np.zeros((top + 1, top + 1), bool)  # the last row and column: any other code point
                table[left, right] = True
                self.table = table.ravel()

    def among(self, codes: np.ndarray) -> np.ndarray:
        """Which neighbours are in the set."""
        if not self.dim:
            return among(pair_keys(codes), self.keys)
        c = np.minimum(codes, self.dim)
        return self.table[c[:-1] * (self.dim + 1) + c[1:]]


def pieces(s: str, joins: Joins | np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (from, to) of two symbols or more, all of whose neighbours are in ``joins`` (or sorted keys)."""
    ok = (joins if isinstance(joins, Joins) else Joins(joins)).among(codes_of(s))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] + 1).tolist()))


def pair_sums(strings: Iterable[str], weights: Iterable[int], most: int = 1 << 20):
    """(keys, sums) of adjacent pairs times their string's weight, some ``most`` symbols at a time."""
    held: list[str] = []
    reps: list[int] = []
    size = 0

    def flush():
        x, n, w = codes_of("".join(held)), np.fromiter(map(len, held), np.int64, len(held)), np.array(reps, np.int64)
        ends = np.cumsum(n)[:-1] - 1  # of a string and the next one: no pair
        dim = int(x.max()) + 1
        if dim <= DENSE and dim * dim <= max(1 << 17, 4 * len(x)) and float(n @ w.astype(np.float64)) < 1 << 52:  # exact as doubles
            k = x[:-1] * dim
            k += x[1:]
            if w.min() == w.max():
                sums = np.bincount(k)
                np.subtract.at(sums, k[ends], 1)
                sums *= w[0]
            else:
                sums = np.bincount(k, weights=np.repeat(w, n)[:-1])
                np.subtract.at(sums, k[ends], w[:-1])
            k = np.flatnonzero(sums)
            return ((k // dim) << SHIFT) | (k % dim), sums[k].astype(np.int64)
        k, w = np.delete(pair_keys(x), ends), np.delete(np.repeat(w, n)[:-1], ends)
        order = np.argsort(k, kind="stable")
        k, w = k[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat(w, first)

    for s, w in zip(strings, weights):
        if len(s) > 1:
            held.append(s)
            reps.append(w)
            size += len(s)
        if size >= most:
            yield flush()
            held, reps, size = [], [], 0
    if held:
        yield flush()


def learn(strings: list[str], weights: list[int], new: Sequence[str], until: tuple[int, str] | None, most: int) -> list[tuple[str, str, int]]:
    """The next merges (left, right, count), at most ``most``: the pair of the greatest count, the
    smallest of equals, as long as it comes before ``until`` = (count, pair).  ``new[i]`` is the i-th
    merge's symbol.  Each merge touches only the strings that hold its pair."""
    counts: dict[str, int] = {}
    holds: dict[str, set[int]] = {}
    for i, (s, w) in enumerate(zip(strings, weights)):
        for p in map(str.__add__, s, s[1:]):
            counts[p] = counts.get(p, 0) + w
            holds.setdefault(p, set()).add(i)
    heap = [(-n, p) for p, n in counts.items()]
    heapq.heapify(heap)
    bound = None if until is None else (-until[0], until[1])
    out: list[tuple[str, str, int]] = []
    while heap and len(out) < most:
        best = heapq.heappop(heap)
        pair = best[1]
        if counts.get(pair) != -best[0]:
            continue  # counted anew since
        if bound is not None and best >= bound:
            break
        x, (a, b), delta = new[len(out)], pair, {}
        out.append((a, b, -best[0]))
        for i in holds.pop(pair):
            parts = strings[i].split(pair)
            if len(parts) == 1:
                continue
            w = weights[i]
            strings[i] = x.join(parts)
            for j in range(len(parts) - 1):
                before, after = parts[j], parts[j + 1]
                changed = []
                if before:
                    changed.append((before[-1] + a, before[-1] + x))
                elif j:
                    changed.append((b + a, x + x))
                if after:
                    changed.append((b + after[0], x + after[0]))
                for gone, made in changed:
                    delta[gone] = delta.get(gone, 0) - w
                    delta[made] = delta.get(made, 0) + w
                    holds.setdefault(made, set()).add(i)
        counts.pop(pair)
        for p, d in delta.items():
            if p != pair and d:
                n = counts.get(p, 0) + d
                if n > 0:
                    counts[p] = n
                    heapq.heappush(heap, (-n, p))
                else:
                    counts.pop(p, None)
    return out
