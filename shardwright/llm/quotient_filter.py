"""Counting quotient filters as sorted, immutable bytes: exact counters of integer keys.

A key is a pair of ``half``-bit numbers.  An invertible permutation of all such pairs (a Feistel
network) spreads keys evenly; a permuted key's leading ``top`` bits name its section, the next q bits
are its quotient and all others its remainder.  A filter holds the keys of one section in ascending
order: one bit a quotient says whether it occurs (``occupied``), one bit a slot ends a quotient's run,
and a slot keeps its whole remainder and a counter of one byte, or 255 and a 64-bit number aside.  The
remainder is full, so nothing is lost: a filter gives back exactly the keys and counts it was
made from.  Filters of one section are sorted alike, so merging them is merging sorted runs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

from shardwright.llm.common import mix64

#: Round keys of the permutation.
ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
_HEAD = struct.Struct("<QQBBBxI")  # slots, section, half, top, quotient bits, escaped counters

Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _right(x: np.ndarray, bits: int) -> np.ndarray:
    return x >> np.uint64(bits) if bits < 64 else np.zeros_like(x)


def permuted(hi: np.ndarray, lo: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The permutation of pairs of ``half``-bit numbers."""
    with np.errstate(over="ignore"):
        for key in ROUNDS:
            hi, lo = lo, hi ^ (mix64(lo + np.uint64(key)) & _mask(half))
    return hi, lo


def inverted(hi: np.ndarray, lo: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The pair that ``permuted`` made these of."""
    with np.errstate(over="ignore"):
        for key in reversed(ROUNDS):
            hi, lo = lo ^ (mix64(hi + np.uint64(key)) & _mask(half)), hi
    return hi, lo


def summed(hi: np.ndarray, lo: np.ndarray, half: int, n: np.ndarray | None = None) -> Counts:
    """Distinct pairs in ascending order and the sums of their counts (each counts once if there are none)."""
    rows = len(hi)
    if not rows:
        return hi, lo, np.zeros(0, np.uint64)
    if 2 * half <= 64:
        key = (hi << np.uint64(half)) | lo
        if n is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        hi, lo = _right(key[first], half), key[first] & _mask(half)
    else:
        order = np.lexsort((lo, hi))
        hi, lo, n = hi[order], lo[order], None if n is None else n[order]
        first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        hi, lo = hi[first], lo[first]
    sums = np.diff(np.append(first, rows)).astype(np.uint64) if n is None else np.add.reduceat(n, first)
    return hi, lo, sums


def _packed(x: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of each number in as many whole bytes as they need."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, : -(-bits // 8)]).tobytes()


def _unpacked(data: memoryview, n: int, bits: int) -> np.ndarray:
    width = -(-bits // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
    return out.view("<u8").reshape(n)


def encoded(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, half: int, top: int) -> bytes:
    """A filter of permuted pairs, distinct and ascending, that share their ``top`` leading bits."""
    slots = len(hi)
    section = int(_right(hi[:1], half - top)[0]) if slots else 0
    q = min(half - top, max(slots - 1, 0).bit_length())
    rest = half - top - q
    quotient = (_right(hi, rest) & _mask(q)).astype(np.int64)
    occupied, ends = np.zeros(1 << q, np.uint8), np.ones(slots, np.uint8)
    occupied[quotient] = 1
    ends[:-1] = quotient[1:] != quotient[:-1]
    big = n[n >= 255]
    return b"".join(
        (
            _HEAD.pack(slots, section, half, top, q, len(big)),
            np.packbits(occupied).tobytes(),
            np.packbits(ends).tobytes(),
            _packed(hi & _mask(rest), rest),
            _packed(lo, half),
            np.minimum(n, 255).astype(np.uint8).tobytes(),
            big.astype("<u8").tobytes(),
        )
    )


def decoded(data: bytes) -> Counts:
    """The permuted pairs of a filter, ascending, and their counts."""
    view = memoryview(data)
    slots, section, half, top, q, escaped = _HEAD.unpack_from(view)
    at = _HEAD.size

    def take(size: int) -> memoryview:
        nonlocal at
        at += size
        return view[at - size : at]

    rest = half - top - q
    occupied = np.unpackbits(np.frombuffer(take(-(-(1 << q) // 8)), np.uint8), count=1 << q)
    ends = np.unpackbits(np.frombuffer(take(-(-slots // 8)), np.uint8), count=slots)
    low = _unpacked(take(slots * -(-rest // 8)), slots, rest)
    lo = _unpacked(take(slots * -(-half // 8)), slots, half)
    n = np.frombuffer(take(slots), np.uint8).astype(np.uint64)
    n[n == 255] = np.frombuffer(take(8 * escaped), "<u8")
    run = np.cumsum(ends) - ends  # the run that a slot is in
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run]
    prefix = ((section << q) << rest) if slots else 0
    hi = np.uint64(prefix) | (quotient << np.uint64(rest) if rest < 64 else quotient) | low
    return hi, lo, n


def merged(filters: Iterable[bytes]) -> tuple[Counts, int, int]:
    """The sums of filters of one section as counts, and their layout (half, top)."""
    filters = list(filters)
    _, _, half, top, _, _ = _HEAD.unpack_from(filters[0])
    parts = [decoded(f) for f in filters]
    hi, lo, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return ((hi, lo, n) if len(parts) == 1 else summed(hi, lo, half, n)), half, top


def sections(hi: np.ndarray, lo: np.ndarray, half: int, top: int) -> list[tuple[int, bytes]]:
    """Keys, any number of times each, as one filter a section that has some."""
    hi, lo, n = summed(*permuted(hi, lo, half), half)
    number = _right(hi, half - top).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(hi) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(hi))
    return [(int(number[a]), encoded(hi[a:b], lo[a:b], n[a:b], half, top)) for a, b in zip(first.tolist(), ends.tolist())]
