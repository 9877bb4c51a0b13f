import random
from collections import Counter

import numpy as np
import pytest

from shardwright.llm import quotient_filter as Q


def keys_of(draw, half, n):
    top = (1 << half) - 1
    some = [(draw.randint(0, top), draw.randint(0, top)) for _ in range(max(1, n // 3))]
    out = [draw.choice(some) for _ in range(n)]
    return out, np.array([k[0] for k in out], np.uint64), np.array([k[1] for k in out], np.uint64)


@pytest.mark.parametrize("half", [1, 2, 7, 16, 31, 32, 33, 40, 63, 64])
def test_permutation_is_invertible(half):
    _, hi, lo = keys_of(random.Random(half), half, 500)
    a, b = Q.permuted(hi, lo, half)
    assert max(int(a.max()), int(b.max())) < 1 << half
    x, y = Q.inverted(a, b, half)
    assert (x == hi).all() and (y == lo).all()
    if half == 7:
        every = np.arange(1 << 14, dtype=np.uint64)
        a, b = Q.permuted(every >> np.uint64(7), every & np.uint64(127), 7)
        assert len(set(zip(a.tolist(), b.tolist()))) == 1 << 14


@pytest.mark.parametrize("half", [1, 3, 16, 32, 33, 50, 64])
@pytest.mark.parametrize("top", [0, 1, 3])
@pytest.mark.parametrize("n", [1, 2, 9, 700])
def test_counts_survive_sections_and_merging(half, top, n):
    top, draw, want, filters = min(top, half), random.Random(half * 100 + n), Counter(), {}
    for _ in range(4):
        keys, hi, lo = keys_of(draw, half, n)
        want.update(keys)
        for section, data in Q.sections(hi, lo, half, top):
            filters.setdefault(section, []).append(data)
    got = Counter()
    for parts in filters.values():
        (hi, lo, counts), h, t = Q.merged(parts)
        assert (h, t) == (half, top)
        again = Q.decoded(Q.encoded(hi, lo, counts, half, top))
        assert all((x == y).all() for x, y in zip(again, (hi, lo, counts)))
        x, y = Q.inverted(hi, lo, half)
        got.update(dict(zip(zip(x.tolist(), y.tolist()), counts.tolist())))
    assert got == want


def test_large_counters_and_no_keys():
    hi = np.full(100_000, 5, np.uint64)
    (section, data), = Q.sections(hi, hi, 16, 0)
    (_, _, n), _, _ = Q.merged([data] * 3)
    assert section == 0 and n.tolist() == [300_000] and len(data) < 50
    assert Q.sections(hi[:0], hi[:0], 16, 2) == []
