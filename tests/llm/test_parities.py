"""The bound that two sets' parity bitmaps put on what they share."""

import numpy as np
import pytest

from textloom.llm import neardup as N


@pytest.mark.parametrize("n", [0, 1, 5, 60, 700, 20_000])
def test_bits_differ_in_no_more_than_items_do(n):
    rng = np.random.default_rng(n)
    for apart in (0, 1, n // 20, n // 5, n):
        both = rng.integers(-(2**63), 2**63, n - min(n, apart), dtype=np.int64)
        a, b = (np.unique(np.concatenate([both, rng.integers(-(2**63), 2**63, size, dtype=np.int64)])) for size in (apart, apart // 2))
        x, y = N.parities(a), N.parities(b)
        assert len(x) == len(y) == N.BITS // 64
        bits = sum(int(v).bit_count() for v in np.bitwise_xor(x, y).view(np.uint64))
        differ = len(np.setxor1d(a, b))
        assert bits <= differ and bits % 2 == differ % 2
        if not apart:
            assert bits == 0


def test_distant_sets_differ_in_bits():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(2**63), 2**63, 200, dtype=np.int64) for _ in range(2))
    bits = sum(int(v).bit_count() for v in np.bitwise_xor(N.parities(a), N.parities(b)).view(np.uint64))
    # two sets of 200 items at a similarity of 0.8 differ in 44 at most
    assert bits > 44
