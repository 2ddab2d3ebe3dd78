import numpy as np
import pytest

from tallymill.llm.golomb import BLOCK, contains, encode, range_per_key, reduced


def hashes(n, seed):
    return np.random.default_rng(seed).integers(-(2**63), 2**63, n, dtype=np.int64)


@pytest.mark.parametrize("n", [0, 1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 5000])
@pytest.mark.parametrize("rice", [1, 4, 10, 20])
def test_never_misses_a_key(n, rice):
    keys = hashes(n, n)
    s = encode(np.concatenate([keys, keys[: n // 2]]), rice)
    assert contains(s, keys).all()
    assert contains(s, keys[:1]).all()


def test_rate_of_wrong_answers_is_the_stated_one():
    s = encode(hashes(20_000, 1), 6)
    probes = hashes(200_000, 2)
    wrong = contains(s, probes).mean()
    assert abs(wrong * range_per_key(6) - 1) < 0.1
    assert s.bits / s.n < 6 + 2.3 + 1.2  # remainder, unary part with its end, directory


def test_equals_the_set_of_reduced_values():
    keys, probes = hashes(3000, 3), hashes(30_000, 4)
    s = encode(keys, 3)
    held = set(reduced(keys, s.size).tolist())
    assert contains(s, probes).tolist() == [v in held for v in reduced(probes, s.size).tolist()]


def test_long_gaps_are_coded_too():
    # with few keys in a large range the unary parts are far longer than a window
    keys = np.array([0, 1, 2**62, -1], np.int64)
    s = encode(keys, 1)
    wide = type(s)(s.n, s.size, s.rice, s.first, s.at, s.code)
    assert contains(wide, keys).all()
    big = encode(np.concatenate([hashes(2000, 5) >> 20, [2**63 - 1]]), 2)
    assert contains(big, np.array([2**63 - 1])).all()


def test_reduction_is_exact():
    h, size = hashes(500, 6), 123_456_789_012_345
    assert reduced(h, size).tolist() == [((x % 2**64) * size) >> 64 for x in h.tolist()]
