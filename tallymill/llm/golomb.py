"""Golomb-coded sets over numpy arrays: sorted reduced hashes, stored as coded gaps in blocks that decode on their own.

A set of n keys maps each 64-bit hash onto [0, n * M), sorts the values and writes the gaps in Golomb-Rice code with
``rice`` bits of remainder. M is about 1.497 * 2**rice, at which that code is shortest; a key that isn't in the set is
taken for one of its keys with probability 1/M. Every ``BLOCK`` values a block begins with its first value and bit offset
in a directory, so a probe decodes one block. Blocks that are probed are decoded side by side, step by step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 128
#: Fixed value: range per key over 2**rice at which Golomb-Rice code is shortest.
RANGE_FACTOR = 1.497137
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def range_per_key(rice: int) -> int:
    return round(RANGE_FACTOR * (1 << rice))


def reduced(hashes: np.ndarray, size: int) -> np.ndarray:
    """High 64 bits of hash * size: the hash's share of [0, size)."""
    a = hashes.astype(np.int64, copy=False).view(np.uint64)
    a_lo, a_hi, b_lo, b_hi = a & _LOW, a >> _32, np.uint64(size & 0xFFFFFFFF), np.uint64(size >> 32)
    low, m1, m2 = a_lo * b_lo, a_lo * b_hi, a_hi * b_lo
    carry = (low >> _32) + (m1 & _LOW) + (m2 & _LOW)
    return a_hi * b_hi + (m1 >> _32) + (m2 >> _32) + (carry >> _32)


@dataclass
class GolombSet:
    n: int
    """Values held: the keys, but for the few that share a value."""
    size: int
    rice: int
    first: np.ndarray
    at: np.ndarray
    code: np.ndarray

    @property
    def bits(self) -> int:
        """Bits of the whole set: code and directory."""
        return 8 * len(self.code) + 64 * (len(self.first) + len(self.at))


def encode(hashes: np.ndarray, rice: int) -> GolombSet:
    """The set of ``hashes`` (64 bits each, repeats allowed)."""
    hashes = np.unique(hashes)
    size = max(1, len(hashes)) * range_per_key(rice)
    values = np.unique(reduced(hashes, size))
    starts = np.arange(0, len(values), BLOCK)
    gaps = np.diff(values, prepend=values[:1]).astype(np.uint64)
    quotient, rest = (gaps >> np.uint64(rice)).astype(np.int64), gaps & np.uint64((1 << rice) - 1)
    length = quotient + 1 + rice
    length[starts] = 0  # a block's first value is in the directory
    quotient[starts] = 0
    end = np.cumsum(length)
    begin = end - length
    bits = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    ones = int(quotient.sum())
    bits[np.repeat(begin, quotient) + np.arange(ones) - np.repeat(np.cumsum(quotient) - quotient, quotient)] = 1
    coded = np.ones(len(values), bool)
    coded[starts] = False
    tail = (begin + quotient + 1)[coded]
    for b in range(rice):
        bits[tail + b] = (rest[coded] >> np.uint64(rice - 1 - b)) & np.uint64(1)
    return GolombSet(len(values), size, rice, values[starts], begin[starts], np.packbits(bits))


def _window(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 56 bits from bit ``at`` on, in the high end of 64; ``code`` has 8 spare bytes."""
    byte = at >> 3
    w = np.zeros(len(at), np.uint64)
    for k in range(8):
        w = (w << np.uint64(8)) | code[byte + k].astype(np.uint64)
    return w << (at & 7).astype(np.uint64)


def _decode(s: GolombSet, code: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The values of the given blocks in ascending order."""
    count = np.full(len(blocks), BLOCK)
    count[blocks == len(s.first) - 1] = s.n - BLOCK * (len(s.first) - 1)
    at, value = s.at[blocks].copy(), s.first[blocks].copy()
    live = np.arange(len(blocks))
    out, owners = [value.copy()], [live]
    for step in range(1, BLOCK):
        live = live[count[live] > step]
        if not len(live):
            break
        q, pos, open_ = np.zeros(len(live), np.uint64), at[live], np.arange(len(live))
        while len(open_):  # 48 bits at a time, which a float's exponent measures exactly; a longer unary part goes on
            inverse = ~_window(code, pos[open_]) >> np.uint64(16)
            run = 48 - np.frexp(inverse.astype(np.float64))[1].astype(np.int64)
            q[open_] += run.astype(np.uint64)
            pos[open_] += run
            open_ = open_[run == 48]
        value[live] += (q << np.uint64(s.rice)) + (_window(code, pos + 1) >> np.uint64(64 - s.rice))
        at[live] = pos + 1 + s.rice
        out.append(value[live].copy())
        owners.append(live)
    flat, owner = np.concatenate(out), np.concatenate(owners)
    return flat[np.argsort(owner, kind="stable")]


def contains(s: GolombSet, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the set; never false for one that is."""
    if not s.n or not len(hashes):
        return np.zeros(len(hashes), bool)
    probe = reduced(hashes, s.size)
    block = np.searchsorted(s.first, probe, side="right") - 1
    probed = np.unique(block[block >= 0])
    if not len(probed):
        return np.zeros(len(hashes), bool)
    values = _decode(s, np.concatenate([s.code, np.zeros(16, np.uint8)]), probed)
    return values[np.minimum(np.searchsorted(values, probe), len(values) - 1)] == probe
