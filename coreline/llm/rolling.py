"""Hashes of byte spans by prefix sums, for numpy arrays.

Each byte has a random value below the prime 2**31 - 1; the sum of value *
BASE**position over a prefix is one cumulative sum, and a span's hash is the
difference of two prefixes, moved back to position 0 by the inverse power.  Two
such hashes with values and bases of their own lie side by side in one 64-bit
number, so equal spans have equal numbers wherever they stand, and unequal ones of
any shape meet by chance only (62 bits).  The modulus is prime on purpose: modulo a
power of two, words in Thue-Morse order collide whatever the base.
"""

from __future__ import annotations

import numpy as np

PRIME = (1 << 31) - 1
_P, _BITS, _HALF = np.uint64(PRIME), np.uint64(31), np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)
_SEED = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _SEED.integers(1, PRIME, (2, 256), dtype=np.uint64)
_BASES = [int(x) for x in _SEED.integers(1 << 29, PRIME, 2)]
_INVERSES = [pow(b, -1, PRIME) for b in _BASES]
_POWERS: dict[int, np.ndarray] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same remainder; 2**62 goes below 2**32."""
    return (x & _P) + (x >> _BITS)


def _reduced(x: np.ndarray) -> np.ndarray:
    """The remainder of any 64-bit number."""
    x = _folded(_folded(_folded(x)))
    x[x == _P] = 0
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... up to ``n`` values; kept, and grown by doubling."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        known = _POWERS.get(base, np.ones(1, np.uint64))
        while len(known) < max(1 << 16, n):
            step = np.uint64(pow(base, len(known), PRIME))
            known = np.concatenate([known, _reduced(known * step)])
        _POWERS[base] = known
    return _POWERS[base][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """One more value than ``data`` has bytes; the first is 0.  For the functions below only."""
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(2):
        terms = _folded(_VALUES[k][data] * _powers(_BASES[k], len(data)))
        out[1:] |= _reduced(np.cumsum(terms)) << (_HALF if k else np.uint64(0))
    return out


def _hash(from_: np.ndarray, to: np.ndarray, inverse: list[np.ndarray]) -> np.ndarray:
    low = _reduced(((to & _LOW) + _P - (from_ & _LOW)) * inverse[0])
    high = _reduced(((to >> _HALF) + _P - (from_ >> _HALF)) * inverse[1])
    return low | high << _HALF


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return _hash(sums[start], sums[stop], [_powers(i, len(sums))[start] for i in _INVERSES])


def window_hash(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all spans of ``size`` bytes, by start."""
    n = max(0, len(sums) - size)
    return _hash(sums[:n], sums[size:], [_powers(i, n) for i in _INVERSES])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
