"""64-bit hashes of many spans of one array at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scatter 64-bit values (a bijection for each seed)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % 2**64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def _powers_to(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 2**64)
        known = tuple(
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b % 2**64, np.uint64))])
            for b in (base, inverse)
        )
        if size <= 1 << 23:  # a very long text must not leave its tables behind
            _powers[base] = known
    return known


class Spans:
    """Hashes of the spans ``[start, end)`` of an array of 64-bit values, each in constant time."""

    def __init__(self, values: np.ndarray, seed: int = 0):
        base = (_BASE + 2 * (seed * 0x51ED270B + 0x2545F491)) % 2**64 | 1
        up, self._down = _powers_to(len(values) + 1, base)
        self._sums = np.empty(len(values) + 1, np.uint64)
        self._sums[0] = 0
        np.cumsum(values * up[:len(values)], dtype=np.uint64, out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw ^ (np.asarray(ends - starts).astype(np.uint64) << np.uint64(48)))

    def every(self, length: int) -> np.ndarray:
        """The hashes of all spans of one length, by start."""
        n = len(self._sums) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self._sums[length:] - self._sums[:n]) * self._down[:n])
