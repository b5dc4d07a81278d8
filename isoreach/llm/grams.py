"""Rolling hashes of byte strings and content-defined anchors, on arrays."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A 64-bit number for every byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20, len(_powers[0]) * 5 // 4)
        full = []
        for base in (_ODD, _BACK):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            full.append(np.multiply.accumulate(p))
        _powers = full[0], full[1]
    return _powers


class Rolling:
    """Hashes of any substring of a buffer from prefix sums."""

    def __init__(self, data: np.ndarray, numbers: np.ndarray = BYTE) -> None:
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(numbers[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal bytes, wherever they lie."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
