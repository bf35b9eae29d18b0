"""Word shingles of whole texts as 64-bit numbers, worked out on byte arrays."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.default_rng(20240229).integers(1, 2**64, 256, np.uint64, endpoint=False) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Distinct k-word shingles; tables of powers grow with the longest text seen."""

    def __init__(self, k: int) -> None:
        self.k, self.up, self.down = k, _powers(_BASE, 4096), _powers(_BACK, 4096)

    def words(self, text: str | None) -> np.ndarray:
        """A number for each word of the text with A-Z in lower case; words part at ASCII white space."""
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
        n = len(data)
        if n + 1 > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_BACK, 2 * n)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~_SPACE[data]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data] * self.up[:n], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingles; a text of fewer words is one shingle, one without words none."""
        w = self.words(text)
        if not len(w):
            return w
        k = min(self.k, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = mix(h + w[i : len(w) - k + 1 + i])
        return np.unique(h)
