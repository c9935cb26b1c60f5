"""64-bit hashes of words and word sequences, computed over whole slices of texts at once."""

from __future__ import annotations

import numpy as np

from .common import LOWER

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD1342543DE82EF95)
_GAP = np.zeros(256, dtype=bool)
_GAP[list(b" \t\n\x0b\x0c\r")] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class WordHasher:
    """Word hashes by differences of prefix sums; the powers are kept between calls."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            one = np.ones(1, dtype=np.uint64)
            self.up = np.concatenate([one, np.full(size, _BASE, dtype=np.uint64)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([one, np.full(size, pow(_BASE, -1, 2**64), dtype=np.uint64)]).cumprod(dtype=np.uint64)

    def __call__(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, lower-cased in ASCII, text after text, and how many each text has."""
        joined = b"\n".join(raw).translate(LOWER)
        data = np.frombuffer(joined, dtype=np.uint8)
        if not len(data):
            return np.zeros(0, dtype=np.uint64), np.zeros(len(raw), dtype=np.int64)
        self._powers(len(data))
        gap = np.concatenate([[True], _GAP[data], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * self.up[: len(data)], dtype=np.uint64)])
        hashes = mix((sums[ends] - sums[starts]) * self.down[starts])
        stops = np.cumsum([len(b) + 1 for b in raw])
        at = np.searchsorted(starts, stops)
        return hashes, np.diff(np.concatenate([[0], at]))


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first; runs across texts are for the caller to drop."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(words) - n + 1
    h = np.full(size, n, dtype=np.uint64)
    for j in range(n):
        h = h * _STEP + words[j : j + size]
        h ^= h >> np.uint64(31)
    return mix(h)
