"""Hashes of the words of a text, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_POWERS = np.cumprod(np.full(4096, _BASE))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order; words are what stands between spaces and U+0009 to U+000D."""
    return _placed(raw)[1]


def hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, one text after the other, and where each text's begin, with the end of the last."""
    starts, hashes = _placed(b" ".join(texts))
    return hashes, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def _placed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start, and their hashes."""
    global _POWERS
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = ~_GAP[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    heads = np.cumsum(lengths) - lengths
    letters = b[inside[1:-1]]
    place = np.arange(len(letters)) - np.repeat(heads, lengths)
    if (longest := int(lengths.max())) > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * longest, _BASE))
    values = (letters.astype(np.uint64) + np.uint64(1)) * _POWERS[place]
    return starts, mix(np.add.reduceat(values, heads))
