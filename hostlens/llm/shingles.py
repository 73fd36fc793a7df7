"""Word shingles and MinHash values of many texts at once."""

from __future__ import annotations

import numpy as np

from hostlens.llm.common import RollingHash, mix
from hostlens.llm.licenses import normalise

WORDS = 5
THRESHOLD = 0.8


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all runs of `words` words, and where each text's begin (one more entry than texts); two
    fingerprints of each text's whole word sequence.

    Words are runs of letters, digits and non-ASCII characters of the lower-cased text. A text of fewer words has one
    shingle of all of them, one without words has none; null counts as empty.
    """
    clean = [normalise((t or "").lower().encode()) for t in texts]
    data = np.frombuffer(b"\0".join(clean) + b"\0", np.uint8)
    hashed = RollingHash(data)
    close = data == 0
    gap = close | (data == 0x20)
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    text_end = np.flatnonzero(close)
    text_start = np.concatenate([[0], text_end[:-1] + 1])
    first = np.searchsorted(start, text_start)
    count = np.diff(np.append(first, len(start)))
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, n)
    upto = at + np.repeat(np.minimum(count, words) - 1, n)
    whole = hashed(text_start, text_end)
    reverse = mix(hashed(text_start, (text_start + text_end) // 2) ^ np.uint64(0x5851F42D4C957F2D)) ^ (text_end - text_start).astype(np.uint64)
    return hashed(start[at], end[upto]), offsets, whole, reverse


def minhashes(prints: np.ndarray, offsets: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """`count` MinHash values per text as uint32; texts without shingles get the largest value."""
    out = np.full((len(offsets) - 1, count), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    if not len(some):
        return out
    rng = np.random.default_rng(seed)
    for j, (shift, odd) in enumerate(zip(rng.integers(0, 2**32, count, dtype=np.uint32), rng.integers(0, 2**32, count, dtype=np.uint32) | 1)):
        if j % 2 == 0:
            x = (mix(prints ^ np.uint64(0x9E3779B97F4A7C15 * (j // 2 + 1) % 2**64)) if j else prints)
            low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        out[some, j] = np.minimum.reduceat(((low if j % 2 == 0 else high) ^ shift) * odd, offsets[some])
    return out
