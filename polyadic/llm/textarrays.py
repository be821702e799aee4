"""Texts of an Arrow batch as NumPy arrays of bytes and word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


_HELD: list[Callable] = []


def held(make: Callable) -> Callable:
    """``cache`` for what is large: a worker keeps it from task to task until let_go()."""
    kept = cache(make)
    _HELD.append(kept)
    return kept


def let_go() -> None:
    """Release what tasks of other steps have left in this worker; they make it anew if they come again."""
    for kept in _HELD:
        kept.cache_clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_views(texts: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each text without copying; None for null."""
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    valid = texts.is_valid().to_pylist()
    for i, ok in enumerate(valid):
        yield data[offs[i] : offs[i + 1]] if ok else None


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[raw]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values``; spans are in order and do not overlap.

    Each value is scrambled together with its position in the span before the sum is taken, so that
    no arrangement of equal values cancels out, as it can in a polynomial modulo 2 ** 64.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    low, high = int(starts[0]), int(ends[-1])
    since = np.arange(low, high, dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, high)))
    sums = np.zeros(high - low + 1, dtype=np.uint64)
    np.cumsum(mix((since.astype(np.uint64) << np.uint64(22)) + values[low:high] + _BASE), out=sums[1:])
    return mix(sums[ends - low] - sums[starts - low] + (ends - starts).astype(np.uint64) * _BASE)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``raw``, in order."""
    starts, ends = word_bounds(raw)
    return span_hashes(raw, starts, ends)


def gram_hashes(words: np.ndarray, n: int, gap: int = 0) -> np.ndarray:
    """Hashes of the runs of ``n`` words; with ``gap``, that many words are left out between neighbours."""
    step = gap + 1
    count = len(words) - (n - 1) * step
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(count, np.uint64(n * 1_000_003 + gap), dtype=np.uint64)
    for k in range(n):
        total = mix(total * _BASE + words[k * step : k * step + count])
    return total


def shingle_set(raw: np.ndarray | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of the lower-cased text.

    A text with fewer words has its whole sequence as one shingle; null and wordless texts have none.
    """
    words = word_hashes(lowered(raw)) if raw is not None and len(raw) else np.zeros(0, dtype=np.uint64)
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(n, len(words))))
