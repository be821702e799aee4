"""Encoding texts word by word: each distinct word of a batch is encoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from .textarrays import byte_views, span_hashes

#: Texts are handled in slices of about this many bytes; the memory of known words is bounded too.
SLICE_BYTES = 2_000_000
SLOTS = 1 << 21
KNOWN_IDS, KNOWN_POINTS = 6_000_000, 12_000_000
_MASK = np.uint64(SLOTS - 1)


@cache
def char_classes() -> np.ndarray:
    """For each code point: 0 other, 1 letter, 2 number, 3 white space."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, dtype=np.uint8)
    for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, points):
            a, b = ord(points[m.start()]), ord(points[m.end() - 1])
            out[a : b + 1] = np.where((np.arange(a, b + 1) >= 0xD800) & (np.arange(a, b + 1) < 0xE000), 0, value)
    return out


_SUFFIXES = ("s", "t", "m", "d", "re", "ve", "ll")


def split_words(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of byte-level BPE's usual pattern, over texts laid end to end.

    The pattern: 's 't 're 've 'm 'll 'd, runs of letters, of numbers or of others with one leading
    space each, white space up to the last before such a run, other white space.
    """
    n = len(points)
    kind = char_classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[doc_starts] = True
    first[n] = True
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first[:n]
    space = kind == 3
    ends_run = np.ones(n, dtype=bool)  # the last of its run
    ends_run[:-1] = change[1:]
    before_word = np.zeros(n, dtype=bool)  # the last white space before a word of the same text
    before_word[:-1] = space[:-1] & ends_run[:-1] & ~first[1:n]
    joined = np.zeros(n, dtype=bool)  # a word whose leading space is in its token
    joined[1:] = before_word[:-1] & (points[:-1] == 32)
    start = (change & ~joined) | before_word
    quote = np.flatnonzero((points == 39) & start & ends_run & ~joined)
    for i in quote.tolist():
        for suffix in _SUFFIXES:
            k = i + 1 + len(suffix)
            if k <= n and not first[i + 1 : k].any() and points[i + 1 : k].tolist() == list(map(ord, suffix)):
                start[i + 1 : k] = False
                if k < n:
                    start[k] = True
                break
    return np.flatnonzero(start)


class WordCoder:
    """Ids of texts through a bounded memory of words.

    ``split`` gives the starts of the words in code points laid end to end; ``encode`` gives the ids
    of some distinct words.  Words are told apart by 64-bit hashes of their code points.  Each hash
    has one slot in the memory; a word that finds another one there is encoded and takes its place.
    """

    def __init__(self, split: Callable[[np.ndarray, np.ndarray], np.ndarray], encode: Callable[[list[str]], list[list[int]]]):
        self.split, self.encode = split, encode
        self.hashes = np.zeros(SLOTS, dtype=np.uint64)
        self.at, self.count = np.zeros(SLOTS, dtype=np.int32), np.zeros(SLOTS, dtype=np.int32)
        self.ids, self.used = np.zeros(KNOWN_IDS, dtype=np.uint32), 0
        #: The known words' code points, end to end, and where each slot's word is among them.
        self.spelt, self.spelt_used = np.zeros(KNOWN_POINTS, dtype=np.uint32), 0
        self.spelt_at, self.spelt_count = np.zeros(SLOTS, dtype=np.int32), np.zeros(SLOTS, dtype=np.int32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode(words)
        count = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
        total = int(count.sum())
        at = (self.used + np.cumsum(count) - count).astype(np.int32)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(total, np.uint32)))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=total)
        self.used += total
        slot = (hashes & _MASK).astype(np.int64)
        self.hashes[slot], self.at[slot], self.count[slot] = hashes, at, count
        lengths = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        spelt = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.spelt_at[slot], self.spelt_count[slot] = self.spelt_used + np.cumsum(lengths) - lengths, lengths
        if self.spelt_used + len(spelt) > len(self.spelt):
            self.spelt = np.concatenate((self.spelt[: self.spelt_used], np.zeros(len(spelt), np.uint32)))
        self.spelt[self.spelt_used : self.spelt_used + len(spelt)] = spelt
        self.spelt_used += len(spelt)
        return at, count

    def _known(self, words: np.ndarray, slot: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which words are those kept in their slots: by hash and length, then by every code point."""
        same = (self.hashes[slot] == words) & (self.spelt_count[slot] == lengths)
        move = np.where(same, self.spelt_at[slot] - starts, 0)
        there = np.minimum(np.arange(len(points)) + np.repeat(move, lengths), len(self.spelt) - 1)
        return same & np.logical_and.reduceat(self.spelt[there] == points, starts) if len(starts) else same

    def _slice(self, views: list[np.ndarray]) -> Iterator[np.ndarray]:
        raw = np.concatenate(views) if views else np.zeros(0, np.uint8)
        text = raw.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        lead = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
        edges = lead[np.concatenate(([0], np.cumsum([len(v) for v in views]))).astype(np.int64)]
        if not len(points):
            yield from (np.zeros(0, np.uint32) for _ in views)
            return
        if self.used >= KNOWN_IDS or self.spelt_used >= KNOWN_POINTS:
            self.hashes[:] = 0
            self.ids, self.used = np.zeros(KNOWN_IDS, dtype=np.uint32), 0
            self.spelt, self.spelt_used = np.zeros(KNOWN_POINTS, dtype=np.uint32), 0
        starts = self.split(points, edges[:-1][np.diff(edges) > 0])
        ends = np.append(starts[1:], len(points))
        words = span_hashes(points, starts, ends)
        words[words == 0] = 1  # 0 marks a free slot
        slot = (words & _MASK).astype(np.int64)
        at, count = self.at[slot], self.count[slot]
        missed = np.flatnonzero(~self._known(words, slot, points, starts, ends - starts))
        if len(missed):
            new: dict[str, int] = {}
            which = [new.setdefault(text[a:b], len(new)) for a, b in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)]
            first = np.zeros(len(new), dtype=np.int64)
            first[which] = missed
            new_at, new_count = self._learn(words[first], list(new))
            at[missed], count[missed] = new_at[which], new_count[which]
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        take = np.arange(total[-1]) + np.repeat(at - total[:-1], count)
        ids = self.ids[take]
        cuts = total[np.searchsorted(starts, edges)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield ids[a:b]

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        held, size = [], 0
        for view in byte_views(texts):
            view = view if view is not None else np.zeros(0, np.uint8)
            if held and size + len(view) > SLICE_BYTES:
                yield from self._slice(held)
                held, size = [], 0
            held.append(view)
            size += len(view)
        yield from self._slice(held)
