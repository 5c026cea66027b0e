"""Longest dictionary match over batches of texts, in flat numpy arrays.

The code points of a batch lie one after another. One running sum gives a 64-bit hash of any
window in a few array operations (a polynomial modulo 2^64, divided by the power of the
window's start), so the windows of one length at all places are looked up together. Hits are
compared by their characters, so equal hashes of different strings do no harm.

``FlatDictionary`` holds keys, values and an open-addressing table of the key hashes: about
five bytes for each byte of keys and values and 40 for each entry, where a Python dict takes
several hundred an entry. ``Bloom`` is a bit set of bounded size over the key hashes, for
dictionaries that are too large to hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Characters that are worked on at a time (a longer text is worked on alone).
SLICE = 1 << 20


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text begins (one more entry at the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), starts


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Windows:
    """Hashes of the windows of a batch of texts."""

    def __init__(self, codes: np.ndarray):
        c = codes.astype(np.uint64) + np.uint64(1)
        c = (c ^ (c << np.uint64(29))) * _MIX
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * _powers(_BASE, len(c)), dtype=np.uint64)])
        self.back = _powers(_INVERSE, len(c) + 1)

    def hashes(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        h = (self.sums[at + length] - self.sums[at]) * self.back[at] + np.asarray(length).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(29))


def text_hashes(texts: Sequence[str]) -> np.ndarray:
    """Hash of every whole text, equal to that of a window with the same characters."""
    codes, starts = code_points(texts)
    return Windows(codes).hashes(starts[:-1], np.diff(starts))


def prefix_hashes(texts: Sequence[str]) -> np.ndarray:
    """Hashes of all that the texts begin with, one for each character."""
    codes, starts = code_points(texts)
    first = np.repeat(starts[:-1], np.diff(starts))
    return Windows(codes).hashes(first, np.arange(1, len(codes) + 1) - first)


def in_slices(texts: Sequence[str]) -> Iterable[Sequence[str]]:
    """The texts in runs of about ``SLICE`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield texts[first:i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:]


class FlatDictionary:
    """Distinct keys (not empty) and their values."""

    def __init__(self, keys: Sequence[str], values: Sequence[str]):
        self.keys, self.key_at = code_points(keys)
        self.values, self.value_at = code_points(values)
        length = np.diff(self.key_at)
        self.lengths = np.unique(length)[::-1]
        # Which lengths the keys that begin with a character have.
        first = self.keys[self.key_at[:-1]] if len(keys) else np.zeros(0, np.uint32)
        firsts = np.unique(first)
        self.row = np.zeros(int(firsts[-1]) + 2 if len(firsts) else 1, np.int32)
        self.row[firsts] = np.arange(1, len(firsts) + 1)
        self.has = np.zeros((len(firsts) + 1, len(self.lengths)), bool)
        self.has[self.row[first], np.searchsorted(-self.lengths, -length)] = True
        self.hashes = Windows(self.keys).hashes(self.key_at[:-1], length) if len(keys) else np.zeros(0, np.uint64)
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), (self.hashes >> self.shift).astype(np.int64)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]  # of several, the last one stays
            left = self.slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """An entry with each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        todo, slot = np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        while len(todo):
            entry = self.slots[slot]
            there = entry >= 0
            hit = there & (self.hashes[np.maximum(entry, 0)] == hashes[todo])
            out[todo[hit]] = entry[hit]
            left = there & ~hit
            todo, slot = todo[left], (slot[left] + 1) & self.mask
        return out

    def _matches(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry or -1, length) of the longest key at each place."""
        entry, taken = np.full(len(codes), -1, np.int64), np.zeros(len(codes), np.int64)
        row = self.row[np.minimum(codes, len(self.row) - 1)]
        at = np.flatnonzero(row)
        if not len(at):
            return entry, taken
        windows, end = Windows(codes), np.repeat(starts[1:], np.diff(starts))
        for k, length in enumerate(self.lengths.tolist()):
            some = at[self.has[row[at], k]]
            some = some[some + length <= end[some]]
            found = self.find(windows.hashes(some, length))
            some, found = some[found >= 0], found[found >= 0]
            same = np.ones(len(some), bool)
            for i in range(length):
                same &= codes[some + i] == self.keys[self.key_at[found] + i]
            entry[some[same]], taken[some[same]] = found[same], length
            at = at[entry[at] < 0]
        return entry, taken

    def _convert(self, texts: Sequence[str]) -> list[str]:
        codes, starts = code_points(texts)
        entry, taken = self._matches(codes, starts)
        n = len(codes)
        # Where the next match at or behind a place begins; the lines step from match to match.
        ahead = np.append(np.where(entry >= 0, np.arange(n), n), n)
        ahead = np.minimum.accumulate(ahead[::-1])[::-1]
        at, end = ahead[starts[:-1]], starts[1:]
        chosen = []
        while True:
            live = at < end
            at, end = at[live], end[live]
            if not len(at):
                break
            chosen.append(at)
            at = ahead[at + taken[at]]
        if not chosen:
            return list(texts)
        chosen = np.concatenate(chosen)
        size, source = np.ones(n, np.int64), np.arange(n)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, chosen, 1)
        np.add.at(edge, chosen + taken[chosen], -1)
        size[np.cumsum(edge[:-1]) > 0] = 0
        size[chosen] = np.diff(self.value_at)[entry[chosen]]
        source[chosen] = n + self.value_at[entry[chosen]]
        ends = np.cumsum(size)
        index = np.repeat(source - (ends - size), size) + np.arange(int(size.sum()))
        out = np.concatenate([codes, self.values])[index].tobytes().decode("utf-32-le", "surrogatepass")
        cuts = np.append(0, ends)[starts].tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def convert(self, texts: Sequence[str | None]) -> list[str | None]:
        """Greedy longest match from the left; characters that no key covers stay."""
        if not len(self.lengths):
            return list(texts)
        done = iter([x for part in in_slices([t for t in texts if t is not None]) for x in self._convert(part)])
        return [None if t is None else next(done) for t in texts]


class Bloom:
    """A bit set over hashes: four bits an entry, in 64-bit words."""

    PROBES = 4

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def bit(hashes: np.ndarray, probe: int, n_words: int) -> np.ndarray:
        step = (hashes >> np.uint64(33)) | np.uint64(1)
        return (hashes + np.uint64(probe) * step * _MIX) % np.uint64(64 * n_words)

    @staticmethod
    def bits(hashes: np.ndarray, n_words: int) -> np.ndarray:
        """The numbers of the bits of each hash, one row a probe."""
        return np.stack([Bloom.bit(hashes, i, n_words) for i in range(Bloom.PROBES)])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(hashes), bool), np.arange(len(hashes))
        for probe in range(self.PROBES):  # most others fall at the first
            bit = self.bit(hashes[left], probe, len(self.words))
            left = left[(self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
        out[left] = True
        return out
