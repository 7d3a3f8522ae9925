"""Elias-Fano coded monotone sequences and an n-gram trie made of them, over numpy arrays."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np

_ONE, _SIX, _LOW6 = np.uint64(1), np.uint64(6), np.uint64(63)


@dataclass(frozen=True)
class EliasFano:
    """Strictly rising numbers: the low ``bits`` of each are packed, the rest are steps in a bit string.

    In the bit string every number is a one and every step of its high part a zero, so the numbers
    of a high part ``h`` stand behind its ``h``-th zero; ``before`` counts the zeros before each of
    its 64-bit words.
    """

    size: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    before: np.ndarray

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> _SIX).astype(np.int64), at & _LOW6
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        steps = (values >> np.uint64(bits)).astype(np.int64)
        ones = steps + np.arange(n) + 1  # a zero stands first, for the high part 0
        length = int((universe >> bits) + n + 3)
        high = np.zeros(length // 64 + 2, dtype=np.uint64)
        np.bitwise_or.at(high, ones >> 6, _ONE << (ones & 63).astype(np.uint64))
        zeros = 64 - np.bitwise_count(high).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(zeros)])
        return EliasFano(n, bits, low, high, total[:-1].astype(np.uint32))

    @staticmethod
    def _spot(bitmap: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Where the ``left``-th one (from 0) of each 64-bit word stands: the half that holds it, six times."""
        left, spot = left.astype(np.uint64), np.zeros(len(left), dtype=np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            half = np.bitwise_count((bitmap >> spot) & np.uint64((1 << width) - 1)).astype(np.uint64)
            far = left >= half
            left = np.where(far, left - half, left)
            spot = np.where(far, spot + np.uint64(width), spot)
        return spot.astype(np.int64)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Where the ``k``-th zero (from 0) stands."""
        word = np.searchsorted(self.before, k, side="right") - 1
        return (word << 6) + self._spot(~self.high[word], k - self.before[word])

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the places ``i``."""
        ones = (np.arange(len(self.before), dtype=np.int64) << 6) - self.before
        word = np.searchsorted(ones, i, side="right") - 1
        spot = (word << 6) + self._spot(self.high[word], i - ones[word])
        return (spot - i - 1 << self.bits) + self._low(i).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> _SIX).astype(np.int64), at & _LOW6
        rest = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & _LOW6), np.uint64(0))
        return ((self.low[word] >> shift) | rest) & np.uint64((1 << self.bits) - 1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1: its successor among the numbers of its high part is looked for, by halving."""
        out = np.full(len(values), -1, dtype=np.int64)
        if not self.size or not len(values):
            return out
        values = values.astype(np.uint64)
        part, high = values & np.uint64((1 << self.bits) - 1), (values >> np.uint64(self.bits)).astype(np.int64)
        first, stop = self._zero(high) - high, self._zero(high + 1) - high - 1
        live = np.arange(len(values))
        while len(live := live[first[live] < stop[live]]):
            middle = (first[live] + stop[live]) >> 1
            low = self._low(middle)
            same = low == part[live]
            out[live[same]] = middle[same]
            less = low < part[live]
            first[live[less]] = middle[less] + 1
            stop[live[~less]] = middle[~less]
            stop[live[same]] = first[live[same]]
        return out

    def values(self) -> np.ndarray:
        """All numbers again."""
        bits = np.unpackbits(self.high.view(np.uint8), bitorder="little")
        ones = np.flatnonzero(bits)[: self.size]
        return ((ones - np.arange(self.size) - 1).astype(np.uint64) << np.uint64(self.bits)) | self._low(np.arange(self.size))


#: Steps a power of ten is divided into; 16 bits reach down to 1e-32.
STEPS = 2048


def quantised(logp: np.ndarray) -> np.ndarray:
    """Log10 probabilities as 16-bit numbers of steps, the same everywhere: at most half a step off."""
    return np.clip(np.rint(logp * -STEPS), 0, 65_535).astype(np.uint16)


@dataclass(frozen=True)
class Level:
    """The n-grams of one order below their contexts.

    ``pointers`` holds where each context's children begin (plus the context's own place, so that it
    rises strictly). ``keys`` holds the children's words, counted from the last number of the
    contexts before, so the sequence rises over all contexts. ``codes`` are the quantised smoothed
    log10 probabilities.
    """

    pointers: EliasFano
    keys: EliasFano
    codes: np.ndarray

    @staticmethod
    def build(parent: np.ndarray, word: np.ndarray, contexts: int, logp: np.ndarray) -> Level:
        """From n-grams in the order of (parent, word); words count from 1."""
        begin = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=contexts))])
        last = np.where(begin[1:] > begin[:-1], word[begin[1:] - 1], 0) if len(word) else np.zeros(contexts, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(last)])
        top = int(total[-1] + word.max(initial=0)) + 2
        pointers = EliasFano.build(begin + np.arange(contexts + 1), len(word) + contexts + 2)
        return Level(pointers, EliasFano.build(word + total[parent], top), quantised(logp))

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each context's children begin, with the end behind the last one, and the number they count from."""
        begin = self.pointers.values().astype(np.int64) - np.arange(self.pointers.size)
        return begin, np.where(begin > 0, self.keys.at(np.maximum(begin - 1, 0)), 0) if self.keys.size else begin

    def find(self, parent: np.ndarray, word: np.ndarray, ranges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The place of each word below its context, or -1: the successor of the word, counted from the
        context's own number, must lie in the context's range."""
        begin, base = ranges
        place = self.keys.find(base[parent] + word)
        return np.where((place >= begin[parent]) & (place < begin[parent + 1]), place, -1)

    def logp(self, place: np.ndarray) -> np.ndarray:
        return self.codes[place] / -float(STEPS)

    def mapped(self) -> Level:
        """The same level with its arrays memory-mapped from an unnamed local file."""
        arrays = [self.pointers.low, self.pointers.high, self.pointers.before, self.keys.low, self.keys.high, self.keys.before, self.codes]
        with tempfile.TemporaryFile() as file:
            places = []
            for array in arrays:
                file.seek(-(-file.tell() // 8) * 8)
                places.append(file.tell())
                file.write(array.tobytes())
            file.flush()
            found = [np.memmap(file, dtype=a.dtype, mode="r", offset=at, shape=a.shape).view(np.ndarray) if len(a) else a for a, at in zip(arrays, places, strict=True)]
        p, k = self.pointers, self.keys
        return Level(EliasFano(p.size, p.bits, *found[:3]), EliasFano(k.size, k.bits, *found[3:6]), found[6])
