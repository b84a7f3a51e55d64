"""Elias-Fano sequences and an n-gram trie of them, over arrays in one memory-mapped file; all operations are vectorised.

A rising sequence of n values below u keeps log2(u / n) low bits of each value packed, and the high bits as a bit vector in which
value i sets the bit (value >> low) + i. Select on that vector gives random access and, for a value searched, the
bucket of its equals in high bits; the successor search goes on over the bucket's low bits."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_U = np.uint64


class Store:
    """Arrays in a file without a name: written, then mapped; gone with the object."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()
        self.places: list[tuple[int, int, np.dtype]] = []

    def put(self, array: np.ndarray) -> int:
        self.file.seek(0, 2)
        self.file.write(b"\0" * (-self.file.tell() % 8))
        self.places.append((self.file.tell(), len(array), array.dtype))
        self.file.write(array.tobytes() or b"\0" * 8)
        return len(self.places) - 1

    def map(self) -> list[np.ndarray]:
        self.file.flush()
        self.mapped = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        return [np.frombuffer(self.mapped, kind, n, at) for at, n, kind in self.places]


def _bits_at(words: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(place), _U)
    at, shift = place >> 6, (place & 63).astype(_U)
    low = words[at] >> shift
    high = np.where(shift > 0, words[at + 1] << (_U(64) - np.maximum(shift, _U(1))), _U(0))
    return (low | high) & _U((1 << width) - 1)


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th set bit of each word."""
    word, rank, place = word.copy(), rank.copy(), np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        part = word & _U((1 << width) - 1)
        count = np.bitwise_count(part).astype(np.int64)
        right = rank >= count
        rank -= count * right
        place += width * right
        word = np.where(right, word >> _U(width), part)
    return place


class Sequence:
    """``put`` writes a sequence into a store; with the mapped arrays an instance reads it."""

    @staticmethod
    def put(store: Store, values: np.ndarray, universe: int) -> dict:
        n = len(values)
        low = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        packed = np.zeros((n * low >> 6) + 2, _U)
        if low and n:
            place = np.arange(n, dtype=np.int64) * low
            part, at, shift = values & _U((1 << low) - 1), place >> 6, (place & 63).astype(_U)
            np.bitwise_or.at(packed, at, part << shift)
            over = shift > 0
            np.bitwise_or.at(packed, at[over] + 1, part[over] >> (_U(64) - shift[over]))
        buckets = (max(universe - 1, 0) >> low) + 1
        upper = np.zeros((n + buckets >> 6) + 1, _U)
        place = (values >> _U(low)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(upper, place >> 6, _U(1) << (place & 63).astype(_U))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)])
        return {"n": n, "low": low, "buckets": buckets, "packed": store.put(packed), "upper": store.put(upper),
                "ones": store.put(ones)}

    def __init__(self, head: dict, arrays: list[np.ndarray]):
        self.n, self.low, self.buckets = head["n"], head["low"], head["buckets"]
        self.packed, self.upper, self.ones = (arrays[head[k]] for k in ("packed", "upper", "ones"))
        self.zeros = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones

    def _select(self, rank: np.ndarray, one: bool) -> np.ndarray:
        totals = self.ones if one else self.zeros
        word = np.searchsorted(totals, rank, side="right") - 1
        bits = self.upper[word] if one else ~self.upper[word]
        return 64 * word + _select_in_word(bits, rank - totals[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(_U)
        return high << _U(self.low) | _bits_at(self.packed, i * self.low, self.low)

    def find(self, value: np.ndarray, since: np.ndarray | None = None, until: np.ndarray | None = None):
        """(place of the first element not below each value, whether it is the value); with ``since`` and ``until`` the
        search is inside that range only."""
        bucket = np.minimum((value >> _U(self.low)).astype(np.int64), self.buckets - 1)
        lo = np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), False) - bucket + 1, 0)
        hi = self._select(bucket, False) - bucket
        if since is not None:
            lo, hi = np.maximum(lo, since), np.maximum(np.minimum(hi, until), np.maximum(lo, since))
        want, end = value & _U((1 << self.low) - 1), hi.copy()
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            middle = lo[live] + hi[live] >> 1
            below = _bits_at(self.packed, middle * self.low, self.low) < want[live]
            lo[live] = np.where(below, middle + 1, lo[live])
            hi[live] = np.where(below, hi[live], middle)
        some = lo < end
        equal = np.zeros(len(value), bool)
        equal[some] = _bits_at(self.packed, lo[some] * self.low, self.low) == want[some]
        return lo, equal & ((value >> _U(self.low)).astype(np.int64) < self.buckets)


class Trie:
    """Bigrams: contexts, pointers to where each one's successors begin, successors, and a 16-bit value for each.

    A successor is kept relative to its context: the number of the context above its own bits, so the level rises."""

    def __init__(self, contexts: np.ndarray, context_of: np.ndarray, successors: np.ndarray, values: np.ndarray):
        """``contexts`` rise; the others are in the order of (context_of, successors); successors are below 2^32."""
        store = Store()
        counts = np.bincount(context_of, minlength=len(contexts))
        pointers = np.concatenate([[0], np.cumsum(counts)]).astype(_U)
        heads = [Sequence.put(store, contexts, int(contexts[-1]) + 1 if len(contexts) else 1),
                 Sequence.put(store, pointers, len(successors) + 1),
                 Sequence.put(store, context_of.astype(_U) << _U(32) | successors, max(len(contexts), 1) << 32)]
        at = store.put(values.astype(np.uint16))
        arrays = store.map()
        self.store, self.values = store, arrays[at]
        self.contexts, self.pointers, self.successors = (Sequence(h, arrays) for h in heads)

    def value(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """0 where the bigram isn't there."""
        out = np.zeros(len(context), np.uint16)
        if not self.successors.n:
            return out
        number, known = self.contexts.find(context)
        known = np.flatnonzero(known)
        number = number[known]
        place, there = self.successors.find(number.astype(_U) << _U(32) | successor[known],
                                            self.pointers.access(number).astype(np.int64),
                                            self.pointers.access(number + 1).astype(np.int64))
        out[known[there]] = self.values[place[there]]
        return out
