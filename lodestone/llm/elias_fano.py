"""Increasing sequences of whole numbers in Elias-Fano form, in a flat buffer that is read in place.

A value's low bits stand packed one after another; its high part is a bit in a bit vector: the i-th value with high
part h sets bit h + i. A directory of the set bits before each word answers where the i-th set or unset bit is.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _ored(at: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """n words, of which word at[i] has bits[i] set; `at` doesn't decrease."""
    out = np.zeros(n, _U)
    if len(at):
        starts = np.flatnonzero(np.diff(at, prepend=at[:1] - 1))
        out[at[starts]] = np.bitwise_or.reduceat(bits, starts)
    return out


def encode(values: np.ndarray) -> bytes:
    """`values`: whole numbers from 0 that don't decrease."""
    v = np.asarray(values, np.int64)
    n = len(v)
    low = max(0, int(max(v[-1], 1) // n).bit_length() - 1) if n else 0
    place = np.arange(n, dtype=np.int64)
    bit = place * low
    word, off = bit >> 6, (bit & 63).astype(_U)
    part = v.astype(_U) & _U((1 << low) - 1)
    lows = _ored(word, part << off, (n * low >> 6) + 2)
    over = np.flatnonzero((bit & 63) + low > 64)
    lows[word[over] + 1] |= part[over] >> (_U(64) - off[over])
    bit = (v >> low) + place
    size = (int(bit[-1]) + 2 >> 6) + 1 if n else 1
    highs = _ored(bit >> 6, _U(1) << (bit & 63).astype(_U), size)
    ones = np.append(0, np.cumsum(np.bitwise_count(highs), dtype=np.int64))
    return np.array([n, low, len(lows), size], np.int64).tobytes() + lows.tobytes() + highs.tobytes() + ones.tobytes()


_BYTE = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _BYTE[_b, : _b.bit_count()] = [i for i in range(8) if _b >> i & 1]


def _select(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th (from 0) set bit of each word."""
    parts = np.ascontiguousarray(word).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.uint8)
    r, row = r.astype(np.uint8), np.arange(len(word))
    part = np.minimum((upto <= r[:, None]).sum(axis=1), 7)
    before = np.where(part > 0, upto[row, part - 1], 0).astype(np.uint8)
    return part * 8 + _BYTE[parts[row, part], np.minimum(r - before, 7)]


class Sequence:
    """An encoded sequence at `offset` of a buffer."""

    def __init__(self, buffer, offset: int = 0):
        self.n, self.low, lows, size = map(int, np.frombuffer(buffer, np.int64, 4, offset))
        at = offset + 32
        self.lows = np.frombuffer(buffer, _U, lows, at)
        self.highs = np.frombuffer(buffer, _U, size, at := at + 8 * lows)
        self.ones = np.frombuffer(buffer, np.int64, size + 1, at := at + 8 * size)
        self.zeros = 64 * np.arange(size + 1, dtype=np.int64) - self.ones
        self.end = at + 8 * (size + 1)

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low
        word, off = bit >> 6, (bit & 63).astype(_U)
        found = self.lows[word] >> off
        over = (bit & 63) + self.low > 64
        found = np.where(over, found | self.lows[word + 1] << (_U(64) - off) % _U(64), found)
        return (found & _U((1 << self.low) - 1)).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values of places i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        return (word * 64 + _select(self.highs[word], i - self.ones[word]) - i << self.low) | self._low(i)

    def _begin(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values have a high part under h, and the place in the bit vector where those of h begin."""
        word = np.minimum(np.searchsorted(self.zeros, h - 1, "right") - 1, len(self.highs) - 1)
        place = np.where(h <= 0, 0, word * 64 + _select(~self.highs[word], np.clip(h - 1 - self.zeros[word], 0, 63)) + 1)
        late = h > self.zeros[-1]
        return np.where(late, self.n, np.minimum(place - h, self.n)), np.where(late, 64 * len(self.highs), place)

    def _bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the first value with x's high part (or a higher one), and behind the last one with it."""
        h = x >> self.low
        first, place = self._begin(h)
        word, off = np.minimum(place >> 6, len(self.highs) - 1), place & 63
        rest = self.highs[word] >> off.astype(_U)
        ones = np.bitwise_count(rest ^ (rest + _U(1))).astype(np.int64) - 1  # set bits in a row from here on
        last = np.where(place < 64 * len(self.highs), first + ones, first)
        open_ = np.flatnonzero((off + ones >= 64) & (place < 64 * len(self.highs)))
        last[open_] = self._begin(h[open_] + 1)[0]
        return first, np.minimum(last, self.n)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = self._bounds(x)
        end, rest = last.copy(), x & ((1 << self.low) - 1)
        todo = np.flatnonzero(first < last)
        while len(todo):
            middle = first[todo] + last[todo] >> 1
            less = self._low(middle) < rest[todo]
            first[todo] = np.where(less, middle + 1, first[todo])
            last[todo] = np.where(less, last[todo], middle)
            todo = todo[first[todo] < last[todo]]
        return first, end

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that isn't under x; n if there is none."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value equal to x, else -1."""
        place, end = self._search(x)
        held = np.flatnonzero(place < end)  # of x's high part; only the low one is left to compare
        out = np.full(len(x), -1, np.int64)
        out[held] = np.where(self._low(place[held]) == x[held] & ((1 << self.low) - 1), place[held], -1)
        return out


class Lists:
    """Increasing lists one after another: each begins where the last value of the one before ends, so that all of them are one sequence."""

    @staticmethod
    def encode(owner: np.ndarray, values: np.ndarray, n: int) -> bytes:
        """List owner[i] (0 to n - 1, not decreasing) holds values[i]."""
        pointers = np.searchsorted(owner, np.arange(n + 1))
        ends = pointers[1:][np.diff(pointers) > 0]
        base = np.zeros(n, np.int64)
        base[np.flatnonzero(np.diff(pointers) > 0)] = np.append(0, np.cumsum(values[ends - 1] + 1)[:-1]) if len(ends) else 0
        return encode(pointers) + encode(values + base[owner])

    def __init__(self, buffer, offset: int = 0):
        self.pointers = Sequence(buffer, offset)
        self.values = Sequence(buffer, self.pointers.end)
        self.end = self.values.end

    def find(self, owner: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of x among all values, and within its list; -1 where the list doesn't hold it. x is at least 0."""
        # Owners mostly come in runs: what belongs to one is read once a run.
        new = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
        one, run = owner[new], np.cumsum(new) - 1
        begin, end = self.pointers.at(one), self.pointers.at(one + 1)
        base = np.zeros(len(one), np.int64)
        late = begin > 0
        base[late] = self.values.at(begin[late] - 1) + 1
        place, begin, end = self.values.find(base[run] + x), begin[run], end[run]
        held = (place >= begin) & (place < end)
        return np.where(held, place, -1), np.where(held, place - begin, -1)
