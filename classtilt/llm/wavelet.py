"""A wavelet matrix over the character classes of UTF-8 texts: ranks of any class at any byte, many at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Classes of bytes: a later byte of a character, a line end, other white space, the first or a later character of a word.
TAIL, NEWLINE, SPACE, HEAD, INNER = range(5)
PLANES = 3
CLASS_OF_BYTE = np.full(256, INNER, np.uint8)
CLASS_OF_BYTE[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
CLASS_OF_BYTE[0x0A] = NEWLINE
CLASS_OF_BYTE[0x80:0xC0] = TAIL


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte of ``data`` (uint8), which holds texts that begin at ``starts``."""

    codes = CLASS_OF_BYTE[data]
    fresh = np.zeros(len(data), bool)
    fresh[1:] = (codes[:-1] == SPACE) | (codes[:-1] == NEWLINE)
    fresh[starts[starts < len(data)]] = True
    codes[fresh & (codes == INNER)] = HEAD
    return codes


class WaveletMatrix:
    """Bit planes of codes, the highest first; each plane is sorted stably by its bit to make the order of the next."""

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        self.planes = []
        for shift in reversed(range(PLANES)):
            bits = (codes >> np.uint8(shift)) & np.uint8(1)
            packed = np.zeros(len(codes) // 64 * 8 + 8, np.uint8)
            packed[: (len(codes) + 7) // 8] = np.packbits(bits, bitorder="little")
            words = packed.view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.planes.append((shift, words, before, len(codes) - int(before[-1])))
            codes = np.concatenate((codes[bits == 0], codes[bits == 1]))

    def rank(self, code: int, ends: np.ndarray) -> np.ndarray:
        """How often ``code`` stands before each position of ``ends``."""

        low, high = np.zeros_like(ends), ends
        for shift, words, before, zeros in self.planes:
            ones = [
                before[at >> 6] + np.bitwise_count(words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
                for at in (low, high)
            ]
            low, high = [zeros + n for n in ones] if code >> shift & 1 else [low - ones[0], high - ones[1]]
        return high - low

    def count(self, codes: tuple[int, ...], ends: np.ndarray) -> np.ndarray:
        """Of several classes together."""

        return sum((self.rank(code, ends) for code in codes), np.zeros_like(ends))


def least_reaching(count: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """By bisection, the least position in ``low`` to ``high`` at which ``count``, which never falls, is ``wanted`` or more."""

    low, high = low.copy(), high.copy()
    while (low < high).any():
        middle = (low + high) // 2
        enough = count(middle) >= wanted
        high = np.where(enough, middle, high)
        low = np.where(enough, low, np.minimum(middle + 1, high))
    return low


#: Unit: the classes that mark one, and whether the mark ends it (or begins it).
UNITS = {"line": ((NEWLINE,), True), "word": ((HEAD,), False), "char": ((NEWLINE, SPACE, HEAD, INNER), False)}


class Units:
    """Texts ``starts`` to ``ends`` of ``data``, in units. Ranks give the number of units, bisection on ranks the cuts."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: str):
        self.marks, self.closing = UNITS[unit]
        self.starts, self.ends = starts, ends
        self.matrix = WaveletMatrix(classes(data, starts))
        self.before = self.matrix.count(self.marks, starts)
        self.n = self.matrix.count(self.marks, ends) - self.before
        if self.closing:
            # Units beyond the last mark: one, unless the text ends with a mark or is empty.
            last = np.maximum(ends - 1, starts)
            self.n += (ends > starts) & (self.matrix.count(self.marks, ends) == self.matrix.count(self.marks, last))

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The byte position after so many units of each text (0 to n)."""

        wanted = self.before + units + (0 if self.closing else 1)
        at = least_reaching(lambda ends: self.matrix.count(self.marks, ends), self.starts, self.ends, wanted)
        at = at if self.closing else at - 1
        return np.where(units <= 0, self.starts, np.where(units >= self.n, self.ends, at))

    def chars(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Characters between two byte positions: bytes without the later bytes of characters."""

        return high - low - self.matrix.rank(TAIL, high) + self.matrix.rank(TAIL, low)
