"""Words of ASCII letters, digits and everything beyond ASCII, with A-Z as a-z, as 64-bit hashes straight from a column's bytes."""

from __future__ import annotations

import numpy as np

from .common import BASE, INVERSE, byte_table, mix64, powers, prefix_sums

_U = np.uint64
#: Every byte of a character beyond ASCII belongs to a word, so words are told on UTF-8 as on characters.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NUMBERS = byte_table(0x70C5, fold_case=True)
#: Bytes hashed at once.
CHUNK = 1 << 20


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in the bytes of rows one after another; a row's end ends a word."""
    is_word = IN_WORD[data]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = is_word[edge]
    last[edge - 1] = is_word[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray, numbers: np.ndarray = _NUMBERS) -> np.ndarray:
    """A hash for each word (or other stretch of bytes). Words are equal where 64 bits of it are; A-Z count as a-z with these numbers."""
    out = np.empty(len(begin), _U)
    done = 0
    while done < len(begin):
        at = int(begin[done])
        upto = max(int(np.searchsorted(end, at + CHUNK, "right")), done + 1)
        some = slice(done, upto)
        s = prefix_sums(data[at : int(end[upto - 1])], numbers)
        a, z = begin[some] - at, end[some] - at
        out[some] = mix64((s[z] - s[a]) * powers(INVERSE, len(s))[a] + (z - a).astype(_U) * _U(BASE))
        done = upto
    return out


def of_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the number of words before each row, and after the last."""
    begin, end = spans(data, offsets)
    return hashed(data, begin, end), np.searchsorted(begin, offsets)


def slices(offsets: np.ndarray, room: int):
    """Ranges of rows of at most so many bytes, or one row."""
    a = 0
    while a < len(offsets) - 1:
        z = max(int(np.searchsorted(offsets, offsets[a] + room, "right")) - 1, a + 1)
        yield a, z
        a = z


class Vocabulary:
    """Numbers of known words from 1 on, by their hashes; of others 0."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = max(12, int(len(self.hashes)).bit_length() + 4)
        slot = (self.hashes >> _U(64 - self.bits)).astype(np.int64)
        self.first = np.zeros(1 << self.bits, np.int32)  # 0: nobody, -1: several
        several = np.bincount(slot, minlength=1 << self.bits) > 1
        self.first[slot] = np.arange(1, len(self.hashes) + 1)
        self.first[several] = -1
        self.several = bool(several.any())
        self.known = np.append(_U(0), self.hashes)

    def __len__(self) -> int:
        return len(self.hashes)

    def number(self, h: np.ndarray) -> np.ndarray:
        out = self.first[(h >> _U(64 - self.bits)).astype(np.int64)]
        if self.several:
            at = np.flatnonzero(out < 0)
            out[at] = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1) + 1
        return np.where(self.known[out] == h, out, 0).astype(np.int32) if len(self.hashes) else np.zeros(len(h), np.int32)
