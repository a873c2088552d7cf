"""Words of whole Arrow text columns as numpy arrays.

Near-duplicate, substring and toxicity operators all need "the words of every
document" without making a Python object for each word.  `WordTable` finds word
boundaries in the UTF-8 buffer of an Arrow column and hashes every word with a
64-bit polynomial that is finished by a multiply-xor mixer.  Nulls have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A word is a maximal run of bytes other than space and \t \n \v \f \r.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All but letters, digits and bytes of other scripts: for words without punctuation.
NOT_ALNUM = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public SplitMix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for every byte, so that the polynomial has no small coefficients.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers and their inverses modulo 2**64, grown by doubling."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("_powers", _BASE), ("_inverse", inverse)):
            table = np.ones(1, dtype=np.uint64)
            while len(table) < size:
                table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
            globals()[name] = table
    return _powers[:n], _inverse[:n]


def utf8_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without copying; null rows have equal offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class WordTable:
    """Words of a text column: byte ranges, document numbers and 64-bit hashes.

    start, end   byte range of each word in `data`
    first        for document i, its words are first[i] .. first[i + 1]
    hashes       hash of each word's bytes, after lower-casing A-Z if asked
    """

    def __init__(self, column, lower: bool = False, separators: np.ndarray = WHITE, step: int = 1 << 14):
        self.data, self.offsets = utf8_column(column)
        data, offsets = self.data, self.offsets
        white = separators[data]
        begins = ~white
        begins[1:] &= white[:-1]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = ~white[inner]  # a document's first byte starts a word whatever stands before
        stops = ~white
        stops[:-1] &= white[1:]
        stops[inner - 1] = ~white[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hashes = np.empty(len(self.start), dtype=np.uint64)
        for a in range(0, len(self.start), step):  # bounded scratch space, whatever the batch
            b = min(a + step, len(self.start))
            self.hashes[a:b] = self._hash(self.start[a:b], self.end[a:b], lower)

    def _hash(self, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
        low = int(start[0])
        piece = self.data[low : int(end[-1])]
        values = BYTE[LOWER[piece]] if lower else BYTE[piece]
        powers, inverse = _power_tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(values * powers[:-1], out=sums[1:])
        whole = (sums[end - low] - sums[start - low]) * inverse[start - low]
        return mix(whole + (end - start).astype(np.uint64))

    def same(self, one: np.ndarray, other: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """Whether the words with two lists of numbers are equal, byte by byte."""
        out = (self.hashes[one] == self.hashes[other]) & (self.end[one] - self.start[one] == self.end[other] - self.start[other])
        left = np.flatnonzero(out)
        for a in range(0, len(left), step):
            own = left[a : a + step]
            begin, there = self.start[one[own]], self.start[other[own]]
            size = self.end[one[own]] - begin
            flat = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            unlike = self.data[flat + np.repeat(begin, size)] != self.data[flat + np.repeat(there, size)]
            out[own[np.repeat(np.arange(len(own)), size)[unlike]]] = False
        return out

    def document(self) -> np.ndarray:
        """The document number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` consecutive values (len - width + 1 of them, or none)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(_BASE)
        out += hashes[k : k + n]
    return mix(out)
