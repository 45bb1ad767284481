"""Words, hashes and shingles of whole Arrow text columns, with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes with A-Z lower-cased, as the
contracts of the shingle and language-model operators have it. All hashes are 64
bits wide: a polynomial over random byte values, then a bijective mix, for words
of up to LONG bytes (in longer ones strings can be made that such a polynomial does
not tell apart), BLAKE2 for longer words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are worked on at once (they should fit in a processor's cache); longer only if a single word is.
SEGMENT = 1 << 17
#: Bytes up to which a word is hashed by the polynomial.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Polynomial:
    """Hashes of any stretch of a byte string from its prefix sums, modulo 2**64.

    A stretch's hash does not depend on where it stands: its sum is multiplied by
    the inverse of its first place's power (the base is odd, so there is one).
    """

    def __init__(self, seed: int, base: int = 0xD1342543DE82EF95):
        self.values, self.base = byte_values(seed), base
        self.inverse = pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << n.bit_length()
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums, one more than there are bytes."""
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        return sums

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), lengths included."""
        return mix((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_WORDS = Polynomial(7)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row that it is in, in order."""
    return words_and_ends(data, offsets)[:2]


def words_and_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and last three bytes of each word, in order."""
    hashes, places, ends = [], [], []
    begin, total = 0, len(data)
    bounds = offsets[1:-1]
    while begin < total:
        end = begin + SEGMENT
        if end < total:  # cut where no word is: after white space or between rows
            space = np.flatnonzero(SPACE[data[max(begin, end - 4096) : end]])
            row = bounds[np.searchsorted(bounds, end, "right") - 1] if len(bounds) else 0
            cut = max(begin, max(begin, end - 4096) + space[-1] + 1 if len(space) else 0, row)
            while cut <= begin and end < total:
                more = np.flatnonzero(SPACE[data[end : end + SEGMENT]])
                at = np.searchsorted(bounds, end, "left")
                stops = [end + more[0] + 1] if len(more) else []
                if at < len(bounds) and bounds[at] <= end + SEGMENT:
                    stops.append(bounds[at])
                cut, end = (min(stops), end) if stops else (begin, end + SEGMENT)
            end = cut if cut > begin else total
        end = min(end, total)
        part = LOWER[data[begin:end]]
        space = SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        inside = bounds[np.searchsorted(bounds, begin, "left") : np.searchsorted(bounds, end, "right")]
        edge[inside - begin] = True
        edge[0] = edge[-1] = True
        first = ~space
        last = first.copy()
        first[1:] &= space[:-1] | edge[1:-1]
        last[:-1] &= space[1:] | edge[1:-1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        found = _WORDS.stretch(_WORDS.prefix(part), start, stop)
        for k in np.flatnonzero(stop - start > LONG).tolist():
            found[k] = int.from_bytes(hashlib.blake2b(part[start[k] : stop[k]].tobytes(), digest_size=8).digest(), "little")
        hashes.append(found)
        last3 = part[stop - 1].astype(np.uint32)
        for k in (2, 3):
            last3 = last3 << np.uint32(8) | np.where(stop - k >= start, part[np.maximum(stop - k, 0)], 0)
        ends.append(last3)
        places.append(start + begin)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    place = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(offsets, place, "right") - 1, np.concatenate(ends)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each row's distinct word n-grams, hashed and ascending.

    A row with fewer words has its whole sequence as one; a row without words has none.
    """
    hashes, row = words(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    ends = np.cumsum(counts)
    step = np.uint64(0x9E3779B97F4A7C15)
    grams = np.zeros(len(hashes), np.uint64)
    length = max(0, len(hashes) - size + 1)
    for k in range(size):
        grams[:length] = grams[:length] * step + hashes[k : k + length]
    grams = mix(grams + np.uint64(size))
    found = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= size:
            found.append(np.unique(grams[end - count : end - size + 1]))
        elif count:
            value = np.zeros(1, np.uint64)
            for h in hashes[end - count : end]:
                value = value * step + h
            found.append(mix(value + np.uint64(count)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found
