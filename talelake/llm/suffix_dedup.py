"""Removal of byte strings that occur more than once in a corpus.

A byte goes when a string of LENGTH bytes that covers it also starts anywhere
else, in the same document too. Three ideas make that a few shuffles:

* Anchors. In every window of LENGTH bytes the grams of GRAM bytes with the
  smallest hash are anchors. Which they are depends on the window's bytes alone,
  so two equal windows have an anchor at the same place. An anchor's context is
  what windows around it can reach: LENGTH - GRAM bytes to the left, LENGTH to the
  right, within its document.
* Equal contexts. A first pass counts the grams of anchors. A gram that occurs once
  repeats nothing; that is most of the corpus, and its bytes never move. Anchors of
  the other grams are counted by context, by 128 bits of BLAKE2. A context that
  occurs twice is repeated as a whole.
* Suffix sorts. Grams with several contexts have one context of each kind sorted
  twice, by what follows and by what precedes the anchor. Suffixes are compared by
  prefix polynomial hashes modulo the prime 2**61 - 1 with a random base: a binary
  search over their lengths finds the common extension. Windows at an anchor all
  cover it, so what is removed around it is one stretch, from the longest left to the
  longest right extension among contexts whose extensions add up to LENGTH. They are
  found by walking from an anchor's place in either order, as far as the extensions
  can still add up. Matches are compared byte by byte in the end.

* Crowds. A gram with more than CROWD different contexts (a line of half the corpus)
  is split: windows with the anchor at nearly the same place share a long core of
  bytes, and are grouped by that instead, in rounds, until groups are small or
  their contexts are equal. So no task sorts more than CROWD contexts of one key.

So bytes go only after a comparison of bytes, or for an equal 128-bit BLAKE2 digest of
whole contexts, for which no two different strings are known. The hashes of grams only
choose and group anchors.

Grams and contexts are counted by batch and by task before a shuffle, and no window
or list runs over a gram; joins by gram or context may be uneven, which adaptive
execution splits. A document is named by its id and the hash of its text; rows that
share both have equal spans.

Texts are UTF-8 bytes of any length (long ones are hashed in pieces), null is empty; a
null id is a value like any other. Matches never cross documents. Rows that share
doc_id and text are two places, so that both lose their bytes. Extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talelake.llm import textblocks as tb
from talelake.llm.common import Scratch, stored, table

#: Bytes of a repeated string, of an anchor's gram, and of a piece that is hashed at once, small enough for a processor's caches.
LENGTH, GRAM, PIECE = 400, 64, 1 << 15
#: Bytes of contexts that are sorted together; the contexts of one gram always are.
SORTED = 1 << 21

#: Bytes whose prefix hashes are worked out at once.
STEP = 1 << 14

#: Different contexts of one key that are sorted in one task, and parts that a larger crowd is split into.
CROWD, SPLIT = 256, 5

_PACK, _UNPACK = zstandard.ZstdCompressor(level=1, write_content_size=True), zstandard.ZstdDecompressor()
_FACTORS = tb.mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)
_PRIME, _BELOW, _LOW31, _LOW30 = np.uint64((1 << 61) - 1), np.uint64((1 << 64) - (1 << 61) + 1), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (8, 16, 32 or 64) from each place on.

    The eight bytes at each place are mixed to 64 bits, and those of a gram added with
    random factors.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    word = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        word[k::8] = padded[k : k + (n - k + 7) // 8 * 8].view("<u8")
    sums, width = tb.mix(word), 8
    while width < gram:
        sums = sums[: len(sums) - width] + _FACTORS[width.bit_length()] * sums[width:]
        width *= 2
    return tb.mix(sums[: n - gram + 1])


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.minimum(x, x - _PRIME)  # below the prime, x - prime wraps around and is larger


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo the prime 2**61 - 1, of factors below it, in 64-bit integers."""
    shift = np.uint64(31)
    a1, a0, b1, b0 = a >> shift, a & _LOW31, b >> shift, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduce(a1 * b1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & _LOW30) << shift) + a0 * b0)


class Polynomial:
    """Hashes of stretches of bytes modulo 2**61 - 1, with a random base."""

    def __init__(self):
        # results do not depend on the draw
        self.base = random.SystemRandom().randrange(1 << 32, int(_PRIME))
        self.powers = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        """Powers up to n."""
        while len(self.powers) < n:
            step = np.uint64(pow(self.base, len(self.powers), int(_PRIME)))
            self.powers = np.concatenate((self.powers, times(self.powers, step)))

    def prefix(self, data: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Prefix sums of the bytes (and one) times the powers of their places ``local``, one more than there are bytes.

        Worked out a STEP at a time, which stays in the processor's caches. Both halves of
        the powers are added up without a reduction, which up to 2**23 bytes allow.
        """
        sums = np.zeros(len(data) + 1, np.uint64)
        for k in range(0, len(data), STEP):
            value, power = data[k : k + STEP].astype(np.uint64) + np.uint64(1), self.powers[local[k : k + STEP]]
            high = _reduce(np.cumsum(value * (power >> np.uint64(31))))
            low = np.cumsum(value * (power & _LOW31))
            part = _reduce((high >> np.uint64(30)) + ((high & _LOW30) << np.uint64(31)) + low)
            sums[k + 1 : k + 1 + len(part)] = _reduce(part + sums[k])
        return sums


_SUFFIXES = Polynomial()


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each ``width`` values in a row."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    pick, fill = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, 0)
    padded = np.concatenate((values, np.full(-len(values) % width, fill, np.uint64))).reshape(-1, width)
    ahead = pick.accumulate(padded, axis=1).ravel()
    back = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, low: int = 0, high: int | None = None, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Anchors of documents that lie one after the other, from windows that start in [low, high).

    Returns row, place (in data), gram, left and right (the context's reach) of each.
    """
    n = len(data)
    if n < length:
        return {k: np.zeros(0, np.uint64 if k == "gram" else np.int64) for k in ("row", "place", "gram", "left", "right")}
    sizes = np.diff(offsets)
    end = np.repeat(offsets[1:], sizes)
    grams = gram_hashes(data, gram)
    at = np.arange(n - gram + 1)
    grams[at + gram > end[: len(at)]] = np.iinfo(np.uint64).max  # reaches into the next document
    width = length - gram + 1
    least = sliding(grams, width, True)
    start = np.arange(len(least))
    least[(start + length > end[: len(least)]) | (start < low) | (start >= (n if high is None else high))] = 0
    # a gram is an anchor if it is the least of some whole window that it is in
    pad = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate((pad, least, pad)), width, False)
    place = np.flatnonzero(most == grams)
    row = np.searchsorted(offsets, place, "right") - 1
    left = np.minimum(length - gram, place - offsets[row])
    right = np.minimum(length, offsets[row + 1] - place)
    return {"row": row, "place": place, "gram": grams[place], "left": left, "right": right}


def batch_anchors(column: pa.Array, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Anchors of a text column; place counts within each document."""
    data, offsets = tb.utf8(column)
    found = []
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        begin, end = int(offsets[row]), int(offsets[stop])
        if end - begin <= PIECE:
            part = anchors(data[begin:end], offsets[row : stop + 1] - begin, length=length, gram=gram)
            part["row"] = part["row"] + row
            part["place"] = part["place"] - (offsets[part["row"]] - begin)
            found.append(part)
        else:  # one long document, in pieces that overlap by what windows and contexts reach
            pieces = []
            for low in range(begin, end, PIECE):
                first, last = max(begin, low - length), min(end, low + PIECE + 2 * length)
                # a piece's ends cut contexts off only beyond the reach of the windows that start in it
                part = anchors(data[first:last], np.array([0, last - first]), low - first, low - first + PIECE, length, gram)
                part["place"] = part["place"] + (first - begin)
                pieces.append(part)
            whole = {k: np.concatenate([p[k] for p in pieces]) for k in pieces[0]}
            _, once = np.unique(whole["place"], return_index=True)
            whole = {k: v[once] for k, v in whole.items()}
            whole["row"] = np.full(len(once), row)
            found.append(whole)
        row = stop
    return {k: np.concatenate([p[k] for p in found]) for k in found[0]} if found else anchors(data, offsets)


def context_digests(column: pa.Array, found: dict[str, np.ndarray]) -> np.ndarray:
    """128 bits of BLAKE2 of each anchor's context and its reach, as two columns."""
    data, offsets = tb.utf8(column)
    raw, at = memoryview(np.ascontiguousarray(data)), offsets[found["row"]] + found["place"]
    spans = zip((at - found["left"]).tolist(), (at + found["right"]).tolist(), found["left"].tolist(), strict=True)
    names = [b"%d" % k for k in range(LENGTH + 1)]
    digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16, person=names[left]).digest() for a, b, left in spans)
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


class Suffixes:
    """Contexts side by side, compared by the prefix hashes of one polynomial."""

    def __init__(self, contexts: list[bytes], left: np.ndarray, gram: np.ndarray):
        lengths = np.array([len(c) for c in contexts], np.int64)
        self.start = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        self.raw = b"".join(contexts)
        self.data = np.frombuffer(self.raw, np.uint8)
        # powers count from a place as far from every anchor, so that stretches at equal distances are compared without
        # a product, and their table stays as short as a context
        shift = int(left.max(initial=0)) - left.astype(np.int64)
        _SUFFIXES.grow(int((lengths + shift).max(initial=0)) + 1)
        self.sums = _SUFFIXES.prefix(self.data, np.arange(len(self.data)) - np.repeat(self.start - shift, lengths))
        self.left, self.right, self.gram = left.astype(np.int64), lengths - left, gram
        self.place = self.start + self.left

    def _same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, back: bool) -> np.ndarray:
        p, q = (self.place[i] - n, self.place[j] - n) if back else (self.place[i], self.place[j])
        rest = self.sums[p + n] - self.sums[p] - self.sums[q + n] + self.sums[q]
        return (rest == 0) | (rest == _PRIME) | (rest == _BELOW)  # the sums are below the prime, so is their difference's amount

    def common(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """Length of the common extension of pairs of contexts, by binary search over hashes."""
        reach = self.left if back else self.right
        low, high = np.zeros(len(i), np.int64), np.minimum(reach[i], reach[j])
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self._same(i, j, middle, back)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """Whether context i sorts before j: by gram, then by what follows (or precedes) the anchor, then by number."""
        out = self.gram[i] < self.gram[j]
        same = np.flatnonzero(self.gram[i] == self.gram[j])
        if len(same):
            i, j = i[same], j[same]
            n = self.common(i, j, back)
            reach = self.left if back else self.right
            a, b = (self.place[i] - n - 1, self.place[j] - n - 1) if back else (self.place[i] + n, self.place[j] + n)
            end_i, end_j = n == reach[i], n == reach[j]
            x, y = self.data[np.where(end_i, 0, a)].astype(np.int64), self.data[np.where(end_j, 0, b)].astype(np.int64)
            x[end_i], y[end_j] = -1, -1
            out[same] = (x < y) | ((x == y) & (i < j))
        return out

    def sort(self, back: bool) -> np.ndarray:
        """Bottom-up mergesort of each gram's contexts, all pairs of runs of a level at once."""
        n = len(self.place)
        order = np.argsort(self.gram, kind="stable")
        if not n:
            return order
        edge = np.flatnonzero(np.concatenate(([True], self.gram[order][1:] != self.gram[order][:-1])))
        sizes = np.diff(np.append(edge, n))
        begin, size = np.repeat(edge, sizes), np.repeat(sizes, sizes)
        at = np.arange(n) - begin
        width = 1
        while width < sizes.max():
            run = at // width
            low = np.minimum((run ^ 1) * width, size)
            first = low.copy()
            high = np.minimum(low + width, size)
            k = np.flatnonzero(low < high)
            while len(k):
                middle = (low[k] + high[k]) >> 1
                lower = self.before(order[begin[k] + middle], order[k], back)
                low[k[lower]] = middle[lower] + 1
                high[k[~lower]] = middle[~lower]
                k = k[low[k] < high[k]]
            merged = np.empty_like(order)
            merged[begin + (run & ~1) * width + (at - run * width) + (low - first)] = order
            order, width = merged, width * 2
        return order

    def _equal(self, i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pairs of contexts hold the same bytes around their anchors."""
        p, q, raw = self.place[i], self.place[j], self.raw
        stretches = zip((p - left).tolist(), (p + right).tolist(), (q - left).tolist(), (q + right).tolist(), strict=True)
        return np.array([raw[a:b] == raw[c:d] for a, b, c, d in stretches], bool)

    def extents(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Longest left and right extension of each context among those that add up to ``length``; zeros if none do."""
        n = len(self.place)
        best = {}
        orders = {back: self.sort(back) for back in (True, False)}
        ranks, adjacent = {}, {}
        for back, order in orders.items():
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            near = np.zeros(n + 1, np.int64)  # near[k]: common extension of places k - 1 and k
            if n > 1:
                same = np.flatnonzero(self.gram[order[:-1]] == self.gram[order[1:]])
                near[same + 1] = self.common(order[same], order[same + 1], back)
            ranks[back], adjacent[back] = rank, near
        most = {back: np.maximum(adjacent[back][ranks[back]], adjacent[back][ranks[back] + 1]) for back in orders}
        for back, order in orders.items():
            found = np.zeros(n, np.int64)
            for step in (-1, 1):
                i = np.arange(n)
                k = ranks[back].copy()
                reach = np.full(n, np.iinfo(np.int64).max)
                while len(i):
                    reach = np.minimum(reach, adjacent[back][k if step < 0 else k + 1])
                    k = k + step
                    go = (reach + most[not back][i] >= length) & (reach > found[i])
                    i, k, reach = i[go], k[go], reach[go]
                    if not len(i):
                        break
                    j = order[k]
                    other = self.common(i, j, not back)
                    fits = np.flatnonzero(reach + other >= length)
                    sure = self._equal(i[fits], j[fits], *((reach[fits], other[fits]) if back else (other[fits], reach[fits])))
                    found[i[fits[sure]]] = reach[fits[sure]]
                    rest = np.ones(len(i), bool)
                    rest[fits[sure]] = False
                    i, k, reach = i[rest], k[rest], reach[rest]
            best[back] = found
        return best[True], best[False]


def pack(text: str | None) -> bytes:
    """A text's bytes on their way through a shuffle, half as large as Spark makes them."""
    return _PACK.compress((text or "").encode())


def unpack(data: bytes) -> bytes:
    return _UNPACK.decompress(data)


def _gram_counts(docs: DataFrame) -> DataFrame:
    """gram, n: how often each is an anchor, by batch. docs: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, n = np.unique(batch_anchors(batch.column(0))["gram"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int32))], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n int")


#: An anchor: its gram, its context's digest, its document, and in one number its place there and its context's reach to the left and right.
_ANCHOR = ["gram", "c1", "c2", "k1", "k2", "at"]
_PLACE, _SIDE = 1 << 20, 1000


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """The anchors of rows k1, k2, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch_anchors(batch.column(2))
            digests = context_digests(batch.column(2), found)
            row = pa.array(found["row"])
            at = found["place"].astype(np.int64) * _PLACE + found["left"] * _SIDE + found["right"]
            columns = [pa.array(x) for x in (found["gram"].view(np.int64), digests[:, 0].copy(), digests[:, 1].copy())]
            columns += [batch.column(0).take(row), batch.column(1).take(row), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, _ANCHOR)

    return docs.select("k1", "k2", "text").mapInArrow(run, "gram long, c1 long, c2 long, k1 long, k2 long, at long")


#: Columns of contexts on their way: grouped by ``key``, equal if ``th`` is equal; ``low`` and ``high`` bound
#: the place of the anchor in the windows that count; gram, c1 and c2 name the class, c1 is null if
#: the class is known to be repeated as a whole and only others are compared with it (``weight`` 2).
_PART = "key long, th binary, left int, right int, low int, high int, bytes binary, gram long, c1 long, c2 long, weight long"
_PART_TYPES = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_PART_NAMES = [c.split()[0] for c in _PART.split(", ")]


def _digest(data: bytes, *numbers: int, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size, person=("%d,%d" % numbers).encode()).digest()


def split_context(row: tuple) -> Iterator[tuple]:
    """A context as up to SPLIT shorter ones, for the parts of its range of places.

    Windows with the anchor at places low to high all hold the same core of bytes,
    so equal windows have equal cores, which are the new keys.
    """
    _, _, left, right, low, high, data, *rest = row
    width = -(-(high - low + 1) // SPLIT)
    for a in range(low, high + 1, width):
        b = min(a + width - 1, high)
        if left >= a and right >= LENGTH - b:  # else no window lies within the document
            new_left, new_right = min(left, b), min(right, LENGTH - a)
            part = data[left - new_left : left + new_right]
            core = int.from_bytes(_digest(data[left - a : left + LENGTH - b], a, b, size=8), "little", signed=True)
            yield core, _digest(part, new_left, a), new_left, new_right, a, b, part, *rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_PART_TYPES)], _PART_NAMES)


#: Lists of a document's contexts; what: 1 if the context occurs once, and 2 more if its gram is crowded.
_WANTED = ["gram", "c1", "c2", "at", "what"]


def _contexts(held: DataFrame, crowded: bool) -> DataFrame:
    """The contexts of documents (z, and of each context gram, c1, c2, at and what) of grams that are crowded, split, or of those that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                rows: list[tuple] = []
                for z, *lists in zip(*(c.slice(low, 256) for c in batch.columns), strict=True):
                    whole = None
                    for gram, c1, c2, at, what in zip(*(x.as_py() for x in lists), strict=True):
                        if (what >= 2) != crowded:
                            continue
                        whole = unpack(z.as_py()) if whole is None else whole
                        place, (left, right) = at // _PLACE, divmod(at % _PLACE, _SIDE)
                        single = what % 2 == 1
                        row = (gram, b"", left, right, 0, LENGTH - GRAM, whole[place - left : place + right], gram, c1 if single else None, c2, 1 if single else 2)
                        rows += split_context(row) if crowded else [row]
                yield _batch(rows)

    return held.select("z", *_WANTED).mapInArrow(run, _PART)


def _split(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 4096):
                yield _batch([new for row in zip(*(c.to_pylist() for c in batch.slice(low, 4096).columns), strict=True) for new in split_context(row)])

    return parts.select(*_PART_NAMES).mapInArrow(run, _PART)


def _partly_repeated(parts: DataFrame) -> DataFrame:
    """gram, c1, c2, left, right: what is repeated around the anchors of each context, by contexts of the same key."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        key = np.array([r[0] for r in rows], np.int64)
        left, right = Suffixes([r[2] for r in rows], np.array([r[1] for r in rows], np.int64), key).extents(LENGTH)
        hit = [k for k in np.flatnonzero(left + right).tolist() if rows[k][4] is not None]
        columns = [*([rows[k][c] for k in hit] for c in (3, 4, 5)), left[hit], right[hit]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["gram", "c1", "c2", "left", "right"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for low in range(0, len(batch), 4096):
                for row in zip(*(c.to_pylist() for c in batch.slice(low, 4096).columns), strict=True):
                    if size >= SORTED and row[0] != held[-1][0]:
                        yield solve(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[2])
        if held:
            yield solve(held)

    dealt = parts.select("key", "left", "bytes", "gram", "c1", "c2").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "gram long, c1 long, c2 long, left long, right long")


def _with_kinds(each: DataFrame, key: str, stored: Callable[[DataFrame], DataFrame], how: str = "inner") -> DataFrame:
    """Rows with ``kinds``, the number of rows of their key, where it is above 1.

    The counts are written: a join splits a key of very many rows only if no side of it
    is still to be aggregated.
    """
    kinds = stored(each.groupBy(key).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    return each.join(kinds, key, how)


def _crowds(parts: DataFrame, stored: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """What ``_partly_repeated`` finds, for contexts of crowded grams that were split once.

    Each round counts equal contexts, which are repeated as they are, sorts what has
    at most CROWD different contexts under a key, and splits the rest. Once a range
    is a single place, a context is its core and all under a key are equal, so the
    rounds end; no group is ever gathered unless it is small.
    """
    found, key = [], ["key", "th"]
    parts = stored(parts)
    while parts.limit(1).count():
        firsts = [F.first(c).alias(c) for c in ("left", "right", "low", "high", "bytes", "gram", "c2")]
        each = stored(parts.groupBy(*key).agg(F.sum("weight").alias("n"), F.min("c1").alias("c1"), *firsts))
        again = each.where(f"n > 1 and left + right >= {LENGTH}").select(*key)
        found.append(parts.where("c1 is not null").join(again, key).select("gram", "c1", "c2", F.col("left").cast("long"), F.col("right").cast("long")))
        counted = stored(_with_kinds(each, "key", stored).withColumn("c1", F.when(F.col("n") == 1, F.col("c1"))).withColumn("weight", F.least("n", F.lit(2))))
        found.append(_partly_repeated(counted.where(f"kinds <= {CROWD}")))
        parts = stored(_split(counted.where(f"kinds > {CROWD}")))
    return found


def repeated_spans(rows: DataFrame, small: DataFrame) -> DataFrame:
    """k1, k2, spans (array of struct<a, b>, may overlap) of the rows (k1, k2, text) that have any. small: the rows, ``packed``."""
    context, doc = ["c1", "c2"], ["k1", "k2"]
    with Scratch() as until_spans:
        with Scratch() as until_anchors:
            # written, so that a gram with very many anchors is split by the join
            again = until_anchors.stored(_gram_counts(rows).groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"))
            every = until_spans.stored(_anchor_rows(rows).join(again, "gram", "left_semi"))
        counted = every.groupBy(*context).agg(F.count(F.lit(1)).alias("n"), F.first("gram").alias("gram"), F.min(F.struct(*doc, "at")).alias("one"))
        classes = until_spans.stored(_with_kinds(counted, "gram", until_spans.stored, "left").select("gram", *context, "n", "kinds", "one.*").where("n > 1 or kinds > 1"))
        several = classes.where("kinds > 1")
        what = F.when(F.col("n") == 1, 1).otherwise(0) + F.when(F.col("kinds") > CROWD, 2).otherwise(0)
        fields = F.struct("gram", *context, "at", what.cast("byte").alias("what"))
        wanted = several.groupBy(*doc).agg(F.collect_list(fields).alias("w")).select(*doc, *(F.col(f"w.{c}") for c in _WANTED))
        with Scratch() as until_partly:
            held = until_partly.stored(small.join(wanted, doc).dropDuplicates(doc).select("z", *_WANTED))
            partly = _partly_repeated(_contexts(held, False))
            for more in _crowds(_contexts(held, True), until_partly.stored):
                partly = partly.unionByName(more)
            partly = until_spans.stored(partly.drop("gram"))
        place, left, right = F.floor(F.col("at") / _PLACE), F.floor(F.col("at") % _PLACE / _SIDE), F.col("at") % _PLACE % _SIDE
        single = several.where("n = 1").select(*context, *doc, place.alias("place")).join(partly, context)
        single = single.select(*doc, (F.col("place") - F.col("left")).alias("a"), (F.col("place") + F.col("right")).alias("b"))
        whole = every.join(classes.where("n > 1").select(*context), context, "left_semi").where(left + right >= LENGTH)
        spans = whole.select(*doc, (place - left).alias("a"), (place + right).alias("b")).unionByName(single)
        return stored(spans.groupBy(*doc).agg(F.collect_list(F.struct("a", "b")).alias("spans")))


def packed(rows: DataFrame) -> DataFrame:
    """k1, k2, id and z, the packed text, of rows k1, k2, id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = pa.array([pack(t.as_py()) for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], z], ["k1", "k2", "id", "z"])

    return rows.select("k1", "k2", "id", "text").mapInArrow(run, "k1 long, k2 long, id long, z binary")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and the kept bytes (``kept``, or their SHA-256 ``kept_sha256``) with the removed runs (``spans``) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # a null id stands with 0: only equal texts share a key for it, and those have equal spans
    rows = rows.select(F.coalesce("id", F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2"), "id", "text")
    small = packed(rows)
    # equal rows have equal keys and lose the same bytes, but each is a place of its own
    spans = repeated_spans(rows, small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                out: list[tuple] = []
                ids, texts, found = (batch.column(k).slice(low, 256).to_pylist() for k in range(3))
                for doc, z, own in zip(ids, texts, found, strict=True):
                    whole = unpack(z)
                    runs = merged([(s["a"], s["b"]) for s in own or ()])
                    ends = [0, *(x for r in runs for x in r), len(whole)]
                    kept = b"".join(whole[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2))
                    row = (doc, len(whole), len(whole) - len(kept), len(runs))
                    out.append((*row, hashlib.sha256(kept).hexdigest()) if digests else (*row, kept, [{"a": a, "b": b} for a, b in runs]))
                kinds = [pa.int64()] * 4 + ([pa.string()] if digests else [pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))])
                names = ["id", "n_bytes", "n_removed", "n_spans", *(["kept_sha256"] if digests else ["kept", "spans"])]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    last = "kept_sha256 string" if digests else "kept binary, spans array<struct<a: long, b: long>>"
    done = small.join(spans, ["k1", "k2"], "left").select("id", "z", "spans").mapInArrow(run, f"id long, n_bytes long, n_removed long, n_spans long, {last}")
    return done.withColumnRenamed("id", id_col)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur twice."""
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)
