"""Byte-level BPE by merge replay.

A block of the corpus is reduced to its distinct words. An inverted index holds,
for each merge rank, the positions of the token pairs with that rank; ranks are
replayed from the lowest, and a merge touches only the pairs on both sides of
each of its positions. Each word then stands for its ids wherever it occurs in
the block, so no text and no vocabulary is shuffled: every document is encoded
in the task that reads it, and a hot source or a group of copies costs no more
than its bytes.

A null or empty text has no tokens. Very long texts are cut into words like all
others; a very long word is one linked list of tokens. Repeated rows give repeated
results, an empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from talelake.llm.common import table

#: Words whose ids a Python worker keeps between blocks; beyond that they are replayed anew.
CACHED_WORDS = 400_000
#: Words that are replayed together: their lists should fit in a processor's cache.
REPLAYED = 8192

#: Texts of only these characters split the same way under Python's own engine, which is faster.
_PLAIN = re.compile("[^\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‘-”]")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes → rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def split_words(text: str, pattern: regex.Pattern, fast: bool) -> list[str]:
    """The matches of the pattern; fast: the pattern is the one that _FAST stands for."""
    if fast and not _PLAIN.search(text):
        return _FAST.findall(text)
    return [m.group() for m in pattern.finditer(text)]


class Merges:
    """A vocabulary as merges: ids are ranks, and a pair of ids has the rank of the token that both make."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.bytes = np.array([ranks[bytes((b,))] for b in range(256)], np.int64)
        self.byte_pairs = np.array([self.pairs.get(int(x) << 32 | int(y), -1) for x in self.bytes for y in self.bytes], np.int64)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word, all words merged together in rank order."""
        pairs, ranks = self.pairs, self.ranks
        found: list[bytes | None] = [None if (r := ranks.get(w)) is None else r.to_bytes(4, "little") for w in words]  # a known word is one token
        open_words = [k for k, f in enumerate(found) if f is None]
        data = np.frombuffer(b"".join(words[k] for k in open_words), np.uint8).astype(np.int64)
        if not len(data):
            return [f or b"" for f in found]
        ends = np.cumsum([len(words[k]) for k in open_words])
        last = np.zeros(len(data), bool)
        last[ends - 1] = True
        rank_of = np.where(last[:-1], -1, self.byte_pairs[data[:-1] * 256 + data[1:]])
        # the inverted index: rank → places of its pairs, ascending
        at = np.flatnonzero(rank_of >= 0)
        at = at[np.argsort(rank_of[at], kind="stable")]
        kinds, first = np.unique(rank_of[at], return_index=True)
        where = {r: p.tolist() for r, p in zip(kinds.tolist(), np.split(at, first[1:]), strict=False)}
        place = np.arange(len(data))
        after = np.where(last, -1, place + 1).tolist()
        before = np.where(np.concatenate(([True], last[:-1])), -1, place - 1).tolist()
        token = self.bytes[data].tolist()
        queue = list(where)
        heapq.heapify(queue)
        get = pairs.get
        while queue:
            rank = heapq.heappop(queue)
            places = where.pop(rank)
            places.sort()
            for k, i in enumerate(places):
                j = after[i]
                if j < 0 or token[i] < 0 or get(token[i] << 32 | token[j]) != rank:
                    continue  # a neighbour has changed since
                token[i], token[j] = rank, -1
                after[i] = right = after[j]
                lower = False
                if right >= 0:
                    before[right] = i
                    if (r := get(rank << 32 | token[right])) is not None:
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heapq.heappush(queue, r)
                            lower = r < rank
                left = before[i]
                if left >= 0 and (r := get(token[left] << 32 | rank)) is not None:
                    if r in where:
                        where[r].append(left)
                    else:
                        where[r] = [left]
                        heapq.heappush(queue, r)
                        lower |= r < rank
                if lower:  # a pair of lower rank arose: it comes before the other places
                    if rest := places[k + 1 :]:
                        if rank in where:
                            where[rank].extend(rest)
                        else:
                            where[rank] = rest
                            heapq.heappush(queue, rank)
                    break
        ids = np.array(token, np.int64)
        alive = ids >= 0
        cuts = (4 * np.cumsum(alive)[ends - 1]).tolist()
        packed, low = ids[alive].astype("<u4").tobytes(), 0
        for k, high in zip(open_words, cuts, strict=True):
            found[k], low = packed[low:high], high
        return found


#: Of this Python worker: the ranks, the bytes of each id and the words' packed ids, by vocabulary file.
_loaded: dict[str, tuple[Merges, list[bytes], dict[str, bytes]]] = {}


class Codec:
    """Encodes and decodes texts block by block."""

    def __init__(self, path: str, pattern: str, fast: bool):
        if path not in _loaded:
            ranks = load_ranks(path)
            tokens = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                tokens[rank] = token
            _loaded[path] = Merges(ranks), tokens, {}
        self.merges, self.tokens, self.known = _loaded[path]
        self.pattern, self.fast = regex.compile(pattern), fast

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [split_words(t, self.pattern, self.fast) for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = list({w for words in split for w in words})
        for low in range(0, len(new), REPLAYED):
            part = new[low : low + REPLAYED]
            self.known.update(zip(part, self.merges.replay([w.encode() for w in part]), strict=True))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def blocks(batches: Iterable[pa.RecordBatch], chars: int) -> Iterator[tuple[list[int | None], list[str]]]:
    """ids and texts, about so many characters at a time; a longer text is a block of its own."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def encode_documents(
    docs: DataFrame, path: str, pattern: str, fast: bool, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 2_000_000
) -> DataFrame:
    """id_col, ids (array of int) and decoded (binary) of each document.

    path: a rank file that every executor has. pattern: what splits texts into
    words. fast: the pattern is public_tokenizers.PATTERN.
    """
    return _encoded(docs, path, pattern, fast, id_col, text_col, block_chars, False)


def encode_digests(
    docs: DataFrame, path: str, pattern: str, fast: bool, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 2_000_000
) -> DataFrame:
    """id_col, n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    return _encoded(docs, path, pattern, fast, id_col, text_col, block_chars, True)


def _encoded(docs, path, pattern, fast, id_col, text_col, block_chars, digests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern, fast)
        for ids, texts in blocks(batches, block_chars):
            packed = codec.encode(texts)
            if digests:
                columns = [
                    pa.array(ids, pa.int64()),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(codec.decode(p)).hexdigest() for p in packed]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                columns = [
                    pa.array(ids, pa.int64()),
                    pa.array([list(memoryview(p).cast("I")) for p in packed], pa.list_(pa.int32())),
                    pa.array([codec.decode(p) for p in packed], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "decoded"])

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, f"`{id_col}` long, {schema}")


def op9_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encodes and decodes every document with the public 50k byte-level vocabulary."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, True)
