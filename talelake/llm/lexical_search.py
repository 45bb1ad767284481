"""Ranked lexical search by MaxScore over the shards of an inverted index.

The index is a table of shards, written once. A shard holds some consecutive documents of
a task's rows: their ids and lengths, its terms in order, and each term's postings (which
of its documents hold the term, how often). A shard is bounded by documents and terms, so
a task holds one shard and no more; a longer document is a shard of its own.

Statistics over all documents come from the index: how many have terms, all terms with
repeats, and in how many documents each term of the items stands. Each shard then meets
each block of items once, by a join on listed pairs, and answers it by MaxScore:

* Every posting list has an upper bound: its weight, times the repeats in the item, times
  the largest factor of any of its documents in this shard.
* Lists are taken from the largest bound down. They are essential, and all their documents
  are scored, until the bounds of the remaining lists add up to less than the tenth best
  score so far: a document that stands in none but these can no longer qualify.
* The remaining, non-essential lists are only probed, for documents whose score so far
  plus what remains still reaches the tenth best; the others are given up on the way.

A shard returns its first ten documents for each item, and these are merged by item. All
of it is integers; nothing is estimated or left out. A group of copies, a hot source or a
word of all documents is spread over shards like any other rows.

Documents without terms have no score. Items that share item_id and text are one; an item
without terms that occur has no rows. Documents that share an id are ranked one by one; a
null id comes last among equal scores. Very long texts are read whole, an empty table
gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talelake.llm.common import stored, table

#: Documents and terms with repeats of a shard; terms of the items of a block.
SHARD, SHARD_TERMS, BLOCK_TERMS = 4096, 1 << 20, 1 << 16
#: Compressed bytes at which a row group of shards ends: a shard has some megabytes, and tasks hold whole row groups.
GROUP_BYTES = 1 << 22
#: Documents that an item gets.
FIRST = 10
#: Different terms of items, and their bytes, up to which they are broadcast; more are joined by term.
LISTED, LISTED_BYTES = 1 << 18, 1 << 24

_SEPARATORS = bytes((*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))
#: Lower-cases A-Z and makes a space of every byte that is no part of a term (all of a non-ASCII character's are).
_TERMS = bytes(32 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_SHARD_SCHEMA = "ids array<long>, lengths array<long>, terms array<string>, sizes array<int>, docs binary, counts binary"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    # split() without arguments would split at other white space, too, but none is left
    return text.translate(_TERMS).split()


class ShardBuilder:
    """Gathers documents until they make a shard."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.numbers: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.total = 0

    def add(self, doc_id: int | None, found: list[bytes]) -> None:
        tally = Counter(found)
        numbers = self.numbers
        self.terms.append(np.fromiter((numbers.setdefault(t, len(numbers)) for t in tally), np.int64, len(tally)))
        self.counts.append(np.fromiter(tally.values(), np.int32, len(tally)))
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.total += len(found)

    def full(self, more: int) -> bool:
        return bool(self.ids) and (len(self.ids) >= SHARD or self.total + more > SHARD_TERMS)

    def shard(self) -> dict:
        names = sorted(self.numbers)
        place = np.empty(len(names), np.int64)
        place[[self.numbers[t] for t in names]] = np.arange(len(names))
        terms = place[np.concatenate(self.terms)] if self.terms else np.zeros(0, np.int64)
        docs = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(t) for t in self.terms])
        order = np.argsort(terms, kind="stable")  # by term, then document
        return {
            "ids": self.ids, "lengths": self.lengths, "terms": [t.decode("utf-8", "replace") for t in names], "sizes": np.bincount(terms, minlength=len(names)).tolist(),
            "docs": docs[order].tobytes(), "counts": np.concatenate(self.counts or [np.zeros(0, np.int32)])[order].tobytes(),
        }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of the documents that have terms, written as a table."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("ids", longs), ("lengths", longs), ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("docs", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = ShardBuilder()
        for batch in batches:
            for k, doc_id in enumerate(batch.column("id").to_pylist()):
                if not (found := terms_of(batch.column("text")[k].as_py())):
                    continue
                if shard.full(len(found)):
                    yield pa.RecordBatch.from_pylist([shard.shard()], schema)
                    shard = ShardBuilder()
                shard.add(doc_id, found)
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.shard()], schema)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return stored(texts.mapInArrow(run, _SHARD_SCHEMA), GROUP_BYTES)


class Shard:
    """One shard, asked for one item after the other."""

    def __init__(self, ids: list[int | None], lengths: np.ndarray, terms: list[str], sizes: np.ndarray, docs: np.ndarray, counts: np.ndarray, n: int, total: int):
        self.null = np.array([i is None for i in ids])
        self.ids = np.array([i or 0 for i in ids], np.int64)
        self.length_part = 100 - 75 + 75 * lengths * n // total
        self.places = dict(zip(terms, range(len(terms)), strict=True))
        self.ends = np.cumsum(sizes)
        self.docs, self.counts = docs, counts.astype(np.int64)
        self.lists: dict[str, tuple[np.ndarray, np.ndarray, int] | None] = {}
        self.probed = self.scored = 0

    def postings(self, term: str) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Documents, their factors and the largest of these."""
        if term not in self.lists:
            if (k := self.places.get(term)) is None:
                self.lists[term] = None
            else:
                part = slice(self.ends[k - 1] if k else 0, self.ends[k])
                docs, tf = self.docs[part], self.counts[part]
                factors = (1_000_000_000 * tf) // (1000 * tf + 8 * self.length_part[docs])
                self.lists[term] = docs, factors, int(factors.max())
        return self.lists[term]

    def search(self, weights: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the first ten documents. weights: terms with their weight times their repeats."""
        lists = [(w * p[2], w, p) for t, w in weights if w > 0 and (p := self.postings(t))]
        lists.sort(key=lambda x: -x[0])
        rest = np.cumsum([x[0] for x in lists][::-1])[::-1].tolist() + [0]
        scores = np.zeros(len(self.ids), np.int64)
        least, at = 0, 0
        while at < len(lists) and rest[at] >= max(least, 1):  # essential: one with this bound alone may qualify
            _, w, (docs, factors, _) = lists[at]
            scores[docs] += w * factors
            self.scored += len(docs)
            at += 1
            if len(scores) > FIRST:
                least = int(np.partition(scores, len(scores) - FIRST)[len(scores) - FIRST])
        found = np.flatnonzero(scores)
        for k in range(at, len(lists)):  # non-essential: only for those that can still qualify
            found = found[scores[found] + rest[k] >= least]
            _, w, (docs, factors, _) = lists[k]
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            held = docs[place] == found
            self.probed += len(found)
            scores[found[held]] += w * factors[place[held]]
            if len(found) > FIRST:
                least = max(least, int(np.partition(scores[found], len(found) - FIRST)[len(found) - FIRST]))
        order = np.lexsort((self.ids[found], self.null[found], -scores[found]))[:FIRST]
        return found[order], scores[found[order]]


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, item (a key of id and text), term, repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (i, key) in enumerate(zip(batch.column("id").to_pylist(), batch.column("item").to_pylist(), strict=True)):
                tally = Counter(terms_of(batch.column("text")[k].as_py()))
                n = len(tally)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int64()), pa.array([key] * n, pa.string()), pa.array([t.decode("utf-8", "replace") for t in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], ["item_id", "item", "term", "repeats"]
                )

    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.sha2(text, 256))
    rows = items.select(F.col(id_col).cast("long").alias("id"), key.alias("item"), text.cast("binary").alias("text")).dropDuplicates(["item"])
    return rows.mapInArrow(run, "item_id long, item string, term string, repeats long")


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's first documents."""
    asked = stored(item_terms(items, id_col, text_col))
    terms = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    n, total = index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(terms), F.lit(0))).first()
    wanted = asked.select("term").distinct()
    many, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    wanted = F.broadcast(wanted) if many <= LISTED and size <= LISTED_BYTES else wanted
    held = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.sizes").alias("size"))
    df = held.join(wanted, "term").groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n).cast("double") + 2) / (2 * F.col("df") + 1)))
    weighed = stored(asked.join(df, "term").select("item_id", "item", "term", (weight * F.col("repeats")).alias("weight")))
    # blocks of items: so many that each has some BLOCK_TERMS terms
    blocks = max(1, -(-weighed.count() // BLOCK_TERMS))
    parts = weighed.groupBy("item_id", "item").agg(F.collect_list(F.struct("term", "weight")).alias("weights"))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    listed = stored(parts.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item_id", "item", "weights")).alias("items")), GROUP_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                get = lambda c: batch.column(c)[k]  # noqa: B023, E731
                arrays = [get(c).values.to_numpy(zero_copy_only=False) for c in ("lengths", "sizes")] + [np.frombuffer(get(c).as_buffer(), np.int32) for c in ("docs", "counts")]
                shard = Shard(get("ids").as_py(), arrays[0], get("terms").as_py(), *arrays[1:], n, total)
                ids = get("ids").values
                rows: list[pa.Table] = []
                for item in get("items").as_py():
                    found, scores = shard.search([(x["term"], x["weight"]) for x in item["weights"]])
                    m = len(found)
                    rows.append(pa.table([pa.array([item["item_id"]] * m, pa.int64()), pa.array([item["item"]] * m, pa.string()), pc.take(ids, pa.array(found)).cast(pa.int64()), pa.array(scores)], ["item_id", "item", "doc_id", "score"]))
                yield from pa.concat_tables(rows).combine_chunks().to_batches() if rows else ()

    # every shard with every block of items, by the blocks' numbers
    numbered = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = numbered.join(listed, "block").mapInArrow(run, "item_id long, item string, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= FIRST).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
n AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS cn, CAST(sum(n) AS BIGINT) AS cl FROM n),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * cn + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY term, cn),
i AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, r, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * cn) // cl)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN n USING (r), total GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
