"""Best-fit packing of documents into bins under conflicts.

A document longer than a bin is cut into pieces; whole bins are filled by its
full pieces and the rest is packed like any other. Within a shard, pieces come by
descending size. Bins are ordered by what is left in them, and each carries two
bitmaps: the sources and the duplicate clusters that it holds. A piece goes to
the bin with the least room that is enough and in which neither its source nor
its cluster is yet; the search goes on to the next larger residual until such a
bin is found, or opens a new one.

Shards are made by hash and hold about SHARD pieces, whatever the sources and
clusters; members of a cluster in different shards can't meet in a bin. Bins
never span shards, so each shard wastes at most a few bins' room. There is no
cap: every piece gets a bin.

Sizes are words ``[^\\x20\\x09-\\x0D]+``, one at least, so that an empty or null
text also gets a place. A null source is a source of its own. Clusters are
texts that are equal up to white space, unless a column is named. Repeated rows
are pieces of their own, a null id is an id. Extra columns are ignored, an empty
table gives no rows. A text of any length is cut into pieces; a word is never cut.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talelake.llm.common import cut, table
from talelake.llm.exact_dedup import digest

#: Words in a bin, and pieces in a shard.
CAPACITY, SHARD = 1024, 4096
#: A word, in the regular expressions of Spark.
WORD = r"[^\x20\x09-\x0D]+"


class Bins:
    """Open bins by residual, and for each residual by source bitmap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = {}  # residual → source bitmap → (number, cluster bitmap)
        self.made = 0

    def _put(self, residual: int, sources: int, clusters: int, number: int) -> None:
        if residual:
            if residual not in self.at:
                self.at[residual] = {}
                insort(self.residuals, residual)
            self.at[residual].setdefault(sources, []).append((number, clusters))

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Number of the tightest compatible bin and the place in it. source, cluster: bitmaps of the piece."""
        for k in range(bisect_left(self.residuals, size), len(self.residuals)):
            residual = self.residuals[k]
            groups = self.at[residual]
            for sources, bins in groups.items():
                if sources & source:
                    continue
                for i, (number, clusters) in enumerate(bins):
                    if not clusters & cluster:
                        bins[i] = bins[-1]
                        bins.pop()
                        if not bins:
                            del groups[sources]
                            if not groups:
                                del self.at[residual]
                                del self.residuals[k]
                        self._put(residual - size, sources | source, clusters | cluster, number)
                        return number, self.capacity - residual
        self.made += 1
        self._put(self.capacity - size, source, cluster, self.made - 1)
        return self.made - 1, 0


def pack(pieces: list[tuple[int, str | None, str]], capacity: int) -> list[tuple[int, int]]:
    """Bin and place of each (size, source, cluster), best fit in descending size."""
    bit: dict[str | None, int] = {}
    for _, source, _ in pieces:
        bit.setdefault(source, 1 << len(bit))
    shared = [c for c, n in Counter(c for _, _, c in pieces).items() if n > 1]
    cluster_bit = {c: 1 << k for k, c in enumerate(shared)}
    bins, found = Bins(capacity), [(0, 0)] * len(pieces)
    for k in sorted(range(len(pieces)), key=lambda k: -pieces[k][0]):
        size, source, cluster = pieces[k]
        found[k] = bins.add(size, bit[source], cluster_bit.get(cluster, 0))
    return found


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, cluster_col: str | None, capacity: int) -> DataFrame:
    """id, digest, piece, n_words, bin_id, bin_offset of each piece."""
    named = F.col(cluster_col).cast("string") if cluster_col else F.lit(None).cast("string")
    sized = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.substring(digest(F.col(text_col)), 1, 32).alias("digest"),
        named.alias("cluster"),
        F.greatest(F.lit(1), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD))).alias("n"),
    )
    sized = cut(sized)
    last = F.floor((F.col("n") - 1) / capacity)
    cluster = F.col("cluster") if cluster_col else F.col("digest")
    pieces = sized.select("id", "source", "digest", cluster.alias("cluster"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"), "n")
    pieces = pieces.select("id", "source", "digest", "cluster", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("size"))
    shards = max(1, -(-sized.agg(F.coalesce(F.sum(last + 1), F.lit(0))).first()[0] // SHARD))
    placed = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "digest"), F.lit(shards)))

    def run(key, batch):
        rows = batch.sort_by([("id", "ascending"), ("piece", "ascending"), ("digest", "ascending"), ("cluster", "ascending")])
        sizes = rows["size"].to_pylist()
        found = pack(list(zip(sizes, rows["source"].to_pylist(), rows["cluster"].to_pylist(), strict=True)), capacity)
        names = [f"{key[0].as_py()}-{number}" for number, _ in found]
        columns = [rows["id"], rows["digest"], rows["piece"], rows["size"].cast(pa.int64()), pa.array(names, pa.string()), pa.array([at for _, at in found], pa.int64())]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["id", "digest", "piece", "n_words", "bin_id", "bin_offset"])

    return placed.groupBy("shard").applyInArrow(run, "id long, digest string, piece long, n_words long, bin_id string, bin_offset long")


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """One row for each piece: id_col, piece, n_words, bin_id, bin_offset.

    piece counts from 0 in the document; it holds words piece * capacity and on.
    docs must have the three named columns.
    """
    return _placed(docs, id_col, text_col, source_col, cluster_col, capacity).drop("digest").withColumnRenamed("id", id_col)


def pack_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """``pack_documents`` with each piece's text: its words, joined by one space.

    Pieces meet their texts by id, digest of the text and number. Rows that share
    id and text have the same pieces, so that a text is taken once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "digest", "piece", "text"]
        for batch in batches:
            for row in range(len(batch)):
                text = batch.column(2)[row].as_py()
                words = (text or "").encode().split()
                parts = [b" ".join(words[low : low + capacity]).decode() for low in range(0, max(1, len(words)), capacity)]
                same = [pa.array([batch.column(k)[row].as_py()] * len(parts), kind) for k, kind in ((0, pa.int64()), (1, pa.string()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], names)

    placed = cut(_placed(docs, id_col, text_col, source_col, cluster_col, capacity))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.substring(digest(F.col(text_col)), 1, 32).alias("digest"), F.col(text_col).alias("text"))
    pieces = texts.mapInArrow(run, "id long, digest string, piece long, text string").dropDuplicates(["digest", "id", "piece"])
    here = placed["id"].eqNullSafe(pieces["id"]) & (placed["digest"] == pieces["digest"]) & (placed["piece"] == pieces["piece"])
    return placed.join(pieces, here).select(placed["id"].alias(id_col), placed["piece"], "n_words", "bin_id", "bin_offset", "text")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into bins of 1,024 words."""
    return pack_documents(table(spark, sf_dir, "documents"))
