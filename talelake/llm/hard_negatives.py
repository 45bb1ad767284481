"""Hard negatives from a vector-approximation file.

Vectors are integers: a component x becomes floor(256 * x). They are dealt by hash into
blocks, and each block is a file of approximations: every dimension's range is cut into
CELLS cells of equal width, and of a vector only its cell in each dimension is looked at
first. For an anchor, a table holds the least product of its component with any value of
a cell; the entries of a vector's cells add up to a lower bound of its score, and as all
cells of a dimension are equally wide, the upper bound lies one number of the anchor's
above it. Only vectors that may enter a window within these bounds are scored exactly:

1. Positives: in each block, vectors of the anchor's label whose upper bound reaches the
   k-th largest lower bound of that label. The blocks' first k are merged by anchor.
2. Negatives: a positive of score p opens the window 30 * p <= 100 * score <= 90 * p. In
   each block, a vector of another label may enter it if its bounds touch the window, and
   does so for certain if both lie inside; whose upper bound is below the k-th largest
   lower bound of the certain ones cannot be among the first k. The blocks' first k are
   merged by anchor and positive.

Anchors are a stated query set (ids divisible by 100): every block of them meets every
block of vectors once, by an equi-join on listed pairs of blocks, and a pair returns k
rows for each window at most. Nothing is broadcast but the counts of blocks, one row for
each length of vectors. Which block a vector is in depends on its hash, not its label, so
a label or a group of copies with a third of all rows fills no block.

Rows with a null id, label or vector, an empty vector, or any null or non-finite component
take no part; vectors of different lengths have no score with each other. Rows that share
an id are one: the one with the smallest label, then vector. Components beyond
LARGEST after the multiplication are set to that bound, so that scores of up to 512
components are exact in 64 bits. Equal scores come by ascending id. An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talelake.llm.common import cut, table

#: Cells of a dimension's range in a block.
CELLS = 64
#: Numbers in a block of vectors and in one of anchors; so many divided by their length are its rows.
VECTORS, ANCHORS = 1 << 20, 1 << 15
#: The largest size of a component.
LARGEST = 1 << 27

_SCHEMA = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("data", pa.binary())])


def as_integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, v (array of int) of the rows that take part, one for each id."""
    v = F.col(vector_col)
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    bound = float(LARGEST)
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double") * 256, F.lit(bound)), F.lit(-bound))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(label_col).cast("int").alias("label"), whole.alias("v")).alias("row"))
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v")


def _blocks(rows: DataFrame, counts: DataFrame, numbers: int) -> DataFrame:
    """dim, block, ids, labels and the components as bytes: one row for each block."""

    def run(key, batch):
        flat = np.concatenate([c.flatten().to_numpy() for c in batch["v"].chunks]).astype(np.int32)
        row = {"dim": key[0].as_py(), "block": key[1].as_py(), "ids": batch["id"].to_pylist(), "labels": batch["label"].to_pylist(), "data": flat.tobytes()}
        return pa.Table.from_pylist([row], _SCHEMA)

    placed = rows.withColumn("dim", F.size("v")).join(F.broadcast(counts), "dim")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), _parts(numbers)).cast("int")).select("dim", "block", "id", "label", "v")
    return placed.groupBy("dim", "block").applyInArrow(run, "dim int, block int, ids array<long>, labels array<int>, data binary")


def _parts(numbers: int):
    """Blocks of the vectors of a length, of which there are n."""
    return F.greatest(F.ceil(F.col("n") * F.col("dim") / numbers), F.lit(1))


class Approximation:
    """The cells of a block's vectors."""

    def __init__(self, values: np.ndarray):
        self.low = values.min(0)
        self.width = (values.max(0) - self.low) // CELLS + 1
        # by dimension, as indexes, so that a lookup reads on end
        self.cells = np.ascontiguousarray(((values - self.low) // self.width).T.astype(np.intp))

    def lower(self, anchor: np.ndarray) -> tuple[np.ndarray, int]:
        """A lower bound of each vector's score, and how far above it the upper one lies."""
        first = self.low[:, None] + np.arange(CELLS) * self.width[:, None]  # each cell's least value
        last = first + self.width[:, None] - 1
        table = np.where(anchor[:, None] >= 0, anchor[:, None] * first, anchor[:, None] * last)
        total = np.zeros(self.cells.shape[1], np.int64)
        for entries, cells in zip(table, self.cells, strict=True):
            total += entries[cells]
        return total, int((np.abs(anchor) * (self.width - 1)).sum())


def _kth(values: np.ndarray, k: int) -> int | None:
    """The k-th largest value, None if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, smaller ids first among equal ones."""
    return np.lexsort((ids, -scores))[:k]


class Searched:
    """A block and its approximation, asked for one anchor after the other."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.ids, self.labels, self.values = ids, labels, values.astype(np.int64)
        self.cells = Approximation(self.values)
        self.scored = 0

    def _exact(self, places: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        self.scored += len(places)
        return self.values[places] @ anchor

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the first k other rows of the label."""
        lower, spread = self.cells.lower(anchor)
        own = np.flatnonzero((self.labels == label) & (self.ids != anchor_id))
        if (least := _kth(lower[own], k)) is not None:
            own = own[lower[own] + spread >= least]
        scores = self._exact(own, anchor)
        first = _first(self.ids[own], scores, k)
        return self.ids[own[first]], scores[first]

    def negatives(self, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids and scores of the first k rows of other labels in each window."""
        lower, spread = self.cells.lower(anchor)
        other = np.flatnonzero(self.labels != label)
        lower = lower[other]
        wanted, kept = np.zeros(len(other), bool), []
        for low, high in windows:
            may = (lower + spread >= low) & (lower <= high)
            sure = lower[(lower >= low) & (lower + spread <= high)]
            if (least := _kth(sure, k)) is not None:
                may &= lower + spread >= least
            wanted |= may
            kept.append(may)
        scores = np.zeros(len(other), np.int64)
        at = np.flatnonzero(wanted)
        scores[at] = self._exact(other[at], anchor)
        found = []
        for (low, high), may in zip(windows, kept, strict=True):
            inside = np.flatnonzero(may)
            inside = inside[(scores[inside] >= low) & (scores[inside] <= high)]
            first = inside[_first(self.ids[other[inside]], scores[inside], k)]
            found.append((self.ids[other[first]], scores[first]))
        return found


def window_of(score: int) -> tuple[int, int]:
    """The least and the largest score s with 30 * score <= 100 * s <= 90 * score."""
    return -(-30 * score // 100), 90 * score // 100


def _tiles(batches: Iterator[pa.RecordBatch], values: list[str]) -> Iterator[tuple]:
    """A searched block, the anchors' ids, labels and vectors, and further columns, for each pair of blocks."""
    for batch in batches:
        for k in range(len(batch)):
            get = lambda c: batch.column(c)[k]  # noqa: B023, E731
            dim = get("dim").as_py()
            ids, labels, their, marks = (get(c).values.to_numpy(zero_copy_only=False) for c in ("ids", "labels", "anchor_ids", "anchor_labels"))
            data, anchors = (np.frombuffer(get(c).as_buffer(), np.int32).reshape(-1, dim) for c in ("data", "anchor_data"))
            yield Searched(ids, labels, data), their, marks, anchors.astype(np.int64), *(get(c) for c in values)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: id, label, v (integers), one row for each id.
    """
    rows = cut(vectors)
    counts = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    blocks = cut(_blocks(rows, counts, VECTORS))
    asked = rows.where(F.col("id") % every == 0)
    asked_counts = asked.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    anchors = cut(_blocks(asked, asked_counts, ANCHORS).select("dim", F.col("block").alias("anchor_block"), *(F.col(c).alias(f"anchor_{c}") for c in ("ids", "labels", "data"))))
    sizes = blocks.select("dim", "block").join(F.broadcast(asked_counts), "dim")
    pairs = sizes.select("dim", "block", F.explode(F.sequence(F.lit(0), _parts(ANCHORS).cast("int") - 1)).alias("anchor_block"))
    pairs = cut(pairs.repartition(F.xxhash64("dim", "block", "anchor_block")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, labels, data in _tiles(batches, []):
            found = [(a, *block.positives(a, label, anchor, positives)) for a, label, anchor in zip(ids.tolist(), labels.tolist(), data, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, [len(x) for _, x, _ in found])), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([s for *_, s in found]))], ["anchor_id", "positive_id", "positive_score"]
            )

    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    tiles = pairs.join(blocks, ["dim", "block"]).join(anchors, ["dim", "anchor_block"])
    near_rows = tiles.mapInArrow(near, "anchor_id long, positive_id long, positive_score long")
    chosen = cut(near_rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= positives).drop("_n"))

    # each anchor block with its anchors' positives: as many entries as it has anchors, times positives
    listed = anchors.select("dim", "anchor_block", F.explode("anchor_ids").alias("anchor_id")).join(chosen, "anchor_id")
    opened = listed.groupBy("dim", "anchor_block").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("opened"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, labels, data, entries in _tiles(batches, ["opened"]):
            mine_: dict[int, list[tuple[int, int]]] = {}
            for e in entries.as_py():
                mine_.setdefault(e["anchor_id"], []).append((e["positive_id"], e["positive_score"]))
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for a, label, anchor in zip(ids.tolist(), labels.tolist(), data, strict=True):
                own = mine_.get(a, [])
                for (p, score), (them, scores) in zip(own, block.negatives(label, anchor, [window_of(s) for _, s in own], negatives) if own else [], strict=True):
                    for column, values in zip(out, (np.full(len(them), a), np.full(len(them), p), np.full(len(them), score), them, scores), strict=True):
                        column.append(values.astype(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    tiles = pairs.join(blocks, ["dim", "block"]).join(anchors.join(opened, ["dim", "anchor_block"]), ["dim", "anchor_block"])
    found = tiles.mapInArrow(windows, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of all embeddings whose ids are divisible by 100; ids divisible by 7 have the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(as_integers(rows.select("vec_id", "embedding", label.alias("label"))))


ORACLE = r"""
WITH good AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM good a JOIN good b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
