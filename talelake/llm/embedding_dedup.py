"""Near-duplicate vectors by int8 tile products with error bounds.

Vectors are scaled to length one and quantised to int8 with a scale of their
own; the lengths of the quantised vector and of its error give a bound on the
error of a product of two quantised vectors:

    |u.v - u'.v'| <= |u - u'| |v| + |u'| |v - v'|

Blocks of vectors are multiplied as int8 tiles. Only pairs whose product may
reach the threshold within the bound are computed again in double precision, so
the links are exact. A tile returns no pairs: it returns how many vectors each
of its vectors is linked with, and a spanning forest of the links.

Equal vectors are one row from the start, with a count. Vectors that are null,
empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different lengths. Rows that share vec_id are separate rows. Labels
and other columns are ignored; an empty table gives no rows. Every block holds about BLOCK vectors; which one a
vector is in depends on its hash, so that no group of near copies fills a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talelake.llm.common import components, cut, table
from talelake.llm.ngram_join import forest

#: Vectors in a block, and rows of a tile that are multiplied at once.
BLOCK, ROWS = 2048, 512
#: Components that a product of int8 values as float32 can add up without rounding.
EXACT = 1024


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, length of the quantised vector and of its error, for each row."""
    scale = np.abs(unit).max(1) / 127
    values = np.rint(unit / scale[:, None]).astype(np.int8)
    near = values * scale[:, None]
    return values, scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def tile_links(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows have a cosine of at least ``least``."""
    ux, uy = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    (qx, sx, nx, ex), (qy, sy, _, ey) = quantise(ux), quantise(uy)
    links = np.zeros((len(x), len(y)), bool)
    wide = qy.astype(np.float32)
    for low in range(0, len(x), ROWS):
        part = slice(low, low + ROWS)
        product = np.zeros((len(qx[part]), len(y)))
        for at in range(0, x.shape[1], EXACT):
            product += qx[part, at : at + EXACT].astype(np.float32) @ wide[:, at : at + EXACT].T
        product *= sx[part, None]
        product *= sy[None, :]
        bound = ex[part, None] + nx[part, None] * ey[None, :] + 1e-9
        a, b = np.nonzero(product + bound >= least)
        for k in range(0, len(a), 1 << 16):
            i, j = a[k : k + (1 << 16)] + low, b[k : k + (1 << 16)]
            cosine = np.einsum("ij,ij->i", x[i], y[j]) / (np.linalg.norm(x[i], axis=1) * np.linalg.norm(y[j], axis=1))
            links[i, j] = cosine >= least
    return links


def _blocks(vectors: DataFrame) -> DataFrame:
    """dim, block, ids, sizes and the vectors' bytes: one row for each block."""

    def run(key, batch):
        flat = batch["v"]
        data = np.concatenate([row.values.to_numpy() for row in flat]).astype(np.float64)
        row = {"dim": key[0].as_py(), "block": key[1].as_py(), "ids": batch["id"].to_pylist(), "sizes": batch["size"].to_pylist(), "data": data.tobytes()}
        longs = pa.list_(pa.int64())
        return pa.Table.from_pylist([row], pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", longs), ("sizes", longs), ("data", pa.binary())]))

    return vectors.groupBy("dim", "block").applyInArrow(run, "dim int, block int, ids array<long>, sizes array<long>, data binary")


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, n_links, component_id and kept of each row."""
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    # one row for each different vector; -0.0 and 0.0 are the same
    valid = rows.where("good").select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    keyed = cut(valid.select("id", "v", F.xxhash64("v").alias("h")))
    distinct = cut(keyed.groupBy("h", "v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("size")).withColumn("id", F.xxhash64("h", F.hash("v"))))
    counts = distinct.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = distinct.withColumn("dim", F.size("v")).join(F.broadcast(counts), "dim").withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int"))
    blocks = cut(_blocks(placed.select("dim", "block", "id", "size", "v")))
    keys = blocks.select("dim", "block")
    one, two = (blocks.select("dim", F.col("block").alias(f"b{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("ids", "sizes", "data"))) for k in (1, 2))
    pairs = (
        keys.withColumnRenamed("block", "b1").join(F.broadcast(counts), "dim")
        .select("dim", "b1", F.explode(F.sequence(F.col("b1"), parts - 1)).alias("b2"))
    )
    pairs = pairs.repartition(F.xxhash64("dim", "b1", "b2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                dim, b1, b2 = (batch.column(c)[k].as_py() for c in ("dim", "b1", "b2"))
                a, b = (batch.column(c)[k].values.to_numpy() for c in ("ids1", "ids2"))
                m, n = (batch.column(c)[k].values.to_numpy() for c in ("sizes1", "sizes2"))
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.float64).reshape(-1, dim) for c in ("data1", "data2"))
                links = tile_links(x, y, least)
                if b1 == b2:
                    links |= links.T
                    np.fill_diagonal(links, False)
                if not links.any():
                    continue
                node, label = forest(links, a, b)
                rows, cols = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
                n_right = links[rows] @ n
                n_left = m @ links[:, cols] if b1 != b2 else np.zeros(len(cols), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label), pa.array(np.concatenate((n_right, n_left)).astype(np.int64))], ["a", "b", "n"])

    tiles = pairs.join(one, ["dim", "b1"]).join(two, ["dim", "b2"])
    found = cut(tiles.mapInArrow(run, "a long, b long, n long"))
    linked = found.groupBy("a").agg(F.sum("n").alias("n"))
    labels = components(found.select("a", "b"))
    classes = cut(
        distinct.join(linked, distinct.id == linked.a, "left").drop("a")
        .join(labels.withColumnRenamed("id", "a"), distinct.id == F.col("a"), "left")
        .select("h", "v", "low", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "comp")
    )
    lowest = classes.where("comp is not null").groupBy("comp").agg(F.min("low").alias("least"))
    final = cut(classes.join(lowest, "comp", "left").where("n_links > 0").select("h", "v", "n_links", F.coalesce("least", "low").alias("component_id")))
    joined = keyed.join(final, ["h", "v"], "left").select("id", "n_links", "component_id")
    result = joined.unionByName(rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    component = F.coalesce("component_id", "id")
    return result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Links of equal vectors included; the components' closure is a recursive union.
ORACLE = r"""
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM good),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u)
  WHERE list_dot_product(a.u, b.u) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c USING (vec_id)
"""
