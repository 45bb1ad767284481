"""Exact dedup over a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of documents is
reduced to one row for each digest, anti-joined with the index by sort-merge,
and what is new is appended. Only DataFrame functions are used. Documents of one
table are taken in by two batches, the smaller ids first: the second one meets the
first in the index, as any later batch will.

Texts are equal when they are identical after every run of
``[\\x20\\x09-\\x0D]`` became one space; a null text counts as empty. Rows that
share both doc_id and text stay or go together; null ids come last. Very long texts
are hashed whole. Extra columns are ignored; an empty batch adds nothing and returns
no rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talelake.llm.common import cut, new_path, remove, table

#: A digest is heavy if it has at least this part of the rows; so there are at most so many.
HEAVY_PARTS = 1024


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space."""
    # a lone space needs no replacement, so the pattern passes over it
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, lowercase hex."""
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """All texts seen so far: columns digest, keep_id (the first batch's smallest id)."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        """name: a table. buckets: as many as shuffle partitions, if not given. path: a folder of its own that all executors share, else the warehouse has it."""
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if path is None and not spark.sparkContext.master.startswith("local") and warehouse.removeprefix("file:").rstrip("/") == f"{os.getcwd()}/spark-warehouse":
            raise ValueError("set spark.sql.warehouse.dir to a folder that all executors share")
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.path is not None:  # Spark leaves files outside the warehouse
            remove(self.spark, self.path)

    def append(self, groups: DataFrame) -> None:
        """Adds digest, keep_id rows whose digests the index lacks."""
        new = groups.select("digest", "keep_id")
        if self.exists():
            new = new.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        (
            new.repartition(self.buckets, "digest")
            .write.options(**{"path": self.path} if self.path is not None else {})
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .format("parquet")
            .saveAsTable(self.name)
        )

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False) -> DataFrame:
        """Dedups a batch against itself and the index, and adds what is new.

        Returns one row per document: id_col, keep_id, group_size (equal texts
        in this batch), kept, text_sha256. keep_id of a text that an earlier
        batch brought is that batch's, and kept is false for all its rows.
        in_order: the batch is taken in as two, the smaller half of its ids first.
        """
        seen = cut(docs.select(F.col(id_col).alias("doc"), digest(F.col(text_col)).alias("digest")))
        total = seen.count()
        middle = seen.agg(F.percentile_approx("doc", 0.5, 1000)).first()[0] if in_order else None
        low = F.coalesce(F.col("doc") <= F.lit(middle), F.lit(False))  # a null id comes last
        for part in [seen] if middle is None else [seen.where(low), seen.where(~low)]:
            self.append(cut(part.groupBy("digest").agg(F.min("doc").alias("keep_id"))))
        sizes = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        groups = cut(sizes.join(self.read().select("digest", "keep_id").hint("merge"), "digest"))
        # few digests can have a 1024th of all rows each: those are broadcast, the rest is joined by digest
        is_heavy = F.col("group_size") * HEAVY_PARTS >= total
        heavy = F.broadcast(groups.where(is_heavy))
        light = seen.join(heavy.select("digest"), "digest", "left_anti").join(groups.where(~is_heavy), "digest")
        return light.unionByName(seen.join(heavy, "digest")).select(
            F.col("doc").alias(id_col),
            "keep_id",
            "group_size",
            F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


@contextmanager
def own_index(spark: SparkSession) -> Iterator[DigestIndex]:
    """An index for one run, in the session's checkpoint folder: the warehouse need not be shared for it."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", path=new_path(spark, "digests"))
    try:
        yield index
    finally:
        index.drop()


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of documents through an index made for this run."""
    with own_index(spark) as index:
        return cut(index.ingest(table(spark, sf_dir, "documents"), in_order=True))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


def drop_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False) -> DataFrame:
    """The rows of docs, all columns, whose texts neither the index nor a smaller id of docs has. They join the index."""
    # by id and text: ids may be null or repeated with other texts
    gone = cut(index.ingest(docs, id_col, text_col, in_order).where("not kept").select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_digest")).distinct())
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (digest(docs[text_col]) == gone["_digest"]), "left_anti")


def drop_copies_once(docs: DataFrame) -> DataFrame:
    """``drop_copies`` of documents among themselves, with an index of their own."""
    with own_index(docs.sparkSession) as index:
        return drop_copies(docs, index, in_order=True)
