"""From raw documents to packed training text, in five stages.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. ``run`` applies them in order to the documents table.

No stage fails on nulls, empty or very long texts, repeated rows, empty tables or
extra columns; all but the last pass extra columns on. A null text is an empty one. A
null id is an id like any other, and comes last where the smallest stays. Rows that
share id and text are one document: they stay or go together. Rows that share an id
alone are different documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talelake.llm import exact_dedup, ngram_join, packing, quality, secrets
from talelake.llm.common import cut, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (operator 10)."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 5): the smallest id's."""
    return exact_dedup.drop_copies_once(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five words, a similarity of 0.8 (operator 2)."""
    return ngram_join.drop_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars set where a text has changed (operator 7)."""
    return secrets.redact(docs, secrets.train())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 1,024 words, one row with its text for each piece of a document (operator 6)."""
    return packing.pack_texts(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scan", mask_secrets),
    ("best-fit packing", pack),
]

#: The classifier and the join over whole tables are out of SQL's reach; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage packs."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
