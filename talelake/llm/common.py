"""What the corpus operators share: table reading, components, and the library's lineage cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talelake.plans.lineage import Scratch, cut, new_path, remove, stored

__all__ = ["Scratch", "components", "cut", "new_path", "remove", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    edges: columns a, b (long). Returns id, comp (long) for every node that has
    an edge; comp is the smallest id of the component. Self-loops and repeated
    edges do no harm; no edges give no rows.

    Smallest labels spread over the edges and every label then jumps to its own
    label, until nothing changes. Labels are a written table each round, so a
    lost executor costs one round at most. A node with very many edges, or a
    label with very many nodes, only makes plain joins uneven, which adaptive
    execution splits; nothing is gathered by key.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    while True:
        near = (
            both.join(labels, both.b == labels.id)
            .groupBy("a")
            .agg(F.min("comp").alias("m"))
        )
        lower = cut(labels.join(near, labels.id == near.a).select("id", F.least("comp", "m").alias("comp"), F.col("comp").alias("was")))
        roots = lower.select(F.col("id").alias("root"), F.col("comp").alias("top"))
        new = cut(lower.join(roots, lower.comp == roots.root).select("id", F.least("comp", "top").alias("comp"), "was"))
        changed = new.where("comp <> was").limit(1).count()
        labels = new.select("id", "comp")
        if not changed:
            return labels
