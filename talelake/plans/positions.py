"""Places of rows in an order within few and large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talelake.plans.lineage import cut


def numbered(df: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place in its group, from 1.

    A window over the group would sort a whole group in one task. Rows are dealt by
    ranges of (group, order) and sorted where they lie; a row's place is its place in
    its range and what lies in the group's ranges before. Only counts meet: one row
    for each group and range.
    """
    keys = [F.col(group), *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the number of a row in its range; the rows are written, so that it stays
    rows = cut(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()))
    runs = rows.groupBy(group, "_range").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col(group).alias("_group"), F.col("_range").alias("_run"), (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    joined = rows.join(runs, rows[group].eqNullSafe(runs["_group"]) & (rows["_range"] == runs["_run"]))
    return joined.select(*df.columns, (F.col("_n") + F.col("_shift")).alias(name))
