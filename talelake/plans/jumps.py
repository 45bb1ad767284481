"""Windows that follow from each other: each starts at the first time that the one before does not cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talelake.plans.lineage import cut


def window_starts(times: DataFrame, length: int) -> DataFrame:
    """key, cell, start of each key's windows over its times (key, t; neither null).

    A key's first time starts a window of ``length``, and so does the first time at or
    after a window's end. Time is laid into cells of that length, ``cell`` being the
    start's: a cell has at most one start. A first time in a cell that comes ``length``
    or more after all before it always is one. From every other the next start follows:
    it lies in the next cell, or is the first of the one after. These jumps are doubled
    until none stays among the times that depend on each other, so the work takes the
    logarithm of the longest run's windows in rounds, and no task ever holds a key:
    the largest group is one key's different times in a cell, of which there are at
    most ``length``, twice.
    """
    cell = F.floor(F.col("t") / length)
    nodes = cut(times.select("key", "t").distinct().withColumn("cell", cell))
    cells = nodes.groupBy("key", "cell").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    before = cells.select("key", (F.col("cell") + 1).alias("cell"), F.col("last").alias("before"))
    cells = cut(cells.join(before, ["key", "cell"], "left").select("key", "cell", "first", F.coalesce(F.col("first") - F.col("before") >= length, F.lit(True)).alias("fresh")))

    # the first time of the next cell that is late enough: asked and given times in one descending order
    given = nodes.select("key", "cell", F.col("t").alias("at"), F.lit(None).cast("long").alias("t"))
    asked = nodes.select("key", (F.col("cell") + 1).alias("cell"), (F.col("t") + length).alias("at"), "t")
    down = Window.partitionBy("key", "cell").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = given.unionByName(asked).withColumn("inside", F.min(F.when(F.col("t").isNull(), F.col("at"))).over(down)).where("t IS NOT NULL")
    after = cells.where("NOT fresh").select("key", (F.col("cell") - 1).alias("cell"), F.col("first").alias("after"))
    joined = inside.join(cells, ["key", "cell"], "left").join(after, ["key", "cell"], "left")
    to = F.when(F.col("inside").isNull(), F.col("after")).when(~(F.col("fresh") & (F.col("inside") == F.col("first"))), F.col("inside"))
    jumps = cut(joined.select("key", "t", to.alias("to")).where("to IS NOT NULL"))

    found = cells.where("fresh").select("key", F.col("first").alias("t"))
    while jumps.limit(1).count():
        found = cut(found.unionByName(found.join(jumps, ["key", "t"]).select("key", F.col("to").alias("t"))).distinct())
        onward = jumps.select("key", F.col("t").alias("to"), F.col("to").alias("onward"))
        jumps = cut(jumps.join(onward, ["key", "to"]).select("key", "t", F.col("onward").alias("to")))
    return found.select("key", cell.alias("cell"), F.col("t").alias("start"))


def in_windows(rows: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """rows (key, t and others) with the start of the window that each lies in: that of its cell, or of the cell before."""
    own = starts.select("key", "cell", F.col("start").alias("own"), F.lit(None).cast("long").alias("past"))
    past = starts.select("key", (F.col("cell") + 1).alias("cell"), F.lit(None).cast("long").alias("own"), F.col("start").alias("past"))
    near = own.unionByName(past).groupBy("key", "cell").agg(F.max("own").alias("own"), F.max("past").alias("past"))
    joined = rows.withColumn("cell", F.floor(F.col("t") / length)).join(near, ["key", "cell"])
    return joined.select(*rows.columns, F.when(F.col("own") <= F.col("t"), F.col("own")).otherwise(F.col("past")).alias("start"))
