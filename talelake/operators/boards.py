"""Planning board, timeline and history feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talelake.functions.schemas import PLANNING_STATUSES


def status_rank(status: Column) -> Column:
    """Place of a status on the board; unknown ones come last."""
    rank = F.when(status == PLANNING_STATUSES[0], 0)
    for k, name in enumerate(PLANNING_STATUSES[1:-1], 1):
        rank = rank.when(status == name, k)
    return rank.otherwise(len(PLANNING_STATUSES) - 1)


def planning_board(items: DataFrame, chapters: DataFrame, books: DataFrame, stories: DataFrame) -> DataFrame:
    """Items with the names of their chapter, book and story, null where there is none, and their rank."""
    c = chapters.select(F.col("id").alias("chapter_id"), F.col("title").alias("chapter_title"), "book_id")
    b = books.select(F.col("id").alias("book_id"), F.col("name").alias("book_name"), "story_id")
    s = stories.select(F.col("id").alias("story_id"), F.col("name").alias("story_name"))
    joined = items.join(c, "chapter_id", "left").join(b, "book_id", "left").join(s, "story_id", "left")
    return joined.select(*(items[x] for x in items.columns), "chapter_title", "book_name", "story_name", status_rank(items["status"]).alias("status_rank"))


def planning_order() -> list[Column]:
    return [F.col("status_rank"), F.col("sort_order"), F.col("created_at"), F.col("id")]


def check_status(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with a status of the board, and those without."""
    known = F.coalesce(F.col("status").isin(PLANNING_STATUSES), F.lit(False))
    return items.where(known), items.where(~known)


def timeline_order() -> list[Column]:
    """By the numeric key, 0 if there is none, then by date as text."""
    return [F.coalesce("sort_key", F.lit(0.0)), F.col("start_date"), F.col("created_at"), F.col("id")]


def history(log: DataFrame, named: dict[str, DataFrame]) -> DataFrame:
    """Log rows with the name of what they are about, or its id if it is gone.

    named: entity type → DataFrame (id, name). All types are one tagged table, so
    that the log is joined once; a type's rows meet only ids of that type.
    """
    tagged = None
    for kind, rows in named.items():
        part = rows.select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), F.col("name").alias("_name"))
        tagged = part if tagged is None else tagged.unionByName(part)
    joined = log.join(tagged, ["entity_type", "entity_id"], "left")
    return joined.select(*(log[c] for c in log.columns), F.coalesce("_name", log["entity_id"]).alias("display_name"))


def latest(feed: DataFrame, n: int = 100) -> DataFrame:
    """The last n rows of a feed."""
    return feed.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
