"""Change capture: what history and revisions get from old and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _made(kind: str, pairs: DataFrame, now: str) -> list[Column]:
    """id and created_at of a new row: the id is the change's own, so that a task that runs again writes the same row.

    Pairs of a merge have ``pos``, the step's place, as one id may change more than once.
    """
    place = [F.col("pos").cast("string")] if "pos" in pairs.columns else []
    return [F.md5(F.concat_ws("|", F.lit(kind), F.col("id"), *place, F.lit(now))).alias("id"), F.lit(now).alias("created_at")]


def row_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, o and n: the rows of two states side by side."""
    return old.select("id", F.struct(*old.columns).alias("o")).join(new.select("id", F.struct(*new.columns).alias("n")), "id", "full_outer")


def revisions(pairs: DataFrame, now: str) -> DataFrame:
    """The old title, content and word count of chapters whose title or content really differs."""
    changed = pairs.where("o is not null and n is not null and (o.content <> n.content or o.title <> n.title)")
    id_, created_at = _made("revision", pairs, now)
    return changed.select(id_, F.col("id").alias("chapter_id"), "o.title", "o.content", "o.word_count", created_at)


def chapter_log(pairs: DataFrame, books: DataFrame, stories: DataFrame, updated: DataFrame | None = None, now: str = "") -> DataFrame:
    """Log rows of chapters. A new one logs its title; an update logs one field, title before status before content.

    updated: ids that an update named, also without any difference; all pairs, if
    not given. Content is logged as word counts. A chapter whose parents are
    missing logs nothing, and deletes are never logged.
    """
    universe = books.select(F.col("id").alias("book_id"), "story_id").join(stories.select(F.col("id").alias("story_id"), "universe_id"), "story_id").select("book_id", "universe_id")
    named = pairs if updated is None else pairs.where("o is null").unionByName(pairs.where("o is not null").join(updated.select("id").distinct(), "id", "left_semi"))
    rows = named.where("n is not null").withColumn("book_id", F.col("n.book_id")).join(universe, "book_id")
    by_title, by_status = F.col("o.title") != F.col("n.title"), F.col("o.status") != F.col("n.status")
    created = F.col("o").isNull()

    def pick(title, status, content):
        return F.when(by_title, title).when(by_status, status).otherwise(content)

    id_, created_at = _made("chapter", pairs, now)
    return rows.select(
        id_,
        F.lit("chapter").alias("entity_type"),
        F.col("id").alias("entity_id"),
        F.when(created, "create").otherwise("update").alias("action"),
        F.when(created, "").otherwise(pick(F.lit("title"), F.lit("status"), F.lit("content"))).alias("field"),
        F.when(created, "").otherwise(pick(F.col("o.title"), F.col("o.status"), F.col("o.word_count").cast("string"))).alias("old_value"),
        F.when(created, F.col("n.title")).otherwise(pick(F.col("n.title"), F.col("n.status"), F.col("n.word_count").cast("string"))).alias("new_value"),
        created_at,
        "universe_id",
    )


def entity_log(pairs: DataFrame, updated: DataFrame | None = None, now: str = "") -> DataFrame:
    """Log rows of entities: one for each new one, and one for each update whatever it changed."""
    named = pairs if updated is None else pairs.where("o is null").unionByName(pairs.where("o is not null").join(updated.select("id").distinct(), "id", "left_semi"))
    created = F.col("o").isNull()
    id_, created_at = _made("entity", pairs, now)
    return named.where("n is not null").select(
        id_,
        F.lit("entity").alias("entity_type"),
        F.col("id").alias("entity_id"),
        F.when(created, "create").otherwise("update").alias("action"),
        F.when(created, "").otherwise("record").alias("field"),
        F.when(created, "").otherwise(F.col("o.name")).alias("old_value"),
        F.col("n.name").alias("new_value"),
        created_at,
        F.col("n.universe_id").alias("universe_id"),
    )
