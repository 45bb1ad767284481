"""Universe → story → book → chapter: statistics and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chapter_catalogue(chapters: DataFrame, books: DataFrame, stories: DataFrame) -> DataFrame:
    """Chapters with the names and orders of their book and story, and their universe."""
    b = books.select(F.col("id").alias("book_id"), F.col("name").alias("book_name"), "story_id", F.col("sort_order").alias("book_order"))
    s = stories.select(F.col("id").alias("story_id"), F.col("name").alias("story_name"), "universe_id", F.col("sort_order").alias("story_order"))
    return chapters.join(b, "book_id").join(s, "story_id")


def reading_order(*tie: str) -> list[Column]:
    """Order of a catalogue: story, book, chapter, and what breaks ties."""
    return [F.col(c) for c in ("story_order", "book_order", "sort_order", *tie)]


def book_catalogue(books: DataFrame, stories: DataFrame) -> DataFrame:
    """Books with the name and order of their story."""
    s = stories.select(F.col("id").alias("story_id"), F.col("name").alias("story_name"), "universe_id", F.col("sort_order").alias("story_order"))
    return books.join(s, "story_id")


def universe_statistics(universes: DataFrame, stories: DataFrame, books: DataFrame, chapters: DataFrame, entities: DataFrame) -> DataFrame:
    """Universes with counts of stories, books, chapters, words and entities, and a map of entities by type.

    Children are added up on the way to the universe, so that no level fans out
    another; a universe without children has zeros and an empty map.
    """
    by_book = chapters.groupBy(F.col("book_id").alias("id")).agg(F.count(F.lit(1)).alias("chapters"), F.sum("word_count").alias("words"))
    by_story = books.select("id", "story_id").join(by_book, "id", "left").groupBy(F.col("story_id").alias("id"))
    by_story = by_story.agg(F.count(F.lit(1)).alias("books"), F.sum("chapters").alias("chapters"), F.sum("words").alias("words"))
    by_universe = stories.select("id", "universe_id").join(by_story, "id", "left").groupBy(F.col("universe_id").alias("id"))
    by_universe = by_universe.agg(F.count(F.lit(1)).alias("stories"), *(F.sum(c).alias(c) for c in ("books", "chapters", "words")))
    types = entities.groupBy("universe_id", "type").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("universe_id").alias("id"))
    types = types.agg(F.sum("n").alias("entities"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("entity_counts"))
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(c, zero).alias(c) for c in ("stories", "books", "chapters", "words", "entities")]
    no_types = F.create_map().cast("map<string,bigint>")
    return universes.join(by_universe, "id", "left").join(types, "id", "left").select(*(universes[c] for c in universes.columns), *counts, F.coalesce("entity_counts", no_types).alias("entity_counts"))


def count_of_type(entity_counts: Column, kind: str) -> Column:
    """Entities of a type from the map, 0 if there are none."""
    return F.coalesce(F.try_element_at(entity_counts, F.lit(kind)), F.lit(0).cast("long"))


def library(statistics: DataFrame, query: str = "", by: str = "recent") -> DataFrame:
    """Universes whose name or description holds the query (case counts not, accents do), by name or by last change."""
    q = F.lower(F.trim(F.lit(query)))
    found = statistics.where(F.contains(F.lower(F.concat_ws(" ", "name", "description")), q))
    order = [F.collate("name", "pt"), F.col("id")] if by == "name" else [F.desc("updated_at"), F.col("id")]
    return found.orderBy(*order)
