"""Search over the tables of a universe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talelake.functions.text import norm, normalise

#: Hits of a search, and the shortest query.
LIMIT, SHORTEST = 24, 2


def like_ascii(text, query: str):
    """LIKE '%query%' that folds A-Z only; % and _ of the query are wildcards, a backslash is itself."""
    fold = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = "%" + query.translate(str.maketrans(*fold)).replace("\\", "\\\\") + "%"
    return F.translate(text, *fold).like(pattern)


def search_entities(entities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Entities by name, as a completion list."""
    return entities.where(like_ascii(F.col("name"), query)).orderBy("name", "id").limit(limit)


def filter_entities(entities: DataFrame, query: str) -> DataFrame:
    """Entities whose name, type or description holds the query; case counts not, accents do."""
    return entities.where(F.contains(F.lower(F.concat_ws(" ", "name", "type", "description")), F.lower(F.trim(F.lit(query)))))


# fixed values: the sign of each kind of hit; an entity has its initial
ICONS = {"story": "⌂", "book": "▱", "chapter": "▤", "timeline": "◷", "planning": "☑"}


def search_source(df: DataFrame, kind: str, rank: int, fields: list, label, context, order: list) -> DataFrame:
    """One source of a search: what is searched, what a hit shows, and its own order."""
    icon = F.lit(ICONS[kind]) if kind in ICONS else F.upper(F.substring(label, 1, 1))
    return df.select(
        F.lit(rank).alias("kind_rank"),
        F.lit(kind).alias("kind"),
        F.col("id"),
        label.alias("label"),
        context.alias("context"),
        icon.alias("icon"),
        F.struct(*order).alias("place"),
        F.concat_ws(" ", *fields).alias("haystack"),
    )


def global_search(sources: list[DataFrame], query: str, limit: int = LIMIT) -> DataFrame:
    """Hits of all sources, those of one source after the other, up to one common limit.

    Case and accents do not count. Each source keeps its own first hits, so only
    ``limit`` rows of each meet in the end.
    """
    q = norm(query)
    if len(q) < SHORTEST:
        return sources[0].select("kind_rank", "kind", "id", "label", "context", "icon").limit(0)
    found = None
    for source in sources:
        hits = source.where(F.contains(normalise("haystack"), F.lit(q))).orderBy("place", "id").limit(limit)
        hits = hits.select("kind_rank", "kind", "id", "label", "context", "icon", F.row_number().over(Window.orderBy("place", "id")).alias("pos"))
        found = hits if found is None else found.unionByName(hits)
    return found.orderBy("kind_rank", "pos").limit(limit).select("kind_rank", "kind", "id", "label", "context", "icon")


def recent(rows: DataFrame, n: int = 8) -> DataFrame:
    """What was changed last."""
    return rows.orderBy(F.desc("updated_at"), "id").limit(n)


def sub_select(rows: DataFrame, column: str, value: str) -> DataFrame:
    """A column of a board or a branch of a tree: the rows with one status, story, book or type."""
    return rows.where(F.col(column) == value)


def toggled(selected: DataFrame, clicked: DataFrame) -> DataFrame:
    """A selection of ids after some were clicked: those in it leave, the others join."""
    left = selected.select("id").distinct().join(clicked.select("id"), "id", "left_anti")
    return left.unionByName(clicked.select("id").distinct().join(selected.select("id"), "id", "left_anti"))
