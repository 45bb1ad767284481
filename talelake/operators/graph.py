"""Entities as nodes and relations as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talelake.functions.schemas import FALLBACK_SHAPE, shapes
from talelake.plans.lineage import bucketed, cut, stored
from talelake.plans.positions import numbered

#: From this depth on the whole graph is shown.
NO_LIMIT = 100
#: Edges of a node in one bucket.
HUB = 65_536
#: Rows of a sheet's page, and of a sheet that is gathered whole, at most.
PAGE, CROWD = 200, 4_096


def relation_cards(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the names and types of both ends; a relation with a missing end has no card."""
    ends = [entities.select(F.col("id").alias(f"{e}_id"), F.col("name").alias(f"{e}_name"), F.col("type").alias(f"{e}_type")) for e in ("source", "target")]
    return relations.join(ends[0], "source_id").join(ends[1], "target_id")


def other_name(focal: Column) -> Column:
    """Of a card, the name at the other end."""
    return F.when(F.col("source_id") == focal, F.col("target_name")).otherwise(F.col("source_name"))


def relations_of(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, relation) for each end that is among the entities, a self-loop once.

    The disjunction of both ends is two equi-joins, as it would be a Cartesian product as one.
    """
    keys = entities.select(F.col("id").alias("entity_id")).distinct()
    ends = [relations.join(keys, relations[f"{e}_id"] == keys["entity_id"]) for e in ("source", "target")]
    # an edge meets a key at both ends only if it is a loop
    return ends[0].unionByName(ends[1].where("source_id <> target_id"))


def incident_edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id, side, other_id, other_name, other_type and the relation, one row for each end: a self-loop has two."""
    named = entities.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
    sides = [F.struct(F.col(f"{a}_id").alias("entity_id"), F.col(f"{b}_id").alias("other_id"), F.lit(a).alias("side")) for a, b in (("source", "target"), ("target", "source"))]
    # both ends in one pass over what the relations come from
    return relations.select(*(c for c in relations.columns if c not in ("source_id", "target_id")), F.inline(F.array(*sides))).join(named, "other_id")


def nodes(entities: DataFrame) -> DataFrame:
    """Nodes with shape, colour and whether there is an image."""
    look = shapes(entities.sparkSession)
    joined = entities.join(F.broadcast(look), "type", "left")  # a dozen fixed rows
    return joined.select(
        "id", "name", "type", "description", "image",
        F.coalesce("shape", F.lit(FALLBACK_SHAPE[0])).alias("shape"),
        F.coalesce("color", F.lit(FALLBACK_SHAPE[1])).alias("color"),
        F.when(F.col("image") != "", 1).otherwise(0).alias("has_image"),
    )


def graph_nodes(entities: DataFrame) -> DataFrame:
    """Entities as the graph's nodes."""
    return entities.select("id", "name", "type", "image", "canon_status", "description")


def edges(relations: DataFrame) -> DataFrame:
    """Relations as the graph's edges."""
    return relations.select("id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "label", "bidirectional", "importance")


def whole_graph(entities: DataFrame, relations: DataFrame, universe_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a universe."""
    mine = F.col("universe_id") == universe_id
    return graph_nodes(entities.where(mine)), edges(relations.where(mine))


def new_relations(asked: DataFrame) -> DataFrame:
    """Of the relations that were asked for, those that may be made: both ends are given and differ."""
    return asked.where((F.coalesce("source_id", F.lit("")) != "") & (F.coalesce("target_id", F.lit("")) != "") & (F.col("source_id") != F.col("target_id")))


def closed_neighbourhood(entities: DataFrame, relations: DataFrame, focal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The focal nodes with their neighbours, and the edges that meet a focal node."""
    touching = relations_of(relations, focal).drop("entity_id").dropDuplicates(["id"])
    ends = touching.select(F.col("source_id").alias("id")).union(touching.select("target_id")).union(focal.select("id")).distinct()
    return entities.join(ends, "id", "left_semi"), touching


def induced(relations: DataFrame, visible: DataFrame) -> DataFrame:
    """Relations with both ends among the visible ids."""
    ids = visible.select("id").distinct()
    return relations.join(ids, relations["source_id"] == ids["id"], "left_semi").join(ids, relations["target_id"] == ids["id"], "left_semi")


def adjacency(relations: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """Each node's neighbours (a, part, b), bucketed by (a, part), and the hubs (a, parts).

    Written once for any number of walks. A node of more than ``hub`` edges is a hub,
    whose neighbours are dealt to parts of about that size, so that no bucket holds it whole.
    """
    # written, as all that follows reads them twice and what they come from may be costly
    ends = stored(relations.where("source_id <> target_id").select("source_id", "target_id"))
    both = F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))
    pairs = ends.select(F.inline(both))
    # written as a table, so that its size is known and decides on how it is joined
    hubs = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("parts")).where("parts > 1"))
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))
    return bucketed(pairs.join(hubs, "a", "left").select("a", part.alias("part"), "b"), ["a", "part"], distinct=True), hubs


def neighbours(ids: DataFrame, edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """Distinct ids next to the given ones, by an ``adjacency``: only the given ids are shuffled, to the buckets of the edges."""
    asked = ids.select(F.col("id").alias("a")).join(hubs, "a", "left")
    asked = asked.select("a", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return asked.join(edges, ["a", "part"]).select(F.col("b").alias("id")).distinct()


def reached(relations: DataFrame, focal: DataFrame, depth: int) -> DataFrame:
    """id, depth of the nodes at most ``depth`` steps from the focal ids; directions do not matter.

    Each level joins the frontier with the bucketed edges, which are shuffled once
    whatever the depth. Levels are written to the checkpoint folder, so the plan
    stays short and the work ends when a level is empty.
    """
    edges, hubs = adjacency(relations)
    seen = cut(focal.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        step = neighbours(frontier, edges, hubs)
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(entities: DataFrame, relations: DataFrame, focal: DataFrame | None, depth: int = 3, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Visible nodes and edges around the focal ids.

    The walk goes through nodes of hidden types; types only decide what is shown.
    Without focal ids, or from a depth of 100, every node of a visible type is shown.
    """
    shown = entities if types is None else entities.where(F.col("type").isin(types))
    if focal is not None and depth < NO_LIMIT:
        shown = shown.join(reached(relations, focal, depth).select("id"), "id", "left_semi")
    return shown, induced(relations, shown)


def types_by_name(entities: DataFrame) -> DataFrame:
    """Distinct types in the order of the language."""
    return entities.select("type").distinct().orderBy(F.collate("type", "pt"))


def attribute_items(attributes: DataFrame) -> DataFrame:
    """Attributes as rows of their entities' sheets."""
    return attributes.select(F.col("entity_id").alias("id"), "sort_order", "key", "value")


def relation_items(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Incident relations as rows of their entities' sheets."""
    return incident_edges(relations, entities).select(F.col("entity_id").alias("id"), "side", F.col("id").alias("relation_id"), "label", "other_id", "other_name", "other_type")


def mention_items(mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Mentioning chapters as rows of their entities' sheets."""
    chapters = catalogue.select(F.col("id").alias("chapter_id"), "title", "story_order", "book_order", "sort_order")
    return mentions.join(chapters, "chapter_id").select(F.col("entity_id").alias("id"), "story_order", "book_order", "sort_order", "chapter_id", "title")


def sheet_pages(items: DataFrame, size: int = PAGE, large: int = CROWD) -> DataFrame:
    """id, page (from 0) and items: the rows of each id's sheet, ordered by their columns from left to right.

    A page has ``size`` rows, the last one what is left, so no row grows with the data.
    An entity that is mentioned everywhere, in more than ``large`` rows, is numbered by
    ranges, not in one task; the sheets of others are gathered and cut into pages. Equal
    rows stay; an id without rows has no page.
    """
    columns = [c for c in items.columns if c != "id"]
    rows = stored(items)
    # written as a table, so that its size is known and decides on how it is joined
    crowded = stored(rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select(F.col("id").alias("_id")))
    is_crowded = rows["id"].eqNullSafe(crowded["_id"])

    def sheets(rows: DataFrame) -> DataFrame:
        whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_all"))
        numbers = F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / size).cast("int"))
        cuts = F.transform(numbers, lambda p: F.slice("_all", p * size + 1, size))
        return whole.select("id", F.posexplode(cuts).alias("page", "items")).select("id", F.col("page").cast("long").alias("page"), "items")

    if not crowded.limit(1).count():
        return sheets(rows)
    placed = numbered(rows.join(crowded, is_crowded, "left_semi"), "id", [F.col(c) for c in columns])
    pages = placed.groupBy("id", F.floor((F.col("place") - 1) / size).alias("page")).agg(F.sort_array(F.collect_list(F.struct("place", *columns))).alias("items"))
    spread = pages.withColumn("items", F.transform("items", lambda i: F.struct(*(i[c].alias(c) for c in columns))))
    return sheets(rows.join(crowded, is_crowded, "left_anti")).unionByName(spread)


def sheet_heads(entities: DataFrame, **sections: DataFrame) -> DataFrame:
    """Entities with n_<section> of each section's rows: what a sheet shows before a page is asked for."""
    heads = entities
    for name, items in sections.items():
        heads = heads.join(items.groupBy("id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "id", "left")
    return heads.fillna(0, [f"n_{name}" for name in sections])


def entity_sheet(entities: DataFrame, attributes: DataFrame, relations: DataFrame, mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Entities with their attributes, incident relations and mentioning chapters as arrays, in order: whole sheets, for a few entities.

    A row holds all that its entity has; ``sheet_heads`` and ``sheet_pages`` read sheets of any length.
    """

    def listed(items: DataFrame, name: str) -> DataFrame:
        return items.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in items.columns if c != "id")))).alias(name))

    sheets = entities.join(listed(attribute_items(attributes), "attributes"), "id", "left")
    sheets = sheets.join(listed(relation_items(relations, entities), "relations"), "id", "left")
    return sheets.join(listed(mention_items(mentions, catalogue), "mentions"), "id", "left")
