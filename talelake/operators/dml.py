"""Set-wise edits. Each takes the current rows and returns the new ones; writing them is up to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talelake.functions.schemas import default_attributes


def insert(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds rows."""
    return current.unionByName(rows)


def insert_absent(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows whose keys are not there; rows that are keep their ids and times."""
    return current.unionByName(rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


def next_positions(current: DataFrame, rows: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """New rows with sort_order after the last of their parent, in the given order; the first of a parent has 0."""
    last = current.groupBy(parent).agg(F.max("sort_order").alias("_last"))
    place = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return rows.join(last, parent, "left").withColumn("sort_order", (F.coalesce("_last", F.lit(-1)) + place).cast("int")).drop("_last")


def patch(current: DataFrame, patches: DataFrame, now: str, key: str = "id") -> DataFrame:
    """Sets the fields that a patch has. patches: key, fields (map<string,string>), one row for each key.

    A field that the map lacks stays; an empty text is a value. Rows with a patch get ``updated_at``.
    """
    joined = current.join(patches.select(key, "fields"), key, "left")
    out = []
    for field in current.schema:
        value = F.col(field.name)
        if field.name == "updated_at":
            value = F.when(F.col("fields").isNotNull(), F.lit(now)).otherwise(value)
        elif field.name != key:
            given = F.coalesce(F.map_contains_key("fields", F.lit(field.name)), F.lit(False))
            value = F.when(given, F.try_element_at("fields", F.lit(field.name)).cast(field.dataType)).otherwise(value)
        out.append(value.alias(field.name))
    return joined.select(*out)


def set_columns(current: DataFrame, values: DataFrame, now: str | None = None) -> DataFrame:
    """Sets the columns that ``values`` has beside its id, one row for each id; also null ones. now: what ``updated_at`` becomes, if anything."""
    given = [c for c in values.columns if c != "id"]
    joined = current.join(values.select("id", F.struct(*given).alias("_new")), "id", "left")
    hit = F.col("_new").isNotNull()

    def value(field):
        if field.name in given:
            return F.when(hit, F.col(f"_new.{field.name}").cast(field.dataType)).otherwise(F.col(field.name))
        return F.when(hit, F.lit(now)).otherwise(F.col(field.name)) if field.name == "updated_at" and now is not None else F.col(field.name)

    return joined.select(*(value(f).alias(f.name) for f in current.schema))


def reorder(current: DataFrame, order: DataFrame, parent: str) -> DataFrame:
    """Sets sort_order by place in a list, only of rows of the list's parent. order: parent, ids (array)."""
    places = order.select(F.col(parent), F.posexplode("ids").alias("_place", "id"))
    joined = current.join(places, ["id", parent], "left")
    return joined.select(*(F.coalesce("_place", "sort_order").cast("int").alias("sort_order") if c == "sort_order" else F.col(c) for c in current.columns))


def set_attributes(attributes: DataFrame, values: DataFrame) -> DataFrame:
    """Upserts (entity_id, key, value): known keys get the value, new ones come after the entity's last."""
    keys = ["entity_id", "key"]
    joined = attributes.join(values.select(*keys, F.col("value").alias("_new")), keys, "left")
    changed = joined.select(*(F.coalesce("_new", "value").alias("value") if c == "value" else F.col(c) for c in attributes.columns))
    fresh = next_positions(attributes, values.join(attributes.select(*keys), keys, "left_anti"), "entity_id", ["key"])
    fresh = fresh.withColumn("id", F.md5(F.concat_ws("|", *keys)))
    return changed.unionByName(fresh.select(*attributes.columns))


def set_sheet(entities: DataFrame, attributes: DataFrame, values: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Entities and attributes after a sheet was saved: the entities of changed attributes get ``updated_at``."""
    return touch(entities, values.select(F.col("entity_id").alias("id")), now), set_attributes(attributes, values)


def touch(rows: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Sets updated_at of the given ids."""
    joined = rows.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return joined.withColumn("updated_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updated_at"))).select(*rows.columns)


def seed_attributes(entities: DataFrame, templates: DataFrame) -> DataFrame:
    """Attributes of new entities: their type's defaults, then the universe's templates whose keys are no defaults."""
    defaults = F.broadcast(default_attributes(entities.sparkSession))  # some dozen fixed rows
    e = entities.select(F.col("id").alias("entity_id"), "universe_id", F.col("type").alias("entity_type"))
    first = e.join(defaults, "entity_type").select("entity_id", F.col("attribute_key").alias("key"), F.lit("").alias("value"), F.col("position").alias("sort_order"))
    sizes = F.broadcast(defaults.select("entity_type", "n").distinct())
    own = templates.join(defaults.select("entity_type", "attribute_key"), ["entity_type", "attribute_key"], "left_anti")
    then = e.join(own.drop("id"), ["universe_id", "entity_type"]).join(sizes, "entity_type", "left")
    then = then.select("entity_id", F.col("attribute_key").alias("key"), F.col("default_value").alias("value"), (F.coalesce("n", F.lit(0)) + F.col("sort_order")).cast("int").alias("sort_order"))
    return first.unionByName(then).withColumn("id", F.md5(F.concat_ws("|", "entity_id", "key")))


def delete(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.join(ids.select("id"), "id", "left_anti")


#: Deletes that go on to children: table → (column, parent).
CASCADES = [
    ("stories", "universe_id", "universes"), ("books", "story_id", "stories"), ("chapters", "book_id", "books"), ("entities", "universe_id", "universes"),
    ("entity_attributes", "entity_id", "entities"), ("entity_templates", "universe_id", "universes"), ("relations", "universe_id", "universes"),
    ("relations", "source_id", "entities"), ("relations", "target_id", "entities"), ("mentions", "chapter_id", "chapters"), ("mentions", "entity_id", "entities"),
    ("timeline_events", "universe_id", "universes"), ("planning_items", "universe_id", "universes"), ("chapter_revisions", "chapter_id", "chapters"),
    ("attachments", "universe_id", "universes"),
]
#: References that become null with their parent.
CLEARED = [("planning_items", "chapter_id", "chapters"), ("timeline_events", "entity_id", "entities")]
#: Kinds of owners whose attachments go with them; a universe's go by their own universe_id.
OWNERS = {"entity": "entities", "chapter": "chapters"}


def cascade_delete(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """All tables after rows of one were deleted, with what hung on them.

    Children go by an anti-join with what was deleted above them, so that rows
    that were orphans before stay. Log rows stay, too.
    """
    gone = {table: tables[table].join(ids.select("id"), "id", "left_semi").select("id")}
    out = dict(tables)
    out[table] = delete(tables[table], ids)
    for child, column, parent in CASCADES:
        if child in out and parent in gone:
            lost = gone[parent].select(F.col("id").alias(column))
            hit = tables[child].join(lost, column, "left_semi").select("id")
            gone[child] = hit if child not in gone else gone[child].union(hit)
            out[child] = out[child].join(lost, column, "left_anti").select(*tables[child].columns)
    for child, column, parent in CLEARED:
        if child in out and parent in gone:
            lost = gone[parent].select(F.col("id").alias(column), F.lit(True).alias("_lost"))
            joined = out[child].join(lost.distinct(), column, "left")
            out[child] = joined.select(*(F.when(F.col("_lost"), None).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in tables[child].columns))
    if "attachments" in out:
        for kind, parent in OWNERS.items():
            if parent in gone:
                owner = gone[parent].select(F.lit(kind).alias("owner_type"), F.col("id").alias("owner_id"))
                out["attachments"] = out["attachments"].join(owner, ["owner_type", "owner_id"], "left_anti").select(*tables["attachments"].columns)
    return out
