"""Table schemas and fixed values of the narrative model.

Times are UTC text ``YYYY-MM-DD HH:MM:SS`` and fictional dates are text, so that
a date such as ``0000-01-01`` survives; text order is time order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talelake.functions.text import now_text

#: Name → DDL of the columns.
TABLES: dict[str, str] = {
    "universes": "id string, name string, description string, cover_image string, created_at string, updated_at string",
    "stories": "id string, universe_id string, name string, description string, sort_order int, created_at string, updated_at string",
    "books": "id string, story_id string, name string, description string, sort_order int, created_at string, updated_at string, cover_image string",
    "chapters": "id string, book_id string, title string, content string, word_count int, status string, canon_status string, sort_order int, created_at string, updated_at string",
    "entities": "id string, universe_id string, type string, name string, description string, image string, canon_status string, created_at string, updated_at string",
    "entity_attributes": "id string, entity_id string, key string, value string, sort_order int",
    "entity_templates": "id string, universe_id string, entity_type string, attribute_key string, default_value string, sort_order int",
    "relations": "id string, universe_id string, source_id string, target_id string, type string, label string, bidirectional int, importance string, created_at string",
    "mentions": "id string, chapter_id string, entity_id string, created_at string",
    "timeline_events": "id string, universe_id string, title string, description string, event_type string, start_date string, end_date string, created_at string, updated_at string, entity_id string, display_date string, sort_key double",
    "planning_items": "id string, universe_id string, chapter_id string, title string, description string, status string, target_words int, sort_order int, created_at string, updated_at string",
    "attachments": "id string, universe_id string, owner_type string, owner_id string, data_url string, caption string, sort_order int, created_at string",
    "change_log": "id string, entity_type string, entity_id string, action string, field string, old_value string, new_value string, created_at string, universe_id string",
    "chapter_revisions": "id string, chapter_id string, title string, content string, word_count int, created_at string",
    "sync_conflicts": "id string, aggregate_type string, aggregate_id string, field string, local_value string, remote_value string, created_at string, resolved_at string",
}

#: Tables that devices exchange.
SYNCED = (
    "universes stories books chapters entities entity_attributes entity_templates relations mentions timeline_events planning_items attachments"
).split()

#: Columns that may be null; all others have a value where nothing is given.
NULLABLE = {("planning_items", "chapter_id"), ("timeline_events", "entity_id")}

# fixed values: what a new row has where nothing is given; times are the moment of writing, all other columns '' or 0
DEFAULTS = {
    ("chapters", "status"): "IDEIA",
    ("chapters", "canon_status"): "CANON",
    ("entities", "canon_status"): "CANON",
    ("relations", "type"): "custom",
    ("relations", "importance"): "normal",
    ("timeline_events", "event_type"): "MARCO",
    ("planning_items", "status"): "IDEIAS",
}
#: Columns that have the moment of writing where nothing is given.
TIMES = ("created_at", "updated_at")

# fixed values
PLANNING_STATUSES = ["IDEIAS", "PLANEJADO", "ESCREVENDO", "REVISAO", "FINALIZADO"]
DEFAULT_ATTRIBUTES = {
    "Personagem": ["Idade", "Nascimento", "Cidade natal", "Localização atual", "Nacionalidade", "Ocupação", "Arco do personagem", "Personalidade", "Qualidades", "Defeitos", "Motivações e objetivos", "Background", "Família", "Observação"],
    "Lugar": ["Tipo", "População", "Governo", "Governante", "Clima"],
    "Evento": ["Data", "Duração", "Local", "Consequências"],
    "Objeto": ["Tipo", "Material", "Propriedades", "Dono atual", "Origem"],
    "Organização": ["Tipo", "Líder", "Sede", "Membros", "Objetivo"],
}
ENTITY_SHAPES = {
    "Personagem": ("ellipse", "#8b5cf6"), "Lugar": ("hexagon", "#06b6d4"), "Evento": ("rectangle", "#f59e0b"), "Objeto": ("triangle", "#10b981"),
    "Organização": ("diamond", "#ef4444"), "Raça": ("octagon", "#ec4899"), "Espécie": ("octagon", "#ec4899"), "Poder": ("octagon", "#ec4899"),
    "Religião": ("octagon", "#ec4899"), "Cultura": ("octagon", "#ec4899"), "Documento": ("round-rectangle", "#64748b"), "Nota": ("round-rectangle", "#94a3b8"),
}
FALLBACK_SHAPE = ("round-rectangle", "#8b7f78")
PREDEFINED_RELATIONS = {
    "familia": [("Irmão(ã) de", True), ("Pai/Mãe de", False), ("Filho(a) de", False), ("Cônjuge de", True)],
    "social": [("Amigo(a) de", True), ("Inimigo(a) de", True), ("Aliado(a) de", True), ("Mestre de", False), ("Aprendiz de", False)],
    "romance": [("Ama", False), ("Amou", False), ("Casado(a) com", True)],
    "geografico": [("Nasceu em", False), ("Vive em", False), ("Capital de", False), ("Contém", False)],
    "narrativo": [("Participou de", False), ("Iniciou", False), ("Destruiu", False), ("Fundou", False)],
    "posse": [("Possui", False), ("Controla", False), ("Governa", False)],
}


def schema(table: str) -> T.StructType:
    """The table's columns."""
    return T.StructType.fromDDL(TABLES[table])


def default(table: str, field: T.StructField, now: str | None = None) -> Column:
    """What a new row has in a column that it does not give."""
    if (table, field.name) in NULLABLE:
        return F.lit(None).cast(field.dataType)
    if field.name in TIMES:
        return F.lit(now) if now is not None else now_text()
    return F.lit(DEFAULTS.get((table, field.name), "" if isinstance(field.dataType, T.StringType) else 0)).cast(field.dataType)


def with_defaults(df: DataFrame, table: str, now: str | None = None) -> DataFrame:
    """df with all of the table's columns: absent and null ones get their default unless null is allowed."""
    out = []
    for field in schema(table):
        value = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        out.append(F.coalesce(value, default(table, field, now)).alias(field.name))
    return df.select(*out)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def default_attributes(spark: SparkSession) -> DataFrame:
    """entity_type, attribute_key, position, count of the fixed defaults (a few dozen rows)."""
    rows = [(t, k, i, len(keys)) for t, keys in DEFAULT_ATTRIBUTES.items() for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "entity_type string, attribute_key string, position int, n int")


def relation_labels(spark: SparkSession) -> DataFrame:
    """category, label, bidirectional of the predefined relations (a few dozen rows)."""
    return spark.createDataFrame([(c, *r) for c, rows in PREDEFINED_RELATIONS.items() for r in rows], "category string, label string, bidirectional boolean")


def shapes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, *s) for t, s in ENTITY_SHAPES.items()], "type string, shape string, color string")
