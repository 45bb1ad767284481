"""Named queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talelake.functions import text
from talelake.functions.schemas import DEFAULT_ATTRIBUTES, SYNCED, empty, with_defaults
from talelake.operators import boards, changes, dml, graph, hierarchy, mentions, merge, reads, search, share
from talelake.operators.mention_index import MentionIndex
from talelake.plans.lineage import new_path
from talelake.plans.positions import numbered
from talelake.sources import shares, snapshots
from talelake.sources.views import view, with_views
from talelake.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = "2026-01-01 00:00:00"


def query(sql: str | None = None, *views: str):
    """Registers a query under its function's name; sql follows ``WITH views``, or stands alone without any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def _views(spark, sf_dir, *names):
    return [view(spark, sf_dir, n) for n in names]


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STATS = """, c AS (SELECT s.universe_id AS id, count(*) AS chapters, sum(word_count) AS words FROM chapters c JOIN books b ON c.book_id = b.id JOIN stories s ON b.story_id = s.id GROUP BY 1)
SELECT u.id, u.name, (SELECT count(*) FROM stories s WHERE s.universe_id = u.id) AS stories,
  (SELECT count(*) FROM books b JOIN stories s ON b.story_id = s.id WHERE s.universe_id = u.id) AS books,
  coalesce(c.chapters, 0) AS chapters, CAST(coalesce(c.words, 0) AS BIGINT) AS words, (SELECT count(*) FROM entities e WHERE e.universe_id = u.id) AS entities,
  coalesce((SELECT string_agg(concat(type, '=', CAST(n AS VARCHAR)), ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM entities e WHERE e.universe_id = u.id GROUP BY type)), '') AS entity_counts
FROM universes u LEFT JOIN c ON c.id = u.id"""


@query(_STATS, "universes", "stories", "books", "chapters", "entities")
def q01_universe_library(spark, sf_dir):
    found = hierarchy.universe_statistics(*_views(spark, sf_dir, "universes", "stories", "books", "chapters", "entities"))
    pairs = F.transform(F.array_sort(F.map_entries("entity_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select("id", "name", "stories", "books", "chapters", "words", "entities", F.array_join(pairs, ",").alias("entity_counts"))


@query(
    """ SELECT c.id, c.title, c.word_count, b.name AS book_name, s.name AS story_name, s.universe_id,
    row_number() OVER (PARTITION BY s.universe_id ORDER BY s.sort_order, b.sort_order, c.sort_order, c.id) AS place
    FROM chapters c JOIN books b ON c.book_id = b.id JOIN stories s ON b.story_id = s.id""",
    "chapters", "books", "stories",
)
def q02_chapter_catalogue(spark, sf_dir):
    found = hierarchy.chapter_catalogue(*_views(spark, sf_dir, "chapters", "books", "stories"))
    return numbered(found, "universe_id", hierarchy.reading_order("id")).select("id", "title", "word_count", "book_name", "story_name", "universe_id", "place")


@query(" SELECT b.id, b.name, s.name AS story_name, s.universe_id FROM books b JOIN stories s ON b.story_id = s.id", "books", "stories")
def j01_book_catalogue(spark, sf_dir):
    return hierarchy.book_catalogue(*_views(spark, sf_dir, "books", "stories")).select("id", "name", "story_name", "universe_id")


def _sheet_inputs(spark, sf_dir):
    entities, relations, told = _views(spark, sf_dir, "entities", "relations", "mentions")
    return entities, relations, hierarchy.chapter_catalogue(*_views(spark, sf_dir, "chapters", "books", "stories")), told.select("chapter_id", "entity_id")


_MENTIONS = ", m AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS chapter_id, CAST(l_partkey AS VARCHAR) AS entity_id FROM lineitem)"


@query(
    _MENTIONS + """ SELECT e.id, e.name,
    (SELECT count(*) FROM relations r JOIN entities o ON o.id = r.target_id WHERE r.source_id = e.id) + (SELECT count(*) FROM relations r JOIN entities o ON o.id = r.source_id WHERE r.target_id = e.id) AS n_relations,
    (SELECT count(*) FROM m JOIN chapters c ON c.id = m.chapter_id JOIN books b ON b.id = c.book_id JOIN stories s ON s.id = b.story_id WHERE m.entity_id = e.id) AS n_mentions,
    concat(e.description, '/', e.type) AS attributes FROM entities e""",
    "entities", "relations", "chapters", "books", "stories",
)
def q03_entity_sheet(spark, sf_dir):
    entities, relations, catalogue, told = _sheet_inputs(spark, sf_dir)
    attributes = entities.select(F.col("id").alias("entity_id"), F.explode(F.array(F.struct(F.lit(0).alias("sort_order"), F.lit("brand").alias("key"), F.col("description").alias("value")), F.struct(F.lit(1).alias("sort_order"), F.lit("kind").alias("key"), F.col("type").alias("value")))).alias("a"))
    items = graph.attribute_items(attributes.select("entity_id", "a.*"))
    first = graph.sheet_pages(items).where("page = 0").select("id", F.array_join(F.transform("items", lambda i: i["value"]), "/").alias("attributes"))
    heads = graph.sheet_heads(entities, relations=graph.relation_items(relations, entities), mentions=graph.mention_items(told, catalogue))
    return heads.join(first, "id", "left").select("id", "name", "n_relations", "n_mentions", "attributes")


@query(
    _MENTIONS + """, i AS (SELECT 'relations' AS section, x.id AS id, concat(x.side, '|', x.rid, '|', x.label, '|', o.name) AS t, row_number() OVER (PARTITION BY x.id ORDER BY x.side, x.rid) AS k
      FROM (SELECT id AS rid, label, source_id AS id, target_id AS other, 'source' AS side FROM relations UNION ALL SELECT id, label, target_id, source_id, 'target' FROM relations) x JOIN entities o ON o.id = x.other
      UNION ALL SELECT 'mentions', m.entity_id, c.title, row_number() OVER (PARTITION BY m.entity_id ORDER BY s.sort_order, b.sort_order, c.sort_order, c.id)
      FROM m JOIN chapters c ON c.id = m.chapter_id JOIN books b ON b.id = c.book_id JOIN stories s ON s.id = b.story_id)
    SELECT section, id, (k - 1) // 20 AS page, count(*) AS n, md5(string_agg(t, ',' ORDER BY k)) AS contents FROM i GROUP BY ALL""",
    "entities", "relations", "chapters", "books", "stories",
)
def q03_sheet_pages(spark, sf_dir):
    entities, relations, catalogue, told = _sheet_inputs(spark, sf_dir)
    lines = {
        "relations": (graph.relation_items(relations, entities), lambda r: F.concat_ws("|", r["side"], r["relation_id"], r["label"], r["other_name"])),
        "mentions": (graph.mention_items(told, catalogue), lambda m: m["title"]),
    }
    found = None
    for section, (items, line) in lines.items():
        pages = graph.sheet_pages(items, 20).select(F.lit(section).alias("section"), "id", "page", F.size("items").cast("long").alias("n"), F.md5(F.array_join(F.transform("items", line), ",")).alias("contents"))
        found = pages if found is None else found.unionByName(pages)
    return found


@query(
    _MENTIONS + """, i AS (SELECT r.source_id AS id, concat('source|', r.id, '|', r.label, '|', o.name) AS t, 'source' AS side, r.id AS rid FROM relations r JOIN entities o ON o.id = r.target_id
      UNION ALL SELECT r.target_id, concat('target|', r.id, '|', r.label, '|', o.name), 'target', r.id FROM relations r JOIN entities o ON o.id = r.source_id),
    rel AS (SELECT id, md5(string_agg(t, ',' ORDER BY side, rid)) AS relations FROM i GROUP BY id),
    told AS (SELECT m.entity_id AS id, md5(string_agg(c.title, ',' ORDER BY s.sort_order, b.sort_order, c.sort_order, c.id)) AS mentions
      FROM m JOIN chapters c ON c.id = m.chapter_id JOIN books b ON b.id = c.book_id JOIN stories s ON s.id = b.story_id GROUP BY m.entity_id)
    SELECT e.id, coalesce(rel.relations, '') AS relations, coalesce(told.mentions, '') AS mentions FROM entities e LEFT JOIN rel USING (id) LEFT JOIN told USING (id)""",
    "entities", "relations", "chapters", "books", "stories",
)
def q03_sheet_contents(spark, sf_dir):
    entities, relations, catalogue, told = _sheet_inputs(spark, sf_dir)
    none = spark.createDataFrame([], "entity_id string, sort_order int, key string, value string")
    sheet = graph.entity_sheet(entities, none, relations, told, catalogue)
    lines = F.transform("relations", lambda r: F.concat_ws("|", r["side"], r["relation_id"], r["label"], r["other_name"]))
    hashed = lambda c: F.coalesce(F.md5(F.array_join(c, ",")), F.lit(""))
    return sheet.select("id", hashed(lines).alias("relations"), hashed(F.transform("mentions", lambda m: m["title"])).alias("mentions"))


@query(
    _MENTIONS + " SELECT m.chapter_id, m.entity_id, c.title, b.name AS book_name, s.name AS story_name, s.universe_id FROM m JOIN chapters c ON c.id = m.chapter_id JOIN books b ON b.id = c.book_id JOIN stories s ON s.id = b.story_id",
    "chapters", "books", "stories",
)
def q04_mention_occurrences(spark, sf_dir):
    _, _, catalogue, told = _sheet_inputs(spark, sf_dir)
    return mentions.occurrences(told, catalogue).select("chapter_id", "entity_id", "title", "book_name", "story_name", "universe_id")


@query(
    _MENTIONS + """ SELECT entity_id, chapter_id FROM (SELECT m.entity_id, m.chapter_id, row_number() OVER (PARTITION BY m.entity_id ORDER BY s.sort_order, b.sort_order, c.sort_order, c.id) AS k
    FROM m JOIN chapters c ON c.id = m.chapter_id JOIN books b ON b.id = c.book_id JOIN stories s ON s.id = b.story_id) WHERE k = 1""",
    "chapters", "books", "stories",
)
def w01_first_occurrences(spark, sf_dir):
    _, _, catalogue, told = _sheet_inputs(spark, sf_dir)
    return mentions.first_occurrences(mentions.occurrences(told, catalogue)).select("entity_id", "chapter_id")


def _names(spark, sf_dir):
    """Every word of the benchmark texts, and the first two words of each together."""
    words = F.split("text", " ")
    names = _table(spark, sf_dir, "benchmark").select(F.explode(F.concat(words, F.array(F.array_join(F.slice(words, 1, 2), " ")))).alias("name"))
    return names.where(F.length("name") >= 2).distinct().select(F.col("name").alias("entity_id"), "name")


def _page(text, lang, source):
    """A document as HTML: a heading, a paragraph for each line, a list."""
    escaped = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.array_join(F.transform(F.split(escaped, "\n"), lambda x: F.concat(F.lit("<p class='x'>"), x, F.lit("</p>"))), "")
    return F.concat(F.lit("<article id=a><h2>"), F.coalesce(lang, F.lit("")), F.lit("</h2>"), lines, F.lit("<ul><li>"), F.coalesce(source, F.lit("")), F.lit("</li></ul></article>"))


def _dealt(spark, sf_dir, name, key):
    """A table of texts, dealt to all tasks: its file may be one row group, and a single task would do all the work on the texts, too."""
    # a number of partitions, or Spark would join them to about as many as there are cores, and some of those would get two
    return _table(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def _pages(spark, sf_dir):
    return _dealt(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("text_id"), _page(F.col("text"), F.col("lang"), F.col("source")).alias("html"))


_BLANK = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_NAMES = """w AS (SELECT string_split(text, ' ') AS ws FROM benchmark),
names AS (SELECT DISTINCT name FROM (SELECT unnest(ws) AS name FROM w UNION ALL SELECT array_to_string(ws[1:2], ' ') FROM w) WHERE length(name) >= 2),
n AS (SELECT name, k FROM (SELECT name, trim(lower(strip_accents(name))) AS k FROM names) WHERE length(k) >= 2)"""
#: text_id, entity_id by the relation ``t`` (text_id, t normalised): plain words by equality, other names by pattern.
_FOUND = """found AS (
  SELECT DISTINCT text_id, n.name AS entity_id FROM (SELECT text_id, unnest(list_distinct(regexp_split_to_array(t, '[^a-z0-9]+'))) AS k FROM t) JOIN n USING (k)
  UNION SELECT text_id, n.name FROM t JOIN n ON NOT regexp_full_match(n.k, '[a-z0-9]+') AND contains(t.t, n.k) AND regexp_matches(t.t, concat('(?:^|[^a-z0-9])', regexp_escape(n.k), '(?:$|[^a-z0-9])')))"""
_LINES = rf"""lines AS (SELECT doc_id AS text_id, list_filter(list_transform([coalesce(lang, '')] || string_split(coalesce(text, ''), chr(10)) || [coalesce(source, '')],
  lambda x: regexp_replace(x, '^{_BLANK}|{_BLANK}$', '', 'g')), lambda x: x <> '') AS ps FROM documents)"""


@query(f"WITH {_NAMES}, t AS (SELECT doc_id AS text_id, trim(lower(strip_accents(text))) AS t FROM documents), {_FOUND} SELECT text_id, entity_id FROM found")
def q05_mention_index(spark, sf_dir):
    return mentions.find_mentions(_dealt(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("text_id"), "text"), _names(spark, sf_dir))


#: Letters of another script, to which a-z and A-Z are turned.
_LETTERS, _OTHER = string.ascii_letters, "".join(chr(0x430 + k) for k in range(26)) + "".join(chr(0x410 + k) for k in range(26))
_OTHER_NAMES = f"""n AS (SELECT name, trim(lower(strip_accents(name))) AS k FROM (
  SELECT DISTINCT translate(concat(a, ' ', b), '{_LETTERS}', '{_OTHER}') AS name FROM (SELECT unnest(ws[1:-2]) AS a, unnest(ws[2:]) AS b FROM (SELECT string_split(text, ' ') AS ws FROM benchmark))))"""


@query(f"""WITH {_OTHER_NAMES}, t AS (SELECT doc_id AS text_id, trim(lower(strip_accents(translate(text, '{_LETTERS}', '{_OTHER}')))) AS t FROM documents)
SELECT DISTINCT text_id, name AS entity_id FROM t JOIN n ON contains(t.t, n.k) AND regexp_matches(t.t, concat('(?:^|[^a-z0-9])', regexp_escape(n.k), '(?:$|[^a-z0-9])'))""")
def q05_other_scripts(spark, sf_dir):
    """Names of two words, and texts, in Cyrillic letters."""
    texts = _dealt(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("text_id"), F.translate("text", _LETTERS, _OTHER).alias("text"))
    words = _table(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("ws"))
    pairs = words.select(F.explode(F.arrays_zip(F.slice("ws", F.lit(1), F.size("ws") - 1).alias("a"), F.slice("ws", F.lit(2), F.size("ws") - 1).alias("b"))).alias("p"))
    names = pairs.select(F.translate(F.concat_ws(" ", "p.a", "p.b"), _LETTERS, _OTHER).alias("name")).distinct()
    return mentions.find_mentions(texts, names.select(F.col("name").alias("entity_id"), "name"))


@query()
def q05_html_mention_index(spark, sf_dir):
    pages = _dealt(spark, sf_dir, "pages", "page_id").select(F.col("page_id").alias("id"), F.col("html").alias("content"))
    return mentions.mention_index(pages, _names(spark, sf_dir).select(F.col("entity_id").alias("id"), "name"))


@query(f"WITH {_NAMES}, {_LINES}, t AS (SELECT text_id, trim(lower(strip_accents(array_to_string(ps, ' ')))) AS t FROM lines), {_FOUND} SELECT text_id AS chapter_id, entity_id FROM found")
def q05_chapter_mentions(spark, sf_dir):
    chapters = _pages(spark, sf_dir).select(F.col("text_id").alias("id"), F.col("html").alias("content"))
    return mentions.mention_index(chapters, _names(spark, sf_dir).select(F.col("entity_id").alias("id"), "name"))


def _told(spark, sf_dir):
    """Where the names occur among the documents, with an order of reading."""
    d, number = F.col("text_id"), lambda k: (F.col("text_id") % k).cast("int")
    return q05_mention_index(spark, sf_dir).select("entity_id", d.cast("string").alias("chapter_id"), number(3).alias("story_order"), number(5).alias("book_order"), d.alias("sort_order"))


_FIRST = "first AS (SELECT entity_id, CAST(arg_min(text_id, (text_id % 3, text_id % 5, text_id)) AS VARCHAR) AS first_chapter FROM whole GROUP BY entity_id)"
_HERE = rf"""whole AS (WITH t AS (SELECT doc_id AS text_id, trim(lower(strip_accents(text))) AS t FROM documents), {_FOUND} SELECT * FROM found), {_FIRST},
p AS (SELECT text_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM lines), np AS (SELECT text_id, pos, p, trim(lower(strip_accents(p))) AS t FROM p),
f AS (WITH t AS (SELECT (text_id, pos) AS text_id, t FROM np), {_FOUND} SELECT text_id[1] AS text_id, text_id[2] AS pos, entity_id FROM found),
here AS (SELECT f.text_id, f.entity_id, array_to_string((list(np.p ORDER BY np.pos) FILTER (regexp_matches(np.t, '^[—–\-]|[“”"]|\b(disse|perguntou|respondeu|sussurrou|gritou|falou)\b') OR starts_with(np.t, n.k || ':')))[1:3], chr(1)) AS s
  FROM f JOIN np USING (text_id, pos) JOIN n ON n.name = f.entity_id GROUP BY f.text_id, f.entity_id)"""


@query(f"WITH {_NAMES}, {_LINES}, {_HERE} SELECT text_id, entity_id, md5(coalesce(s, '')) AS snippets, first_chapter FROM here LEFT JOIN first USING (entity_id)")
def q06_character_insights(spark, sf_dir):
    found = mentions.insights(_pages(spark, sf_dir), _names(spark, sf_dir), _told(spark, sf_dir))
    return found.select("text_id", "entity_id", F.md5(F.array_join("snippets", "\x01")).alias("snippets"), "first_chapter")


@query(
    f"""WITH {_NAMES}, {_LINES}, {_HERE}, one AS (SELECT * FROM here WHERE text_id = (SELECT min(doc_id) FROM documents))
    SELECT entity_id, one.s IS NOT NULL OR one.text_id IS NOT NULL AS mentioned, md5(coalesce(one.s, '')) AS snippets, first_chapter FROM one FULL JOIN first USING (entity_id)"""
)
def q06_one_text(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    text = pages.join(pages.agg(F.min("text_id").alias("text_id")), "text_id")  # the text that is open
    found = mentions.text_insights(text, _names(spark, sf_dir), _told(spark, sf_dir))
    return found.select("entity_id", "mentioned", F.md5(F.array_join("snippets", "\x01")).alias("snippets"), "first_chapter")


_SEARCH = """, hits AS (
  SELECT 0 AS kind_rank, 'story' AS kind, id, name AS label, 'História' AS context, '⌂' AS icon, sort_order AS place, concat_ws(' ', name, description) AS h FROM stories
  UNION ALL SELECT 1, 'book', b.id, b.name, concat('Livro · ', s.name), '▱', b.sort_order, concat_ws(' ', b.name, b.description, s.name) FROM books b JOIN stories s ON b.story_id = s.id
  UNION ALL SELECT 2, 'chapter', c.id, c.title, concat(s.name, ' · ', b.name), '▤', c.sort_order, concat_ws(' ', c.title, c.content, b.name, s.name) FROM chapters c JOIN books b ON c.book_id = b.id JOIN stories s ON b.story_id = s.id
  UNION ALL SELECT 3, 'entity', id, name, type, upper(name[1]), CAST(id AS BIGINT), concat_ws(' ', name, description, type) FROM entities
  UNION ALL SELECT 4, 'timeline', id, title, 'Linha do tempo', '◷', CAST(id AS BIGINT), concat_ws(' ', title, description, start_date) FROM timeline_events
  UNION ALL SELECT 5, 'planning', id, title, concat('Planejamento · ', status), '☑', CAST(id AS BIGINT), concat_ws(' ', title, description, status) FROM planning_items)
SELECT kind_rank, kind, id, label, context, icon FROM hits WHERE contains(trim(lower(strip_accents(h))), 'on_1') ORDER BY kind_rank, place, id LIMIT 24"""


@query(_SEARCH, "stories", "books", "chapters", "entities", "timeline_events", "planning_items")
def q07_global_search(spark, sf_dir):
    stories, books, chapters, entities, timeline, planning = _views(spark, sf_dir, "stories", "books", "chapters", "entities", "timeline_events", "planning_items")
    cat, shelf = hierarchy.chapter_catalogue(chapters, books, stories), hierarchy.book_catalogue(books, stories)
    c, s, number = F.col, search.search_source, F.col("id").cast("long")
    sources = [
        s(stories, "story", 0, ["name", "description"], c("name"), F.lit("História"), [c("sort_order")]),
        s(shelf, "book", 1, ["name", "description", "story_name"], c("name"), F.concat(F.lit("Livro · "), "story_name"), [c("sort_order")]),
        s(cat, "chapter", 2, ["title", "content", "book_name", "story_name"], c("title"), F.concat_ws(" · ", "story_name", "book_name"), [c("sort_order")]),
        s(entities, "entity", 3, ["name", "description", "type"], c("name"), c("type"), [number]),
        s(timeline, "timeline", 4, ["title", "description", "start_date"], c("title"), F.lit("Linha do tempo"), [number]),
        s(planning, "planning", 5, ["title", "description", "status"], c("title"), F.concat(F.lit("Planejamento · "), "status"), [number]),
    ]
    return search.global_search(sources, "ÔN_1")


@query(
    """ SELECT p.id, p.universe_id, p.status, c.title AS chapter_title, b.name AS book_name, s.name AS story_name, row_number() OVER (PARTITION BY p.universe_id ORDER BY
    CASE p.status WHEN 'IDEIAS' THEN 0 WHEN 'PLANEJADO' THEN 1 WHEN 'ESCREVENDO' THEN 2 WHEN 'REVISAO' THEN 3 ELSE 4 END, p.sort_order, p.created_at, p.id) AS place
    FROM planning_items p LEFT JOIN chapters c ON c.id = p.chapter_id LEFT JOIN books b ON b.id = c.book_id LEFT JOIN stories s ON s.id = b.story_id""",
    "planning_items", "chapters", "books", "stories",
)
def q08_planning_board(spark, sf_dir):
    found = boards.planning_board(*_views(spark, sf_dir, "planning_items", "chapters", "books", "stories"))
    return numbered(found, "universe_id", boards.planning_order()).select("id", "universe_id", "status", "chapter_title", "book_name", "story_name", "place")


@query(
    " SELECT id, universe_id, title, start_date, row_number() OVER (PARTITION BY universe_id ORDER BY coalesce(sort_key, 0), start_date, created_at, id) AS place FROM timeline_events",
    "timeline_events",
)
def q09_timeline(spark, sf_dir):
    (rows,) = _views(spark, sf_dir, "timeline_events")
    return numbered(rows, "universe_id", boards.timeline_order()).select("id", "universe_id", "title", "start_date", "place")


@query(
    """ SELECT r.id, r.type, r.label, r.bidirectional, r.created_at, s.name AS source_name, s.type AS source_type, t.name AS target_name, t.type AS target_type
    FROM relations r JOIN entities s ON s.id = r.source_id JOIN entities t ON t.id = r.target_id""",
    "relations", "entities",
)
def q10_relation_cards(spark, sf_dir):
    cards = graph.relation_cards(*_views(spark, sf_dir, "relations", "entities"))
    return cards.select("id", "type", "label", "bidirectional", "created_at", "source_name", "source_type", "target_name", "target_type")


@query(
    """ SELECT c.id, c.entity_type, c.entity_id, c.created_at, coalesce(u.name, s.name, b.name, ch.title, e.name, c.entity_id) AS display_name FROM change_log c
    LEFT JOIN universes u ON c.entity_type = 'universe' AND u.id = c.entity_id LEFT JOIN stories s ON c.entity_type = 'story' AND s.id = c.entity_id
    LEFT JOIN books b ON c.entity_type = 'book' AND b.id = c.entity_id LEFT JOIN chapters ch ON c.entity_type = 'chapter' AND ch.id = c.entity_id
    LEFT JOIN entities e ON c.entity_type = 'entity' AND e.id = c.entity_id ORDER BY c.logged DESC LIMIT 100""",
    "change_log", "universes", "stories", "books", "chapters", "entities",
)
def q11_history_feed(spark, sf_dir):
    log, universes, stories, books, chapters, entities = _views(spark, sf_dir, "change_log", "universes", "stories", "books", "chapters", "entities")
    # the page is cut first, so that only its rows are joined
    page = log.orderBy(F.desc("logged")).limit(100)
    named = {"universe": universes, "story": stories, "book": books, "chapter": chapters.select("id", F.col("title").alias("name")), "entity": entities}
    return boards.history(page, named).select("id", "entity_type", "entity_id", "created_at", "display_name")


def _focal(relations):
    return relations.agg(F.min(F.col("source_id").cast("long")).cast("string").alias("id"))


_REACH = """, e AS (SELECT source_id AS a, target_id AS b FROM relations UNION ALL SELECT target_id, source_id FROM relations),
reach AS (SELECT CAST(min(CAST(source_id AS BIGINT)) AS VARCHAR) AS id, 0 AS depth FROM relations UNION SELECT e.b, depth + 1 FROM reach JOIN e ON e.a = reach.id WHERE depth < 3),
near AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id)"""


@query(_REACH + " SELECT id, depth FROM near /*RECURSIVE*/", "relations")
def q12_graph_reach(spark, sf_dir):
    (relations,) = _views(spark, sf_dir, "relations")
    return graph.reached(relations, _focal(relations), 3)


@query(
    _REACH + """, shown AS (SELECT e.id FROM entities e JOIN near USING (id) WHERE e.type IN ('STANDARD', 'MEDIUM', 'LARGE'))
    SELECT r.id, r.source_id, r.target_id FROM relations r WHERE r.source_id IN (SELECT id FROM shown) AND r.target_id IN (SELECT id FROM shown) /*RECURSIVE*/""",
    "relations", "entities",
)
def q12_graph_neighbourhood(spark, sf_dir):
    relations, entities = _views(spark, sf_dir, "relations", "entities")
    _, found = graph.neighbourhood(entities, relations, _focal(relations), 3, ["STANDARD", "MEDIUM", "LARGE"])
    return found.select("id", "source_id", "target_id")


_LOOK = """ SELECT id, name, CASE type WHEN 'PROMO' THEN 'Lugar' WHEN 'SMALL' THEN 'Objeto' WHEN 'LARGE' THEN 'Personagem' ELSE type END AS type,
  CASE type WHEN 'PROMO' THEN 'hexagon' WHEN 'SMALL' THEN 'triangle' WHEN 'LARGE' THEN 'ellipse' ELSE 'round-rectangle' END AS shape,
  CASE type WHEN 'PROMO' THEN '#06b6d4' WHEN 'SMALL' THEN '#10b981' WHEN 'LARGE' THEN '#8b5cf6' ELSE '#8b7f78' END AS color, CASE WHEN image <> '' THEN 1 ELSE 0 END AS has_image FROM entities"""


@query(
    """ SELECT 'node' AS kind, id, name AS a, type AS b, image AS c, canon_status AS d, description AS e FROM entities WHERE universe_id = '1'
    UNION ALL SELECT 'edge', id, source_id, target_id, label, CAST(bidirectional AS VARCHAR), importance FROM relations WHERE universe_id = '1'""",
    "entities", "relations",
)
def g01_whole_graph(spark, sf_dir):
    nodes, edges = graph.whole_graph(*_views(spark, sf_dir, "entities", "relations"), "1")
    c = F.col
    first = nodes.select(F.lit("node").alias("kind"), "id", c("name").alias("a"), c("type").alias("b"), c("image").alias("c"), c("canon_status").alias("d"), c("description").alias("e"))
    return first.unionByName(edges.select(F.lit("edge").alias("kind"), "id", c("source").alias("a"), c("target").alias("b"), c("label").alias("c"), c("bidirectional").cast("string").alias("d"), c("importance").alias("e")))


@query(
    """, f AS (SELECT CAST(min(CAST(source_id AS BIGINT)) AS VARCHAR) AS id FROM relations), r AS (SELECT * FROM relations WHERE source_id = (SELECT id FROM f) OR target_id = (SELECT id FROM f))
    SELECT 'edge' AS kind, id FROM r UNION ALL SELECT 'node', id FROM entities WHERE id IN (SELECT source_id FROM r UNION SELECT target_id FROM r UNION SELECT id FROM f)""",
    "entities", "relations",
)
def g04_closed_neighbourhood(spark, sf_dir):
    entities, relations = _views(spark, sf_dir, "entities", "relations")
    nodes, edges = graph.closed_neighbourhood(entities, relations, _focal(relations))
    return nodes.select(F.lit("node").alias("kind"), "id").unionByName(edges.select(F.lit("edge").alias("kind"), "id"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey <> l_suppkey")
def f15_new_relations(spark, sf_dir):
    asked = _table(spark, sf_dir, "lineitem").withColumns({"source_id": F.col("l_partkey").cast("string"), "target_id": F.col("l_suppkey").cast("string")})
    return graph.new_relations(asked).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(_LOOK, "entities")
def g03_visible_nodes(spark, sf_dir):
    (entities,) = _views(spark, sf_dir, "entities")
    known = F.when(F.col("type") == "PROMO", "Lugar").when(F.col("type") == "SMALL", "Objeto").when(F.col("type") == "LARGE", "Personagem").otherwise(F.col("type"))
    return graph.nodes(entities.withColumn("type", known)).select("id", "name", "type", "shape", "color", "has_image")


@query(
    """ SELECT e.id AS entity_id, r.id, CASE WHEN r.source_id = e.id THEN t.name ELSE s.name END AS other_name FROM entities e JOIN relations r ON r.source_id = e.id OR r.target_id = e.id
    JOIN entities s ON s.id = r.source_id JOIN entities t ON t.id = r.target_id WHERE e.type = 'PROMO'""",
    "entities", "relations",
)
def g05_relations_of_entities(spark, sf_dir):
    entities, relations = _views(spark, sf_dir, "entities", "relations")
    cards = graph.relation_cards(relations, entities)
    found = graph.relations_of(cards, entities.where("type = 'PROMO'"))
    return found.select("entity_id", "id", graph.other_name(F.col("entity_id")).alias("other_name"))


@query(" SELECT type, count(*) AS n FROM entities GROUP BY type", "entities")
def a08_types(spark, sf_dir):
    (entities,) = _views(spark, sf_dir, "entities")
    return graph.types_by_name(entities).join(entities.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "type")


_OUTCOME = """ SELECT coalesce(l.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'local' WHEN l.id IS NULL THEN 'insert' WHEN r.updated_at = l.updated_at AND r.content <> l.content THEN 'conflict'
  WHEN r.updated_at > l.updated_at THEN 'update' ELSE 'kept' END AS outcome, l.title AS lt, r.title AS rt, l.content AS lc, r.content AS rc, l.word_count AS lw, r.word_count AS rw, l.updated_at AS lu, r.updated_at AS ru
  FROM local_chapters l FULL JOIN remote_chapters r ON l.id = r.id"""


def _merged(spark, sf_dir):
    local, remote = _views(spark, sf_dir, "local_chapters", "remote_chapters")
    return merge.merge_table(local, remote, "chapters", NOW)


@query(
    f""", o AS ({_OUTCOME}) SELECT id, CASE WHEN outcome IN ('insert', 'update') THEN rt ELSE lt END AS title, CASE WHEN outcome IN ('insert', 'update') THEN rc ELSE lc END AS content,
    CAST(CASE WHEN outcome IN ('insert', 'update') THEN rw ELSE lw END AS INTEGER) AS word_count, CASE WHEN outcome IN ('insert', 'update') THEN ru ELSE lu END AS updated_at FROM o""",
    "local_chapters", "remote_chapters",
)
def q13_snapshot_merge(spark, sf_dir):
    return _merged(spark, sf_dir)[0].select("id", "title", "content", "word_count", "updated_at")


@query(f", o AS ({_OUTCOME}) SELECT outcome, count(*) AS n FROM o GROUP BY outcome", "local_chapters", "remote_chapters")
def q13_merge_outcomes(spark, sf_dir):
    return _merged(spark, sf_dir)[1].groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f", o AS ({_OUTCOME}) SELECT id AS aggregate_id, lc AS local_value, rc AS remote_value FROM o WHERE outcome = 'conflict'", "local_chapters", "remote_chapters")
def q13_merge_conflicts(spark, sf_dir):
    return merge.conflict_rows(_merged(spark, sf_dir)[1], NOW).select("aggregate_id", "local_value", "remote_value")


def _stepwise(spark, sf_dir):
    """A merge of a snapshot in JSON that has every third chapter twice and lacks the status of every seventh."""
    local, remote, books, stories = _views(spark, sf_dir, "local_chapters", "remote_chapters", "books", "stories")
    number = F.col("id").cast("long")
    given = remote.withColumn("status", F.when(number % 7 != 0, F.col("status"))).withColumn("pos", 2 * number)
    time = F.date_format(F.to_timestamp("updated_at") + F.make_dt_interval(number % 4 - 1), "yyyy-MM-dd HH:mm:ss")
    again = given.where(number % 3 == 0).withColumn("content", F.concat("content", F.lit("b"))).withColumn("updated_at", time).withColumn("pos", 2 * number + 1)
    fields = F.to_json(F.struct("id", "book_id", "title", "content", "word_count", "status", "updated_at"))  # null fields are left out
    snapshot = given.unionByName(again).select(F.lit("chapters").alias("name"), fields.alias("row"), "pos")
    names = ["id", "book_id", "title", "content", "word_count", "status", "updated_at"]
    rows = snapshots.import_table(snapshot, "chapters", names, steps=True)
    tables = {"chapters": with_defaults(local, "chapters", NOW), "books": with_defaults(books, "books", NOW), "stories": with_defaults(stories, "stories", NOW)}
    return merge.merge_snapshot(tables, {"chapters": rows}, NOW, check=False)


_STEPS = """, r AS (SELECT *, CAST(id AS BIGINT) AS k FROM remote_chapters),
two AS (SELECT id, book_id, title, CASE WHEN k % 7 <> 0 THEN status END AS status, content, word_count, updated_at, 1 AS step FROM r
  UNION ALL SELECT id, book_id, title, CASE WHEN k % 7 <> 0 THEN status END, content || 'b', word_count, strftime(CAST(updated_at AS TIMESTAMP) + to_days(CAST(k % 4 - 1 AS INTEGER)), '%Y-%m-%d %H:%M:%S'), 2 FROM r WHERE k % 3 = 0),
s0 AS (SELECT *, 'CANON' AS canon_status FROM local_chapters),
o1 AS (SELECT coalesce(l.id, t.id) AS id, CASE WHEN t.id IS NULL THEN 'local' WHEN l.id IS NULL THEN 'insert' WHEN l.updated_at = t.updated_at AND l.content <> t.content THEN 'conflict'
    WHEN t.updated_at > l.updated_at THEN 'update' ELSE 'kept' END AS outcome, l.title AS lt, l.content AS lc, l.status AS ls, l.word_count AS lw, l.updated_at AS lu, t.title, t.content, t.status, t.word_count, t.updated_at
  FROM s0 l FULL JOIN (SELECT * FROM two WHERE step = 1) t ON l.id = t.id),
s1 AS (SELECT id, outcome IN ('insert', 'update') AS x, CASE WHEN x THEN title ELSE lt END AS title, CASE WHEN x THEN content ELSE lc END AS content,
    CASE WHEN outcome = 'insert' THEN coalesce(status, 'IDEIA') WHEN x THEN coalesce(status, ls) ELSE ls END AS status, CASE WHEN x THEN word_count ELSE lw END AS word_count, CASE WHEN x THEN updated_at ELSE lu END AS updated_at FROM o1),
o2 AS (SELECT l.id, CASE WHEN t.id IS NULL THEN 'local' WHEN l.updated_at = t.updated_at AND l.content <> t.content THEN 'conflict' WHEN t.updated_at > l.updated_at THEN 'update' ELSE 'kept' END AS outcome,
    l.title AS lt, l.content AS lc, l.status AS ls, l.word_count AS lw, l.updated_at AS lu, t.title, t.content, t.status, t.word_count, t.updated_at
  FROM s1 l LEFT JOIN (SELECT * FROM two WHERE step = 2) t ON l.id = t.id),
s2 AS (SELECT id, outcome = 'update' AS x, CASE WHEN x THEN title ELSE lt END AS title, CASE WHEN x THEN content ELSE lc END AS content, CASE WHEN x THEN coalesce(status, ls) ELSE ls END AS status,
    CASE WHEN x THEN word_count ELSE lw END AS word_count, CASE WHEN x THEN updated_at ELSE lu END AS updated_at FROM o2),
both_steps AS (SELECT *, 2 * CAST(id AS BIGINT) AS pos FROM o1 UNION ALL SELECT *, 2 * CAST(id AS BIGINT) + 1 FROM o2)"""
_LOG_ID = f"md5(concat_ws('|', 'chapter', id, CAST(pos AS VARCHAR), '{NOW}')) AS id, '{NOW}' AS created_at"


@query(_STEPS + " SELECT id, title, content, status, 'CANON' AS canon_status, CAST(word_count AS INTEGER) AS word_count, updated_at FROM s2", "local_chapters", "remote_chapters")
def q13_stepwise_merge(spark, sf_dir):
    return _stepwise(spark, sf_dir).tables["chapters"].select("id", "title", "content", "status", "canon_status", "word_count", "updated_at")


@query(_STEPS + " SELECT id AS aggregate_id, lc AS local_value, content AS remote_value FROM both_steps WHERE outcome = 'conflict'", "local_chapters", "remote_chapters")
def q13_stepwise_conflicts(spark, sf_dir):
    return _stepwise(spark, sf_dir).conflicts.select("aggregate_id", "local_value", "remote_value")


@query(
    _STEPS + " SELECT 'chapters' AS name, count(*) FILTER (outcome IN ('insert', 'update')) AS applied, count(*) FILTER (outcome = 'conflict') AS conflicts FROM both_steps",
    "local_chapters", "remote_chapters",
)
def q13_stepwise_counts(spark, sf_dir):
    return _stepwise(spark, sf_dir).counts().withColumnRenamed("table", "name")


@query(
    _STEPS + """, u AS (SELECT lr.id, s.universe_id FROM (SELECT id, book_id FROM local_chapters UNION SELECT id, book_id FROM remote_chapters) lr JOIN books b ON b.id = lr.book_id JOIN stories s ON s.id = b.story_id)
    SELECT """ + _LOG_ID + """, 'chapter' AS entity_type, id AS entity_id, CASE WHEN outcome = 'insert' THEN 'create' ELSE outcome END AS action, CASE WHEN outcome = 'insert' THEN '' WHEN lt <> title THEN 'title' WHEN coalesce(status, ls) <> ls THEN 'status' ELSE 'content' END AS field,
    CASE WHEN outcome = 'insert' THEN '' WHEN lt <> title THEN lt WHEN coalesce(status, ls) <> ls THEN ls ELSE CAST(lw AS VARCHAR) END AS old_value,
    CASE WHEN outcome = 'insert' OR lt <> title THEN title WHEN coalesce(status, ls) <> ls THEN status ELSE CAST(word_count AS VARCHAR) END AS new_value, universe_id
    FROM both_steps JOIN u USING (id) WHERE outcome IN ('insert', 'update')""",
    "local_chapters", "remote_chapters", "books", "stories",
)
def q13_merge_history(spark, sf_dir):
    return _stepwise(spark, sf_dir).history()["change_log"]


@query(_STEPS + f" SELECT {_LOG_ID.replace('chapter', 'revision')}, id AS chapter_id, lt AS title, lc AS content, lw AS word_count FROM both_steps WHERE outcome = 'update' AND (lt <> title OR lc <> content)", "local_chapters", "remote_chapters")
def q13_merge_revisions(spark, sf_dir):
    return _stepwise(spark, sf_dir).history()["chapter_revisions"].withColumn("word_count", F.col("word_count").cast("long"))


@query(
    f""", o AS ({_OUTCOME}) SELECT CAST((SELECT count(*) FROM o) AS BIGINT) AS received, CAST((SELECT count(*) FROM local_chapters) AS BIGINT) AS sent,
    CAST(2 * (SELECT count(*) FROM o WHERE outcome = 'conflict') AS BIGINT) AS conflicts""",
    "local_chapters", "remote_chapters",
)
def q13_exchange_counts(spark, sf_dir):
    local, remote = ({"chapters": v} for v in _views(spark, sf_dir, "local_chapters", "remote_chapters"))
    return merge.exchange_counts(local, *merge.exchange(local, remote, NOW))


@query(
    """ SELECT n.id AS entity_id, CASE WHEN o.id IS NULL THEN 'create' ELSE 'update' END AS action,
    CASE WHEN o.id IS NULL THEN '' WHEN o.title <> n.title THEN 'title' WHEN o.status <> n.status THEN 'status' ELSE 'content' END AS field,
    CASE WHEN o.id IS NULL THEN '' WHEN o.title <> n.title THEN o.title WHEN o.status <> n.status THEN o.status ELSE CAST(o.word_count AS VARCHAR) END AS old_value,
    CASE WHEN o.id IS NULL THEN n.title WHEN o.title <> n.title THEN n.title WHEN o.status <> n.status THEN n.status ELSE CAST(n.word_count AS VARCHAR) END AS new_value, s.universe_id
    FROM remote_chapters n LEFT JOIN local_chapters o ON o.id = n.id JOIN books b ON b.id = n.book_id JOIN stories s ON s.id = b.story_id""",
    "local_chapters", "remote_chapters", "books", "stories",
)
def q14_change_capture(spark, sf_dir):
    old, new, books, stories = _views(spark, sf_dir, "local_chapters", "remote_chapters", "books", "stories")
    log = changes.chapter_log(changes.row_pairs(old, new), books, stories)
    return log.select("entity_id", "action", "field", "old_value", "new_value", "universe_id")


@query(
    " SELECT o.id AS chapter_id, o.title, o.content, o.word_count FROM local_chapters o JOIN remote_chapters n ON n.id = o.id WHERE o.title <> n.title OR o.content <> n.content",
    "local_chapters", "remote_chapters",
)
def q14_chapter_revisions(spark, sf_dir):
    old, new = _views(spark, sf_dir, "local_chapters", "remote_chapters")
    return changes.revisions(changes.row_pairs(old, new), NOW).select("chapter_id", "title", "content", "word_count")


@query(" SELECT id AS entity_id, 'create' AS action, name AS new_value FROM entities WHERE CAST(id AS BIGINT) % 3 = 0 UNION ALL SELECT id, 'update', name FROM entities WHERE CAST(id AS BIGINT) % 3 = 1", "entities")
def c05_entity_changes(spark, sf_dir):
    (entities,) = _views(spark, sf_dir, "entities")
    number = F.col("id").cast("long") % 3
    pairs = changes.row_pairs(entities.where(number != 0), entities.where(number != 2))
    return changes.entity_log(pairs).select("entity_id", "action", "new_value")


def _key_and_iv():
    """Fixed, as the rows must come out alike each time; real shares draw both at random."""
    return F.lit("0123456789abcdef0123456789abcdef"), F.lit("abcdefghijkl").cast("binary")


@query(
    """SELECT doc_id, coalesce(text, '') AS document, 16 AS iv_chars, ceil((octet_length(encode(coalesce(text, ''))) + 16) * 4 / 3) BETWEEN 24 AND 2800000 AS valid
    FROM documents WHERE octet_length(encode(coalesce(text, ''))) <= 2000000"""
)
def q15_share_round_trip(spark, sf_dir):
    key, iv = _key_and_iv()
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("document"))
    sealed = docs.where(share.small_enough(F.col("document"))).select("doc_id", share.encrypt(F.col("document"), key, iv).alias("e"))
    return sealed.select("doc_id", share.decrypt(F.col("e"), key).alias("document"), F.length("e.iv").alias("iv_chars"), share.valid_envelope(F.col("e"), F.lit(7)).alias("valid"))


_ATTRIBUTES = "a AS (SELECT id AS entity_id, 'brand' AS key, CASE WHEN type = 'PROMO' THEN ' ' ELSE description END AS value FROM entities)"


@query(
    f""", {_ATTRIBUTES}, cat AS (SELECT s.universe_id, c.id, c.title, c.content, b.name AS book_name, s.name AS story_name FROM chapters c JOIN books b ON c.book_id = b.id JOIN stories s ON b.story_id = s.id),
    w AS (SELECT universe_id, 64 + octet_length(encode(concat(id, title, content, story_name, book_name))) AS w FROM cat
      UNION ALL SELECT universe_id, 64 + octet_length(encode(concat(id, type, name, description, image))) FROM entities
      UNION ALL SELECT e.universe_id, 64 + octet_length(encode(concat(a.key, a.value))) FROM a JOIN entities e ON e.id = a.entity_id WHERE trim(a.value) <> ''),
    size AS (SELECT universe_id, CAST(sum(w) AS BIGINT) AS bytes FROM w GROUP BY 1),
    ch AS (SELECT universe_id, md5(string_agg(concat(id, title, content, story_name, book_name), ',' ORDER BY id, title)) AS chapters FROM cat GROUP BY 1),
    en AS (SELECT universe_id, md5(string_agg(concat(e.id, e.type, e.name, CASE WHEN trim(a.value) <> '' THEN concat(a.key, '=', a.value) ELSE '' END), ',' ORDER BY e.id)) AS entities FROM entities e JOIN a ON a.entity_id = e.id GROUP BY 1)
    SELECT u.id AS universe_id, coalesce(bytes, 0) AS bytes, CASE WHEN coalesce(bytes, 0) <= 2000000 THEN u.name END AS title,
    CASE WHEN bytes <= 2000000 THEN chapters END AS chapters, CASE WHEN bytes <= 2000000 THEN entities END AS entities
    FROM universes u LEFT JOIN size ON size.universe_id = u.id LEFT JOIN ch ON ch.universe_id = u.id LEFT JOIN en ON en.universe_id = u.id""",
    "universes", "stories", "books", "chapters", "entities",
)
def q15_share_bundles(spark, sf_dir):
    universes, stories, books, chapters, entities = _views(spark, sf_dir, "universes", "stories", "books", "chapters", "entities")
    attributes = entities.select(F.col("id").alias("entity_id"), F.lit("brand").alias("key"), F.when(F.col("type") == "PROMO", " ").otherwise(F.col("description")).alias("value"), F.lit(0).alias("sort_order"))
    found = share.bundles(universes, hierarchy.chapter_catalogue(chapters, books, stories), entities, attributes, NOW)
    # opened again as a reader does
    chapter, attribute = "struct<id: string, title: string, content: string, storyName: string, bookName: string>", "struct<key: string, value: string>"
    entity = f"struct<id: string, type: string, name: string, attributes: array<{attribute}>>"
    read = F.from_json("document", f"title string, chapters array<{chapter}>, entities array<{entity}>")

    def hashed(column, line):
        return F.md5(F.array_join(F.transform(column, line), ","))

    lines = lambda a: F.array_join(F.transform(a, lambda x: F.concat(x["key"], F.lit("="), x["value"])), "")
    return found.withColumn("d", read).select(
        "universe_id", "bytes", F.col("d.title").alias("title"),
        hashed("d.chapters", lambda c: F.concat(c["id"], c["title"], c["content"], c["storyName"], c["bookName"])).alias("chapters"),
        hashed("d.entities", lambda e: F.concat(e["id"], e["type"], e["name"], F.coalesce(lines(e["attributes"]), F.lit("")))).alias("entities"),
    )


@query(f", {_ATTRIBUTES} SELECT entity_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY key) AS k FROM (SELECT * FROM a UNION ALL SELECT a.entity_id, concat('k', lpad(CAST(i AS VARCHAR), 2, '0')), a.value FROM a, range(60) t(i))) WHERE k <= 40", "entities")
def o09_shown_attributes(spark, sf_dir):
    (entities,) = _views(spark, sf_dir, "entities")
    value = F.when(F.col("type") == "PROMO", " ").otherwise(F.col("description"))
    keys = F.array(F.lit("brand"), *(F.lit(f"k{i:02d}") for i in range(60)))
    return share.shown_attributes(entities.select(F.col("id").alias("entity_id"), F.explode(keys).alias("key"), value.alias("value"), F.lit(0).alias("sort_order"))).select("entity_id", "key", "value")


_GONE = """, gb AS (SELECT b.id FROM books b JOIN stories s ON b.story_id = s.id WHERE s.universe_id = '1'), gc AS (SELECT id FROM chapters WHERE book_id IN (SELECT id FROM gb)),
ge AS (SELECT id FROM entities WHERE universe_id = '1')"""


@query(
    _GONE + """ SELECT 'stories' AS kind, id FROM stories WHERE universe_id <> '1' UNION ALL SELECT 'books', id FROM books WHERE id NOT IN (SELECT id FROM gb)
    UNION ALL SELECT 'chapters', id FROM chapters WHERE id NOT IN (SELECT id FROM gc) UNION ALL SELECT 'entities', id FROM entities WHERE universe_id <> '1'
    UNION ALL SELECT 'relations', id FROM relations WHERE universe_id <> '1' AND source_id NOT IN (SELECT id FROM ge) AND target_id NOT IN (SELECT id FROM ge)
    UNION ALL SELECT 'mentions', id FROM mentions WHERE chapter_id NOT IN (SELECT id FROM gc) AND entity_id NOT IN (SELECT id FROM ge)
    UNION ALL SELECT 'entity_attributes', id || '-a' FROM entities WHERE universe_id <> '1' UNION ALL SELECT 'entity_templates', id || '-t' FROM universes WHERE id <> '1'
    UNION ALL SELECT 'chapter_revisions', id || '-r' FROM chapters WHERE id NOT IN (SELECT id FROM gc) UNION ALL SELECT 'timeline_events', id FROM timeline_events WHERE universe_id <> '1'
    UNION ALL SELECT 'timeline cleared', id FROM timeline_events WHERE universe_id <> '1' AND sort_key IS NOT NULL AND CAST(CAST(floor(sort_key) AS BIGINT) AS VARCHAR) IN (SELECT id FROM ge)
    UNION ALL SELECT 'planning_items', id FROM planning_items WHERE universe_id <> '1' UNION ALL SELECT 'planning cleared', id FROM planning_items WHERE universe_id <> '1' AND chapter_id IN (SELECT id FROM gc)
    UNION ALL SELECT 'attachments', 'e' || e.id FROM entities e WHERE CAST(e.id AS BIGINT) % 2 = 0 AND e.id NOT IN (SELECT id FROM ge) UNION ALL SELECT 'attachments', 'c' || id FROM chapters WHERE id NOT IN (SELECT id FROM gc)""",
    "universes", "stories", "books", "chapters", "entities", "relations", "mentions", "timeline_events", "planning_items",
)
def q16_cascade_delete(spark, sf_dir):
    names = ["universes", "stories", "books", "chapters", "entities", "relations", "mentions", "timeline_events", "planning_items"]
    tables = dict(zip(names, _views(spark, sf_dir, *names), strict=True))
    entities, chapters = tables["entities"], tables["chapters"]
    c, with_id = F.col, lambda suffix: F.concat("id", F.lit(suffix)).alias("id")
    tables["timeline_events"] = tables["timeline_events"].withColumn("entity_id", c("sort_key").cast("long").cast("string"))
    tables["entity_attributes"] = entities.select(with_id("-a"), c("id").alias("entity_id"))
    tables["entity_templates"] = tables["universes"].select(with_id("-t"), c("id").alias("universe_id"))
    tables["chapter_revisions"] = chapters.select(with_id("-r"), c("id").alias("chapter_id"))
    # attachments hang on their owners; their own universe is one that stays
    owned = [(entities.where(c("id").cast("long") % 2 == 0), "entity", "e"), (chapters, "chapter", "c")]
    parts = [d.select(F.concat(F.lit(p), "id").alias("id"), F.lit("0").alias("universe_id"), F.lit(kind).alias("owner_type"), c("id").alias("owner_id")) for d, kind, p in owned]
    tables["attachments"] = parts[0].unionByName(parts[1])
    left = dml.cascade_delete(tables, "universes", spark.createDataFrame([("1",)], "id string"))
    out = None
    for name in tables:
        if name != "universes":
            part = left[name].select(F.lit(name).alias("kind"), "id")
            out = part if out is None else out.unionByName(part)
    for name, column in (("planning_items", "chapter_id"), ("timeline_events", "entity_id")):
        had = tables[name].where(c(column).isNotNull()).select("id")
        out = out.unionByName(left[name].where(c(column).isNull()).join(had, "id", "left_semi").select(F.lit(f"{name.split('_')[0]} cleared").alias("kind"), "id"))
    return out


_POSITIONS = """, cur AS (SELECT story_id, max(sort_order) AS last FROM books WHERE CAST(id AS BIGINT) % 2 = 0 GROUP BY 1)
SELECT b.id, b.story_id, CAST(coalesce(cur.last, -1) + row_number() OVER (PARTITION BY b.story_id ORDER BY b.id) AS INTEGER) AS sort_order FROM books b LEFT JOIN cur ON cur.story_id = b.story_id WHERE CAST(b.id AS BIGINT) % 2 = 1"""


@query(_POSITIONS, "books")
def k02_next_positions(spark, sf_dir):
    (books,) = _views(spark, sf_dir, "books")
    odd = F.col("id").cast("long") % 2
    return dml.next_positions(books.where(odd == 0), books.where(odd == 1).drop("sort_order"), "story_id", ["id"]).select("id", "story_id", "sort_order")


@query(
    f""" SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN '' ELSE name END AS name, CASE WHEN CAST(id AS BIGINT) % 4 = 2 THEN 'patched' ELSE description END AS description,
    CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN '{NOW}' ELSE updated_at END AS updated_at FROM entities""",
    "entities",
)
def k03_partial_update(spark, sf_dir):
    (entities,) = _views(spark, sf_dir, "entities")
    number = F.col("id").cast("long")
    fields = F.when(number % 4 == 0, F.create_map(F.lit("name"), F.lit(""))).otherwise(F.create_map(F.lit("description"), F.lit("patched")))
    return dml.patch(entities, entities.where(number % 2 == 0).select("id", fields.alias("fields")), NOW).select("id", "name", "description", "updated_at")


@query(" SELECT id, CAST(CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN row_number() OVER (PARTITION BY story_id, CAST(id AS BIGINT) % 2 ORDER BY id DESC) - 1 ELSE sort_order END AS INTEGER) AS sort_order FROM books", "books")
def k05_reorder(spark, sf_dir):
    (books,) = _views(spark, sf_dir, "books")
    even = books.where(F.col("id").cast("long") % 2 == 0)
    order = even.groupBy("story_id").agg(F.reverse(F.array_sort(F.collect_list("id"))).alias("ids"))
    return dml.reorder(books, order, "story_id").select("id", "sort_order")


_UPSERT = """WITH a AS (SELECT doc_id, unnest(['lang', 'source']) AS key, unnest([lang, source]) AS value, unnest([0, 1]) AS sort_order FROM documents),
v AS (SELECT doc_id, unnest(['source', 'size']) AS key, unnest(['changed', CAST(n_chars AS VARCHAR)]) AS value FROM documents WHERE doc_id % 3 = 0)
SELECT CAST(a.doc_id AS VARCHAR) AS entity_id, a.key, coalesce(v.value, a.value) AS value, CAST(a.sort_order AS INTEGER) AS sort_order FROM a LEFT JOIN v USING (doc_id, key)
UNION ALL SELECT CAST(doc_id AS VARCHAR), key, value, 2 FROM v WHERE key = 'size'"""


@query(_UPSERT)
def k06_set_attributes(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    owner = F.col("doc_id").cast("string").alias("entity_id")
    own = docs.select(owner, F.posexplode(F.array(F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("key"), F.col("source").alias("value")))).alias("sort_order", "a"))
    own = own.select(F.md5(F.concat_ws("|", "entity_id", "a.key")).alias("id"), "entity_id", "a.key", "a.value", "sort_order")
    new = docs.where("doc_id % 3 = 0").select(owner, F.explode(F.create_map(F.lit("source"), F.lit("changed"), F.lit("size"), F.col("n_chars").cast("string"))).alias("key", "value"))
    return dml.set_attributes(own, new).select("entity_id", "key", "value", "sort_order")


_DEFAULTS = ", ".join(f"('{t}', '{k}', {i}, {len(keys)})" for t, keys in DEFAULT_ATTRIBUTES.items() for i, k in enumerate(keys))
_TYPED = "SELECT CAST(p_partkey AS {0}) AS id, CAST(p_partkey % 5 AS {0}) AS universe_id, CASE p_type WHEN 'PROMO' THEN 'Lugar' WHEN 'SMALL' THEN 'Objeto' ELSE p_type END AS type FROM {1}"
_TEMPLATES = [("0", "Lugar", "Clima", "x", 0), ("0", "Lugar", "Altitude", "0 m", 1), ("1", "LARGE", "Peso", "", 0), ("2", "Objeto", "Valor", "1", 3)]


@query(
    f"""WITH d(type, key, pos, n) AS (VALUES {_DEFAULTS}), e AS ({_TYPED.format('VARCHAR', 'part')}), t(universe_id, type, key, value, pos) AS (VALUES {", ".join(map(str, _TEMPLATES))})
    SELECT e.id AS entity_id, d.key, '' AS value, d.pos AS sort_order FROM e JOIN d USING (type)
    UNION ALL SELECT e.id, t.key, t.value, t.pos + coalesce((SELECT max(n) FROM d WHERE d.type = t.type), 0) FROM e JOIN t USING (universe_id, type) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.type = t.type AND d.key = t.key)"""
)
def k07_seed_attributes(spark, sf_dir):
    entities = spark.sql(_TYPED.format("STRING", "{part}"), part=_table(spark, sf_dir, "part"))
    templates = spark.createDataFrame([(str(k), *t) for k, t in enumerate(_TEMPLATES)], "id string, universe_id string, entity_type string, attribute_key string, default_value string, sort_order int")
    return dml.seed_attributes(entities, templates).select("entity_id", "key", "value", "sort_order")


@query(
    f""", cur AS (SELECT id AS chapter_id, status AS entity_id, 'old' AS created_at FROM chapters), want AS (SELECT id AS chapter_id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN status ELSE 'new' END AS entity_id FROM chapters WHERE CAST(id AS BIGINT) % 2 = 0)
    SELECT cur.chapter_id, cur.entity_id, cur.created_at FROM cur WHERE CAST(chapter_id AS BIGINT) % 2 = 1 OR EXISTS (SELECT 1 FROM want w WHERE w.chapter_id = cur.chapter_id AND w.entity_id = cur.entity_id)
    UNION ALL SELECT w.chapter_id, w.entity_id, '{NOW}' FROM want w WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.chapter_id = w.chapter_id AND cur.entity_id = w.entity_id)""",
    "chapters",
)
def k12_sync_mentions(spark, sf_dir):
    (chapters,) = _views(spark, sf_dir, "chapters")
    number = F.col("id").cast("long")
    current = chapters.select(F.col("id"), F.col("id").alias("chapter_id"), F.col("status").alias("entity_id"), F.lit("old").alias("created_at"))
    even = chapters.where(number % 2 == 0)
    wanted = even.select(F.col("id").alias("chapter_id"), F.when(number % 3 == 0, F.col("status")).otherwise("new").alias("entity_id"))
    return mentions.sync_mentions(current, wanted, wanted.select("chapter_id"), NOW).select("chapter_id", "entity_id", "created_at")


@query(" SELECT id, name FROM entities WHERE translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%d w_d%' ORDER BY name, id LIMIT 10", "entities")
def f04_search_entities(spark, sf_dir):
    (entities,) = _views(spark, sf_dir, "entities")
    return search.search_entities(entities, "D W_D").select("id", "name")


@query(" SELECT id, name FROM entities WHERE contains(lower(concat_ws(' ', name, type, description)), 'brand#2')", "entities")
def f06_filter_entities(spark, sf_dir):
    (entities,) = _views(spark, sf_dir, "entities")
    return search.filter_entities(entities, "  BRAND#2 ").select("id", "name")


@query("SELECT event_id, length(props) >= 9 AND event_id % 4 < 3 AS valid FROM events")
def f11_envelope_validation(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    body = F.rpad(F.lit("A"), 24, "b")
    cipher = F.when(F.length("props") >= 9, body).otherwise(F.substring(body, 1, 23))
    e = F.struct(F.lit(1).alias("version"), F.lit("A256GCM").alias("algorithm"), F.lit("abcdefghijklmnop").alias("iv"), cipher.alias("ciphertext"))
    days = F.element_at(F.array(*map(F.lit, (1, 7, 30, 365))), (F.col("event_id") % 4 + 1).cast("int"))
    return rows.select("event_id", e.alias("e"), days.alias("days")).select("event_id", share.valid_envelope(F.col("e"), F.col("days")).alias("valid"))


@query(
    """, i AS (SELECT id, CASE WHEN chapter_id IS NULL THEN 'CONCLUIDO' ELSE status END AS status FROM planning_items UNION ALL SELECT concat(id, '-null'), NULL FROM planning_items)
    SELECT id, status, coalesce(status IN ('IDEIAS', 'PLANEJADO', 'ESCREVENDO', 'REVISAO', 'FINALIZADO'), false) AS valid FROM i""",
    "planning_items",
)
def f14_status_check(spark, sf_dir):
    (items,) = _views(spark, sf_dir, "planning_items")
    asked = items.select("id", F.when(F.col("chapter_id").isNull(), "CONCLUIDO").otherwise(F.col("status")).alias("status"))
    asked = asked.unionByName(items.select(F.concat("id", F.lit("-null")).alias("id"), F.lit(None).cast("string").alias("status")))
    good, bad = boards.check_status(asked)
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


@query("SELECT event_id, regexp_full_match(c, '[0-9]{6}') AS valid, regexp_full_match(c, '[0-9]{6}') AND c = '000420' AS paired FROM (SELECT event_id, lpad(CAST(event_id AS VARCHAR), CAST(5 + event_id % 3 AS INTEGER), '0') AS c FROM events)")
def f12_pairing_codes(spark, sf_dir):
    length = (F.col("event_id") % 3 + 5).cast("int")
    code = F.concat(F.lit(" "), F.lpad(F.col("event_id").cast("string"), length, F.lit("0")), F.lit("\t"))
    return _table(spark, sf_dir, "events").select("event_id", text.is_pairing_code(code).alias("valid"), text.pairs_with(code, F.lit("000420")).alias("paired"))


@query("SELECT doc_id, trim(lower(strip_accents(text))) AS norm FROM documents")
def n01_normalise(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.normalise("text").alias("norm"))


@query(r"""SELECT page_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '[\s\x0B]+')) END AS INTEGER) AS words
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS t FROM pages)""")
def n02_word_count(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.word_count(F.col("html")).alias("words"))


@query(f"WITH {_LINES} SELECT text_id AS doc_id, unnest(ps) AS paragraph, generate_subscripts(ps, 1) - 1 AS pos FROM lines")
def n03_paragraphs(spark, sf_dir):
    return _pages(spark, sf_dir).select(F.col("text_id").alias("doc_id"), F.posexplode(text.html_paragraphs("html")).alias("pos", "paragraph"))


@query()
def n03_page_paragraphs(spark, sf_dir):
    return _dealt(spark, sf_dir, "pages", "page_id").select("page_id", F.posexplode(text.html_paragraphs("html")).alias("pos", "paragraph"))


_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    f"""SELECT doc_id, '<h2>' || coalesce(lang, '') || '</h2>' || array_to_string(list_transform(string_split({_ESCAPED.format("coalesce(text, '')")}, chr(10)), lambda x: '<p>' || x || '</p>'), '')
    || '<ul><li>' || coalesce(source, '') || '</li></ul>' || 'alert(1)more' AS html FROM documents"""
)
def n23_sanitised_texts(spark, sf_dir):
    more = "<script type=x>alert(1)</script><div><a href='q'>more</a></div><img src=x>"
    html = _pages(spark, sf_dir).select(F.col("text_id").alias("doc_id"), F.concat("html", F.lit(more)).alias("html"))
    return html.select("doc_id", text.sanitise_html("html").alias("html"))


@query()
def n23_sanitised_pages(spark, sf_dir):
    return _dealt(spark, sf_dir, "pages", "page_id").select("page_id", text.sanitise_html("html").alias("html"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '(?i)https?://[^\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', 0), '') AS url FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -page_id, html FROM pages)")
def n06_first_urls(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(_table(spark, sf_dir, "pages").select((-F.col("page_id")).alias("doc_id"), F.col("html").alias("text")))
    return rows.select("doc_id", text.first_url(F.col("text")).alias("url"))


_CODES = r"""SELECT page_id, regexp_extract(html, '(?i)https?://[^\s<"]+', 0) AS seen, sha256(url) AS sha, rtrim(translate(base64(encode(url)), '+/', '-_'), '=') AS code,
  url AS back, CASE WHEN trim(url) = '' THEN 'untitled' ELSE url[1:20] END AS title, replace(CAST(format('{:,}', page_id * 1000) AS VARCHAR), ',', '.') AS number FROM pages"""


@query(_CODES)
def n18_codes(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    code = text.base64url(F.col("url").cast("binary"))
    return pages.select(
        "page_id", F.coalesce(text.first_url(F.regexp_extract("html", r'(?i)https?://[^\s<"]+', 0)), F.lit("")).alias("seen"), F.sha2("url", 256).alias("sha"), code.alias("code"),
        text.from_base64url(code).cast("string").alias("back"), text.default_text(F.col("url"), "untitled", 20).alias("title"), text.number_text(F.col("page_id") * 1000).alias("number"),
    )


_WHOLE = rf"regexp_replace(coalesce(text, ''), '^{_BLANK}|{_BLANK}$', '', 'g')"


@query(
    f"""SELECT doc_id, CASE WHEN t = '' THEN '<p></p>' WHEN regexp_matches(t, '(?i)<(?:p|h[1-6]|ul|ol|li|blockquote|img|hr|div|br)\\b') THEN text
    ELSE '<p>' || replace(array_to_string(regexp_split_to_array({_ESCAPED.format("t")}, '\\n{{2,}}'), '</p><p>'), chr(10), '<br>') || '</p>' END AS html FROM (SELECT doc_id, text, {_WHOLE} AS t FROM documents)"""
)
def n07_to_html(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.to_html(F.col("text")).alias("html"))


_AGE = """SELECT event_id, CASE WHEN m < 2 THEN 'Editado agora' WHEN m < 60 THEN 'Editado há ' || m || ' min' WHEN m // 60 < 24 THEN 'Editado há ' || (m // 60) || ' h'
  WHEN m // 1440 < 30 THEN 'Editado há ' || (m // 1440) || ' dia' || CASE WHEN m // 1440 = 1 THEN '' ELSE 's' END
  ELSE strftime(s, '%d') || ' de ' || (['jan.', 'fev.', 'mar.', 'abr.', 'mai.', 'jun.', 'jul.', 'ago.', 'set.', 'out.', 'nov.', 'dez.'])[month(s)] || ' de ' || strftime(s, '%Y') END AS age
FROM (SELECT event_id, date_trunc('second', ts) AS s, greatest(0, epoch_ms(TIMESTAMP '2024-02-20 00:00:00') - epoch_ms(date_trunc('second', ts))) // 60000 AS m FROM events)"""


@query(_AGE)
def n08_relative_age(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    now = F.unix_millis(F.to_timestamp(F.lit("2024-02-20T00:00:00Z")))
    return rows.select("event_id", text.relative_age(F.col("at"), now).alias("age"))


@query("SELECT event_id, ts + CASE event_id % 3 WHEN 0 THEN INTERVAL 1 DAY WHEN 1 THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END > TIMESTAMP '2024-01-12 00:00:00' AS alive FROM events WHERE event_id % 5 > 0 OR event_type <> 'view'")
def s07_share_expiry(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    days = F.element_at(F.array(*map(F.lit, share.DAYS)), (F.col("event_id") % 3 + 1).cast("int"))
    stored = rows.select("event_id", F.col("event_id").cast("string").alias("id"), F.sha2(F.concat(F.lit("t"), "event_id"), 256).alias("revoke_hash"), share.expires_at(F.col("ts"), share.expiry_days(days)).alias("expires_at"))
    token = F.when(F.col("event_type") == "view", F.concat(F.lit("t"), "event_id")).otherwise("wrong")
    left = share.revoke(stored, rows.where("event_id % 5 = 0").select(F.col("event_id").cast("string").alias("id"), token.alias("token")))
    alive, dead = share.split_expired(left, F.lit("2024-01-12 00:00:00").cast("timestamp_ntz"))
    return alive.select("event_id", F.lit(True).alias("alive")).unionByName(dead.select("event_id", F.lit(False).alias("alive")))


@query(" SELECT 'universes' AS name, count(*) AS n FROM universes UNION ALL SELECT 'stories', count(*) FROM stories UNION ALL SELECT 'chapters', count(*) FROM chapters", "universes", "stories", "chapters")
def s04_snapshot_counts(spark, sf_dir):
    names = ["universes", "stories", "chapters"]
    return snapshots.row_counts(snapshots.export_snapshot(dict(zip(names, _views(spark, sf_dir, *names), strict=True))))


@query(" SELECT id, book_id, title, content, status, CAST(sort_order AS INTEGER) AS sort_order, updated_at FROM chapters", "chapters")
def s06_snapshot_import(spark, sf_dir):
    (chapters,) = _views(spark, sf_dir, "chapters")
    columns = ["id", "book_id", "title", "content", "status", "sort_order", "updated_at"]
    return snapshots.import_table(snapshots.export_snapshot({"chapters": chapters}), "chapters", columns)


_BURSTS = """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events),
b AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM e)
SELECT user_id, arg_max(event_type, ts) AS event_type, count(*) AS n FROM b GROUP BY user_id, burst"""


@query(_BURSTS)
def t01_debounce(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.debounced(rows, "user_id", "ts", "event_type", "30 minutes").select("user_id", "event_type", "n")


_LIMITED = """WITH RECURSIVE e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS client, (epoch_us(ts) // 240) // 1000 AS t FROM events),
n AS (SELECT client, t, min(t) OVER (PARTITION BY client ORDER BY t RANGE BETWEEN 3600000 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM e),
w AS (SELECT client, min(t) AS s FROM e GROUP BY client UNION SELECT n.client, n.later FROM w JOIN n ON n.client = w.client AND n.t = w.s WHERE n.later IS NOT NULL),
p AS (SELECT e.event_id, e.client, e.t, w.s FROM e ASOF JOIN w ON e.client = w.client AND e.t >= w.s)
SELECT event_id, client, t, row_number() OVER (PARTITION BY client, s ORDER BY t, event_id) <= 20 AS allowed FROM p"""


@query(_LIMITED)
def t04_rate_limit(spark, sf_dir):
    # the month of events in three hours, so that some clients ask too often
    rows = _table(spark, sf_dir, "events").withColumn("at", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 240).cast("long")))
    return events.rate_limited(rows, "user_id", "at", "event_id")


_ASKED = "('1', '3', '17', 'none')"


@query(
    f""" SELECT 'universe' AS kind, id, name AS label FROM universes WHERE id IN {_ASKED} UNION ALL SELECT 'story', id, name FROM stories WHERE id IN {_ASKED} UNION ALL SELECT 'book', id, name FROM books WHERE id IN {_ASKED}
    UNION ALL SELECT 'chapter', id, title FROM chapters WHERE id IN {_ASKED} UNION ALL SELECT 'entity', id, name FROM entities WHERE id IN {_ASKED}""",
    "universes", "stories", "books", "chapters", "entities",
)
def s03_point_lookups(spark, sf_dir):
    kinds = {"universe": "universes", "story": "stories", "book": "books", "chapter": "chapters", "entity": "entities"}
    out = None
    for kind, name in kinds.items():
        (rows,) = _views(spark, sf_dir, name)
        part = reads.by_ids(rows, ["1", "3", "17", "none"]).select(F.lit(kind).alias("kind"), "id", F.col("title" if kind == "chapter" else "name").alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


@query(" SELECT id, name, sort_order FROM books WHERE story_id = '7' AND sort_order >= 20", "books")
def s01_parameterised_select(spark, sf_dir):
    (books,) = _views(spark, sf_dir, "books")
    return reads.select(spark, "SELECT id, name, sort_order FROM {books} WHERE story_id = :story AND sort_order >= :least", {"books": books}, story="7", least=20)


@query(" SELECT id, name FROM stories WHERE universe_id = '2' ORDER BY sort_order, id LIMIT 1", "stories")
def s02_first_row(spark, sf_dir):
    (stories,) = _views(spark, sf_dir, "stories")
    row = reads.select_one(reads.children(stories, "universe_id", "2").select("id", "name"))
    return spark.createDataFrame([] if row is None else [(row["id"], row["name"])], "id string, name string")


@query(
    """ SELECT 'timeline' AS kind, id FROM timeline_events WHERE universe_id = '3' UNION ALL SELECT 'planning', id FROM planning_items WHERE universe_id = '3'
    UNION ALL SELECT 'history', id FROM change_log WHERE universe_id = '3' UNION ALL SELECT 'relation', id FROM relations WHERE universe_id = '3'""",
    "timeline_events", "planning_items", "change_log", "relations",
)
def f01_universe_rows(spark, sf_dir):
    out = None
    for kind, rows in zip(("timeline", "planning", "history", "relation"), _views(spark, sf_dir, "timeline_events", "planning_items", "change_log", "relations"), strict=True):
        part = reads.of_universe(rows, "3").select(F.lit(kind).alias("kind"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    " SELECT 'typed' AS kind, id, name FROM entities WHERE universe_id = '2' AND type = 'PROMO' UNION ALL SELECT 'any', id, name FROM entities WHERE universe_id = '2' UNION ALL SELECT 'drafts', id, name FROM entities WHERE universe_id = '2' AND type = 'PROMO' AND canon_status = 'RASCUNHO'",
    "entities",
)
def f02_matching_entities(spark, sf_dir):
    (entities,) = _views(spark, sf_dir, "entities")
    asked = {"typed": {"type": "PROMO"}, "any": {"type": None}, "drafts": {"type": "PROMO", "canon_status": "RASCUNHO"}}
    out = None
    for kind, values in asked.items():
        part = reads.matching(entities, universe_id="2", **values).select(F.lit(kind).alias("kind"), "id", "name")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """ SELECT 'planning' AS kind, id FROM planning_items WHERE status = 'FINALIZADO' UNION ALL SELECT 'book', id FROM books WHERE story_id = '4' UNION ALL SELECT 'chapter', id FROM chapters WHERE book_id = '9'
    UNION ALL SELECT 'count ' || type, CAST(count(*) AS VARCHAR) FROM entities GROUP BY type""",
    "planning_items", "books", "chapters", "entities",
)
def f10_sub_selects(spark, sf_dir):
    planning, books, chapters, entities = _views(spark, sf_dir, "planning_items", "books", "chapters", "entities")
    parts = [("planning", planning, "status", "FINALIZADO"), ("book", books, "story_id", "4"), ("chapter", chapters, "book_id", "9")]
    out = entities.groupBy("type").agg(F.count(F.lit(1)).cast("string").alias("id")).select(F.concat(F.lit("count "), "type").alias("kind"), "id")
    for kind, rows, column, value in parts:
        out = out.unionByName(search.sub_select(rows, column, value).select(F.lit(kind).alias("kind"), "id"))
    return out


@query(
    f""" SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN concat('new ', id) ELSE content END AS content, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 7 ELSE word_count END AS word_count,
    CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'FEITO' ELSE status END AS status, CASE WHEN CAST(id AS BIGINT) % 3 = 0 OR CAST(id AS BIGINT) % 5 = 0 THEN '{NOW}' ELSE updated_at END AS updated_at FROM chapters""",
    "chapters",
)
def k04_column_updates(spark, sf_dir):
    (chapters,) = _views(spark, sf_dir, "chapters")
    number = F.col("id").cast("long")
    content = chapters.where(number % 3 == 0).select("id", F.concat(F.lit("new "), "id").alias("content"), F.lit(7).alias("word_count"))
    changed = dml.set_columns(chapters, content, NOW)
    return dml.set_columns(changed, chapters.where(number % 5 == 0).select("id", F.lit("FEITO").alias("status")), NOW).select("id", "content", "word_count", "status", "updated_at")


@query(f" SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN '{NOW}' ELSE updated_at END AS updated_at FROM entities", "entities")
def k06_touched_entities(spark, sf_dir):
    (entities,) = _views(spark, sf_dir, "entities")
    own = spark.createDataFrame([], "id string, entity_id string, key string, value string, sort_order int")
    values = entities.where(F.col("id").cast("long") % 3 == 0).select(F.col("id").alias("entity_id"), F.lit("k").alias("key"), F.lit("v").alias("value"))
    return dml.set_sheet(entities, own, values, NOW)[0].select("id", "updated_at")


@query(
    " SELECT chapter_id, entity_id, created_at FROM mentions UNION ALL SELECT DISTINCT m.chapter_id, concat(m.entity_id, 'x'), 'new' FROM mentions m WHERE CAST(m.entity_id AS BIGINT) % 2 = 1",
    "mentions",
)
def k13_insert_absent(spark, sf_dir):
    (told,) = _views(spark, sf_dir, "mentions")
    odd = F.col("entity_id").cast("long") % 2 == 1
    asked = told.withColumn("entity_id", F.when(odd, F.concat("entity_id", F.lit("x"))).otherwise(F.col("entity_id"))).withColumn("created_at", F.lit("new"))
    return dml.insert_absent(told, asked.unionByName(asked), ["chapter_id", "entity_id"]).select("chapter_id", "entity_id", "created_at")


@query(
    """ SELECT u.id, (SELECT count(*) FROM entities e WHERE e.universe_id = u.id AND e.type = t.kind) AS n, t.kind FROM universes u,
    (SELECT unnest(['PROMO', 'LARGE', 'Personagem']) AS kind) t""",
    "universes", "entities",
)
def a07_counts_of_types(spark, sf_dir):
    found = hierarchy.universe_statistics(*_views(spark, sf_dir, "universes", "stories", "books", "chapters", "entities"))
    kinds = ["PROMO", "LARGE", "Personagem"]
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), hierarchy.count_of_type(F.col("entity_counts"), k).alias("n")) for k in kinds))).alias("a")
    return found.select("id", asked).select("id", "a.n", "a.kind")


_ACCENTED = "CASE type WHEN 'PROMO' THEN 'Órgão' WHEN 'SMALL' THEN 'lugar' WHEN 'LARGE' THEN 'Ânimo' WHEN 'ECONOMY' THEN 'época' ELSE type END"


@query(f" SELECT type, row_number() OVER (ORDER BY lower(strip_accents(type))) AS place FROM (SELECT DISTINCT {_ACCENTED} AS type FROM entities)", "entities")
def o04_types_in_order(spark, sf_dir):
    (entities,) = _views(spark, sf_dir, "entities")
    found = graph.types_by_name(entities.withColumn("type", F.expr(_ACCENTED))).withColumn("n", F.monotonically_increasing_id())
    return found.select("type", F.row_number().over(Window.orderBy("n")).cast("long").alias("place"))  # a few types


@query(" SELECT id, title, updated_at FROM chapters ORDER BY updated_at DESC, id LIMIT 8", "chapters")
def o05_recent_chapters(spark, sf_dir):
    (chapters,) = _views(spark, sf_dir, "chapters")
    return search.recent(chapters).select("id", "title", "updated_at")


@query(
    """, s AS (SELECT id FROM entities WHERE canon_status = 'CANON'), c AS (SELECT id FROM entities WHERE type IN ('PROMO', 'LARGE'))
    (SELECT id FROM s EXCEPT SELECT id FROM c) UNION ALL (SELECT id FROM c EXCEPT SELECT id FROM s)""",
    "entities",
)
def o12_toggled_selection(spark, sf_dir):
    (entities,) = _views(spark, sf_dir, "entities")
    return search.toggled(entities.where("canon_status = 'CANON'"), entities.where("type IN ('PROMO', 'LARGE')"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 2 THEN concat('dia ', event_id) WHEN 3 THEN 'Sem data' WHEN 4 THEN 'Sem data' ELSE
    concat(strftime(ts, '%d'), ' de ', ['jan.', 'fev.', 'mar.', 'abr.', 'mai.', 'jun.', 'jul.', 'ago.', 'set.', 'out.', 'nov.', 'dez.'][month(ts)], ' de ', strftime(ts, '%Y')) END AS shown FROM events"""
)
def n10_date_texts(spark, sf_dir):
    kinds = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("dia "), F.col("event_id").cast("string")), F.lit(""), F.lit(None).cast("string")]
    given = F.element_at(F.array(*kinds), (F.col("event_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", text.date_text(given).alias("shown"))


_IMAGES = "CASE CAST(id AS BIGINT) % 6 WHEN 1 THEN replace(image, 'png', 'jpg') WHEN 2 THEN replace(image, 'png', 'svg+xml') WHEN 3 THEN concat(image, ' ') WHEN 4 THEN replace(image, 'AA', 'A-') WHEN 5 THEN concat('x', image) ELSE image END"


@query(f" SELECT id, image <> '' AND CAST(id AS BIGINT) % 6 < 2 AS shown, {_IMAGES} AS image FROM entities", "entities")
def n24_image_urls(spark, sf_dir):
    (entities,) = _views(spark, sf_dir, "entities")
    given = entities.select("id", F.expr(_IMAGES).alias("image"))
    return given.select("id", text.is_image_url(F.col("image")).alias("shown"), "image")


@query(
    """SELECT event_id, lower(hex(encode(props))) AS bytes, value, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind, event_id % 3 = 0 AS null_kept
    FROM events"""
)
def s05_typed_rows(spark, sf_dir):
    """Whole numbers, fractions, text, nulls and bytes through a snapshot's JSON and back."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.encode("props", "UTF-8").alias("bytes"), "value", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("kind"))
    of = lambda c: F.get_json_object("row", f"$.{c}")
    kept = F.array_contains(F.json_object_keys("row"), "kind") & of("kind").isNull()
    return snapshots.export_rows(rows, "events").select(of("event_id").cast("long").alias("event_id"), of("bytes").alias("bytes"), of("value").cast("double").alias("value"), of("kind").alias("kind"), kept.alias("null_kept"))


_TABLE_NAMES = ["universes", "stories", "books", "chapters", "entities", "relations", "mentions", "timeline_events", "planning_items"]


@query(
    "".join(f"{' UNION ALL' if k else ''} SELECT '{n}' AS name, count(*) AS n FROM {n}" for k, n in enumerate(_TABLE_NAMES))
    + " UNION ALL SELECT 'entity_attributes', 2 * count(*) FROM entities UNION ALL SELECT 'entity_templates', count(DISTINCT (universe_id, type)) FROM entities UNION ALL SELECT 'attachments', count(*) FROM entities WHERE image <> ''",
    *_TABLE_NAMES,
)
def s04_snapshot_of_all_tables(spark, sf_dir):
    """All twelve tables; one that is not synced is left out."""
    tables = dict(zip(_TABLE_NAMES, _views(spark, sf_dir, *_TABLE_NAMES), strict=True))
    entities = tables["entities"]
    attribute = F.explode(F.array(*(F.struct(F.lit(k).alias("sort_order"), F.lit(c).alias("key"), F.col(c).alias("value")) for k, c in enumerate(("description", "canon_status"))))).alias("a")
    tables["entity_attributes"] = entities.select(F.col("id").alias("entity_id"), attribute).select(F.concat_ws("-", "entity_id", "a.key").alias("id"), "entity_id", "a.*")
    tables["entity_templates"] = entities.select("universe_id", F.col("type").alias("entity_type")).distinct().withColumn("id", F.concat_ws("-", "universe_id", "entity_type"))
    tables["attachments"] = entities.where("image <> ''").select("id", "universe_id", F.lit("entity").alias("owner_type"), F.col("id").alias("owner_id"), F.col("image").alias("data_url"))
    tables["settings"] = entities.select("id")
    return snapshots.row_counts(snapshots.export_snapshot(tables))


@query(
    """, l AS (SELECT id, label, importance, created_at FROM relations WHERE label <> 'F' OR importance <> 'alta'), r AS (SELECT id, concat('novo ', label) AS label, created_at FROM relations WHERE importance <> 'normal')
    SELECT coalesce(l.id, r.id) AS id, coalesce(r.label, l.label) AS label, coalesce(l.importance, 'normal') AS importance, coalesce(r.created_at, l.created_at) AS created_at FROM l FULL JOIN r ON l.id = r.id""",
    "relations",
)
def m05_merge_without_times(spark, sf_dir):
    """Relations have no time of change, so a snapshot's always win, for the keys that they have; its rows without id and unknown tables are left out."""
    (relations,) = _views(spark, sf_dir, "relations")
    given = relations.where("importance <> 'normal'").select("id", "universe_id", "source_id", "target_id", "type", F.concat(F.lit("novo "), "label").alias("label"), "created_at")
    sent = snapshots.export_snapshot({"relations": given}).unionByName(snapshots.export_rows(given.drop("id"), "relations")).unionByName(snapshots.export_rows(given, "settings"))
    local = with_defaults(relations.where("label <> 'F' OR importance <> 'alta'"), "relations", NOW)
    remote = {"relations": snapshots.import_table(sent, "relations", given.columns), "settings": given}
    return merge.merge_snapshot({"relations": local}, remote, NOW, check=False).tables["relations"].select("id", "label", "importance", "created_at")


_ENVELOPE = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderkey % 11 = 0 THEN 'A128GCM' ELSE 'A256GCM' END AS algorithm,
CASE o_orderkey % 13 WHEN 0 THEN 'abcdefghijklmno' WHEN 1 THEN 'abcdefghijklmn+/' WHEN 2 THEN NULL ELSE 'abcdefghijklm-_9' END AS iv,
CASE o_orderkey % 17 WHEN 0 THEN repeat('A', 23) WHEN 1 THEN repeat('A', 24) WHEN 2 THEN concat(repeat('A', 30), '=') ELSE concat(repeat('b', 40), CAST(o_custkey AS {str})) END AS ciphertext,
CAST(CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 30 WHEN 3 THEN 7 ELSE 8 END AS INTEGER) AS days FROM {orders}"""


@query(
    f"""WITH e AS ({_ENVELOPE.format(str='VARCHAR', orders='orders')}) SELECT id, coalesce(version = 1 AND algorithm = 'A256GCM' AND iv = 'abcdefghijklm-_9' AND length(ciphertext) >= 24 AND NOT contains(ciphertext, '=') AND days <> 8, false) AS valid FROM e"""
)
def f11_envelope_fields(spark, sf_dir):
    rows = spark.sql(_ENVELOPE.replace("{str}", "STRING"), orders=_table(spark, sf_dir, "orders"))
    envelope = F.struct("version", "algorithm", "iv", "ciphertext")
    return rows.select("id", share.valid_envelope(envelope, F.col("days")).alias("valid"))


@query(
    f"""WITH e AS ({_ENVELOPE.format(str='VARCHAR', orders='orders')}), v AS (SELECT * FROM e WHERE version = 1 AND algorithm = 'A256GCM' AND iv = 'abcdefghijklm-_9' AND length(ciphertext) >= 24 AND NOT contains(ciphertext, '=') AND days <> 8)
    SELECT days, count(*) AS n, count(*) AS ids, count(*) AS tokens, count(*) AS formed, count(*) AS hashed, strftime(TIMESTAMP '2024-01-12 00:00:00' + to_days(days), '%Y-%m-%d') AS ends FROM v GROUP BY days"""
)
def k14_new_shares(spark, sf_dir):
    """Ids and tokens are random, so what must hold of all of them is counted."""
    rows = spark.sql(_ENVELOPE.replace("{str}", "STRING"), orders=_table(spark, sf_dir, "orders"))
    made = share.new_shares(rows.select(F.struct("version", "algorithm", "iv", "ciphertext").alias("envelope"), "days"), F.lit("2024-01-12 00:00:00").cast("timestamp_ntz"))
    made = made.withColumn("days", F.datediff("expires_at", "created_at"))
    formed = F.col("id").rlike("^[A-Za-z0-9_-]{16}$") & F.col("revoke_token").rlike("^[A-Za-z0-9_-]{32}$")
    return made.groupBy("days").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("revoke_token").alias("tokens"), F.count_if(formed).alias("formed"),
        F.count_if(F.col("revoke_hash") == F.sha2("revoke_token", 256)).alias("hashed"), F.date_format(F.max("expires_at"), "yyyy-MM-dd").alias("ends"),
    )


@query("SELECT doc_id, coalesce(octet_length(encode(text)), 0) <= 2000 AS allowed FROM documents WHERE text IS NOT NULL")
def t05_body_limits(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return documents.select("doc_id", events.body_allowed(F.col("text"), 2000).alias("allowed"))


@query(" SELECT id, story_id, name FROM books UNION ALL SELECT concat('new-', id), id, concat('Livro de ', name) FROM stories", "books", "stories")
def k01_inserts(spark, sf_dir):
    books, stories = _views(spark, sf_dir, "books", "stories")
    rows = with_defaults(stories.select(F.concat(F.lit("new-"), "id").alias("id"), F.col("id").alias("story_id"), F.concat(F.lit("Livro de "), "name").alias("name")), "books", NOW)
    return dml.insert(with_defaults(books, "books", NOW), rows).select("id", "story_id", "name")


@query(
    f"WITH {_NAMES}, {_LINES}, t AS (SELECT text_id, trim(lower(strip_accents(array_to_string(ps, ' ')))) AS t FROM lines), {_FOUND} SELECT CAST(text_id AS VARCHAR) AS chapter_id, entity_id FROM found"
)
def t06_index_after_saves(spark, sf_dir):
    """An index of older texts and half of the names, then the saved texts and the other names: what a full rebuild finds."""
    chapters = _pages(spark, sf_dir).select(F.col("text_id").alias("id"), F.col("html").alias("content"))
    names = _names(spark, sf_dir).select(F.col("entity_id").alias("id"), "name")
    saved, early = F.pmod(F.xxhash64("id"), F.lit(3)) == 0, F.pmod(F.xxhash64("id", F.lit("name")), F.lit(2)) == 0
    index = MentionIndex(spark, new_path(spark, "index"), buckets=8, key_buckets=8)
    index.build(chapters.withColumn("content", F.when(saved, F.concat(F.lit("<p>before"), F.reverse("content"), F.lit("</p>"))).otherwise(F.col("content"))), names.where(early))
    index.save(chapters.where(saved))
    index.add(names.where(~early))
    return index.read()


@query(
    f""", o AS ({_OUTCOME}) SELECT 'chapter' AS kind, id, CASE WHEN outcome IN ('insert', 'update') THEN rt ELSE lt END AS a, CASE WHEN outcome IN ('insert', 'update') THEN rc ELSE lc END AS b FROM o
    UNION ALL SELECT 'conflict', id, lc, rc FROM o WHERE outcome = 'conflict' UNION ALL SELECT 'revision', id, lt, lc FROM o WHERE outcome = 'update' AND (lt <> rt OR lc <> rc)""",
    "local_chapters", "remote_chapters",
)
def k16_committed_merge(spark, sf_dir):
    """A merge into a folder of versions: tables, conflicts and revisions as the commit shows them."""
    names = ["universes", "stories", "books"]
    local, remote, *parents = _views(spark, sf_dir, "local_chapters", "remote_chapters", *names)
    tables = {name: empty(spark, name) for name in SYNCED} | {name: with_defaults(df, name, NOW) for name, df in zip(["chapters", *names], [local, *parents], strict=True)}
    folder = new_path(spark, "workspace")
    snapshots.write_version(tables, folder, "v1")
    snapshots.publish(spark, folder, "v1", NOW)
    merge.merge_into(spark, folder, {"chapters": remote}, "v2", NOW)
    chapters = snapshots.read_tables(spark, snapshots.current_version(spark, folder), ["chapters"])["chapters"]
    row = lambda kind, *columns: [F.lit(kind).alias("kind"), *(F.col(c).alias(n) for c, n in zip(columns, ("id", "a", "b"), strict=True))]
    found = chapters.select(*row("chapter", "id", "title", "content"))
    found = found.unionByName(snapshots.read_history(spark, folder, "sync_conflicts").select(*row("conflict", "aggregate_id", "local_value", "remote_value")))
    return found.unionByName(snapshots.read_history(spark, folder, "chapter_revisions").select(*row("revision", "chapter_id", "title", "content")))


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE ts + CASE event_id % 3 WHEN 0 THEN INTERVAL 1 DAY WHEN 1 THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END > TIMESTAMP '2024-01-20 06:00:00'")
def s08_live_shares(spark, sf_dir):
    """Shares in a store by expiry day, after the days that are over have gone."""
    rows, path = _table(spark, sf_dir, "events"), new_path(spark, "shares")
    days = F.element_at(F.array(*map(F.lit, share.DAYS)), (F.col("event_id") % 3 + 1).cast("int"))
    now, at = F.lit("2024-01-20 06:00:00").cast("timestamp"), F.col("ts").cast("timestamp")
    envelope = F.struct(F.lit(1).alias("version"), F.lit("A256GCM").alias("algorithm"), F.lit("abcdefghijklmnop").alias("iv"), F.col("props").alias("ciphertext"))
    token = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    shares.store(rows.select(F.col("event_id").cast("string").alias("id"), token.alias("revoke_token"), F.sha2(token, 256).alias("revoke_hash"), at.alias("created_at"), share.expires_at(at, days).alias("expires_at"), envelope.alias("envelope")), path)
    shares.drop_expired_days(spark, path, now)
    return shares.read_live(spark, path, now).select("id")
