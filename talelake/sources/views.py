"""The narrative model over the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TEXT_TIME = {"spark": "date_format({0}, 'yyyy-MM-dd HH:mm:ss')", "duckdb": "strftime({0}, '%Y-%m-%d %H:%M:%S')"}

#: Name → SELECT over the driver's tables; {name(...)} is filled in for each dialect.
_VIEWS = {
    "universes": "SELECT CAST(r_regionkey AS {str}) AS id, r_name AS name, '' AS description, '' AS cover_image, '2024-01-01 00:00:00' AS updated_at FROM region",
    "stories": "SELECT CAST(n_nationkey AS {str}) AS id, CAST(n_regionkey AS {str}) AS universe_id, n_name AS name, '' AS description, n_nationkey AS sort_order FROM nation",
    "books": "SELECT CAST(c_custkey AS {str}) AS id, CAST(c_nationkey AS {str}) AS story_id, c_name AS name, c_mktsegment AS description, c_custkey AS sort_order FROM customer",
    "chapters": (
        "SELECT CAST(o_orderkey AS {str}) AS id, CAST(o_custkey AS {str}) AS book_id, concat('Chapter ', CAST(o_orderkey AS {str})) AS title, o_orderpriority AS content, "
        "CAST(round(o_totalprice * 100) AS BIGINT) AS word_count, o_orderstatus AS status, o_orderkey AS sort_order, {updated} AS updated_at FROM orders"
    ),
    "entities": (
        "SELECT CAST(p_partkey AS {str}) AS id, CAST(p_partkey % 5 AS {str}) AS universe_id, p_type AS type, p_name AS name, p_brand AS description, CASE WHEN p_size % 4 = 0 THEN 'data:image/png;base64,AA==' ELSE '' END AS image, "
        "CASE WHEN p_size % 3 = 0 THEN 'RASCUNHO' ELSE 'CANON' END AS canon_status, "
        "concat('2024-01-', substr(CAST(110 + p_size % 19 AS {str}), 2, 2), ' 00:00:00') AS updated_at FROM part"
    ),
    "relations": (
        "SELECT concat(CAST(l_orderkey AS {str}), '-', CAST(l_linenumber AS {str}), '-', CAST(source AS {str}), '-', CAST(l_suppkey AS {str})) AS id, "
        "CAST(l_orderkey % 5 AS {str}) AS universe_id, CAST(source AS {str}) AS source_id, CAST(target AS {str}) AS target_id, l_returnflag AS type, "
        "l_linestatus AS label, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS bidirectional, CASE WHEN l_returnflag = 'R' THEN 'alta' ELSE 'normal' END AS importance, {shipped} AS created_at "
        "FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, l_shipdate, l_partkey AS source, "
        "lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target FROM lineitem) "
        "WHERE target IS NOT NULL AND target <> source"
    ),
    "mentions": (
        "SELECT concat(CAST(l_orderkey AS {str}), ':', CAST(l_partkey AS {str})) AS id, CAST(l_orderkey AS {str}) AS chapter_id, CAST(l_partkey AS {str}) AS entity_id, {first_shipped} AS created_at "
        "FROM lineitem GROUP BY l_orderkey, l_partkey"
    ),
    "planning_items": (
        "SELECT CAST(o_orderkey AS {str}) AS id, CAST(o_custkey % 5 AS {str}) AS universe_id, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey AS {str}) END AS chapter_id, "
        "concat('Plan ', CAST(o_orderkey AS {str})) AS title, '' AS description, CASE o_orderpriority WHEN '1-URGENT' THEN 'IDEIAS' WHEN '2-HIGH' THEN 'PLANEJADO' "
        "WHEN '3-MEDIUM' THEN 'ESCREVENDO' WHEN '4-NOT SPECIFIED' THEN 'REVISAO' ELSE 'FINALIZADO' END AS status, o_custkey AS sort_order, {updated} AS created_at FROM orders"
    ),
    "timeline_events": (
        "SELECT CAST(event_id AS {str}) AS id, CAST(user_id % 5 AS {str}) AS universe_id, event_type AS title, props AS description, {at} AS start_date, '' AS display_date, "
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS sort_key, {at} AS created_at FROM events"
    ),
    "change_log": (
        "SELECT CAST(event_id AS {str}) AS id, CASE event_type WHEN 'view' THEN 'universe' WHEN 'signup' THEN 'story' WHEN 'click' THEN 'book' WHEN 'error' THEN 'chapter' ELSE 'entity' END AS entity_type, "
        "CAST(user_id AS {str}) AS entity_id, 'update' AS action, ts AS logged, {at} AS created_at, CAST(event_id % 5 AS {str}) AS universe_id FROM events"
    ),
    "local_chapters": (
        "SELECT CAST(o_orderkey AS {str}) AS id, CAST(o_custkey AS {str}) AS book_id, o_orderpriority AS title, concat(o_orderstatus, '0') AS content, "
        "CAST(round(o_totalprice) AS BIGINT) AS word_count, o_orderstatus AS status, {updated} AS updated_at FROM orders WHERE o_orderkey % 10 <> 0"
    ),
    "remote_chapters": (
        "SELECT CAST(o_orderkey AS {str}) AS id, CAST(o_custkey AS {str}) AS book_id, CASE WHEN o_orderkey % 5 = 2 THEN 'Renamed' ELSE o_orderpriority END AS title, "
        "concat(o_orderstatus, CAST(o_orderkey % 2 AS {str})) AS content, CAST(round(o_totalprice) AS BIGINT) + o_orderkey % 2 AS word_count, o_orderstatus AS status, {shifted} AS updated_at "
        "FROM orders WHERE o_orderkey % 10 <> 1"
    ),
}
#: The driver's tables that each view reads.
_BASES = {
    "universes": "region", "stories": "nation", "books": "customer", "chapters": "orders", "entities": "part", "relations": "lineitem", "mentions": "lineitem", "planning_items": "orders",
    "timeline_events": "events", "change_log": "events", "local_chapters": "orders", "remote_chapters": "orders",
}


def _sql(name: str, dialect: str) -> str:
    time = _TEXT_TIME[dialect].format
    return _VIEWS[name].format(
        str="STRING" if dialect == "spark" else "VARCHAR",
        updated=time("o_orderdate"),
        shifted=time("o_orderdate + (o_orderkey % 3 - 1) * INTERVAL 1 DAY"),
        shipped=time("l_shipdate"),
        first_shipped=time("min(l_shipdate)"),
        at=time("ts"),
    )


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the model's tables over the driver's."""
    base = spark.read.parquet(f"{sf_dir}/{_BASES[name]}.parquet")
    return spark.sql(_sql(name, "spark").replace(f"FROM {_BASES[name]}", "FROM {base}"), base=base)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that can name the views; ``sql`` may start with further CTEs after a comma."""
    recursive = "RECURSIVE " if "UNION" in sql and "RECURSIVE" in sql else ""
    return f"WITH {recursive}" + ", ".join(f"{n} AS ({_sql(n, 'duckdb')})" for n in names) + sql.replace("/*RECURSIVE*/", "")
