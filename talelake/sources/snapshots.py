"""Snapshots of the synced tables: rows as JSON, and back to columns."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talelake.functions.schemas import SYNCED, schema, with_defaults


def json_value(column: Column, kind: T.DataType) -> Column:
    """What JSON holds of a column: bytes as hex text, the rest as it is."""
    return F.lower(F.hex(column)) if isinstance(kind, T.BinaryType) else column


def export_rows(df: DataFrame, name: str) -> DataFrame:
    """name, row: each row as a JSON object, nulls included."""
    fields = [json_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.lit(name).alias("name"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("row"))


def export_snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """All synced tables as one DataFrame of name, row."""
    out = None
    for name in SYNCED:
        if name in tables:
            part = export_rows(tables[name], name)
            out = part if out is None else out.unionByName(part)
    return out


def import_table(snapshot: DataFrame, name: str, columns: list[str] | None = None, steps: bool = False) -> DataFrame:
    """One table of a snapshot, typed; booleans become 0 or 1 and objects JSON text. Rows without the key ``id`` are left out.

    columns: those that the snapshot's rows have, all of the table's if not given. steps: also ``_keys``, the keys of
    each row, and ``_pos`` if the snapshot has its rows' places as ``pos``, for a merge row by row.
    """
    kept = [f for f in schema(name) if columns is None or f.name in columns]
    raw = snapshot.where(F.col("name") == name)
    values = [F.get_json_object("row", f"$.{f.name}").alias(f.name) for f in kept]
    typed = [F.when(F.col(f.name).isin("true", "false"), (F.col(f.name) == "true").cast("int").cast("string")).otherwise(F.col(f.name)).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.col(f.name) for f in kept]
    more = [F.json_object_keys("row").alias("_keys"), *([F.col("pos").alias("_pos")] if "pos" in snapshot.columns else [])] if steps else []
    return raw.select(*values, *more).where("id is not null").select(*typed, *(c for c in ("_keys", "_pos") if steps and (c == "_keys" or "pos" in snapshot.columns)))


#: Tables that a version only adds to.
HISTORY = ("change_log", "chapter_revisions", "sync_conflicts")
#: How tables without a universe of their own get to it: table → (its column, table, that table's column), up to one that has it.
_OWNERS = {
    "books": ("story_id", "stories"),
    "chapters": ("book_id", "books"),
    "entity_attributes": ("entity_id", "entities"),
    "mentions": ("chapter_id", "chapters"),
}
#: The partition column of those tables; it is no column of theirs.
_UNIVERSE = "_universe"


def read_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of a folder of Parquet files, with all of their columns. A filter by universe_id reads only its folders."""
    return {n: with_defaults(spark.read.schema(schema(n)).parquet(f"{folder}/{n}.parquet"), n) for n in names or SYNCED}


def read_universe(spark: SparkSession, folder: str, universe_id: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables' rows of one universe, of a version that ``write_version`` wrote: only the files of that universe are read."""
    found = {}
    for n in names or SYNCED:
        kind = schema(n) if "universe_id" in schema(n).names else T.StructType([*schema(n), T.StructField(_UNIVERSE, T.StringType())])
        rows = spark.read.schema(kind).parquet(f"{folder}/{n}.parquet")
        found[n] = with_defaults(rows.where(F.col("universe_id" if "universe_id" in schema(n).names else _UNIVERSE) == universe_id).drop(_UNIVERSE), n)
    return found


def _owned(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """The table with the universe that each row belongs to, null if its parents are missing."""
    if name == "universes":
        return tables[name].withColumn(_UNIVERSE, F.col("id"))
    column, parent = _OWNERS[name]
    up = tables[parent].select(F.col("id").alias("_up"), F.col("universe_id").alias(_UNIVERSE)) if parent not in _OWNERS else _owned(tables, parent).select(F.col("id").alias("_up"), _UNIVERSE)
    return tables[name].join(up, F.col(column) == F.col("_up"), "left").drop("_up")


def write_version(tables: dict[str, DataFrame], folder: str, version: str) -> str:
    """Writes all tables into a new folder, each by universe; nobody reads it before ``publish``.

    Tables without a universe of their own are written by that of their owners, if
    these are among the tables.
    """
    path = f"{folder}/{version}"
    for name, df in tables.items():
        by = "universe_id" if "universe_id" in df.columns else None
        parents, up = set(), name
        while up in _OWNERS:
            up = _OWNERS[up][1]
            parents.add(up)
        if by is None and (name == "universes" or name in _OWNERS and parents <= set(tables)):
            df, by = _owned(tables, name), _UNIVERSE
        # few files for each universe, large ones split
        writer = (df.hint("rebalance", F.col(by)) if by else df).write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).parquet(f"{path}/{name}.parquet")
    return path


class CommitConflict(RuntimeError):
    """Another writer has committed in the meantime."""


_COMMITS = "sequence long, version string, committed_at string"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_COMMITS).json(f"{folder}/commits")


def last_sequence(spark: SparkSession, folder: str) -> int:
    """The number of the last commit, 0 before the first. One that was cut off while it was written has a number, too."""
    system, path = _files(spark, f"{folder}/commits")
    if not system.exists(path):
        return 0
    names = (s.getPath().getName() for s in system.listStatus(path))
    return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)


def publish(spark: SparkSession, folder: str, version: str, now: str, after: int | None = None) -> int:
    """Makes a written version the current one, and returns the commit's number.

    after: the commit that the version is based on, the last one if not given. A commit
    is a file of its own with the next number, which the file system creates only if it
    is not there: of two writers that began at the same commit, one fails.
    """
    number = (last_sequence(spark, folder) if after is None else after) + 1
    system, path = _files(spark, f"{folder}/commits/{number:020d}.json")
    if system.exists(path) or last_sequence(spark, folder) >= number:
        raise CommitConflict(f"commit {number} of {folder} is there already")
    try:
        out = system.create(path, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in str(error.java_exception):
            raise CommitConflict(f"commit {number} of {folder} is there already") from error
        raise
    try:
        out.write(bytearray((json.dumps({"sequence": number, "version": version, "committed_at": now}) + "\n").encode()))
    finally:
        out.close()
    return number


def current_version(spark: SparkSession, folder: str) -> str:
    """Path of the version that was published last."""
    last = _commits(spark, folder).agg(F.max_by("version", "sequence")).first()[0]
    return f"{folder}/{last}"


def read_history(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """What the committed versions have added to a history table; what a failed merge wrote is not among it."""
    versions = [r.version for r in _commits(spark, folder).orderBy("sequence").collect()]  # one row for each version
    paths = [p for p in (f"{folder}/{v}/{name}.parquet" for v in versions) if (f := _files(spark, p))[0].exists(f[1])]
    return spark.read.schema(schema(name)).parquet(*paths) if paths else spark.createDataFrame([], schema(name))


def row_counts(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
