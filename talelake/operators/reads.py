"""Reads of a workspace's screens: parameters, single rows, rows by id, universe or equal values, children in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def select(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **args: object) -> DataFrame:
    """Rows of a query over named tables (``{name}``) with parameters (``:name``), which are bound and never spliced in."""
    return spark.sql(sql, args=args or None, **tables)


def select_one(df: DataFrame) -> dict | None:
    """The first row of a DataFrame as a dictionary, None without any."""
    row = df.limit(1).first()
    return None if row is None else row.asDict(recursive=True)


def by_ids(df: DataFrame, ids: list[str]) -> DataFrame:
    """The rows with one of a few ids; the predicate goes down to the scan."""
    return df.where(F.col("id").isin(ids))


def get(df: DataFrame, row_id: str) -> dict | None:
    """One row by its id."""
    return select_one(by_ids(df, [row_id]))


def of_universe(df: DataFrame, universe_id: str) -> DataFrame:
    """A universe's rows. On a table that is written by universe only its folder is read."""
    return df.where(F.col("universe_id") == universe_id)


def matching(df: DataFrame, **values: str | None) -> DataFrame:
    """Rows that have all of the given values; a parameter that is None asks for nothing."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def children(df: DataFrame, column: str, parent: str) -> DataFrame:
    """The rows under one parent, in their order."""
    return df.where(F.col(column) == parent).orderBy("sort_order", "id")
