"""Stored shares, in folders by the day on which they expire; readers see only what has not expired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talelake.operators.share import split_expired

_DAY = "expires_day"


def _day(time: Column) -> Column:
    """Days since 1970 of a time, in UTC whatever the session's zone is."""
    return F.floor(F.unix_seconds(time) / 86400)


def store(shares: DataFrame, path: str) -> None:
    """Adds records without their tokens; a write is seen whole or not at all."""
    shares.drop("revoke_token").withColumn(_DAY, _day(F.col("expires_at"))).write.mode("append").partitionBy(_DAY).json(path)


SCHEMA = "id string, revoke_hash string, created_at timestamp, expires_at timestamp, envelope struct<version: int, algorithm: string, iv: string, ciphertext: string>"


def read_live(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """The records whose time is not over; folders of days that are over are not read."""
    rows = spark.read.schema(f"{SCHEMA}, {_DAY} long").json(path).where(F.col(_DAY) >= _day(now))
    return split_expired(rows.drop(_DAY), now)[0]


def prune(spark: SparkSession, path: str, new_path: str, now: Column) -> str:
    """Writes what has not expired into a new folder; readers move on when the caller publishes it."""
    store(read_live(spark, path, now), new_path)
    return new_path


def drop_expired_days(spark: SparkSession, path: str, now: Column) -> int:
    """Removes the folders of days that are over, and returns how many: no record is read or written.

    What expires on this very day stays, and is not read any more once its time is over.
    """
    today = spark.range(1).select(_day(now)).first()[0]
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in system.listStatus(root) if s.isDirectory() and (p := s.getPath().getName().partition(f"{_DAY}="))[1] and p[2].isdigit() and int(p[2]) < today]
    for folder in gone:
        system.delete(folder, True)
    return len(gone)
