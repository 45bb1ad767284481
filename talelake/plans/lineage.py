"""Cuts of long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(df: DataFrame) -> None:
    """Sets the checkpoint folder if the session has none: that of ``spark.checkpoint.dir``, a temporary one only for a local session."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(shared)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing has."""
    _folder(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes what is at a path that ``new_path`` gave, if anything."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder. Spark removes
    a checkpoint that is no longer used if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true.
    """
    _folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """df, computed once and written as a compressed table in that folder, so that later reads take only their columns.

    It stays until the session's checkpoint folder is removed; ``Scratch`` has tables that go before.
    group_bytes: for tables of large rows, the compressed bytes at which a row group ends. Writers
    and readers hold a whole row group, which else has 100 rows at least, however large they are.
    """
    return _written(df, group_bytes)[0]


def _written(df: DataFrame, group_bytes: int | None = None) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, "table")
    sizes = {} if group_bytes is None else {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1}
    df.write.option("compression", "zstd").options(**sizes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables like those of ``stored`` that are removed at the end of a with block.

    Inside it, what is made of them must be written in turn: nothing that outlives the
    block may be read from them, not even when a lost executor's part is made again.
    """

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []

    def stored(self, df: DataFrame) -> DataFrame:
        self.tables.append(_written(df))
        return self.tables[-1][0]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for df, path in self.tables:
            remove(df.sparkSession, path)
        self.tables.clear()


def bucketed(df: DataFrame, keys: list[str], distinct: bool = False) -> DataFrame:
    """df, computed once and written to the session's checkpoint folder in ``spark.sql.shuffle.partitions`` buckets of the keys.

    Joins and groupings by just these keys read it without a shuffle. distinct: equal rows once, which takes no shuffle more.
    """
    _folder(df)
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"bucketed_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    dealt = df.repartition(n, *keys)  # like the buckets, so that each is one file
    (dealt.distinct() if distinct else dealt).write.option("path", path).option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files are outside the warehouse and stay
    return table
