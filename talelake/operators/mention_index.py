"""A mention index that is kept up to date: saved texts and new names touch only their own parts of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talelake.functions.text import html_paragraphs, normalise
from talelake.operators import mentions
from talelake.plans.lineage import Scratch, cut


class MentionIndex:
    """Texts, names, mentions and a table of keys (text_id, its keys of a bucket) in a folder.

    Keys are single words, and stretches of signs for names without a word: a longer name
    goes by the one of its words that the fewest texts have, and is searched in these.
    Texts, mentions and keys are laid out by the text's bucket, keys by their own, too
    (buckets: a fixed hash of the id or key). ``save`` reads and writes the buckets of the
    texts that it gets, by dynamic partition overwrite; ``add`` reads the buckets of the
    new names' keys, and of texts only those that it must search. Both can be run again
    with the same rows, as a stream's batch may be, and leave the same behind.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, key_buckets: int = 64):
        self.spark, self.folder, self.buckets, self.key_buckets = spark, folder, buckets, key_buckets

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(self.buckets)).cast("int").alias("bucket")

    def _key_bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.key_buckets)).cast("int").alias("key_bucket")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _write(self, name: str, rows: DataFrame, *parts: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*parts).parquet(f"{self.folder}/{name}")

    def _put(self, name: str, rows: DataFrame, touched: list[int]) -> None:
        """Replaces the touched buckets by rows. A row of nulls in each makes sure that one that is left empty is replaced, too."""
        blank = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
        self._write(name, rows.unionByName(blank, allowMissingColumns=True).repartition("bucket"), "bucket")

    def build(self, chapters: DataFrame, entities: DataFrame) -> None:
        """A new index. chapters: id, content; entities: id, name."""
        entities.select(F.col("id").alias("entity_id"), "name").write.parquet(f"{self.folder}/names")
        self._store(chapters, list(range(self.buckets)), old=False)

    def save(self, chapters: DataFrame) -> None:
        """Chapters (id, content) that are new or have changed."""
        ids = chapters.select(self._bucket("id")).distinct().collect()  # as many rows as there are buckets
        self._store(chapters, sorted(r.bucket for r in ids), old=True)

    def _store(self, chapters: DataFrame, touched: list[int], old: bool) -> None:
        # the file sink spells ids in its own type: all are text
        own = chapters.select(F.col("id").cast("string").alias("text_id"), F.array_join(html_paragraphs("content"), " ").alias("text"), self._bucket("id"))
        with Scratch() as on_the_way:
            texts = on_the_way.stored(own.withColumn("text", normalise("text")))
            found = mentions.find_mentions(texts, self._read("names"), on_the_way.stored).select("text_id", "entity_id", self._bucket("text_id"))
            for name, rows in (("texts", texts), ("mentions", found)):
                if old:  # a dynamic overwrite puts the old buckets' files away when all new ones are written
                    left = self._read(name).where(F.col("bucket").isin(touched) & F.col("text_id").isNotNull()).join(texts.select("text_id"), "text_id", "left_anti")
                    rows = left.select(*rows.columns).unionByName(rows)
                self._put(name, rows, touched)
        # from the texts as they lie, bucket by bucket, so that keys, which are larger, are not shuffled
        self._write("keys", self._keys(self._read("texts").where(F.col("bucket").isin(touched))), "key_bucket", "bucket")

    def _keys(self, texts: DataFrame) -> DataFrame:
        """text_id, bucket, key_bucket, keys: a text's keys of each bucket in one row, so that ids do not travel with every key; a row of nulls stays one in each bucket."""
        dealt = F.transform(mentions.word_keys(), lambda k: F.struct(F.pmod(F.xxhash64(k), F.lit(self.key_buckets)).cast("int").alias("b"), k.alias("k")))
        own = lambda n: F.transform(F.filter("dealt", lambda x: (x["b"] == n) & (x["k"] != "")), lambda x: x["k"])
        rows = F.array(*(F.struct(F.lit(n).alias("key_bucket"), own(n).alias("keys")) for n in range(self.key_buckets)))
        return texts.select("text_id", "bucket", dealt.alias("dealt")).select("text_id", "bucket", F.explode_outer(rows).alias("row")).select("text_id", "bucket", "row.*").where((F.size("keys") > 0) | F.col("text_id").isNull())

    def _held(self, keys: DataFrame) -> DataFrame:
        """The rows of the key table that may have these keys: only their buckets are read."""
        wanted = [r.key_bucket for r in keys.select(self._key_bucket()).distinct().collect()]  # as many rows as there are buckets
        return self._read("keys").where(F.col("key_bucket").isin(wanted)).select("text_id", "bucket", F.explode("keys").alias("key"))

    def new_mentions(self, entities: DataFrame) -> DataFrame:
        """text_id, entity_id, bucket: the mentions of names (id, name) in all texts, by the index."""
        named, parts = (cut(x) for x in mentions.name_parts(entities.select(F.col("id").alias("entity_id"), "name")))
        if parts.limit(1).count():
            wanted = parts.select("key").distinct()
            counts = self._held(parts).join(F.broadcast(wanted) if mentions.is_few(parts) else wanted, "key").groupBy("key").count()
            named = cut(named.unionByName(mentions.rarest(parts, counts)))
        found = self._held(named).join(F.broadcast(named) if mentions.is_few(named) else named, "key").select("text_id", "bucket", "entity_id", "name", "whole")
        texts = self._read("texts").where(F.col("text_id").isNotNull()).select("text_id", "bucket", "text")
        searched = found.where("not whole").join(texts, ["text_id", "bucket"]).where(mentions.stands())
        columns = ["text_id", "entity_id", "bucket"]
        return found.where("whole").select(*columns).unionByName(searched.select(*columns)).distinct()

    def add(self, entities: DataFrame) -> None:
        """New names (id, name): their mentions are added, no text is read that has none of their keys."""
        self.new_mentions(entities).write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/mentions")
        entities.select(F.col("id").alias("entity_id"), "name").write.mode("append").parquet(f"{self.folder}/names")

    def read(self) -> DataFrame:
        """chapter_id, entity_id of all texts."""
        return self._read("mentions").where("text_id is not null").select(F.col("text_id").alias("chapter_id"), "entity_id").distinct()
