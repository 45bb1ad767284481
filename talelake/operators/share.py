"""Shared bundles: assembly, encryption, envelopes, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talelake.functions.text import base64url, from_base64url, trim

# fixed values: limits of plain and encrypted bundles, the choices of days, and an envelope's alphabet
PLAIN_BYTES, CIPHER_CHARS, DAYS = 2_000_000, 2_800_000, (1, 7, 30)
URL_TEXT = "^[A-Za-z0-9_-]+$"
#: Bytes that JSON adds to a row of a bundle, about.
ROW_BYTES = 64


def bundles(universes: DataFrame, catalogue: DataFrame, entities: DataFrame, attributes: DataFrame, now: str) -> DataFrame:
    """universe_id, bytes and document: the JSON of each universe with its chapters and entities, blank attributes left out.

    The rows of a universe are gathered only if their texts add up to no more than
    a share may hold; a larger one has no document, and nothing of it is gathered.
    """
    filled = attributes.where(trim(F.col("value")) != "").select("entity_id", "sort_order", "key", "value")
    owned = filled.join(entities.select(F.col("id").alias("entity_id"), "universe_id"), "entity_id")

    def weight(rows, *columns):
        texts = sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in columns), F.lit(ROW_BYTES))
        return rows.select("universe_id", texts.cast("long").alias("w"))

    weights = weight(catalogue, "id", "title", "content", "story_name", "book_name").unionByName(weight(entities, "id", "type", "name", "description", "image")).unionByName(weight(owned, "key", "value"))
    sizes = weights.groupBy("universe_id").agg(F.sum("w").alias("bytes"))
    small = sizes.where(F.col("bytes") <= PLAIN_BYTES).select("universe_id")
    chapter = F.struct("id", "title", "content", F.col("story_name").alias("storyName"), F.col("book_name").alias("bookName"))
    chapters = catalogue.join(small, "universe_id", "left_semi").groupBy("universe_id").agg(F.array_sort(F.collect_list(chapter)).alias("chapters"))
    own = owned.join(small, "universe_id", "left_semi").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "key", "value"))).alias("a"))
    own = own.select(F.col("entity_id").alias("id"), F.transform("a", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("attributes"))
    entity = F.struct("id", "type", "name", "description", "image", "attributes")
    shown = entities.join(small, "universe_id", "left_semi").join(own, "id", "left").groupBy("universe_id").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    whole = universes.withColumnRenamed("id", "universe_id").join(sizes, "universe_id", "left").join(chapters, "universe_id", "left").join(shown, "universe_id", "left")
    universe = F.struct("name", "description", F.col("cover_image").alias("coverImage"))
    document = F.struct(F.lit(2).alias("version"), F.lit("bundle").alias("kind"), F.col("name").alias("title"), universe.alias("universe"), "chapters", "entities", F.lit(now).alias("sharedAt"))
    size = F.coalesce("bytes", F.lit(0)).cast("long")
    return whole.select("universe_id", size.alias("bytes"), F.when(size <= PLAIN_BYTES, F.to_json(document)).alias("document"))


def shown_attributes(attributes: DataFrame, n: int = 40) -> DataFrame:
    """The first attributes of each entity, as a reader of a share sees them.

    Dealt by entity before they are sorted: Spark would otherwise sort each input task's
    rows first, and of a small file that is all of them in one task.
    """
    by = Window.partitionBy("entity_id").orderBy("sort_order", "key")
    return attributes.repartition("entity_id").withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= n).drop("_k")


def expiry_days(days: Column) -> Column:
    """The choice, or 7 if it is none."""
    return F.when(days.isin(*DAYS), days).otherwise(7)


def encrypt(document: Column, key: Column, iv: Column) -> Column:
    """Envelope (version, algorithm, iv, ciphertext) by AES-256-GCM with a 12-byte iv."""
    sealed = F.aes_encrypt(document, key, F.lit("GCM"), F.lit("DEFAULT"), iv)
    body = F.substring(sealed, 13, 2_147_483_647)  # Spark puts the iv first; the envelope has it apart
    return F.struct(F.lit(1).alias("version"), F.lit("A256GCM").alias("algorithm"), base64url(iv).alias("iv"), base64url(body).alias("ciphertext"))


def decrypt(envelope: Column, key: Column) -> Column:
    """The document of an envelope, null if the key or the envelope is wrong."""
    sealed = F.concat(from_base64url(envelope["iv"]), from_base64url(envelope["ciphertext"]))
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def valid_envelope(e: Column, days: Column) -> Column:
    """Whether a store takes an envelope."""
    n = F.length(e["ciphertext"])
    good = (e["version"] == 1) & (e["algorithm"] == "A256GCM") & (F.length(e["iv"]) == 16) & e["iv"].rlike(URL_TEXT)
    return F.coalesce(good & n.between(24, CIPHER_CHARS) & e["ciphertext"].rlike(URL_TEXT) & days.isin(*DAYS), F.lit(False))


def small_enough(document: Column) -> Column:
    return F.octet_length(document) <= PLAIN_BYTES


def expires_at(created: Column, days: Column) -> Column:
    return created + F.make_dt_interval(days)


def new_shares(envelopes: DataFrame, now: Column) -> DataFrame:
    """Records of valid envelopes (envelope, days): id, revoke_token, revoke_hash, created_at, expires_at, envelope.

    Ids and tokens are random, so write the result once and read it from there;
    the token goes to the sharer and is not to be stored.
    """
    valid = envelopes.where(valid_envelope(F.col("envelope"), F.col("days")))

    def secret(n: int) -> Column:
        return F.substring(base64url(F.unhex(F.replace(F.concat(F.uuid(), F.uuid()), F.lit("-"), F.lit("")))), 1, n)

    made = valid.select(secret(16).alias("id"), secret(32).alias("revoke_token"), now.alias("created_at"), expires_at(now, F.col("days")).alias("expires_at"), "envelope")
    return made.withColumn("revoke_hash", F.sha2("revoke_token", 256))


def remembered(shares: DataFrame, n: int = 50) -> DataFrame:
    """A sharer's last shares."""
    return shares.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def split_expired(shares: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Shares that can be read, and those whose time is over (the very moment included)."""
    alive = F.col("expires_at") > now
    return shares.where(alive), shares.where(~alive)


def revoke(shares: DataFrame, requests: DataFrame) -> DataFrame:
    """Shares without those that a request (id, token) with the right token takes back."""
    right = requests.select("id", F.sha2("token", 256).alias("revoke_hash")).distinct()
    return shares.join(right, ["id", "revoke_hash"], "left_anti").select(*shares.columns)
