"""Images that are uploaded as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talelake.functions.schemas import schema
from talelake.functions.text import IMAGE_BYTES, UPLOAD_FILES, image_url

#: Types of image files by their extension.
_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "svg": "image/svg+xml", "avif": "image/avif", "bmp": "image/bmp"}


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """owner_id, name, place, mime, content of the images that count: of each upload, a folder ``owner_id=…``, the first twelve by name.

    Files that are no images or larger than IMAGE_BYTES do not count, and their bytes
    are not read: names and lengths are looked at first, and only the files that are
    left are opened.
    """
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, owner_id string").option("pathGlobFilter", "*").load(folder)
    types = F.create_map(*(F.lit(x) for pair in _TYPES.items() for x in pair))
    listed = files.where(F.col("length") <= IMAGE_BYTES).select("path", "owner_id", F.element_at(F.split("path", "/"), -1).alias("name"))
    listed = listed.withColumn("mime", types[F.lower(F.element_at(F.split("name", r"\."), -1))]).where("mime is not null")
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy("name"))
    accepted = listed.withColumn("place", place).where(F.col("place") <= UPLOAD_FILES)
    return files.where(F.col("length") <= IMAGE_BYTES).select("path", "content").join(accepted, "path").select("owner_id", "name", "place", "mime", "content")


def attachments(uploads: DataFrame, universe_id: str, owner_type: str, now: str) -> DataFrame:
    """Uploaded images as rows of the attachment table, captioned with their file names."""
    rows = uploads.select(
        F.md5(F.concat_ws("|", "owner_id", "name", F.lit(now))).alias("id"), F.lit(universe_id).alias("universe_id"), F.lit(owner_type).alias("owner_type"), "owner_id",
        image_url(F.col("mime"), F.col("content")).alias("data_url"), F.col("name").alias("caption"), (F.col("place") - 1).alias("sort_order"), F.lit(now).alias("created_at"),
    )
    return rows.select(*schema("attachments").names)
