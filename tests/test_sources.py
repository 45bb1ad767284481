"""Shares by their day, and uploads."""

import datetime

from pyspark.sql import functions as F

from talelake.functions.schemas import schema
from talelake.functions.text import IMAGE_BYTES
from talelake.sources import shares, uploads


def test_shares_by_day(spark, tmp_path):
    path = str(tmp_path / "shares")
    start = datetime.datetime(2026, 1, 1, 12)
    rows = [(f"s{k}", "h", "t", start, start + datetime.timedelta(days=k, hours=k), (1, "A256GCM", "iv", "c")) for k in range(6)]
    made = spark.createDataFrame(rows, "id string, revoke_hash string, revoke_token string, created_at timestamp, expires_at timestamp, envelope struct<version: int, algorithm: string, iv: string, ciphertext: string>")
    shares.store(made, path)
    now = F.lit("2026-01-04 15:00:00").cast("timestamp")  # the very end of s3
    live = shares.read_live(spark, path, now)
    assert sorted(r.id for r in live.collect()) == ["s4", "s5"] and "revoke_token" not in live.columns
    assert "PartitionFilters: [isnotnull(expires_day" in live._jdf.queryExecution().executedPlan().toString()
    assert shares.drop_expired_days(spark, path, now) == 3 and len(list((tmp_path / "shares").glob("expires_day=*"))) == 3
    assert sorted(r.id for r in shares.read_live(spark, path, now).collect()) == ["s4", "s5"]
    assert shares.drop_expired_days(spark, path, now) == 0
    shares.store(made.where("id = 's5'").withColumn("id", F.lit("more")), path)  # the store goes on
    assert shares.read_live(spark, path, now).count() == 3
    kept = shares.prune(spark, path, str(tmp_path / "new"), F.lit("2026-01-06 00:00:00").cast("timestamp"))
    assert sorted(r.id for r in shares.read_live(spark, kept, now).collect()) == ["more", "s5"]


def test_uploads(spark, tmp_path):
    """Thirteen images of one owner, of which twelve count; a text, an image that is too large, and another owner."""
    for owner, names in (("e1", [f"i{k:02d}.png" for k in range(13)] + ["a.txt", "big.jpg", "B.JPEG"]), ("e2", ["x.gif", "none"])):
        folder = tmp_path / "up" / f"owner_id={owner}"
        folder.mkdir(parents=True)
        for n in names:
            (folder / n).write_bytes(b"x" * (IMAGE_BYTES + 1) if n == "big.jpg" else n.encode())
    found = uploads.attachments(uploads.read_uploads(spark, str(tmp_path / "up")), "u", "entity", "9")
    assert found.columns == schema("attachments").names
    rows = sorted((r.owner_id, r.sort_order, r.caption) for r in found.collect())
    assert rows == [("e1", k, n) for k, n in enumerate(["B.JPEG"] + [f"i{k:02d}.png" for k in range(11)])] + [("e2", 0, "x.gif")]
    urls = {r.caption: r.data_url for r in found.collect()}
    assert urls["x.gif"] == "data:image/gif;base64,eC5naWY=" and urls["B.JPEG"].startswith("data:image/jpeg;base64,")
