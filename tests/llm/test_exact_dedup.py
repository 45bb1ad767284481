import hashlib
import re

import pytest

from talelake.llm import exact_dedup
from talelake.llm.exact_dedup import DigestIndex, drop_copies_once


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def test_batches(spark):
    index = DigestIndex(spark, "t_exact")
    index.drop()
    rows = [(5, "a  b", 1), (3, "a\tb", 2), (9, None, 3), (7, "", 4), (8, "x y", 5), (8, "x y", 5), (2, "é" * 30000, 6), (1, " ", 7), (4, "  ", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in index.ingest(docs).collect()}
    want = set()
    for doc, text, _ in rows:
        group = [d for d, t, _ in rows if digest(t) == digest(text)]
        want.add((doc, min(group), len(group), doc == min(group), digest(text)))
    assert found == want
    more = spark.createDataFrame([(1, "a b"), (30, "new"), (20, "new")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in index.ingest(more).collect()} == {(1, 3, 1, False), (30, 20, 2, False), (20, 20, 2, True)}
    assert index.read().count() == len({digest(t) for _, t, _ in rows}) + 1
    assert index.ingest(more.limit(0)).count() == 0
    index.drop()


def test_heavy_groups_are_whole(spark):
    index = DigestIndex(spark, "t_heavy")
    index.drop()
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id) END AS text")
    found = index.ingest(docs).groupBy("group_size", "kept").count().collect()
    assert {tuple(r) for r in found} == {(2000, True, 1), (2000, False, 1999), (1, True, 4000)}
    index.drop()


def test_null_and_repeated_ids_lose_copies_only(spark):
    rows = [(1, "x"), (None, "x"), (None, "unique"), (7, "x"), (7, "other"), (7, "other"), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(str, map(tuple, drop_copies_once(docs).collect())))
    assert found == sorted(map(str, [(1, "x"), (None, "unique"), (7, "other"), (7, "other"), (9, "")]))


def test_the_second_half_meets_the_first_in_the_index(spark, monkeypatch):
    """Taken in as two batches, the smaller ids first, a table has the same rows, and the anti-join is planned once."""
    plans = []
    append = DigestIndex.append

    def watched(self, groups):
        plans.append(self.exists())
        append(self, groups)

    monkeypatch.setattr(DigestIndex, "append", watched)
    rows = [(d, f"t{d % 7}") for d in range(60)] + [(None, "t3"), (None, "only null"), (61, None), (62, ""), (5, "t5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = DigestIndex(spark, "t_in_order")
    index.drop()
    found = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in index.ingest(docs, in_order=True).collect()), key=repr)
    want = []
    for doc, text in rows:
        group = [d for d, t in rows if digest(t) == digest(text)]
        keep = min((d for d in group if d is not None), default=None)
        want.append((doc, keep, len(group), doc == keep, digest(text)))
    assert found == sorted(want, key=repr) and plans == [False, True]
    assert index.read().groupBy("digest").count().where("count > 1").count() == 0
    again = index.read().select("digest").join(index.read().select("digest").hint("merge"), "digest", "left_anti")
    assert "SortMergeJoin" in again._jdf.queryExecution().executedPlan().toString()
    index.drop()
    assert index.ingest(docs.limit(0), in_order=True).count() == 0
    index.drop()


def test_an_index_for_one_run_needs_no_shared_warehouse(spark, monkeypatch, tmp_path):
    """On a cluster whose warehouse is Spark's default, a folder of the driver, op5 and the pipeline's stage run; the index is in the checkpoint folder and goes."""
    home = tmp_path / "driver"
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(exact_dedup.os, "getcwd", lambda: str(home))
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a, get=type(spark.conf).get: f"file:{home}/spark-warehouse" if key == "spark.sql.warehouse.dir" else get(self, key, *a))
    with pytest.raises(ValueError, match="warehouse"):
        DigestIndex(spark, "t_kept")
    files = []
    append = DigestIndex.append

    def watched(self, groups):
        append(self, groups)
        files.append((self.path, self.read().inputFiles()))

    monkeypatch.setattr(DigestIndex, "append", watched)
    spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = exact_dedup.op5_exact_dedup(spark, str(tmp_path))
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found.collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1)}
    assert {r.doc_id for r in drop_copies_once(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()} == {1, 3}
    shared, hadoop = spark.sparkContext.getCheckpointDir(), spark._jvm.org.apache.hadoop.fs
    assert len(files) == 4 and all(path.startswith(shared) and names and all(path.rsplit("/", 1)[1] in n for n in names) for path, names in files)
    assert not any(hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(path)) for path, _ in files)
