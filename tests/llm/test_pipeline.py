import re

import pytest

import corpus_pipeline
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    found.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], SF).cache())
    return found


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "secret scan", "best-fit packing"]
    for frame in stages[1:-1]:
        assert frame.dtypes == stages[0].dtypes


def test_decisions(spark, stages):
    texts = [{r.doc_id: r.text for r in s.collect()} for s in stages[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d in texts[0] if labels.get(d) == 1]
    assert sum(d in texts[1] for d in good) >= 0.99 * len(good)
    bad = [d for d in texts[0] if labels.get(d) == 0]
    assert sum(d in texts[1] for d in bad) <= 0.2 * len(bad)
    first = {}
    for d, t in sorted(texts[1].items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), d)
    assert set(texts[2]) == set(first.values())
    near = brute(sorted(texts[2].items()), 5, 80)
    assert set(texts[3]) == {c for _, _, c in near}
    assert set(texts[4]) == set(texts[3]) and not any(re.search(r'(?i)token = "[0-9a-f]{40}"', t or "") for t in texts[4].values())
    words = {d: max(1, len((t or "").encode().split())) for d, t in texts[4].items()}
    packed, bins = {}, {}
    for r in stages[-1].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_words
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_words
    assert packed == words and max(bins.values()) <= 1024


def test_run(spark, stages):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in stages[-1].collect())


def test_result_holds_masked_texts(stages):
    """The pieces' texts are those of the masked documents, and no token is left."""
    words = {r.doc_id: (r.text or "").encode().split() for r in stages[-2].collect()}
    for r in stages[-1].collect():
        assert r.text.encode().split() == words[r.doc_id][1024 * r.piece : 1024 * (r.piece + 1)]
        assert not re.search(r'(?i)token = "[0-9a-f]{40}"', r.text)


ODD = "doc_id long, text string, lang string, source string, n_chars long, rk long, comp string, digest string"


def test_odd_rows_at_each_stage(spark):
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(3, "A"), (5, "A"), (5, "unique B"), (None, "A"), (None, "unique C"), (7, near), (8, near + " end"), (None, near + " last"), (8, "other text of eight"), (9, None), (10, ""), (11, "z " * 30000), (12, "twice"), (12, "twice")]
    docs = spark.createDataFrame([(d, t, "en", None, len(t or ""), 1, "x", "y") for d, t in rows], ODD)
    named = dict(corpus_pipeline.STAGES)
    kept = named["quality classifier"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    once = named["exact dedup"](spark, docs, SF)
    left = [(3, "A"), (5, "unique B"), (7, near), (8, "other text of eight"), (8, near + " end"), (9, ""), (11, "z " * 30000), (12, "twice"), (12, "twice"), (None, "unique C"), (None, near + " last")]
    assert [(r.doc_id, r.text or "") for r in sorted(once.collect(), key=key)] == left
    apart = named["n-gram Jaccard join"](spark, once, SF)
    left = [x for x in left if x[1] not in (near + " end", near + " last")]
    assert [(r.doc_id, r.text or "") for r in sorted(apart.collect(), key=key)] == left and apart.columns == docs.columns
    masked = named["secret scan"](spark, apart, SF)
    assert sorted(map(tuple, masked.collect()), key=str) == sorted(map(tuple, apart.collect()), key=str)
    pieces = named["best-fit packing"](spark, masked, SF).collect()
    assert sum(r.n_words for r in pieces) == sum(max(1, len(t.split())) for _, t in left) and len(pieces) == len(left) + 29
    for stage in named.values():
        assert stage(spark, docs.limit(0), SF).count() == 0
