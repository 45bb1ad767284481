import random

import numpy as np
import pyarrow as pa

from talelake.llm import quality


def rows_of(n, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.25
        words = [r.choice(["alpha", "beta", "gamma", "of", "the", "and"]) for _ in range(r.randrange(5, 80))]
        text = " ".join(w + r.choice(["***", "%%%"]) for w in words) if bad else " ".join(words).capitalize() + "."
        rows.append((i, text, r.choice(["en", "de"]), f"s{r.randrange(9) if not bad else r.randrange(5, 12)}", len(text)))
        if i % 2:
            labels.append((i, int(not bad)))
    return rows, labels, [" " in t and "***" not in t and "%%%" not in t for _, t, *_ in rows]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_accuracy(spark):
    rows, labels, good = rows_of(1200)
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, marks)
    found = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    unlabelled = [i for i in range(1200) if i % 2 == 0]
    assert sum(found[i].kept == good[i] for i in unlabelled) >= 0.98 * len(unlabelled)
    kept = quality.keep_good(docs.withColumn("kept", docs.doc_id), model)
    assert kept.columns == [*docs.columns, "kept"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept}


def test_odd_rows(spark):
    rows, labels, _ = rows_of(300)
    odd = [(9000, None, None, None, None), (9001, "", "", "", -5), (9002, "x " * 100000, "en", "s1", 200000), (None, "a", "en", "s1", 1), (9002, "x " * 100000, "en", "s1", 200000)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(docs, marks)
    found = quality.score_documents(docs, model).collect()
    assert len(found) == 305 and all(0 <= r.quality_score <= 1 for r in found)
    assert len({round(r.quality_score, 9) for r in found if r.doc_id == 9002}) == 1
    assert quality.score_documents(docs.limit(0), model).count() == 0
    assert quality.train(docs.limit(0), marks) is None and quality.train(docs, marks.where("quality = 1")) is None
    assert quality.keep_good(docs, None).count() == 305


def test_features_do_not_depend_on_batches():
    texts = ["Ab c\n", None, "é é é", "", "one one two!!"]
    whole = quality.text_features(pa.array(texts))
    assert whole.shape == (5, quality.TEXT_WIDTH)
    assert np.allclose(whole, np.vstack([quality.text_features(pa.array([t], pa.string())) for t in texts]))


def test_sums_are_those_of_all_rows(spark):
    """A round's sums over the table equal those of all unlabelled rows at once, whatever the partitions."""
    rows, labels, _ = rows_of(400)
    docs = spark.createDataFrame([*rows, (None, "a b", None, None, None)], DOCS)
    known = [i for i, _ in labels]
    free = [r for r in [*rows, (None, "a b", None, None, None)] if r[0] not in set(known)]
    features = [quality.text_features(pa.array([r[1] for r in free])), quality.meta_features(*([r[k] for r in free] for k in (2, 3, 4)))]
    y = np.array([i % 2 for i in range(len(free))], float)
    views = [quality.calibrate(quality.fit_view(x, y), x, y) for x in features]
    views[0].slope, views[1].slope = 5.0, 50.0
    want = quality.pseudo_sums(views, features)
    for parts in (1, 7):
        assert np.allclose(quality._unlabelled_sums(quality._plain(docs.repartition(parts)), known, views), want)
    assert want[0] > 0 and quality._unlabelled_sums(quality._plain(docs.limit(0)), known, views) is None


def test_labels_of_the_documents(spark):
    """Held-out labels: both views with co-training do no worse than without it, and leave good documents alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    right, lost = {}, {}
    for rounds in (0, quality.ROUNDS):
        model = quality.train(docs, labels.where("doc_id % 3 <> 0"), rounds=rounds)
        kept = {r.doc_id: r.kept for r in quality.score_documents(docs.where("doc_id % 3 = 0"), model).collect()}
        right[rounds] = sum(kept[d] == bool(q) for d, q in held.items())
        lost[rounds] = sum(q == 1 and not kept[d] for d, q in held.items())
        print(rounds, right[rounds], len(held), lost[rounds], model.text.slope, model.meta.slope)
    assert right[quality.ROUNDS] >= max(0.99 * len(held), right[0] - 3) and lost[quality.ROUNDS] <= 0.002 * len(held)


def test_one_row_of_each_labelled_id(spark, monkeypatch):
    """However many rows share an id, one of them is fitted on."""
    seen = []
    co_train = quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda x, *a, **k: seen.append(len(x)) or co_train(x, *a, **k))
    rows = [(k % 10, f"text number {k} " * 5, "en", "web", 20) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert seen == [10] and quality.score_documents(docs, model).count() == 500
