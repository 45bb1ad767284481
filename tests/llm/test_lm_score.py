import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from talelake.llm import lm_score


def corpus(n=240):
    r = random.Random(5)
    languages = [[f"{p}{k}" for k in range(30)] for p in "ab"]
    rows = []
    for i in range(n):
        words = languages[i % 2]
        rows.append((i * 7, " ".join(r.choice(words + [f"rare{r.randrange(5000)}"]) for _ in range(r.randrange(1, 60))).upper()))
    return rows + [(5001, None), (5002, ""), (5003, "  \t"), (5003, "  \t"), (5004, "never " * 70000)]


def expected(rows):
    words = {i: (t or "").encode().lower().split() for i, (_, t) in enumerate(rows)}
    held = [zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    c = Counter()
    for i, h in enumerate(held):
        if not h:
            c.update([*words[i], None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, (d, _) in enumerate(rows):
        tokens = [*words[i], None]
        out.append((d, held[i], len(tokens), sum(c[t] > 0 for t in tokens), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)))
    return out


@pytest.mark.parametrize("head,classes", [(1 << 20, 448), (40, 404)])
def test_counts_and_scores(spark, head, classes, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", head)
    monkeypatch.setattr(lm_score, "CLASSES", classes)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, row int").repartition(3)
    found = sorted(lm_score.score_documents(docs).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    want = sorted(expected(rows), key=lambda r: (r[0], r[2]))
    assert [tuple(r)[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r.base_score for r in found], [r[5] for r in want], rtol=1e-9)
    ordinary = [r for r in found if r.held_out and r.doc_id < 5000]
    assert sum(r.score for r in ordinary) > sum(r.base_score for r in ordinary)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    step = rng.dirichlet(np.full(12, 0.1), size=12)
    classes = [0]
    for _ in range(60000):
        classes.append(rng.choice(12, p=step[classes[-1]]))
    classes = np.array(classes)
    unigram = np.bincount(classes, minlength=12) + 0.1
    unigram = unigram / unigram.sum()
    model = lm_score.LogBilinear.fresh(unigram)
    squares = None
    for k in range(12):
        squares = model.fit(classes, unigram, k, squares=squares)
    scorer = lm_score.Scorer(model, np.stack([model.normalisers(u) for u in range(12)]))
    whole = scorer.u[:, None, :] + scorer.v[None, :, :] - scorer.log_z[:, :, None]
    assert np.allclose(np.exp(whole).sum(2), 1, atol=1e-4)
    assert scorer.log10(classes).mean() > np.log10(unigram)[classes].mean() + 0.1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score_documents(docs).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = lm_score.score_documents(spark.createDataFrame([(held, "a b"), (None, "c")], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.held_out) for r in only) == [(2, 0, 0, True), (3, 0, 0, True)]


def test_the_warm_sample_is_bounded(spark, monkeypatch):
    """Any number of rows under one id: the sample takes rows, not ids, and no more tokens than it may."""
    seen = []
    fit = lm_score.LogBilinear.fit
    monkeypatch.setattr(lm_score.LogBilinear, "fit", lambda self, classes, *a, **k: seen.append(len(classes)) or fit(self, classes, *a, **k))
    docs = spark.createDataFrame([(1, f"a b c {k % 400}") for k in range(3000)] + [(k, "x y z") for k in range(20)], "doc_id long, text string")
    monkeypatch.setattr(lm_score, "WARM_DOCS", 100)
    assert lm_score.score_documents(docs).count() == 3020
    assert seen and max(seen) <= 100 * 5  # four words and an end each
    seen.clear()
    monkeypatch.setattr(lm_score, "WARM_TOKENS", 77)
    assert lm_score.score_documents(docs).count() == 3020 and max(seen) == 77
