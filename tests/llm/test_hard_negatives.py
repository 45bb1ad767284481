import numpy as np
import pytest
from pyspark.sql import functions as F

from talelake.llm import hard_negatives as hn

INF = float("inf")


def brute(rows):
    """rows: vec_id, label, vector; labels as they count."""
    one = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = tuple(max(-hn.LARGEST, min(hn.LARGEST, int(np.floor(float(np.float32(x)) * 256)))) for x in v)
        one[i] = min(one.get(i, (label, whole)), (label, whole))
    found = []
    for a, (label, v) in one.items():
        if a % 100:
            continue
        scores = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in one.items() if i != a and len(w) == len(v)}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if one[i][0] == label][:5]:
            inside = [i for i in order if one[i][0] != label and 30 * scores[p] <= 100 * scores[i] <= 90 * scores[p]]
            found += [(a, p, r, n, scores[p], scores[n]) for r, n in enumerate(inside[:10], 1)]
    return sorted(found)


@pytest.mark.parametrize(("vectors", "anchors", "cells"), [(1 << 20, 1 << 15, 64), (700, 40, 8), (3000, 100, 512)])
def test_against_brute_force(spark, monkeypatch, vectors, anchors, cells):
    monkeypatch.setattr(hn, "VECTORS", vectors)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    monkeypatch.setattr(hn, "CELLS", cells)
    r = np.random.default_rng(cells)
    middle = r.normal(size=(6, 16)) * 0.2
    rows = [(int(i), int(r.integers(4)), (middle[r.integers(6)] + r.normal(size=16) * r.choice([0.0, 0.02, 0.2])).tolist()) for i in r.permutation(900)]
    rows += [(1000 + i, int(i) % 3, rows[7][2]) for i in range(60)]  # copies, ties
    rows += [(2000, 1, [0.5, 0.5]), (2001, 1, [0.5, 0.25]), (2002, 2, [0.25, 0.5]), (2003, 2, [3.0, 4.0]), (2004, 0, [0.1, 0.1])]
    rows += [(2100, None, [1.0]), (2200, 1, None), (2300, 1, []), (2400, 1, [None, 1.0]), (2500, 1, [INF, 1.0]), (2600, 1, [float("nan")] * 16), (None, 1, rows[7][2])]
    rows += [(2700, 1, [1e30] * 3), (2701, 1, [-1e30] * 3), (2702, 2, [1e5] * 3), (2703, 1, [3e5] * 3), (2800, 7, [0.0] * 16), (2801, 7, [0.0] * 16)]
    rows += [rows[3], rows[3], (rows[5][0], 3, rows[9][2]), (0, 3, rows[9][2])]  # repeated rows and ids
    frame = spark.createDataFrame([(*x, 1.5, "v") for x in rows], "vec_id long, label int, embedding array<float>, score double, v string")
    found = hn.mine(hn.as_integers(frame)).collect()
    assert sorted(tuple(x) for x in found) == brute(rows)
    assert hn.mine(hn.as_integers(frame.where(F.lit(False)))).count() == 0


def test_bounds_hold_and_spare_work():
    r = np.random.default_rng(3)
    values = np.floor(256 * (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(r.normal(size=(4000, 64)))).astype(np.int64)
    anchor = values[0]
    lower, spread = hn.Approximation(values).lower(anchor)
    exact = values @ anchor
    assert (lower <= exact).all() and (exact <= lower + spread).all()
    block = hn.Searched(np.arange(4000), r.integers(0, 10, 4000), values)
    ids, scores = block.positives(0, int(block.labels[0]), anchor, 5)
    assert len(ids) == 5 and block.scored < 200  # of about 400 of its label
    before = block.scored
    block.negatives(int(block.labels[0]), anchor, [hn.window_of(int(s)) for s in scores], 10)
    assert block.scored - before < 2000  # of about 3,600 of other labels


def test_windows():
    for score in range(-40, 400):
        low, high = hn.window_of(score)
        assert [s for s in range(-400, 400) if 30 * score <= 100 * s <= 90 * score] == list(range(low, high + 1))
