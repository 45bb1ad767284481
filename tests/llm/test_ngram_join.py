import random

import numpy as np
import pytest

from talelake.llm import ngram_join


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size=4, percent=85):
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def rows_of(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([3, 12, 60, 150]))] for _ in range(25)]
    line = " ".join(r.choice(vocabulary) for _ in range(14))
    rows = []
    for _ in range(n):
        w = list(base[min(24, int(r.expovariate(0.3)))])
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append(r.choice([" ", "\n", "  "]).join(w) + (f"\n{line}" if r.random() < 0.4 else ""))
    rows += ["", None, "  ", "Word", "WORD", "one two three", "one two three four"]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_signatures_bound_intersections():
    r = np.random.default_rng(2)
    for n in (1, 5, 300, 5000):
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate((x[: n // 2], r.integers(0, 1 << 63, n * 3).astype(np.uint64))))
        for a, b in ((x, y), (y, x), (x, x)):
            assert len(np.intersect1d(a, b)) <= ngram_join.most_common(ngram_join.signature(a), ngram_join.signature(b)) <= min(len(a), len(b))
    assert ngram_join.most_common(b"", b"x") is None


@pytest.mark.parametrize("short", [64, 3])
def test_against_brute_force(spark, short, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "FEW", 16 if short == 64 else 2)
    monkeypatch.setattr(ngram_join, "UNIT", 256 if short == 64 else 5)
    rows = rows_of(short)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, cls string")
    found = sorted(tuple(r) for r in ngram_join.jaccard_components(docs).collect())
    assert found == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(4, "a b c d e"), (4, "a b c d e"), (2, "A B c\td e"), (7, None), (None, "q r")], "doc_id long, text string")
    found = sorted(map(str, (tuple(r) for r in ngram_join.jaccard_components(docs).collect())))
    assert found == sorted(map(str, [(2, 2, 2), (4, 2, 2), (4, 2, 2), (7, 0, 7), (None, 1, None)]))
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_common_items_in_parts():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 200, r.integers(0, 90)).astype(np.uint64) << np.uint64(56)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert ngram_join.common_items(sets[:5], sets[5:], columns=16).tolist() == want


def test_forest_keeps_components():
    r = np.random.default_rng(0)
    for _ in range(50):
        mask = r.random((6, 7)) < 0.2
        left, right = np.arange(6), np.arange(10, 17)
        a, b = ngram_join.forest(mask, left, right)
        assert set(a) == set(left[mask.any(1)]) | set(right[mask.any(0)])
        label = dict(zip(a.tolist(), b.tolist(), strict=True))
        for i, j in zip(*np.nonzero(mask), strict=True):
            assert label[left[i]] == label[right[j]]


def test_null_and_repeated_ids_lose_near_copies_only(spark):
    base = " ".join(f"w{k}" for k in range(60))
    texts = [base + " end", base + " stop", base + " over", " ".join(f"u{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))]
    pair = [" ".join(f"p{k}" for k in range(60)) + e for e in (" a", " b")]
    same = [" ".join(f"q{k}" for k in range(60)) + e for e in (" a", " b")]
    rows = [(1, texts[0]), (None, texts[1]), (7, texts[2]), (None, texts[3]), (7, texts[4]), (7, texts[4]), (None, pair[0]), (None, pair[1]), (8, same[0]), (8, same[1]), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in ngram_join.drop_near_copies(docs).collect()]
    rest = [r for r in found if r[1] not in pair + same]
    assert sorted(map(str, rest)) == sorted(map(str, [(1, texts[0]), (None, texts[3]), (7, texts[4]), (7, texts[4]), (9, ""), (None, None)]))
    assert sorted(str(d) for d, t in found if t in pair + same) == ["8", "None"]
