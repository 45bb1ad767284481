import numpy as np
import pytest

from talelake.llm import embedding_dedup as ed


def brute(rows, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(k, low.get(find(i), k))
    return sorted((k, n[i], low[find(i)], k == low[find(i)]) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 37])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", block)
    r = np.random.default_rng(block)
    base = r.normal(size=(20, 16))
    rows = [(i, (base[r.integers(20)] * r.uniform(0.1, 9) + r.normal(size=16) * r.choice([0, 0.1, 0.2, 0.3])).tolist()) for i in range(200)]
    rows += [(1000 + k, rows[5][1]) for k in range(40)]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [1.0, None]), (304, [float("nan")] * 16), (305, [float("inf")] * 16), (306, [1.0, 0.0]), (307, [2.0, 0.1]), (308, [-0.0] * 15 + [1.0])]
    order = r.permutation(len(rows))
    frame = spark.createDataFrame([(rows[i][0], rows[i][1], 3, 4) for i in order], "vec_id long, embedding array<float>, label int, n_links int")
    assert sorted(tuple(x) for x in ed.near_vectors(frame).collect()) == brute(rows)
    assert ed.near_vectors(frame.limit(0)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(1)
    for dim in (3, 64, 1500):
        u = r.normal(size=(60, dim)) * r.uniform(0, 3, size=dim) ** 4
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        q, s, n, e = ed.quantise(u)
        product = (q.astype(float) @ q.astype(float).T) * s[:, None] * s[None, :]
        assert (np.abs(product - u @ u.T) <= e[:, None] + n[:, None] * e[None, :] + 1e-9).all()
        x = np.repeat(u[:30], 2, 0) + r.normal(size=(60, dim)) * 0.2 / np.sqrt(dim)
        w = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert (ed.tile_links(x, x, 0.95) == (w @ w.T >= 0.95)).mean() > 0.9999
