import hashlib
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from talelake.llm import suffix_dedup as sd


def brute(rows, length):
    places = defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for i, t in enumerate(texts):
        for k in range(len(t) - length + 1):
            places[t[k : k + length]].append((i, k))
    gone = [np.zeros(len(t), bool) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for i, k in found:
                gone[i][k : k + length] = True
    out = []
    for (d, _), t, g in zip(rows, texts, gone, strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~g]) if len(t) else b""
        spans = int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum())
        out.append((d, len(t), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = random.Random(seed)

    def text(k):
        return "".join(r.choice("abcdefghij é\n") for _ in range(k))

    common = [text(k) for k in (390, 399, 400, 401, 500, 900, 2000)]
    rows = []
    for i in range(n):
        t = text(r.choice([0, 50, 390, 600, 1500]))
        for _ in range(r.choice([0, 1, 1, 2])):
            c = r.choice(common)
            a = r.randrange(0, 60)
            at = r.randrange(len(t) + 1)
            t = t[:at] + c[a : a + r.choice([350, 420, 800, 3000])] + t[at:]
        rows.append((i, t))
    base = list(text(2500))
    for i in range(12):
        b = list(base)
        for _ in range(r.choice([0, 1, 3])):
            b[r.randrange(len(b))] = "#"
        rows.append((1000 + i, "".join(b)))
    rows += [(2000, None), (2001, ""), (2002, "z" * 3000), (2003, "xy" * 450), (2004, "q" * 399), (2005, "Q" * 400), (2005, "Q" * 400), (2006, "R" * 401)]
    rows += [(3000, rows[7][1]), (3000, rows[7][1]), (None, "ü" * 300)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,piece,crowd", [(1, 1 << 20, 256), (2, 700, 3)])
def test_against_brute_force(spark, seed, piece, crowd, monkeypatch):
    monkeypatch.setattr(sd, "CROWD", crowd)
    monkeypatch.setattr(sd, "PIECE", piece)
    monkeypatch.setattr(sd, "SORTED", 1 << 22 if seed == 1 else 5000)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "g") for d, t in rows], "doc_id long, text string, n long, gram string").repartition(5)
    found = sorted((tuple(r) for r in sd.remove_repeats(docs, digests=True).collect()), key=str)
    assert found == brute(rows, 400)


def test_spans_and_bytes(spark):
    docs = spark.createDataFrame([(1, "a" * 10 + "b" * 500), (2, "c" * 7)], "doc_id long, text string")
    found = {r.doc_id: r for r in sd.remove_repeats(docs).collect()}
    assert bytes(found[1].kept) == b"a" * 10 and [tuple(s) for s in found[1].spans] == [(10, 510)]
    assert bytes(found[2].kept) == b"c" * 7 and found[2].spans == []
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_pieces_give_the_same_anchors(monkeypatch):
    r = np.random.default_rng(0)
    texts = ["".join(chr(97 + x) for x in r.integers(0, 26, n)) for n in (5000, 100, 0, 3000)]
    whole = sd.batch_anchors(pa.array(texts))
    monkeypatch.setattr(sd, "PIECE", 900)
    parts = sd.batch_anchors(pa.array(texts))
    for k in whole:
        assert (whole[k] == parts[k]).all(), k


def test_strings_that_defeat_powers_of_two(spark):
    """A string of two letters by the parity of set bits and its complement collide in any polynomial modulo 2**64."""
    r = random.Random(5)
    rows = []
    for i in range(24):
        a, b = ("*", "u") if i % 2 else ("u", "*")
        rows.append((i, "".join(chr(33 + r.randrange(90)) for _ in range(300)) + "".join(a if bin(k).count("1") % 2 else b for k in range(256))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(x) for x in sd.remove_repeats(docs, digests=True).collect()), key=str)
    assert found == brute(rows, 400) and all(x[2] == 0 for x in found)


def test_products_and_hashes():
    r = random.Random(1)
    prime = (1 << 61) - 1
    a, b = ([*(r.randrange(prime) for _ in range(500)), 0, prime - 1, prime - 1] for _ in range(2))
    assert sd.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % prime for x, y in zip(a, b, strict=True)]
    data = np.frombuffer(bytes(r.randrange(3) for _ in range(3000)), np.uint8)
    for gram in (8, 16, 64):
        by = {}
        for k, h in enumerate(sd.gram_hashes(data, gram).tolist()):
            assert by.setdefault(bytes(data[k : k + gram]), h) == h
        assert len(set(by.values())) == len(by) and len(sd.gram_hashes(data, gram)) == 3000 - gram + 1
    assert sd.gram_hashes(data[1:65], 64)[0] == sd.gram_hashes(data, 64)[1]


def test_sort_and_extents():
    r = random.Random(3)
    contexts, left = [], []
    base = "".join(r.choice("ab") for _ in range(40))
    for _ in range(300):
        k = r.randrange(0, 20)
        t = list(base[k:])
        if r.random() < 0.7:
            t[r.randrange(len(t))] = "c"
        contexts.append("".join(t).encode())
        left.append(20 - k)
    left = np.array(left)
    s = sd.Suffixes(contexts, left, np.arange(300) % 3)
    for back in (False, True):
        keys = [(i % 3, contexts[i][: left[i]][::-1] if back else contexts[i][left[i] :], i) for i in range(300)]
        assert s.sort(back).tolist() == sorted(range(300), key=keys.__getitem__)

    def shared(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    a, b = s.extents(25)
    for i in range(300):
        pairs = [(shared(contexts[i][: left[i]][::-1], contexts[j][: left[j]][::-1]), shared(contexts[i][left[i] :], contexts[j][left[j] :])) for j in range(300) if j != i and j % 3 == i % 3]
        pairs = [p for p in pairs if sum(p) >= 25]
        assert (a[i], b[i]) == (max((p[0] for p in pairs), default=0), max((p[1] for p in pairs), default=0))


def test_prefix_hashes_are_worked_out_in_steps():
    """Several arrays of eight times the bytes each once stood side by side; now there is the result and a step."""
    p = sd.Polynomial()
    p.grow(900)
    data, local = np.random.default_rng(5).integers(0, 256, 1 << 20).astype(np.uint8), np.arange(1 << 20) % 900
    tracemalloc.start()
    sums = p.prefix(data, local)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(data)
    prime, total, whole = (1 << 61) - 1, 0, [0]
    for x, k in zip(data[: 3 * sd.STEP].tolist(), local.tolist(), strict=False):
        total = (total + (x + 1) * int(p.powers[k])) % prime
        whole.append(total)
    assert sums[: len(whole)].tolist() == whole


def test_a_gram_of_very_many_contexts_is_split_by_the_join(spark):
    """Kinds were counted inside the join, which left all contexts of a frequent line to one task."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    small |= {f"spark.sql.adaptive.{k}": "16k" for k in ("advisoryPartitionSizeInBytes", "skewJoin.skewedPartitionThresholdInBytes")}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        # 40,000 contexts of one gram, two of each of 500 grams, one of each of 500
        each = sd.stored(spark.range(41500).selectExpr("CASE WHEN id < 40000 THEN -1 WHEN id < 41000 THEN id div 2 ELSE id END gram", "uuid() c1"))
        for how, rows in (("inner", 41000), ("left", 41500)):
            found = sd._with_kinds(each, "gram", sd.stored, how)
            kinds = [r.kinds for r in found.collect()]
            assert len(kinds) == rows and kinds.count(40000) == 40000 and kinds.count(2) == 1000
            assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
