import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from talelake.llm import lexical_search as lx


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\ud800", ""))


def brute(docs, items):
    split = [(d, Counter(terms(t))) for d, t in docs]
    split = [(d, c, c.total()) for d, c in split if c]
    n, total = len(split), sum(x[2] for x in split)
    df = Counter(t for _, c, _ in split for t in c)
    found = []
    for item, text in set(items):
        scores = []
        for d, c, length in split:
            m = 100 - 75 + 75 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        found += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:10], 1)]
    return sorted(found, key=repr)


@pytest.mark.parametrize(("shard", "shard_terms", "block_terms", "listed"), [(4096, 1 << 20, 1 << 16, 1 << 18), (7, 60, 9, 0), (40, 1 << 20, 1 << 16, 1 << 18)])
def test_against_brute_force(spark, monkeypatch, shard, shard_terms, block_terms, listed):
    for name, value in (("SHARD", shard), ("SHARD_TERMS", shard_terms), ("BLOCK_TERMS", block_terms), ("LISTED", listed)):
        monkeypatch.setattr(lx, name, value)
    r = random.Random(shard)
    words = [f"w{k}" for k in range(60)] + ["The", "ÉTÉ", "été", "naïve", "日本語", "x1", "K"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: "".join(w + r.choice([" ", ", ", ".\n", "_", "-"]) for w in r.choices(words, weights, k=n))
    docs = [(k, text(r.randrange(1, 40))) for k in range(300)] + [(900 + k, "w3 w9 w40 same text") for k in range(30)]
    docs += [(1, None), (2, ""), (3, "  .,;  "), (None, "w1 w55 été"), (None, "w1 w55 été"), (7, "w7 " * 20000 + "unique"), (8, "THE the tHe w1"), (8, "the w59 w58")]
    items = [(k, text(r.randrange(1, 15))) for k in range(25)] + [(50, "unique"), (51, "nowhere at-all"), (52, None), (53, ""), (54, "w3 w3 w9 w40 same"), (None, "été w55"), (54, "other w8"), (50, "unique")]
    frame = spark.createDataFrame([(*d, "de", 4) for d in docs], "doc_id long, text string, term string, score int").repartition(5)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    index = lx.build_index(frame)
    assert sorted((tuple(x) for x in lx.search(index, asked).collect()), key=repr) == brute(docs, items)
    assert lx.search(index, asked.limit(0)).count() == 0
    assert lx.search(lx.build_index(frame.limit(0)), asked).count() == 0


def test_non_essential_lists_are_only_probed():
    r = np.random.default_rng(1)
    builder = lx.ShardBuilder()
    for k in range(3000):
        builder.add(k, [b"common"] * int(r.integers(1, 4)) + ([b"rare"] * 3 if k % 150 == 0 else []) + [b"filler"] * int(r.integers(0, 30)))
    s = builder.shard()
    shard = lx.Shard(s["ids"], np.array(s["lengths"]), s["terms"], np.array(s["sizes"]), np.frombuffer(s["docs"], np.int32), np.frombuffer(s["counts"], np.int32), 3000, sum(s["lengths"]))
    found, scores = shard.search([("rare", 5000), ("common", 10)])
    assert len(found) == 10 and (np.diff(scores) <= 0).all()
    assert shard.scored == 20 and shard.probed <= 20  # not the 3,000 of the common term
    full = np.zeros(3000, np.int64)
    for t, w in (("rare", 5000), ("common", 10)):
        docs, factors, _ = shard.postings(t)
        full[docs] += w * factors
    assert scores.tolist() == sorted(full.tolist(), reverse=True)[:10]


def test_terms():
    every = "".join(chr(c) for c in range(0x250)) + " 日 x"
    assert [t.decode() for t in lx.terms_of(every.encode())] == terms(every)


def test_row_groups_of_the_index_are_bounded_by_bytes(spark, monkeypatch):
    """Tasks hold whole row groups: a hundred shards in one would be hundreds of megabytes."""
    monkeypatch.setattr(lx, "GROUP_BYTES", 1 << 13, raising=False)
    docs = spark.range(5 * lx.SHARD, numPartitions=1).selectExpr("id AS doc_id", "concat_ws(' ', md5(concat(id, '')), md5(concat(id, 'x'))) AS text")
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in lx.build_index(docs).inputFiles()]
    groups = [f.row_group(k) for f in files for k in range(f.num_row_groups)]
    assert [g.num_rows for g in groups] == [1] * 5
