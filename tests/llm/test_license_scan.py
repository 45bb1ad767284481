import random
import re
from math import ceil

import pytest

from talelake.llm import license_scan as ls
from talelake.llm.license_scan import Template


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text, templates, least):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, base, labels, score = [], set(), set(), 0.0
    for t in templates:
        n, size = len(t.words), len(set(t.words))
        for start in range(0, len(w), n):
            common = len(set(t.words) & set(w[start : start + 2 * n]))
            if t.ordered:
                if at := [s for s in range(start, start + n) if w[s : s + n] == t.words]:
                    places += at
                    base.add(t.label)
                    labels.add(t.label)
                    score = 1.0
            elif common >= ceil(least * size - 1e-9):
                labels.add(t.label)
                score = max(score, common / size)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


TEXTS = [
    None, "", " .,-", "CC BY", "cc-by-cc BY, all Rights\nreserved", "all all rights reserved rights reserved", "General public license general public license",
    "released mit license the", "Released under the MIT License.", "mit", "the license of mit was released under", "Licensed under CC BY-NC 4.0.",
    "K cc by İ Kall rights reserved", "café CC BY ccé by", "word " * 30000 + "all rights reserved " + "cc by " * 5000,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files the software to deal without restriction",
]


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_against_brute_force(spark, least):
    templates = [*ls.PHRASES, *ls.NOTICES]
    r = random.Random(least)
    pool = sorted({w for t in templates for w in t.words}) + ["lorem", "ipsum", "CC", "é"]
    texts = TEXTS + [" ".join(r.choices(pool, k=r.randrange(80))) for _ in range(60)]
    for t in ls.NOTICES:  # notices with words left out, changed, in any order
        for _ in range(6):
            w = [x for x in t.words if r.random() > 0.15]
            if r.random() < 0.5:
                r.shuffle(w)
            texts.append(" ".join(r.choices(pool, k=r.randrange(20)) + w + r.choices(pool, k=r.randrange(20))))
    rows = [(k if k % 9 else None, text, "x", 1) for k, text in enumerate(texts)]
    rows += [rows[3], rows[3], rows[4], (5, "cc by cc by", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, template int").repartition(5)
    found = sorted((tuple(x) for x in ls.scan(docs, least=least).collect()), key=repr)
    assert found == sorted(((d, *brute(text, templates, least)) for d, text, *_ in rows), key=repr)


def test_no_documents_and_own_templates(spark):
    docs = spark.createDataFrame([(1, "a b c a b d"), (2, "d c b a")], "doc_id long, text string")
    own = [Template("x", "a b c d"), Template("y", "b a", True)]
    assert sorted(tuple(x) for x in ls.scan(docs, own, 1.0).collect()) == [(1, *brute("a b c a b d", own, 1.0)), (2, *brute("d c b a", own, 1.0))]
    assert ls.scan(docs.limit(0)).count() == 0
    hits = ls.find_blocks(docs, own, 1.0).where("label = 'x'").select("doc", "start", "length", "containment").collect()
    assert sorted(tuple(h) for h in hits) == [(1, 0, 6, 1.0), (2, 0, 4, 1.0)]


def test_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = ls.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_blocks_that_begin_one_word_before_a_part(spark):
    """A word that opens a part, in a block that the part before has: slice was asked for place 0."""
    texts = ["word " * k + "general public license cc by all rights reserved" for k in range(ls.PART - 8, ls.PART + 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = sorted(tuple(x) for x in ls.scan(docs).collect())
    assert found == [(k, *brute(t, [*ls.PHRASES, *ls.NOTICES], ls.LEAST)) for k, t in enumerate(texts)]
