"""Mentions by keys, and normalised texts, against plain readings."""

import random
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from talelake.functions.text import norm, normalise
from talelake.operators import mentions


def brute(texts, names):
    found = set()
    for i, text in texts:
        for e, name in names:
            n = norm(name)
            if text is not None and n is not None and len(n) >= 2 and re.search(f"(?:^|[^a-z0-9]){re.escape(n)}(?:$|[^a-z0-9])", norm(text)):
                found.add((i, e))
    return found


@pytest.mark.parametrize("few", [1 << 17, 0])
def test_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(mentions, "NAMES", few)
    r = random.Random(few)
    parts = ["ana", "Ana", "ána", "b2", "o", "the", "The", "Иван", "иван", "Й", "日本", "語", "—", "!", "\u0301", "İ", "ß", "\U0001F600", "-", " ", " ", " ", ", ", "\n"]
    make = lambda n: "".join(r.choices(parts, k=n))
    texts = [(k, make(r.randrange(0, 40))) for k in range(150)] + [(900, None), (901, ""), (902, "日本" * 5000 + " ana b2")]
    names = [(k, make(r.randrange(1, 6))) for k in range(150)] + [(500, "ana"), (501, "ana b2"), (502, "the ana o"), (503, "иван"), (504, "(ana b2)"), (505, None), (506, "日本語"), (507, "b2 ana,"), (510, "ana,"), (511, "b2-"), (512, "the\n"), (513, "ana b2, "), (514, "ana\u0301, b2"), (508, "зззз"), (509, "—!")]
    found = mentions.find_mentions(spark.createDataFrame(texts, "text_id long, text string").repartition(3), spark.createDataFrame(names, "entity_id long, name string"))
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, names)
    assert found.limit(0).count() == 0


def test_names_of_another_script_make_few_candidates(spark):
    """A thousand Cyrillic names, two hundred Cyrillic texts without any of them: once 200,000 pairs."""
    r = random.Random(1)
    letters = [chr(0x430 + k) for k in range(32)]
    word = lambda n: "".join(r.choices(letters, k=n))
    names = [(k, word(8)) for k in range(1000)]
    texts = [(k, " ".join(word(r.randrange(2, 7)) for _ in range(60))) for k in range(200)]
    texts.append((200, "x " + names[7][1] + " y"))
    words, known, few = mentions.candidates(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "entity_id long, name string"))
    pairs = words.select("text_id", F.explode("keys").alias("key")).join(known, "key")
    assert few and pairs.count() < 2000
    assert [tuple(x) for x in mentions.find_mentions(words.select("text_id", "text"), known.select("entity_id", "name")).collect()] == [(200, 7)]


def test_texts_are_read_in_one_pass(spark):
    """Latin names, few enough to be broadcast: no Python, no shuffle of texts, one for the result."""
    texts = spark.createDataFrame([(1, "Ana foi")], "text_id long, text string")
    plan = mentions.find_mentions(texts, spark.createDataFrame([("a", "Ana"), ("b", "Ana B")], "entity_id string, name string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|SortMergeJoin", plan) and "BroadcastHashJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(text_id" in plan


def test_normalise_over_all_characters(spark):
    """Every character that this Python knows, alone and between others."""
    known = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = known + [f"a{c}\u0301 B" for c in known] + ["", "  A ", "\ufeffÉ\u3000", "ΑΣ ΣΑ Σ", "e\u0327\u0301\u05b0\u0591x", "ﬁ", None]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", normalise("t").alias("n"))
    wrong = [(k, texts[k], n, norm(texts[k])) for k, n in frame.collect() if n != norm(texts[k])]
    assert not wrong, (len(wrong), wrong[:5])


def test_search_has_no_python(spark):
    from talelake.operators import search

    rows = spark.createDataFrame([("1", "Ávila"), ("2", "x")], "id string, name string")
    source = search.search_source(rows, "entity", 0, ["name"], F.col("name"), F.lit(""), [F.col("id")])
    hits = search.global_search([source], "avila")
    assert [r.id for r in hits.collect()] == ["1"]
    assert "Python" not in hits._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [1 << 17, 0])
def test_insights_carry_places_not_paragraphs(spark, monkeypatch, few):
    """No exchange has both entities and paragraphs: each pair once took its whole paragraph along."""
    monkeypatch.setattr(mentions, "NAMES", few)
    html = "<p>Ana: oi</p><p>ana e Bia</p><p>— Bia</p><p>\u201cAna\u201d</p><p>Bia disse</p><p>- ana, bia</p><p>bia gritou</p>"
    content = spark.createDataFrame([(1, html), (2, "<p>Bia</p>"), (3, None)], "text_id long, html string")
    characters = spark.createDataFrame([("a", "Ana"), ("b", "Bia"), ("c", "Caio")], "entity_id string, name string")
    told = spark.createDataFrame([("a", "9", 1, 0, 0), ("a", "8", 0, 5, 0), ("c", "7", 0, 0, 0)], "entity_id string, chapter_id string, story_order int, book_order int, sort_order int")
    found = mentions.insights(content, characters, told)
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, "a", ["Ana: oi", "\u201cAna\u201d", "- ana, bia"], "8"), (1, "b", ["— Bia", "Bia disse", "- ana, bia"], None), (2, "b", [], None),
    ]
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    for moved in re.findall(r"\) (?:Exchange|BroadcastExchange)\nInput \[\d+\]: \[(.*)\]", plan):
        assert not ("paragraph" in moved and "entity_id" in moved), moved
    one = mentions.text_insights(content.where("text_id = 1"), characters, told)
    assert sorted((r.entity_id, r.mentioned, len(r.snippets), r.first_chapter) for r in one.collect()) == [("a", True, 3, "8"), ("b", True, 3, None), ("c", False, 0, "7")]


@pytest.mark.parametrize("few", [1 << 17, 0])
def test_names_with_a_space_in_another_script(spark, monkeypatch, few):
    """Names without a telling Latin word go by what stands around a space: every stretch of three characters of a text was once a key."""
    monkeypatch.setattr(mentions, "NAMES", few)
    r = random.Random(2)
    parts = ["мама", "ма", "мыла", "ла", "м", "ó", "o", "a", "b2", "ß", "日本", "!", ".", "\n", "\U0001F600", " ", " ", " ", " ", " "]
    make = lambda n: "".join(r.choices(parts, k=n))
    texts = [(k, make(r.randrange(0, 60))) for k in range(200)] + [(900, None), (901, "мама мыла"), (902, "xмама мыла"), (903, "мама мылаx"), (904, "умама мылау мама мыла2"), (905, "мама  мыла"), (906, "м ла м"), (907, "мама мыла: да")]
    names = [(k, make(r.randrange(2, 8))) for k in range(200)] + [(500, "мама мыла"), (501, "ма м"), (502, "ма ла м"), (503, "м  ма"), (504, "ó мыла"), (505, None), (506, "ß."), (507, " ла м ")]
    found = mentions.find_mentions(spark.createDataFrame(texts, "text_id long, text string").repartition(3), spark.createDataFrame(names, "entity_id long, name string"))
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, names)
    two_words = spark.createDataFrame([(1, "мама мыла"), (2, "ó мыла")], "entity_id long, name string")
    plan = mentions.find_mentions(spark.createDataFrame(texts, "text_id long, text string"), two_words)._jdf.queryExecution().toString()
    assert "{3}" not in plan


def test_a_short_sign_name_does_not_have_texts_written(spark):
    """A name of two signs has one stretch, so there is no rarest to be found: texts once were written and read twice for it."""
    texts = spark.createDataFrame([(1, "Ana foi ß. já"), (2, "ana ß"), (3, "xß.")], "text_id long, text string")
    names = spark.createDataFrame([("a", "Ana"), ("b", "ß.")], "entity_id string, name string")

    def keep(df):
        raise AssertionError("texts are written")

    assert {tuple(r) for r in mentions.find_mentions(texts, names, keep).collect()} == {(1, "a"), (1, "b"), (2, "a")}
