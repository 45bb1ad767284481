"""License scans as an exact set-similarity join of text blocks with templates.

A template is a notice of n different words; a text block is a window of twice the
notice's length, one every such length, so that a notice that stands in a text lies
whole in one of them. A block and a template join when the block holds at least
``least`` of the template's different words (its containment). The join is exact:

* Words are ordered by their occurrences in all documents, rarest first. Of a template
  that needs o of n words, one of the first n - o + 1 must be in the block (prefix
  filter), so that only places of such words make candidates: a word of the text is
  looked up among these few words, which are broadcast.
* A block is reduced to the words that occur in any template; fewer than o are not
  enough (length filter), nor are o words left from the place of the first common word
  on, in the template or in the block (positional filter).
* What is left is counted. Phrases (``ordered``) must then stand word by word; each
  place is counted in the block whose first half it begins in.

Nothing but expressions and joins of DataFrames is used, and texts are not shuffled:
blocks are cut in the task that reads the text; what travels is one row for each
document and each hit. A long text, a hot source or a line that many documents share is
split by no key and needs no salt.

A null or empty text has no words. Rows that share doc_id and text have equal results,
one row each; a null doc_id is an id like any other. Very long texts are cut into blocks
like all others, ties have no bearing, an empty table gives no rows, and extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talelake.llm.common import table

#: What stands between words; digits, a-z and all that is not ASCII make words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Part of a template's words that a block must hold.
LEAST = 0.8
#: Words of all templates together; so large is the table that is broadcast.
MOST_WORDS = 8192
#: Words of a text that one row holds.
PART = 1024


@dataclass(frozen=True)
class Template:
    """A notice: its label and its words. ordered: all of them, one after the other."""

    label: str
    text: str
    ordered: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: Phrases that decide by their words alone.
PHRASES = [
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
]
#: Notices of well-known licenses, as words.
NOTICES = [
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    # lower() has a fast way for ASCII; in other texts it would change more than A-Z
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(lower, BETWEEN), "")  # empty: before the first and after the last


def occurrences(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """How often each word of the vocabulary stands in all documents (0: nowhere)."""
    # outer: Spark would otherwise split each text twice, first to see whether it has words
    found = docs.select(F.explode_outer(words(F.col(text_col))).alias("word")).where(F.col("word").isin(vocabulary)).groupBy("word").count()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in found.collect()}  # as many rows as the vocabulary has words


def find_blocks(docs: DataFrame, templates: list[Template], least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The hits of the join, and one row without a template for each document.

    Columns: doc, digest (of the text), n_words, template (place in the list), label,
    ordered, start (the block's first word, from 0), length (words), containment, places
    (where an ordered template's words begin in the block's first half).
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in t.words})
    if sum(len(t.words) for t in templates) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    count = occurrences(docs, vocabulary, text_col)
    order = sorted(vocabulary, key=lambda w: (count[w], w))
    rank = {w: k for k, w in enumerate(order)}
    prefixes: list[tuple] = [("", None, None, None, None, None, None, None, None)]  # the document's own row
    for k, t in enumerate(templates):
        tokens = sorted(set(t.words), key=rank.__getitem__)
        need = len(tokens) if t.ordered else max(1, ceil(least * len(tokens) - 1e-9))
        first = tokens[: len(tokens) - need + 1]
        prefixes += [(w, k, t.label, t.ordered, t.words, tokens, first, need, i) for i, w in enumerate(first)]
    listed = spark.createDataFrame(prefixes, "word string, template int, label string, ordered boolean, phrase array<string>, tokens array<string>, first array<string>, need int, place int")

    text = F.coalesce(F.col(text_col), F.lit(""))
    longest = max(len(t.words) for t in templates)
    split = docs.select(F.col(id_col).alias("doc"), F.sha2(text, 256).alias("digest"), words(F.col(text_col)).alias("words"))
    # parts of a text with all blocks that begin in them, so that no row that follows holds a long text
    part = lambda c: F.struct(c.alias("low"), F.slice("words", c + 1, PART + 2 * longest).alias("words"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(PART)), part)
    rare = sorted({p[0] for p in prefixes[1:]})
    few = F.when(F.arrays_overlap("words", F.lit(rare)), F.col("words")).otherwise(F.array().cast("array<string>"))  # most texts have none of these words
    split = split.select("doc", "digest", F.size("words").cast("long").alias("n_words"), few.alias("words"))
    split = split.select("doc", "digest", "n_words", F.explode_outer(parts).alias("part")).select("doc", "digest", "n_words", "part.*")
    # no word is empty, so an empty one in the first part stands for the document
    marked = F.when(F.col("low") == 0, F.array_append("words", F.lit(""))).otherwise(F.col("words"))
    placed = split.select("*", F.posexplode_outer(marked).alias("at", "word")).withColumn("at", F.col("at") + F.col("low"))
    found = placed.join(F.broadcast(listed), "word")
    step, block = F.size("phrase"), F.col("block")
    k = F.floor(F.col("at") / step).cast("int")
    blocks = F.when(F.col("template").isNull(), F.array(F.lit(0))).when(k > 0, F.array(k, k - 1)).otherwise(F.array(k))
    cut = found.withColumn("k", F.explode_outer(blocks)).withColumn("start", F.col("k") * step)
    cut = cut.where(F.col("template").isNull() | ((F.col("start") >= F.col("low")) & (F.col("start") < F.col("low") + PART)))
    # bounded, as Spark may evaluate this before the filter, and fails at place 0
    first = F.greatest(F.col("start") - F.col("low") + 1, F.lit(1))
    cut = cut.withColumn("block", F.when(F.col("template").isNotNull(), F.slice("words", first, F.greatest(2 * step, F.lit(0)))))
    known = F.array_intersect(F.lit(order), block)  # the block's words that matter, in the global order
    n = F.size("tokens")
    left = F.least(n - F.col("place"), F.size(known) - F.array_position(known, F.col("word")).cast("int") + 1)
    candidate = (
        (F.array_position(block, F.col("word")) == F.col("at") - F.col("start") + 1)  # once for each block
        & (F.element_at(F.array_intersect("first", block), 1) == F.col("word"))  # by its first common word
        & (F.size(known) >= F.col("need"))
        & (left >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("tokens", block))
    counted = cut.where(F.col("template").isNull() | candidate).withColumn("overlap", overlap).where(F.col("template").isNull() | (F.col("overlap") >= F.col("need")))
    small = counted.select("doc", "digest", "n_words", "template", "label", "ordered", "phrase", "start", "block", (F.col("overlap") / n).alias("containment"))
    begins = F.filter(F.sequence(F.lit(0), step - 1), lambda s: F.slice(block, s + 1, step) == F.col("phrase"))
    places = F.when(F.col("ordered"), F.transform(begins, lambda s: s + F.col("start")))
    hits = small.withColumn("places", places).where("template IS NULL OR NOT ordered OR size(places) > 0")
    return hits.select("doc", "digest", "n_words", "template", "label", "ordered", "start", F.size(block).alias("length"), "containment", "places")


def scan(docs: DataFrame, templates: list[Template] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What each document holds: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    base: the ordered templates. score: the largest containment of a template that was
    found (1 for a phrase), 0 without any.
    """
    hits = find_blocks(docs, templates or [*PHRASES, *NOTICES], least, id_col, text_col)
    joined = lambda label: F.array_join(F.sort_array(F.collect_set(label)), ",")
    per = hits.groupBy("doc", "digest").agg(
        F.count_if(F.col("template").isNull()).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.coalesce(F.sum(F.when(F.col("ordered"), F.size("places"))), F.lit(0)).alias("n_base"),
        F.min(F.array_min("places")).cast("long").alias("first_word"),
        F.max(F.array_max("places")).cast("long").alias("last_word"),
        joined(F.when(F.col("ordered"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("containment"), F.lit(0.0)).alias("score"),
    )
    each = per.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    n_base = (F.col("n_base") / F.col("copies")).cast("long")
    return each.select(F.col("doc").alias(id_col), "n_words", n_base.alias("n_base"), "first_word", "last_word", "base_labels", "labels", "score")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and phrases of all documents."""
    return scan(table(spark, sf_dir, "documents"))


#: A word in SQL.
WORD = BETWEEN.replace("[", "[^")


def _listed(templates: list[Template]) -> str:
    return ",\n  ".join(f"({k}, '{t.label}', {str(t.ordered).lower()}, string_split('{t.text}', ' '))" for k, t in enumerate(templates))


#: Every block is compared with every template.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}') AS w
  FROM documents),
t(k, label, ordered, phrase) AS (VALUES
  {_listed([*PHRASES, *NOTICES])}),
blocks AS (
  SELECT r, label, ordered, phrase, len(phrase) AS l, w, unnest(range(0, len(w), len(phrase))) AS start FROM d, t),
counted AS (
  SELECT r, label, ordered, len(list_intersect(list_distinct(phrase), list_distinct(w[start + 1 : start + 2 * l]))) / len(list_distinct(phrase)) AS part,
    CASE WHEN ordered THEN list_filter(range(start, start + l), lambda s: w[s + 1 : s + l] = phrase) END AS places
  FROM blocks),
hits AS (
  SELECT r, max(part) AS score, CAST(sum(len(places)) AS BIGINT) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word,
    string_agg(DISTINCT CASE WHEN ordered THEN label END, ',' ORDER BY CASE WHEN ordered THEN label END) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM counted WHERE CASE WHEN ordered THEN len(places) > 0 ELSE part >= {LEAST} - 1e-9 END GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN hits USING (r)
"""
