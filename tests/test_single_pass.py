"""Steps that once sorted an input task's rows whole, or read costly relations several times."""

import re

import pytest
from pyspark.sql import functions as F

from talelake.operators import graph, share
from talelake.plans import registry


def test_attributes_are_dealt_before_they_are_sorted(spark):
    rows = spark.createDataFrame([(f"e{i}", 0, f"k{k:02d}") for i in range(30) for k in range(50)], "entity_id string, sort_order int, key string").coalesce(1)
    shown = share.shown_attributes(rows)
    assert {tuple(r) for r in shown.groupBy("entity_id").agg(F.count("key"), F.max("key")).collect()} == {(f"e{i}", 40, "k39") for i in range(30)}
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan[plan.index("Exchange") :]


def test_a_walk_reads_the_relations_once(spark):
    """Both directions and the hubs once were read from the relations each by themselves, four times in all."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(x):
        seen.add(1)
        return x

    relations = spark.createDataFrame([(str(k), str(k + 1)) for k in range(50)], "source_id string, target_id string")
    relations = relations.select(read.asNondeterministic()("source_id").alias("source_id"), "target_id")
    found = graph.reached(relations, spark.createDataFrame([("0",)], "id string"), 2)
    assert {(r.id, r.depth) for r in found.collect()} == {("0", 0), ("1", 1), ("2", 2)} and seen.value == 50


@pytest.mark.parametrize("name, work", [("q05_mention_index", "Generate"), ("q05_chapter_mentions", "html_paragraphs"), ("q05_html_mention_index", "html_paragraphs"), ("n03_paragraphs", "html_paragraphs"), ("n23_sanitised_pages", "sanitise_html")])
def test_texts_are_dealt_before_they_are_worked_on(spark, name, work):
    """A file of one row group is read by a single task, which once did all the work on its texts, too."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.search(r"Exchange hashpartitioning\((doc_id|page_id)#\w+, \d+\), REPARTITION_BY_NUM", plan)
    assert dealt and work in plan[: dealt.start()] and work not in plan[dealt.start() :]
