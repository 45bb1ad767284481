from pathlib import Path

from talelake.plans.lineage import Scratch, stored


def test_scratch_tables_go(spark):
    def tables():
        folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        return {p.name for p in Path(folder).glob("table-*")}

    kept = stored(spark.range(3))
    before = tables()
    with Scratch() as on_the_way:
        one = on_the_way.stored(spark.range(5))
        assert len(tables()) == len(before) + 1
        two = stored(one.where("id > 2"))
    assert len(tables()) == len(before) + 1 and sorted(r.id for r in two.collect()) == [3, 4] and kept.count() == 3
