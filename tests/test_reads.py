"""Reads, versions and what a merge brings, on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from talelake.functions import text
from talelake.functions.schemas import SYNCED, empty, schema, with_defaults
from talelake.operators import graph, hierarchy, merge, reads, share
from talelake.plans.positions import numbered
from talelake.sources import snapshots
from tests.test_quirks import CH, made, rows


def test_reads(spark):
    e = made(spark, "entities", {"id": "1", "universe_id": "u", "type": "x", "name": "A"}, {"id": "2", "universe_id": "u", "type": "y"}, {"id": "3", "universe_id": "v", "type": "x"})
    assert reads.get(e, "1")["name"] == "A" and reads.get(e, "9") is None and reads.select_one(empty(spark, "entities")) is None
    assert {r.id for r in reads.of_universe(e, "u").collect()} == {"1", "2"} and reads.by_ids(e, []).count() == 0
    assert [r.id for r in reads.matching(e, universe_id="u", type="x").collect()] == ["1"] and reads.matching(e, type=None).count() == 3
    owned = made(spark, "attachments", {"id": "a", "universe_id": "u", "owner_type": "entity", "owner_id": "1"}, {"id": "b", "universe_id": "u", "owner_type": "chapter", "owner_id": "1"})
    assert [r.id for r in reads.matching(owned, universe_id="u", owner_type="entity", owner_id="1").collect()] == ["a"]
    # a value that looks like SQL is a value
    assert reads.select(spark, "SELECT id FROM {e} WHERE name = :n", {"e": e}, n="A' OR '1'='1").count() == 0
    books = made(spark, "books", {"id": "b", "story_id": "s", "sort_order": 2}, {"id": "a", "story_id": "s", "sort_order": 1}, {"id": "c", "story_id": "t"})
    assert [r.id for r in reads.children(books, "story_id", "s").collect()] == ["a", "b"]


def test_numbered(spark):
    data = [("g" if k % 3 else "h", k % 7, k) for k in range(200)] + [(None, 1, 900)]
    found = numbered(rows(spark, data, "g string, o int, id int"), "g", [F.col("o"), F.col("id")]).collect()
    want = {}
    for g, o, i in sorted(data, key=lambda r: (r[0] or "", r[1], r[2])):
        want[i] = 1 + sum(1 for x in data if x[0] == g and (x[1], x[2]) < (o, i))
    assert {r.id: r.place for r in found} == want and numbered(rows(spark, [], "g string, o int"), "g", [F.col("o")]).count() == 0


def test_duplicates_apply_in_order(spark):
    def steps(local, remote):
        return merge.merge_table(rows(spark, [("c", "b", "t", x, t) for x, t in local], CH), rows(spark, [("c", "b", "t", x, t, k) for k, (x, t) in enumerate(remote)], CH + ", _pos int"), "chapters", "9")

    def told(local, remote):
        merged, found = steps(local, remote)
        conflicts = sorted((r.local_value, r.remote_value) for r in merge.conflict_rows(found, "9").collect())
        return [r.content for r in merged.collect()], conflicts, found.where("outcome in ('insert', 'update')").count()

    assert told([("L", "1")], [("A", "5"), ("B", "5")]) == (["A"], [("A", "B")], 1)
    assert told([("L", "1")], [("X", "1"), ("Y", "6")]) == (["Y"], [("L", "X")], 1)
    assert told([], [("A", "1"), ("B", "2"), ("C", "3")]) == (["C"], [], 3)
    assert told([("L", "3")], [("A", "1"), ("B", "2")]) == (["L"], [], 0)


def test_defaults_of_new_rows(spark):
    raw = rows(spark, [("planning_items", '{"id":"p","universe_id":"u","title":"t"}', 0), ("planning_items", '{"id":"q","universe_id":"u","title":"t","status":"REVISAO","target_words":5}', 1)], "name string, row string, pos long")
    remote = snapshots.import_table(raw, "planning_items", steps=True)
    merged, _ = merge.merge_table(empty(spark, "planning_items"), remote, "planning_items", "2026-01-01 00:00:00")
    assert {r.id: (r.status, r.target_words, r.chapter_id, r.created_at) for r in merged.collect()} == {
        "p": ("IDEIAS", 0, None, "2026-01-01 00:00:00"), "q": ("REVISAO", 5, None, "2026-01-01 00:00:00"),
    }
    for table, column, value in (("chapters", "status", "IDEIA"), ("chapters", "canon_status", "CANON"), ("entities", "canon_status", "CANON"), ("relations", "type", "custom"), ("relations", "importance", "normal"), ("timeline_events", "event_type", "MARCO")):
        assert with_defaults(rows(spark, [("x",)], "id string"), table, "9").first()[column] == value
    # a known row keeps what the snapshot does not give
    local = made(spark, "planning_items", {"id": "p", "status": "ESCREVENDO", "updated_at": "1", "universe_id": "u"})
    again, _ = merge.merge_table(local, snapshots.import_table(rows(spark, [("planning_items", '{"id":"p","title":"new","updated_at":"2"}')], "name string, row string"), "planning_items", steps=True), "planning_items", "9")
    assert again.select("title", "status").first()[:] == ("new", "ESCREVENDO")


def test_versions_and_history(spark, tmp_path, capsys):
    folder = str(tmp_path)
    first = {t: empty(spark, t) for t in SYNCED}
    first["universes"] = made(spark, "universes", {"id": "007", "name": "old", "updated_at": "1"})
    first["stories"] = made(spark, "stories", {"id": "s", "universe_id": "007", "updated_at": "1"})
    first["books"] = made(spark, "books", {"id": "b", "story_id": "s", "updated_at": "1"})
    first["chapters"] = made(spark, "chapters", {"id": "c", "book_id": "b", "title": "t", "content": "x", "updated_at": "1"})
    snapshots.write_version(first, folder, "v1")
    snapshots.publish(spark, folder, "v1", "1")
    remote = {"chapters": made(spark, "chapters", {"id": "c", "book_id": "b", "title": "t", "content": "y", "updated_at": "2"}, {"id": "d", "book_id": "b", "title": "n", "updated_at": "2"})}
    result = merge.merge_into(spark, folder, remote, "v2", "9")
    assert snapshots.current_version(spark, folder).endswith("/v2")
    now = snapshots.read_tables(spark, snapshots.current_version(spark, folder))
    assert {r.id: r.content for r in now["chapters"].collect()} == {"c": "y", "d": ""} and now["stories"].first().universe_id == "007"
    # a filter by universe reads its folder only
    reads.of_universe(now["stories"], "007").explain("formatted")
    assert "universe_id" in capsys.readouterr().out.partition("PartitionFilters: ")[2].partition("\n")[0]
    history = result.history()
    assert sorted((r.entity_id, r.action, r.field, r.universe_id) for r in history["change_log"].collect()) == [("c", "update", "content", "007"), ("d", "create", "", "007")]
    assert [(r.chapter_id, r.content) for r in history["chapter_revisions"].collect()] == [("c", "x")]
    # a merge that fails leaves the current version
    with pytest.raises(ValueError, match="book_id"):
        merge.merge_into(spark, folder, {"chapters": made(spark, "chapters", {"id": "z", "book_id": "none", "updated_at": "2"})}, "v3", "9")
    assert snapshots.current_version(spark, folder).endswith("/v2")
    # conflicts and history are in the version; what the failed merge would have added is not
    assert sorted((r.entity_id, r.action, r.created_at) for r in snapshots.read_history(spark, folder, "change_log").collect()) == [("c", "update", "9"), ("d", "create", "9")]
    clash = {"chapters": made(spark, "chapters", {"id": "c", "book_id": "b", "title": "t", "content": "z", "updated_at": "2"})}
    merge.merge_into(spark, folder, clash, "v4", "10")
    assert [(r.aggregate_id, r.local_value, r.remote_value) for r in snapshots.read_history(spark, folder, "sync_conflicts").collect()] == [("c", "y", "z")]
    assert {r.content for r in snapshots.read_history(spark, folder, "chapter_revisions").collect()} == {"x"}
    assert snapshots.last_sequence(spark, folder) == 3
    a, b = {"universes": first["universes"]}, {"universes": made(spark, "universes", {"id": "x"}, {"id": "y"})}
    assert merge.exchange_counts(a, *merge.exchange(a, b, "9")).first()[:] == (3, 1, 0)


def test_small_rules(spark):
    one = rows(spark, [(1,)], "x int")
    codes = [one.select(text.pairs_with(F.lit(c), F.lit("123456"))).first()[0] for c in (" 123456 ", "12345", "1234567", "654321", None)]
    assert codes == [True, False, False, False, False]
    asked = rows(spark, [("a", "b"), ("a", "a"), (None, "b"), ("", "b")], "source_id string, target_id string")
    assert [tuple(r) for r in graph.new_relations(asked).collect()] == [("a", "b")]
    many = rows(spark, [("e", i, f"k{i:02d}", "v") for i in range(50)], "entity_id string, sort_order int, key string, value string")
    assert share.shown_attributes(many).agg(F.count("key"), F.max("key")).first()[:] == (40, "k39")


def test_bundle_too_large(spark):
    u = made(spark, "universes", {"id": "u", "name": "N"}, {"id": "v", "name": "M"}, {"id": "w", "name": "E"})
    s, b = made(spark, "stories", {"id": "s", "universe_id": "u"}, {"id": "r", "universe_id": "v"}), made(spark, "books", {"id": "b", "story_id": "s"}, {"id": "a", "story_id": "r"})
    c = made(spark, "chapters", {"id": "c", "book_id": "b", "content": "x" * 1_500_000}, {"id": "d", "book_id": "b", "content": "x" * 600_000}, {"id": "e", "book_id": "a", "content": "ok"})
    none = rows(spark, [], "entity_id string, key string, value string, sort_order int")
    found = {r.universe_id: r for r in share.bundles(u, hierarchy.chapter_catalogue(c, b, s), empty(spark, "entities"), none, "9").collect()}
    assert found["u"].document is None and found["u"].bytes > 2_000_000 and json.loads(found["v"].document)["chapters"][0]["content"] == "ok"
    assert json.loads(found["w"].document)["title"] == "E" and found["w"].bytes == 0


def test_whole_texts_are_read():
    assert text.sanitise("<p>" + "x" * 2_100_000 + "</p>") == "<p>" + "x" * 2_100_000 + "</p>"


def test_of_two_writers_one_fails(spark, tmp_path):
    folder = str(tmp_path / "two")
    tables = {t: empty(spark, t) for t in SYNCED}
    tables["universes"] = made(spark, "universes", {"id": "u", "name": "old", "updated_at": "1"})
    snapshots.write_version(tables, folder, "v1")
    snapshots.publish(spark, folder, "v1", "1")
    base = snapshots.last_sequence(spark, folder)
    one = {"universes": made(spark, "universes", {"id": "u", "name": "one", "updated_at": "2"})}
    merge.merge_into(spark, folder, one, "v2", "2")
    # a writer that began at the same commit and ends later
    snapshots.write_version(tables, folder, "v3")
    with pytest.raises(snapshots.CommitConflict):
        snapshots.publish(spark, folder, "v3", "3", after=base)
    assert snapshots.current_version(spark, folder).endswith("/v2") and snapshots.read_tables(spark, f"{folder}/v2")["universes"].first().name == "one"
    # a commit that was cut off counts for nothing and stands in nobody's way
    (tmp_path / "two" / "commits" / f"{3:020d}.json").write_text("")
    assert snapshots.current_version(spark, folder).endswith("/v2")
    assert snapshots.publish(spark, folder, "v3", "4") == 4 and snapshots.current_version(spark, folder).endswith("/v3")


def test_every_table_is_read_by_universe(spark, tmp_path):
    import re

    tables = {t: empty(spark, t) for t in SYNCED}
    pairs = [("u", "1"), ("w", "2")]
    tables["universes"] = made(spark, "universes", *({"id": u} for u, _ in pairs))
    tables["stories"] = made(spark, "stories", *({"id": f"s{k}", "universe_id": u} for u, k in pairs))
    tables["books"] = made(spark, "books", *({"id": f"b{k}", "story_id": f"s{k}"} for _, k in pairs), {"id": "lost", "story_id": "none"})
    tables["chapters"] = made(spark, "chapters", *({"id": f"c{k}", "book_id": f"b{k}"} for _, k in pairs))
    tables["entities"] = made(spark, "entities", *({"id": f"e{k}", "universe_id": u} for u, k in pairs))
    tables["entity_attributes"] = made(spark, "entity_attributes", *({"id": f"a{k}", "entity_id": f"e{k}"} for _, k in pairs))
    tables["mentions"] = made(spark, "mentions", *({"id": f"m{k}", "chapter_id": f"c{k}", "entity_id": f"e{k}"} for _, k in pairs))
    for t in ("entity_templates", "relations", "timeline_events", "planning_items", "attachments"):
        tables[t] = made(spark, t, *({"id": f"x{k}", "universe_id": u} for u, k in pairs))
    path = snapshots.write_version(tables, str(tmp_path), "v1")
    own = snapshots.read_universe(spark, path, "u")
    assert set(own) == set(SYNCED)
    for name, df in own.items():
        assert df.columns == schema(name).names
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*univ", plan), (name, plan)
    assert {n: [r.id for r in own[n].collect()] for n in ("universes", "books", "chapters", "entity_attributes", "mentions")} == {"universes": ["u"], "books": ["b1"], "chapters": ["c1"], "entity_attributes": ["a1"], "mentions": ["m1"]}
    assert sorted(r.id for r in snapshots.read_tables(spark, path)["books"].collect()) == ["b1", "b2", "lost"]
