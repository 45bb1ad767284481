"""Hand-made rows for what the driver's tables do not show."""

import pytest
from pyspark.sql import functions as F

from talelake.functions import text
from talelake.functions.schemas import TABLES, empty, schema, with_defaults
from talelake.operators import boards, changes, dml, graph, hierarchy, mentions, merge, search, share
from talelake.sources import shares, snapshots


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def made(spark, table, *dicts):
    names = schema(table).names
    data = [tuple(d.get(n, 0.0 if f.dataType.typeName() == "double" else 0 if f.dataType.typeName() != "string" else ("" if n != "chapter_id" or table != "planning_items" else None)) for n, f in zip(names, schema(table), strict=True)) for d in dicts]
    return spark.createDataFrame(data, schema(table))


def test_empty_universe_has_zeros(spark):
    u = made(spark, "universes", {"id": "u"})
    r = hierarchy.universe_statistics(u, empty(spark, "stories"), empty(spark, "books"), empty(spark, "chapters"), empty(spark, "entities")).first()
    assert (r.stories, r.books, r.chapters, r.words, r.entities, r.entity_counts) == (0, 0, 0, 0, 0, {})
    counts = hierarchy.universe_statistics(u, *(empty(spark, t) for t in ("stories", "books", "chapters")), made(spark, "entities", {"id": "e", "universe_id": "u", "type": "Personagem"}))
    assert counts.select(hierarchy.count_of_type(F.col("entity_counts"), "Personagem"), hierarchy.count_of_type(F.col("entity_counts"), "Lugar")).first()[:] == (1, 0)
    library = made(spark, "universes", {"id": "a", "name": "Zeta"}, {"id": "b", "name": "ávila"})
    assert [r.id for r in hierarchy.library(library, by="name").collect()] == ["b", "a"]
    assert hierarchy.library(library, "AVILA").count() == 0 and hierarchy.library(library, "ÁVILA").count() == 1


def test_self_loop_and_orphans(spark):
    e = made(spark, "entities", {"id": "e1", "name": "E"}, {"id": "e2", "name": "F"})
    r = made(spark, "relations", {"id": "r", "source_id": "e1", "target_id": "e1"}, {"id": "q", "source_id": "e1", "target_id": "gone"})
    assert graph.incident_edges(r, e).where("entity_id = 'e1' and id = 'r'").count() == 2
    assert graph.relations_of(r, e.where("id = 'e1'")).where("id = 'r'").count() == 1
    log = made(spark, "change_log", {"id": "1", "entity_type": "entity", "entity_id": "lost"}, {"id": "2", "entity_type": "entity", "entity_id": "e2"})
    assert {r.id: r.display_name for r in boards.history(log, {"entity": e.select("id", "name")}).collect()} == {"1": "lost", "2": "F"}


CH = "id string, book_id string, title string, content string, updated_at string"


def test_merge_rules(spark):
    local = rows(spark, [("c1", "b", "t", "x", "5"), ("c2", "b", "t", "x", "5"), ("c3", "b", "t", "x", "5"), ("c4", "b", "t", "x", "5"), ("c5", "b", "t", "x", "5")], CH)
    remote = rows(spark, [("c1", "b", "t2", "y", "5"), ("c2", "b", "t2", "x", "5"), ("c3", "b", "t", "y", "6"), ("c4", "b", "t", "y", "4"), ("new", "b", "n", "z", "1"), (None, "b", "n", "z", "1")], CH)
    merged, classified = merge.merge_table(local, remote, "chapters", "9")
    assert {r.id: r.outcome for r in classified.collect()} == {"c1": "conflict", "c2": "kept", "c3": "update", "c4": "kept", "c5": "local", "new": "insert"}
    assert {r.id: (r.title, r.content) for r in merged.collect()} == {"c1": ("t", "x"), "c2": ("t", "x"), "c3": ("t", "y"), "c4": ("t", "x"), "c5": ("t", "x"), "new": ("n", "z")}
    assert [(r.aggregate_id, r.local_value, r.remote_value) for r in merge.conflict_rows(classified, "9").collect()] == [("c1", "x", "y")]
    again, _ = merge.merge_table(merged, remote, "chapters", "9")
    assert sorted(again.collect()) == sorted(merged.collect())


def test_merge_without_times_and_duplicates(spark):
    local = rows(spark, [("r1", "old", "imp")], "id string, label string, importance string")
    remote = rows(spark, [("r1", "a", 0), ("r1", "b", 1)], "id string, label string, _pos int")
    merged, classified = merge.merge_table(local, remote, "relations", "9")
    assert [(r.label, r.importance) for r in merged.collect()] == [("b", "imp")] and [r.outcome for r in classified.collect()] == ["update", "update"]
    twice = rows(spark, [("n", "b", "t", "first", "5", 0), ("n", "b", "t", "second", "5", 1), ("m", "b", "t", "x", "5", 0), ("m", "b", "t", "y", "6", 1)], CH + ", _pos int")
    merged, classified = merge.merge_table(rows(spark, [], CH), twice, "chapters", "9")
    assert {r.id: r.content for r in merged.collect()} == {"n": "first", "m": "y"}
    assert [r.aggregate_id for r in merge.conflict_rows(classified, "9").collect()] == ["n"]
    universes = made(spark, "universes", {"id": "u", "name": "N", "updated_at": "2026-08-20 10:00:00"})
    newer = made(spark, "universes", {"id": "u", "name": "M", "updated_at": "2026-08-20 12:00:00"})
    result = merge.merge_snapshot({"universes": universes}, {"universes": newer, "change_log": empty(spark, "change_log")}, "9")
    assert result.tables["universes"].first().name == "M" and "change_log" not in result.steps
    assert merge.merge_snapshot({"universes": newer}, {"universes": universes}, "9").tables["universes"].first().name == "M"
    assert result.counts().first()[:] == ("universes", 1, 0)
    lost = {"universes": universes, "stories": empty(spark, "stories")}
    with pytest.raises(ValueError, match="universe_id"):
        merge.merge_snapshot(lost, {"stories": made(spark, "stories", {"id": "s", "universe_id": "none"})}, "9")
    at_a, at_b = merge.exchange({"universes": universes}, {"universes": newer}, "9")
    assert at_a.tables["universes"].first().name == at_b.tables["universes"].first().name == "M"


def test_change_rules(spark):
    books, stories = made(spark, "books", {"id": "b", "story_id": "s"}), made(spark, "stories", {"id": "s", "universe_id": "u"})
    base = {"book_id": "b", "title": "t", "content": "x", "status": "st", "word_count": 1}
    old = made(spark, "chapters", {"id": "same", **base}, {"id": "two", **base}, {"id": "status", **base}, {"id": "canon", **base}, {"id": "gone", **base})
    new = made(spark, "chapters", {"id": "same", **base}, {"id": "two", **base, "title": "t2", "status": "s2"}, {"id": "status", **base, "status": "s2"}, {"id": "canon", **base, "canon_status": "no"}, {"id": "lost", **base, "book_id": "?"}, {"id": "new", **base})
    pairs = changes.row_pairs(old, new)
    named = rows(spark, [("same",), ("two",), ("status",)], "id string")
    log = {r.entity_id: (r.action, r.field, r.old_value, r.new_value) for r in changes.chapter_log(pairs, books, stories, named).collect()}
    assert log == {"same": ("update", "content", "1", "1"), "two": ("update", "title", "t", "t2"), "status": ("update", "status", "st", "s2"), "new": ("create", "", "", "t")}
    assert [r.chapter_id for r in changes.revisions(pairs, "9").collect()] == ["two"]


def test_text_rules(spark):
    one = rows(spark, [(1,)], "x int")
    val = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert val(text.word_count(lit("a &nbsp; b"))) == 3 and val(text.word_count(lit("a b"))) == 2 and val(text.word_count(lit("<p></p>"))) == 0
    assert [text.norm(x) for x in ("Ávila", " ÇÃO ", None, "İ")] == ["avila", "cao", None, "i"]
    assert val(text.mentions(lit("foi a avila."), lit("avila"))) and not val(text.mentions(lit("mariana"), lit("ana"))) and not val(text.mentions(lit("a b"), lit("a")))
    assert val(text.mentions(lit("x c++ y"), lit("c++"))) and not val(text.mentions(lit("x ccc y"), lit("c++")))
    assert text.paragraphs("<blockquote><p>x</p></blockquote>") == ["x", "x"] and text.paragraphs("<ul><li><p>a</p></li></ul>") == ["a", "a"]
    assert text.paragraphs("one\n\n two ") == ["one", "two"] and text.paragraphs("<h4>no</h4><p>yes") == ["yes"] and text.paragraphs(None) == [] == text.paragraphs(" ")
    assert val(text.is_dialogue(lit('he said "no"'), lit("ana"))) and val(text.is_dialogue(lit("— oi"), lit("ana"))) and val(text.is_dialogue(lit("ana: oi"), lit("ana"))) and not val(text.is_dialogue(lit("nada"), lit("ana")))
    assert val(text.is_dialogue(lit("entao disse ola"), lit("x"))) and not val(text.is_dialogue(lit("contradisse"), lit("x")))
    assert text.sanitise('<p class=x>a<script>b</script><a href=y>c</a></p><img src=z>d &lt;') == "<p>abc</p>d &lt;" and text.sanitise("") == ""
    assert val(text.to_html(lit("a<b\nc\n\n\nd&"))) == "<p>a&lt;b<br>c</p><p>d&amp;</p>" and val(text.to_html(lit(" "))) == "<p></p>" and val(text.to_html(lit("x<br>y"))) == "x<br>y"
    assert val(text.millis(lit("1970-01-01 00:00:01"))) == 1000 and val(text.millis(lit(""))) == 0 and val(text.millis(lit("0000-99"))) == 0
    assert val(text.relative_age(lit(""), lit(0).cast("long"))) == "Sem edição" and val(text.number_text(lit(1234567))) == "1.234.567"
    assert [val(text.date_text(lit(x))) for x in ("2026-03-05", "", "0000-99-01", "2026-12-01T23:00:00")] == ["05 de mar. de 2026", "Sem data", "0000-99-01", "01 de dez. de 2026"]
    assert val(text.first_url(lit("see HTTPS://a.b/c d"))) == "HTTPS://a.b/c" and val(text.first_url(lit("no"))) is None
    assert val(text.default_text(lit("  "), "Sem título")) == "Sem título" and val(text.default_text(lit("abc"), "", 2)) == "ab"
    assert val(text.is_image_url(lit("data:image/png;base64,AA=="))) and not val(text.is_image_url(lit("data:text/html;base64,AA==")))
    assert val(text.image_url(lit("image/png"), lit(b"abc"))) == "data:image/png;base64,YWJj" and val(text.image_url(lit("text/x"), lit(b"abc"))) is None
    assert val(text.from_base64url(text.base64url(lit(bytes(range(200)))))) == bytes(range(200))


def test_graph_walks(spark):
    e = made(spark, "entities", {"id": "A", "type": "x"}, {"id": "B", "type": "hidden"}, {"id": "C", "type": "x"}, {"id": "D", "type": "x"})
    r = made(spark, "relations", {"id": "1", "source_id": "A", "target_id": "B"}, {"id": "2", "source_id": "C", "target_id": "B"}, {"id": "3", "source_id": "C", "target_id": "D"})
    focal = rows(spark, [("A",)], "id string")
    nodes, edges = graph.neighbourhood(e, r, focal, 2, ["x"])
    assert {n.id for n in nodes.collect()} == {"A", "C"} and edges.count() == 0
    assert {n.id for n in graph.neighbourhood(e, r, focal, 100, ["x"])[0].collect()} == {"A", "C", "D"}
    assert {n.id for n in graph.neighbourhood(e, r, None)[0].collect()} == {"A", "B", "C", "D"}
    assert {(n.id, n.depth) for n in graph.reached(r, focal, 9).collect()} == {("A", 0), ("B", 1), ("C", 2), ("D", 3)}
    look = {n.type: (n.shape, n.has_image) for n in graph.nodes(made(spark, "entities", {"id": "1", "type": "Lugar", "image": "data:"}, {"id": "2", "type": "?"})).collect()}
    assert look == {"Lugar": ("hexagon", 1), "?": ("round-rectangle", 0)}


def test_mentions(spark):
    texts = rows(spark, [(1, "Foi a Ávila e c++."), (2, "Mariana — 日本"), (3, None)], "text_id int, text string")
    names = rows(spark, [("a", "Avila"), ("b", "Ana"), ("c", "C++"), ("d", "—"), ("e", "日本"), ("f", "")], "entity_id string, name string")
    assert {(r.text_id, r.entity_id) for r in mentions.find_mentions(texts, names).collect()} == {(1, "a"), (1, "c"), (2, "e")}
    content = rows(spark, [(1, '<p>Ana foi.</p><p>Ana: "sim"</p><p>"Não", disse Ana.</p>')], "text_id int, html string")
    told = rows(spark, [("b", "c9", 0, 0, 1), ("b", "c8", 0, 0, 0), ("a", "c9", 0, 0, 1)], "entity_id string, chapter_id string, story_order int, book_order int, sort_order int")
    (r,) = mentions.insights(content, names.where("entity_id = 'b'"), told).collect()
    assert r.snippets == ['Ana: "sim"', '"Não", disse Ana.'] and r.first_chapter == "c8"
    both = {r.entity_id: (r.mentioned, r.first_chapter) for r in mentions.text_insights(content, names.where("entity_id in ('a', 'b', 'c')"), told).collect()}
    assert both == {"b": (True, "c8"), "a": (False, "c9")}


def test_edits(spark):
    kept = dml.insert_absent(rows(spark, [("c", "e", "t0")], "chapter_id string, entity_id string, created_at string"), rows(spark, [("c", "e", "t1"), ("c", "f", "t1"), ("c", "f", "t1")], "chapter_id string, entity_id string, created_at string"), ["chapter_id", "entity_id"])
    assert sorted(tuple(r) for r in kept.collect()) == [("c", "e", "t0"), ("c", "f", "t1")]
    tables = {
        "universes": made(spark, "universes", {"id": "u"}, {"id": "v"}),
        "entities": made(spark, "entities", {"id": "e", "universe_id": "u"}, {"id": "f", "universe_id": "v"}),
        "timeline_events": made(spark, "timeline_events", {"id": "1", "universe_id": "v", "entity_id": "e"}, {"id": "2", "universe_id": "u", "entity_id": "e"}),
        "attachments": made(spark, "attachments", {"id": "1", "universe_id": "v", "owner_type": "entity", "owner_id": "e"}, {"id": "2", "universe_id": "v", "owner_type": "x", "owner_id": "e"}, {"id": "3", "universe_id": "v", "owner_type": "chapter", "owner_id": "c"}),
        "stories": made(spark, "stories", {"id": "s", "universe_id": "u"}), "books": made(spark, "books", {"id": "b", "story_id": "s"}), "chapters": made(spark, "chapters", {"id": "c", "book_id": "b"}),
        "change_log": made(spark, "change_log", {"id": "1", "universe_id": "u"}),
    }
    left = dml.cascade_delete(tables, "universes", rows(spark, [("u",)], "id string"))
    assert {t: sorted(r.id for r in d.collect()) for t, d in left.items()} == {"universes": ["v"], "entities": ["f"], "timeline_events": ["1"], "attachments": ["2"], "change_log": ["1"], "stories": [], "books": [], "chapters": []}
    assert left["timeline_events"].first().entity_id is None
    assert dml.touch(tables["universes"], rows(spark, [("u",)], "id string"), "9").where("updated_at = '9'").count() == 1
    assert dml.delete(tables["universes"], rows(spark, [("u",)], "id string")).count() == 1 and dml.insert(tables["universes"], tables["universes"]).count() == 4


def test_shares(spark):
    e = lambda iv, c, a="A256GCM": F.struct(F.lit(1).alias("version"), F.lit(a).alias("algorithm"), F.lit(iv).alias("iv"), F.lit(c).alias("ciphertext"))
    one, cipher = rows(spark, [(1,)], "x int"), "a" * 24
    check = lambda env, days: one.select(share.valid_envelope(env, F.lit(days))).first()[0]
    assert check(e("i" * 16, cipher), 7) and not check(e("short", cipher), 7) and not check(e("i" * 16, "<markup>" * 4), 7) and not check(e("i" * 16, cipher), 365) and not check(e("i" * 16, cipher, "none"), 7)
    assert one.select(share.expiry_days(F.lit(5)), share.expiry_days(F.lit(30))).first()[:] == (7, 30)
    shares = rows(spark, [("s", "2026-01-01 00:00:00")], "id string, at string").select("id", F.to_timestamp("at").alias("expires_at"), F.sha2(F.lit("right"), 256).alias("revoke_hash"))
    alive, dead = share.split_expired(shares, F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    assert (alive.count(), dead.count()) == (0, 1)
    ask = lambda t: share.revoke(shares, rows(spark, [("s", t)], "id string, token string")).count()
    assert (ask("wrong"), ask("right")) == (1, 0)
    key, iv = F.lit("k" * 32), F.lit("i" * 12).cast("binary")
    assert one.select(share.decrypt(share.encrypt(F.lit("secret é"), key, iv), key)).first()[0] == "secret é"
    assert one.select(share.decrypt(share.encrypt(F.lit("secret"), key, iv), F.lit("q" * 32))).first()[0] is None


def test_share_store(spark, tmp_path):
    e = F.struct(F.lit(1).alias("version"), F.lit("A256GCM").alias("algorithm"), F.lit("i" * 16).alias("iv"), F.lit("c" * 24).alias("ciphertext"))
    now = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    made = share.new_shares(rows(spark, [(7,), (365,), (1,)], "days int").select("days", e.alias("envelope")), now)
    made.write.parquet(str(tmp_path / "made"))
    made = spark.read.parquet(str(tmp_path / "made"))
    shares.store(made, str(tmp_path / "s"))
    live = shares.read_live(spark, str(tmp_path / "s"), now)
    assert live.count() == 2 and "revoke_token" not in live.columns and {len(r.id) for r in live.collect()} == {16}
    later = F.to_timestamp(F.lit("2026-01-03 00:00:00"))
    kept = shares.prune(spark, str(tmp_path / "s"), str(tmp_path / "t"), later)
    assert shares.read_live(spark, kept, now).count() == 1
    assert share.revoke(live, made.select("id", F.col("revoke_token").alias("token"))).count() == 0 and share.remembered(made, 1).count() == 1


def test_snapshots(spark, tmp_path):
    r = made(spark, "relations", {"id": "r", "bidirectional": 1})
    snap = snapshots.export_snapshot({"relations": r, "change_log": empty(spark, "change_log")})
    assert [x.id for x in snapshots.import_table(snap, "relations").collect()] == ["r"]
    raw = rows(spark, [("relations", '{"id":"a","bidirectional":true,"label":{"x":1}}'), ("relations", '{"label":"no id"}')], "name string, row string")
    (got,) = snapshots.import_table(raw, "relations", ["id", "bidirectional", "label"]).collect()
    assert (got.id, got.bidirectional, got.label) == ("a", 1, '{"x":1}')
    assert snapshots.export_rows(spark.sql("select 'x' id, x'0AFF' b, null n"), "t").first().row == '{"id":"x","b":"0aff","n":null}'
    path = snapshots.write_version({"relations": r}, str(tmp_path), "v1")
    assert snapshots.read_tables(spark, path, ["relations"])["relations"].collect() == r.collect()
    assert set(with_defaults(rows(spark, [("p",)], "id string"), "planning_items").first()[2:4]) == {None, ""} and len(TABLES) == 15


def test_search(spark):
    e = made(spark, "entities", {"id": "1", "name": "Ana_B", "type": "t"}, {"id": "2", "name": "ÉA", "type": "t"}, {"id": "3", "name": r"a\b", "type": "t"})
    found = lambda q: {r.id for r in search.search_entities(e, q).collect()}
    assert found("ANA") == {"1"} and found("é") == set() and found("_b") == {"1", "3"} and found("\\b") == {"3"} and found("a%b") == {"1", "3"}
    sources = [search.search_source(e, "entity", 3, ["name"], F.col("name"), F.col("type"), [F.col("id")])]
    assert [r.id for r in search.recent(made(spark, "entities", {"id": "a", "updated_at": "1"}, {"id": "b", "updated_at": "2"}), 1).collect()] == ["b"]
    assert {r.id for r in search.toggled(e.where("id < '3'"), e.where("id > '1'")).collect()} == {"1", "3"}
    assert [r.id for r in search.global_search(sources, " ea ").collect()] == ["2"] and search.global_search(sources, "e").count() == 0


def test_walks_read_edges_by_bucket(spark):
    """A hub falls into parts, and a level shuffles the frontier alone."""
    ids = [str(k) for k in range(40)]
    star = made(spark, "relations", *({"id": f"r{k}", "source_id": "hub" if k % 2 else i, "target_id": i if k % 2 else "hub"} for k, i in enumerate(ids)), {"id": "x", "source_id": "5", "target_id": "far"}, {"id": "y", "source_id": "5", "target_id": "far"})
    edges, hubs = graph.adjacency(star, hub=10)
    assert [tuple(r) for r in hubs.collect()] == [("hub", 4)]
    assert edges.where("a = 'hub'").select("part").distinct().count() > 1 and edges.count() == 2 * len(ids) + 2
    focal = spark.createDataFrame([("hub",), ("far",)], "id string")
    assert {r.id for r in graph.neighbours(focal, edges, hubs).collect()} == set(ids)
    assert {(r.id, r.depth) for r in graph.reached(star, focal.where("id = 'far'"), 3).collect()} == {("far", 0), ("5", 1), ("hub", 2), *((i, 3) for i in ids if i != "5")}
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.neighbours(focal, edges, hubs)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    scan = next(k for k, line in enumerate(plan) if "FileScan" in line and "Bucketed: true" in line)
    join = max(k for k, line in enumerate(plan[:scan]) if "SortMergeJoin [a" in line and "part" in line)
    # what stands between the join and the scan with no deeper branch than the scan's own
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    chain, below = [], depth(plan[scan])
    for line in reversed(plan[join + 1 : scan]):
        if depth(line) < below:
            chain.append(line)
            below = depth(line)
    assert not any("Exchange" in line for line in chain), plan


def test_sheets_by_page(spark):
    items = spark.createDataFrame([("a", k, f"v{k % 3}") for k in range(7)] + [("b", 1, "x"), ("b", 1, "x"), ("c", None, None)], "id string, k int, v string")
    pages = {(r.id, r.page): [tuple(i) for i in r["items"]] for r in graph.sheet_pages(items, 3).collect()}
    assert pages == {("a", p): [(k, f"v{k % 3}") for k in range(3 * p, min(3 * p + 3, 7))] for p in range(3)} | {("b", 0): [(1, "x")] * 2, ("c", 0): [(None, None)]}
    assert graph.sheet_pages(items.limit(0)).count() == 0
    e = made(spark, "entities", {"id": "a"}, {"id": "z"})
    assert {(r.id, r.n_told) for r in graph.sheet_heads(e, told=items).collect()} == {("a", 7), ("z", 0)}


def test_crowded_sheets_and_others(spark):
    """Only sheets of more than ``large`` rows are numbered by ranges: once all rows took that way, with three shuffles."""
    items = spark.createDataFrame([(i, k % 50, f"v{k % 7}") for i, n in (("a", 90), ("b", 40), ("c", 1), (None, 60), ("d", 41)) for k in range(n)], "id string, k int, v string")
    want = {}
    for i in ("a", "b", "c", None, "d"):
        own = sorted((r.k, r.v) for r in items.collect() if r.id == i)
        want |= {(i, p // 8): own[p : p + 8] for p in range(0, len(own), 8)}
    for large in (40, 1000, 0):
        pages = graph.sheet_pages(items, 8, large)
        assert dict(pages.dtypes)["page"] == "bigint"
        assert {(r.id, r.page): [tuple(i) for i in r["items"]] for r in pages.collect()} == want
    assert graph.sheet_pages(items, 8)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_a_merge_of_ids_that_come_once_has_no_windows(spark):
    """Every field once had two windows over the ids; the steps are the same by either way."""
    local = rows(spark, [("a", "b", "t", "x", "5"), ("b", "b", "t", "x", "5"), ("c", "b", "t", "x", "5"), ("d", "b", "t", "x", "5"), ("e", "b", "t", "x", None), ("f", "b", "t", None, "5")], CH)
    remote = rows(spark, [("b", "b", "u", "y", "6"), ("c", "b", "u", "y", "5"), ("d", "b", "u", "y", "4"), ("e", "b", "u", "y", "4"), ("f", "b", "u", "y", "5"), ("g", "b", None, "y", None), (None, "b", "u", "y", "6")], CH)
    keys = F.when(F.col("id") == "d", F.array(F.lit("id"), F.lit("content"))).otherwise(F.array(F.lit("id"), F.lit("title"), F.lit("updated_at")))
    for given in (remote, remote.withColumn("_keys", keys), remote.drop("updated_at", "title"), remote.select("id")):
        once, stepwise = merge.merge_steps(local, given, "chapters", "9"), merge.merge_steps(local, given.withColumn("_pos", F.lit(0)), "chapters", "9")
        assert once.schema.simpleString() == stepwise.schema.simpleString() and sorted(map(str, once.collect())) == sorted(map(str, stepwise.collect()))
        assert "Window" not in once._jdf.queryExecution().executedPlan().toString()
