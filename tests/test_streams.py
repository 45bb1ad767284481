import random

import pandas as pd
from pyspark.sql import functions as F

from talelake.streaming import events


EPOCH = 1_700_000_000_000


def test_limits():
    passed, started, count = events.limited([0] * 21 + [3_599_999, 3_600_000], None, 0)
    assert passed == [True] * 20 + [False, False, True] and (started, count) == (3_600_000, 1)


def test_batch_and_stream_agree(spark, tmp_path):
    data = [(c, t) for c in ("a", "b") for t in range(EPOCH, EPOCH + 30 * (1 if c == "a" else 300_000), 1 if c == "a" else 300_000)]
    frame = spark.createDataFrame([(k, *row) for k, row in enumerate(data)], "n long, client string, t long").select("n", "client", F.timestamp_millis("t").alias("at"))
    frame.repartition(1).write.parquet(str(tmp_path / "in"))
    batch = sorted(tuple(r) for r in events.rate_limited(frame, "client", "at", "n").collect())
    assert sum(r[3] for r in batch if r[1] == "a") == 20 and all(r[3] for r in batch if r[1] == "b") and [r[0] for r in batch] == list(range(60))
    stream = events.rate_limited_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "client", "at", "n")
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("limited").collect()) == batch


def test_a_client_that_holds_most_requests(spark):
    """Chains of windows over many hours, with and without gaps, against the plain rule for each client."""
    dice = random.Random(5)
    hours = events.HOUR
    clients = {
        "hot": [EPOCH + dice.randrange(60 * hours) for _ in range(4000)],
        "even": [EPOCH + k * hours // 2 for k in range(80)],
        "edges": [k * hours + d for k in range(0, 60, 3) for d in (-1, 0, 1, hours - 1, hours)],
        "burst": [EPOCH] * 30 + [EPOCH + hours] * 30,
        None: [5 * hours + dice.randrange(4 * hours) for _ in range(200)],
    }
    data = [(c, t) for c, times in clients.items() for t in times]
    data = [(k, *row) for k, row in enumerate(data)] + [(len(data), "hot", None), (len(data) + 1, None, None)]
    frame = spark.createDataFrame(data, "n long, client string, t long").select("n", "client", F.timestamp_millis("t").alias("at"))
    want = {(n, None, True) for n, _, t in data if t is None}
    for c in clients:
        own = sorted((t, n) for n, of, t in data if of == c and t is not None)
        want |= {(n, t, ok) for (t, n), ok in zip(own, events.limited([t for t, _ in own], None, 0)[0])}
    assert {(r.n, r.t, r.allowed) for r in events.rate_limited(frame, "client", "at", "n").collect()} == want
    assert events.rate_limited(frame.limit(0), "client", "at", "n").count() == 0


def test_windows_are_not_laid_out_by_client(spark):
    """No window over a client alone: every one has the cell or the range beside it."""
    frame = spark.createDataFrame([(1, "a", 5)], "n long, client string, t long").select("n", "client", F.timestamp_millis("t").alias("at"))
    found = events.rate_limited(frame, "client", "at", "n")
    assert "windowspecdefinition(client" not in found._jdf.queryExecution().toString()


def test_debounce(spark):
    frame = spark.createDataFrame([("c", 0, "a"), ("c", 500, "b"), ("c", 1300, "c"), ("d", 0, "x")], "id string, t long, v string").select("id", F.timestamp_millis("t").alias("at"), "v")
    assert sorted((r.id, r.v, r.n) for r in events.debounced(frame, "id", "at", "v").collect()) == [("c", "b", 2), ("c", "c", 1), ("d", "x", 1)]


def test_share_state():
    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

        def clear(self):
            self.v = None

    p = events.ShareState()
    p.share = Value()
    p.handle = type("Handle", (), {"registerTimer": lambda self, t: None})()
    rows = pd.DataFrame([("put", 0, 100, "h"), ("get", 1, 0, ""), ("revoke", 2, 0, "wrong"), ("get", 3, 0, ""), ("revoke", 4, 0, "h"), ("get", 5, 0, ""), ("put", 6, 50, "h"), ("get", 50, 0, "")], columns=["kind", "t", "expires", "revoke_hash"])
    (out,) = p.handleInputRows(("s",), iter([rows]), None)
    assert out["found"].tolist() == [True, False, True, True, False, False]


def test_changes_run_by_batch(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    q = events.apply_changes(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda df, k: seen.append(df.count()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sum(seen) == 5
    assert spark.range(1).select(events.body_allowed(F.lit("abc"), 3), events.body_allowed(F.lit("abcd"), 3)).first()[:] == (True, False)


def test_share_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [("s", "put", 1, 100, "h"), ("s", "get", 1, 0, ""), ("s", "revoke", 4, 0, "h"), ("s", "get", 5, 0, ""), ("x", "get", 1, 0, ""), ("e", "put", 1, 3, "h"), ("e", "get", 3, 0, "")]
        frame = spark.createDataFrame(rows, "id string, kind string, t long, expires long, revoke_hash string")
        frame.coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = events.share_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName("shares").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.awaitTermination()
        assert {tuple(r) for r in spark.table("shares").collect()} == {("s", "get", 1, True), ("s", "revoke", 4, True), ("s", "get", 5, False), ("x", "get", 1, False), ("e", "get", 3, False)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_capture_and_mentions_of_a_stream(spark, tmp_path):
    books, stories = spark.createDataFrame([("b", "s")], "id string, story_id string"), spark.createDataFrame([("s", "u")], "id string, universe_id string")
    ddl = "id string, book_id string, title string, content string, status string, word_count int, updated_at string"
    folder = str(tmp_path / "store")
    spark.createDataFrame([("c", "b", "t", "<p>Ana</p>", "x", 1, "1"), ("d", "b", "t", "<p>Ana</p>", "x", 1, "1")], ddl).write.parquet(f"{folder}/chapters/0")
    spark.createDataFrame([("m", "c", "a", "1"), ("k", "d", "a", "1")], "id string, chapter_id string, entity_id string, created_at string").write.parquet(f"{folder}/mentions/0")
    source = str(tmp_path / "in")
    for k, row in enumerate([("c", "b", "t2", "<p>Bia</p>", "x", 2, "2"), ("c", "b", "t2", "<p>Bia e Ana</p>", "x", 4, "3")]):
        spark.createDataFrame([row], ddl).coalesce(1).write.mode("append").parquet(source)
    names = spark.createDataFrame([("a", "Ana"), ("b", "Bia")], "id string, name string")
    steps = {"capture": events.capture(folder, books, stories, "9"), "sync": events.sync_saves(folder, names, "9")}
    for name, step in steps.items():
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
        events.apply_changes(stream, step, str(tmp_path / name)).awaitTermination()
    assert sorted((r.field, r.old_value, r.new_value) for r in spark.read.parquet(f"{folder}/change_log").collect()) == [("content", "2", "4"), ("title", "t", "t2")]
    assert sorted(r.content for r in spark.read.parquet(f"{folder}/chapter_revisions").collect()) == ["<p>Ana</p>", "<p>Bia</p>"]
    assert {r.id: r.word_count for r in spark.read.parquet(f"{folder}/chapters/2").collect()} == {"c": 4, "d": 1}
    assert {(r.chapter_id, r.entity_id) for r in spark.read.parquet(f"{folder}/mentions/2").collect()} == {("c", "a"), ("c", "b"), ("d", "a")}


CHAPTERS = "id string, book_id string, title string, content string, status string, word_count int, updated_at string"


def test_changes_by_state(spark, tmp_path):
    """Three batches; each reads what it saves alone, and what comes out is what a pass over all saves in order gives."""
    books, stories = spark.createDataFrame([("b", "s")], "id string, story_id string"), spark.createDataFrame([("s", "u")], "id string, universe_id string")
    before = spark.createDataFrame([("c", "b", "t", "x", "A", 1, "1"), ("d", "b", "t", "y", "A", 1, "1")], CHAPTERS)
    batches = [
        [("c", "b", "t2", "x", "A", 1, "2"), ("c", "b", "t2", "x2", "B", 2, "3")],
        [("e", "b", "new", "", "A", 0, "4"), ("c", "b", "t2", "x3", "B", 3, "5")],
        [("c", "b", "t2", "x2", "B", 2, "6"), ("c", "b", "t2", "x3", "B", 3, "7"), ("e", "none", "new", "z", "A", 1, "8")],
    ]
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in batches:  # a run each, on the state that the one before left
            spark.createDataFrame(rows, CHAPTERS).coalesce(1).write.mode("append").parquet(source)
            pairs = events.chapter_pairs(spark.readStream.schema(CHAPTERS).parquet(source), before)
            events.apply_changes(pairs, events.write_changes(folder, books, stories, "9"), str(tmp_path / "ck")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    state = {r.id: r for r in before.collect()}
    logs, revisions = [], []
    for row in (r for rows in batches for r in rows):
        new, was = dict(zip(before.columns, row, strict=True)), state.get(row[0])
        if was is None:
            logs.append((row[0], "create", "", "", new["title"]))
        else:
            field = "title" if was["title"] != new["title"] else "status" if was["status"] != new["status"] else "content"
            column = "word_count" if field == "content" else field
            if new["book_id"] == "b":
                logs.append((row[0], "update", field, str(was[column]), str(new[column])))
            if was["title"] != new["title"] or was["content"] != new["content"]:
                revisions.append((row[0], was["title"], was["content"], was["word_count"]))
        state[row[0]] = new
    got = spark.read.parquet(f"{folder}/change_log").collect()
    assert sorted((r.entity_id, r.action, r.field, r.old_value, r.new_value) for r in got) == sorted(logs)
    assert sorted((r.chapter_id, r.title, r.content, r.word_count) for r in spark.read.parquet(f"{folder}/chapter_revisions").collect()) == sorted(revisions)
    assert len({r.id for r in got}) == len(got) and {r.created_at for r in got} == {"9"} and {r.batch for r in got} == {0, 1, 2}


def test_mention_index_is_kept_up_to_date(spark, tmp_path):
    from talelake.operators import mentions
    from talelake.operators.mention_index import MentionIndex

    chapters = {f"c{k}": f"<p>Ana foi a {w}.</p><p>b2 - {w}, Bia</p>" for k, w in enumerate(["Rio", "Иван", "日本語", "lá, Bia", "Rio b2"] * 4)}
    names = {"1": "Ana", "2": "Rio", "3": "Bia"}
    frame = lambda d, ddl: spark.createDataFrame(list(d.items()), ddl)
    texts, entities = "id string, content string", "id string, name string"
    index = MentionIndex(spark, str(tmp_path / "index"), buckets=5, key_buckets=7)
    index.build(frame(chapters, texts), frame(names, entities))

    def same():
        got = [tuple(r) for r in index.read().collect()]
        assert len(got) == len(set(got))
        assert set(got) == {tuple(r) for r in mentions.mention_index(frame(chapters, texts), frame(names, entities)).collect()}

    same()
    saved = {"c1": "<p>nada</p>", "c2": "<p>Bia b2</p>", "new": "<p>Ana Иван Rio.</p>", "c4": ""}
    chapters |= saved
    for _ in range(2):  # a batch may run twice
        index.save(frame(saved, texts))
        same()
    more = {"4": "Иван", "5": "foi a Rio", "6": "日本", "7": "Rio.", "8": "nowhere", "9": "b2 - lá"}
    names |= more
    plan = index.new_mentions(frame(more, entities))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [key_bucket" in plan
    index.add(frame(more, entities))
    same()
    chapters |= {"c7": "<p>Иван foi a Rio.</p>"}
    source = str(tmp_path / "in")
    spark.createDataFrame([("c7", "<p>old Ana</p>", "1"), ("c7", chapters["c7"], "2")], "id string, content string, updated_at string").write.parquet(source)
    events.apply_changes(spark.readStream.schema("id string, content string, updated_at string").parquet(source), events.save_to_index(index), str(tmp_path / "ck")).awaitTermination()
    same()


def test_keys_of_the_mention_index_are_small_and_not_shuffled(spark, tmp_path, monkeypatch):
    """Longer names go by one of their words, so a text keeps its words and not their pairs; keys are written where the texts lie."""
    from talelake.operators.mention_index import MentionIndex

    words = [f"w{k}" for k in range(40)]
    content = "<p>" + " ".join(words) + " w0 W1, w2</p>"
    index = MentionIndex(spark, str(tmp_path / "index"), buckets=3, key_buckets=4)
    plans = []
    put = MentionIndex._write if hasattr(MentionIndex, "_write") else None
    if put:
        monkeypatch.setattr(MentionIndex, "_write", lambda self, name, rows, *parts: (plans.append((name, rows._jdf.queryExecution().executedPlan().toString())), put(self, name, rows, *parts))[1])
    chapters = lambda n: spark.createDataFrame([(k, content) for k in range(n)], "id long, content string")
    index.build(chapters(6), spark.createDataFrame([("1", "w3 w4")], "id string, name string"))
    index.save(chapters(2))
    held = spark.read.parquet(f"{tmp_path}/index/keys").where("text_id is not null").selectExpr("text_id", "explode(keys) AS key").collect()
    assert sorted(held) == sorted((str(k), w) for k in range(6) for w in [*words, ", "])
    assert len(plans) == 6 and all(("Exchange" in plan) == (name != "keys") for name, plan in plans)
    index.add(spark.createDataFrame([("2", "w0 w1"), ("3", "w1, w2"), ("4", "w2 w1"), ("5", "w0 gone"), ("6", "w39")], "id string, name string"))
    assert sorted(map(tuple, index.read().collect())) == sorted((str(k), e) for k in range(6) for e in ("1", "2", "3", "6"))
