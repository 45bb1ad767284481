"""Streaming readings of the workspace's stateful behaviour (extensions of the batch operators)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from talelake.operators import changes, mentions
from talelake.operators.mention_index import MentionIndex
from talelake.plans.jumps import in_windows, window_starts
from talelake.plans.lineage import cut
from talelake.plans.positions import numbered

#: Requests of a client in an hour that pass, and the hour in milliseconds.
ALLOWED, HOUR = 20, 3_600_000


def debounced(saves: DataFrame, key: str, time: str, value: str, quiet: str = "700 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last value of each burst of saves: a burst ends after a quiet time. Batch or stream."""
    source = saves.withWatermark(time, late) if saves.isStreaming else saves
    bursts = source.groupBy(F.session_window(time, quiet).alias("burst"), key)
    return bursts.agg(F.max_by(value, time).alias(value), F.max(time).alias("saved_at"), F.count(F.lit(1)).alias("n")).drop("burst")


def limited(times: list[int], started: int | None, count: int) -> tuple[list[bool], int | None, int]:
    """Which requests pass, at ascending milliseconds, and the window's start and count after them.

    A window starts with its first request and lasts an hour; rejected requests count.
    """
    passed = []
    for t in times:
        if started is None or t - started >= HOUR:
            started, count = t, 0
        count += 1
        passed.append(count <= ALLOWED)
    return passed, started, count


def rate_limited(requests: DataFrame, client: str, time: str, id_col: str) -> DataFrame:
    """id_col, client, t (milliseconds) and allowed of each request; requests of one time go by id.

    The windows come from jumps between times (``plans/jumps.py``), a request's place in
    its window from ranges and counts, so a client, or a window, that holds most requests
    is spread over many tasks. A null client is a client of its own; a request without a
    time passes and counts in no window.
    """
    rows = requests.select(F.col(id_col).cast("long").alias("id"), F.col(client).cast("string").alias("client"), F.unix_millis(F.col(time).cast("timestamp")).alias("t"))
    # a key that is never null
    timed = rows.where("t IS NOT NULL").withColumn("key", F.coalesce(F.concat(F.lit("="), "client"), F.lit("")))
    placed = in_windows(timed, window_starts(timed, HOUR), HOUR)
    placed = numbered(placed.withColumn("window", F.struct("key", "start")), "window", [F.col("t"), F.col("id")])
    found = placed.select("id", "client", "t", (F.col("place") <= ALLOWED).alias("allowed"))
    return found.unionByName(rows.where("t IS NULL").withColumn("allowed", F.lit(True))).withColumnRenamed("id", id_col)


def rate_limited_stream(requests: DataFrame, client: str, time: str, id_col: str, late: str = "10 minutes") -> DataFrame:
    """The same over a stream: each client's window is kept as state, and goes when it is over by the stream's own time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        started, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        passed, started, count = limited([int(t) for t in rows["t"]], started, count)
        state.update((started, count))
        state.setTimeoutTimestamp(max(started + HOUR, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": rows["id"], "client": [key[0]] * len(rows), "t": rows["t"], "allowed": passed})

    rows = requests.select(F.col(id_col).cast("long").alias("id"), F.col(client).cast("string").alias("client"), F.col(time).cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", late).withColumn("t", F.unix_millis("at"))
    found = rows.groupBy("client").applyInPandasWithState(step, "id long, client string, t long, allowed boolean", "started long, count long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumnRenamed("id", id_col)


class ShareState(StatefulProcessor):
    """Live shares by id: a put (expires) is kept until its time; a revoke (hash) with the right hash removes it; a get tells whether it is there.

    A timer removes a share when its time is over by the stream's own time, also if nobody asks for it again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.share = handle.getValueState("share", "expires long, revoke_hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("t", kind="stable")
        out = []
        for e in events.itertuples():
            held = self.share.get() if self.share.exists() else None
            live = held is not None and held[0] > e.t
            if e.kind == "put":
                self.share.update((int(e.expires), e.revoke_hash))
                self.handle.registerTimer(int(e.expires))
                continue
            if held is not None and (not live or e.kind == "revoke" and held[1] == e.revoke_hash):
                self.share.clear()
            out.append((key[0], e.kind, int(e.t), bool(live and (e.kind == "get" or held[1] == e.revoke_hash))))
        yield pd.DataFrame(out, columns=["id", "kind", "t", "found"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.share.exists() and self.share.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.share.clear()  # a later put may have moved the end
        yield from ()

    def close(self) -> None:
        """Nothing is held outside the state."""


def share_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """id, kind, t, found of the gets and revokes of a stream (id, kind, t, expires, revoke_hash).

    The session needs a state store that keeps several states, such as RocksDB.
    """
    return events.withColumn("at", F.timestamp_millis("t")).withWatermark("at", late).groupBy("id").transformWithStateInPandas(ShareState(), outputStructType="id string, kind string, t long, found boolean", outputMode="append", timeMode="EventTime")


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a batch function (change capture, mention sync) on each batch of a stream of changes."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def capture(folder: str, books: DataFrame, stories: DataFrame, now: str) -> Callable[[DataFrame, int], None]:
    """A batch function for saved chapters: logs and revisions against the chapters of ``folder`` are appended there, and the chapters written anew.

    Each batch has folders of its own, so that a batch that runs twice writes the same again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{folder}/chapters/{number}")
        saved = batch.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("updated_at")))).where("_k = 1").select(*old.columns)
        known = old.join(saved.select("id"), "id", "left_semi").select(*old.columns)
        pairs = cut(changes.row_pairs(known, saved))
        changes.chapter_log(pairs, books, stories, now=now).write.mode("overwrite").parquet(f"{folder}/change_log/batch={number}")
        changes.revisions(pairs, now).write.mode("overwrite").parquet(f"{folder}/chapter_revisions/batch={number}")
        left = old.join(saved.select("id"), "id", "left_anti").select(*old.columns)
        left.unionByName(saved).write.mode("overwrite").parquet(f"{folder}/chapters/{number + 1}")

    return apply


_CHAPTER = "book_id string, title string, content string, status string, word_count int"


class ChapterState(StatefulProcessor):
    """The last state of each chapter: every save gives a pair of what was there and what is there now."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chapter = handle.getValueState("chapter", f"saves long, {_CHAPTER}")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for row in initialState[_names(_CHAPTER)].itertuples(index=False):
            self.chapter.update((0, *_plain(row)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        saves = pd.concat(list(rows)).sort_values("updated_at", kind="stable")
        held = self.chapter.get() if self.chapter.exists() else None
        out = []
        for row in saves[_names(_CHAPTER)].itertuples(index=False):
            new = (0 if held is None else held[0] + 1, *_plain(row))
            out.append((key[0], new[0], held is None, *(held[1:] if held is not None else (None,) * (len(new) - 1)), *new[1:]))
            held = new
        if held is not None:
            self.chapter.update(tuple(held))
        yield pd.DataFrame(out, columns=_names(_PAIRS)).astype({"o_word_count": "Int32", "n_word_count": "Int32"})

    def close(self) -> None:
        """Nothing is held outside the state."""


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _plain(row) -> tuple:
    return tuple(None if pd.isna(v) else int(v) if k == 4 else v for k, v in enumerate(row))


_PAIRS = ", ".join(["id string, pos long, created boolean", *(f"{side}_{c}" for side in "on" for c in _CHAPTER.split(", "))])


def chapter_pairs(saves: DataFrame, before: DataFrame) -> DataFrame:
    """id, pos, o and n of each save of a stream, in the order of ``updated_at``; o is null for a new chapter.

    saves, before (the chapters when the stream began): id, book_id, title, content,
    status, word_count, updated_at. A chapter's last state is kept, so a batch costs what
    it saves, however many chapters there are, and one that runs again gives the same
    pairs. pos counts a chapter's saves. The session needs a state store that keeps
    several states, such as RocksDB.
    """
    pairs = saves.groupBy("id").transformWithStateInPandas(
        ChapterState(), outputStructType=_PAIRS, outputMode="append", timeMode="None", initialState=before.select("id", *_names(_CHAPTER)).groupBy("id")
    )
    old, new = (F.struct(*(F.col(f"{side}_{c}").alias(c) for c in _names(_CHAPTER))) for side in "on")
    return pairs.select("id", "pos", F.when(~F.col("created"), old).alias("o"), new.alias("n"))


def write_changes(folder: str, books: DataFrame, stories: DataFrame, now: str) -> Callable[[DataFrame, int], None]:
    """A batch function for ``chapter_pairs``: the batch's logs and revisions, in folders of the batch's own."""

    def apply(pairs: DataFrame, number: int) -> None:
        pairs = cut(pairs)
        changes.chapter_log(pairs, books, stories, now=now).write.mode("overwrite").parquet(f"{folder}/change_log/batch={number}")
        changes.revisions(pairs, now).write.mode("overwrite").parquet(f"{folder}/chapter_revisions/batch={number}")

    return apply


def save_to_index(index: MentionIndex) -> Callable[[DataFrame, int], None]:
    """A batch function for saved chapters (id, content, updated_at): the index's parts of these chapters are written anew."""

    def apply(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("id").agg(F.max_by("content", "updated_at").alias("content"))
        index.save(newest)

    return apply


def sync_saves(folder: str, entities: DataFrame, now: str) -> Callable[[DataFrame, int], None]:
    """A batch function for saved chapters (id, content): only their mentions are read anew; ``folder`` gets a new mention table for each batch."""

    def apply(batch: DataFrame, number: int) -> None:
        current = batch.sparkSession.read.parquet(f"{folder}/mentions/{number}")
        mentions.rebuild_mentions(batch, entities, current, now).write.mode("overwrite").parquet(f"{folder}/mentions/{number + 1}")

    return apply


def body_allowed(body, limit: int = 3_000_000):
    """Whether a request's body is within the limit."""
    return F.octet_length(body) <= limit
