"""Log-bilinear language model, trained with noise-contrastive estimation.

The tokens are a document's words and one end. The model's classes are the end, each
of the most frequent words, and RARE classes of all other words, known or not, by their
last letters: every word is in a class, as a target and as a context. From the two
classes before it, a token's class has the score

    s(w | u, v) = (d1 * r_u + d2 * r_v) . q_w + b_w        (u is the nearer one)

Training is numpy inside Spark tasks. A bounded sample warms the parameters up;
then every task trains a copy on all training documents of its partition, and
the copies' mean, weighted by tokens, is the model. The normaliser of each pair
of classes is computed once by batched matrix products, so log-probabilities are
normalised exactly. A rare word has its class's probability times its smoothed
share (c + 0.1) / (N' + 0.1 (V' + 1)) in the class; N' and V' are the class's training
tokens and distinct words, so that all words of a class and one unseen add up to one.

Counts are sums over all training documents. Those of the words with at least
1/HEAD of all training tokens (at most HEAD words) are broadcast; the rest are
joined by word, with one row for each document and rare word.

A null text is empty and has its end alone; a null doc_id counts as the empty
text for the held-out split. Rows that share doc_id are scored on their own.
Without any training document all classes are alike. Extra columns are ignored, texts
of any length are read whole, and an empty table gives no rows. Tasks train on the
partitions that they are given, so scores depend a little on how the table is dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talelake.llm import textblocks as tb
from talelake.llm.common import cut, table

#: Classes, those of rare words among them, the width of their vectors, noise words of a minibatch, and its tokens.
CLASSES, RARE, WIDTH, NOISE, BATCH = 1024, 384, 32, 32, 4096
#: Documents that warm the parameters up, their tokens at most, and passes over them.
WARM_DOCS, WARM_TOKENS, WARM_PASSES = 1000, 2_000_000, 3
#: A word's count is broadcast if it has at least this part of all tokens.
HEAD = 1 << 20
#: The end's class; rare words have classes 1 to RARE, frequent words those after.
END = 0
_END_HASH = np.uint64(0x0123456789ABCDEF)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and class among the rare words of each token, ends included."""
    hashes, row, last = tb.words_and_ends(*tb.utf8(column))
    n = len(column)
    out = np.full(len(hashes) + n, _END_HASH)
    rows, rare = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
    at = np.arange(len(hashes)) + row
    out[at], rows[at], rare[at] = hashes, row, 1 + (tb.mix(last) % np.uint64(RARE)).astype(np.int64)
    ends = np.cumsum(np.bincount(row, minlength=n)) + np.arange(n)
    rows[ends] = np.arange(n)
    return out, rows, rare


def contexts(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearer and the farther class before each token; before a text's start stand ends."""
    near = np.concatenate(([END], classes[:-1]))
    far = np.concatenate(([END, END], classes[:-2]))[: len(classes)]
    return near, np.where(near == END, END, far)


def lookup(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash among the ascending keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return place, keys[place] == hashes


def _add_rows(out: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """out[index] += rows, with repeated indexes."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    out[index[first]] += np.add.reduceat(rows[order], first)


class LogBilinear:
    """Parameters r, q (classes x width), d (2 x width) and b (classes), in one flat array."""

    def __init__(self, flat: np.ndarray, classes: int):
        self.flat, self.k = flat, classes
        n = classes * WIDTH
        self.r, self.q = flat[:n].reshape(classes, WIDTH), flat[n : 2 * n].reshape(classes, WIDTH)
        self.d, self.b = flat[2 * n : 2 * n + 2 * WIDTH].reshape(2, WIDTH), flat[2 * n + 2 * WIDTH :]

    @classmethod
    def fresh(cls, unigram: np.ndarray) -> LogBilinear:
        """Small random vectors; the biases alone give the unigram distribution."""
        k = len(unigram)
        flat = (np.random.default_rng(3).normal(size=2 * k * WIDTH + 2 * WIDTH + k) * 0.05).astype(np.float32)
        model = cls(flat, k)
        model.d[:] = 1
        model.b[:] = np.log(unigram)
        return model

    def fit(self, classes: np.ndarray, unigram: np.ndarray, seed: int, rate: float = 0.05, squares: np.ndarray | None = None) -> np.ndarray:
        """One pass of noise-contrastive estimation with AdaGrad; returns the sums of squares.

        The NOISE noise words are common to a minibatch, so that all scores are
        matrix products.
        """
        rng = np.random.default_rng(seed)
        near, far = contexts(classes)
        cdf, log_noise = np.cumsum(unigram), np.log(NOISE * unigram).astype(np.float32)
        squares = np.full(len(self.flat), 1e-2, np.float32) if squares is None else squares
        grad = LogBilinear(np.zeros_like(self.flat), self.k)
        for low in range(0, len(classes), BATCH):
            w, u, v = classes[low : low + BATCH], near[low : low + BATCH], far[low : low + BATCH]
            noise = np.minimum(np.searchsorted(cdf, rng.random(NOISE) * cdf[-1]), self.k - 1)
            ru, rv, qw, qn = self.r[u], self.r[v], self.q[w], self.q[noise]
            hat = ru * self.d[0] + rv * self.d[1]
            with np.errstate(over="ignore"):
                good = 1 / (1 + np.exp(np.einsum("ij,ij->i", hat, qw) + self.b[w] - log_noise[w]))  # 1 - sigma
                bad = 1 / (1 + np.exp(log_noise[noise] - self.b[noise] - hat @ qn.T))
            grad.flat[:] = 0
            back = bad @ qn - good[:, None] * qw
            _add_rows(grad.q, w, -good[:, None] * hat)
            np.add.at(grad.q, noise, bad.T @ hat)
            grad.b[:] = -np.bincount(w, good, self.k)
            np.add.at(grad.b, noise, bad.sum(0))
            _add_rows(grad.r, u, back * self.d[0])
            _add_rows(grad.r, v, back * self.d[1])
            grad.d[0], grad.d[1] = (back * ru).sum(0), (back * rv).sum(0)
            grad.flat /= len(w) ** 0.5
            squares += grad.flat**2
            self.flat -= rate * grad.flat / np.sqrt(squares)
        return squares

    def normalisers(self, near: int) -> np.ndarray:
        """Log of the sum over all classes, for one nearer class and each farther one."""
        s = (self.r[near] * self.d[0] + self.r * self.d[1]) @ self.q.T + self.b
        top = s.max(1)
        return top + np.log(np.exp(s - top[:, None]).sum(1, dtype=np.float64))


class Scorer:
    """Tables from which a token's log-probability is three look-ups."""

    def __init__(self, model: LogBilinear, log_z: np.ndarray):
        self.u = (model.r * model.d[0]) @ model.q.T + model.b
        self.v = (model.r * model.d[1]) @ model.q.T
        self.log_z = log_z

    def log10(self, classes: np.ndarray) -> np.ndarray:
        near, far = contexts(classes)
        return (self.u[near, classes] + self.v[far, classes].astype(np.float64) - self.log_z[near, far]) / np.log(10)


def _counts(train: DataFrame) -> DataFrame:
    """h, rare, c: each token's class among the rare words and its training count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, _, rare = tokens(batch.column(0))
            h, first, c = np.unique(hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rare[first].astype(np.int16)), pa.array(c)], ["h", "rare", "c"])

    return train.select("text").mapInArrow(run, "h long, rare short, c long").groupBy("h").agg(F.first("rare").alias("rare"), F.sum("c").alias("c"))


def _class_ids(keys: np.ndarray, ids: np.ndarray, hashes: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """The class of each token: its own if it is among the keys, else that of its last letters."""
    place, there = lookup(keys, hashes)
    return np.where(there, ids[place] if len(ids) else END, rare)


def classes_of(keys: np.ndarray, ids: np.ndarray, column: pa.Array) -> np.ndarray:
    """Classes of all tokens of a text column, in order."""
    hashes, _, rare = tokens(column)
    return _class_ids(keys, ids, hashes, rare)


def train_model(train: DataFrame, keys: np.ndarray, ids: np.ndarray, unigram: np.ndarray) -> LogBilinear:
    """The mean of the tasks' models. keys, ids: hash and number of each class; train: id, text."""
    spark, k = train.sparkSession, len(unigram)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([classes_of(keys, ids, batch.column(0))], pa.list_(pa.int64()))], ["ids"])

    model = LogBilinear.fresh(unigram)
    # rows with the smallest hashes, of equal ones one: an id may be that of any number of rows
    rows = train.select("text", F.xxhash64("id", "text").alias("rk"))
    last = rows.select("rk").distinct().orderBy("rk").limit(WARM_DOCS).agg(F.max("rk")).first()[0]
    few = rows.where(F.col("rk") <= F.lit(last)).groupBy("rk").agg(F.first("text").alias("text")).orderBy("rk").select("text")
    warm: list[np.ndarray] = []
    left = WARM_TOKENS
    for row in few.mapInArrow(encode, "ids array<long>").toLocalIterator():
        warm.append(np.array(row.ids)[:left])
        left -= len(warm[-1])
        if not left:
            break
    squares = None
    for k_pass in range(WARM_PASSES if warm else 0):
        squares = model.fit(np.concatenate(warm), unigram, k_pass, squares=squares)
    start = spark.sparkContext.broadcast((model.flat, squares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, squares = start.value
        own, squares, seen = LogBilinear(flat.copy(), k), None if squares is None else squares.copy(), 0
        for batch in batches:
            classes = classes_of(keys, ids, batch.column(0))
            squares = own.fit(classes, unigram, seen, squares=squares)
            seen += len(classes)
        if seen:
            columns = [pa.array(np.arange(len(own.flat) + 1)), pa.array(np.append(own.flat.astype(np.float64), 1.0) * seen)]
            yield pa.RecordBatch.from_arrays(columns, ["place", "value"])

    sums = train.select("text").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    if not len(sums):
        return model
    values = np.zeros(len(model.flat) + 1)
    values[sums["place"].to_numpy()] = sums["value"].to_numpy()
    return LogBilinear((values[:-1] / values[-1]).astype(np.float32), k)


def _normalisers(spark: SparkSession, model: LogBilinear) -> np.ndarray:
    shared = spark.sparkContext.broadcast(model.flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LogBilinear(shared.value, model_k)
        for batch in batches:
            rows = [own.normalisers(u) for u in batch.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "z"])

    model_k = model.k
    rows = spark.range(model.k, numPartitions=12).mapInArrow(run, "id long, z array<double>").toArrow()
    out = np.zeros((model.k, model.k))
    for u, z in zip(rows["id"].to_pylist(), rows["z"], strict=True):
        out[u] = z.values.to_numpy()
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held_out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    train = rows.where(~held_out)
    counts = cut(_counts(train))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end_hash = int(_END_HASH.view(np.int64))
    words = counts.where(f"h <> {end_hash}")
    top = words.orderBy(F.desc("c"), "h").limit(CLASSES - RARE - 1).toArrow()
    ends = counts.where(f"h = {end_hash}").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    keys = np.append(top["h"].to_numpy().view(np.uint64), _END_HASH)
    ids = np.append(np.arange(RARE + 1, RARE + 1 + len(top)), END)
    by = np.argsort(keys)
    keys, ids = keys[by], ids[by]
    # tokens and kinds of each class of rare words: RARE rows, less the frequent words
    sums = words.groupBy("rare").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).toArrow()
    known, own = top["c"].to_numpy(), top["rare"].to_numpy().astype(np.int64)
    rare_tokens, rare_kinds = np.zeros(RARE + 1), np.zeros(RARE + 1)
    rare_tokens[sums["rare"].to_numpy()], rare_kinds[sums["rare"].to_numpy()] = sums["c"].to_numpy(), sums["k"].to_numpy()
    rare_tokens -= np.bincount(own, known, RARE + 1)
    rare_kinds -= np.bincount(own, minlength=RARE + 1)
    unigram = np.concatenate(([ends], rare_tokens[1:], known)) + 0.1
    unigram = unigram / unigram.sum()
    rare_logs = np.log10(rare_tokens + 0.1 * (rare_kinds + 1))
    model = train_model(train, keys, ids, unigram)
    head = counts.where(f"c * {HEAD} >= {total}").toArrow()
    head_keys = head["h"].to_numpy().view(np.uint64)
    by = np.argsort(head_keys)
    head_keys, head_logs = head_keys[by], np.log10(head["c"].to_numpy()[by] + 0.1)
    head_ids = _class_ids(keys, ids, head_keys, head["rare"].to_numpy().astype(np.int64)[by])
    tables = spark.sparkContext.broadcast((model.flat, _normalisers(spark, model), head_keys, head_logs, head_ids, keys, ids, rare_logs))
    model_k = model.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, log_z, head_keys, head_logs, head_ids, keys, ids, rare_logs = tables.value
        scorer = Scorer(LogBilinear(flat, model_k), log_z)
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                h, row, rare = tokens(part.column(2))
                n = len(part)
                place, there = lookup(head_keys, h)
                classes = np.where(there, head_ids[place] if len(head_ids) else END, END)
                if not there.all():  # a class may be too rare for the head when the corpus is small
                    classes[~there] = _class_ids(keys, ids, h[~there], rare[~there])
                logs = np.where(there, head_logs[place] if len(head_logs) else 0.0, 0.0)
                other = (classes > END) & (classes <= RARE)
                # what is in no head is left to the join: hash, occurrences and whether it is a rare word
                tail = np.flatnonzero(~there)
                order = tail[np.lexsort((h[tail], row[tail]))]
                first = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])))) if len(order) else order
                times = np.diff(np.append(first, len(order)))
                offsets = np.concatenate(([0], np.cumsum(np.bincount(row[order[first]], minlength=n)))).astype(np.int32)

                def total_of(values, row=row, n=n):
                    return pa.array(np.bincount(row, values, n))

                def lists(values, offsets=offsets):
                    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

                columns = {
                    "id": part.column(0),
                    "held_out": part.column(1),
                    "n_tokens": pa.array(np.bincount(row, minlength=n)),
                    "head_known": pa.array(np.bincount(row[there], minlength=n)),
                    "head_logs": total_of(logs),
                    "head_other_logs": total_of(np.where(other, logs, 0.0)),
                    "class_logs": total_of(scorer.log10(classes) - np.where(other, rare_logs[np.where(other, classes, 0)], 0.0)),
                    "words": lists(h[order[first]].view(np.int64)),
                    "times": lists(times),
                    "others": lists(other[order[first]]),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    seen = rows.select("id", held_out.alias("held_out"), "text").mapInArrow(
        run,
        "id long, held_out boolean, n_tokens long, head_known long, head_logs double, head_other_logs double, class_logs double, "
        "words array<long>, times array<long>, others array<boolean>",
    )
    seen = cut(seen).withColumn("row", F.monotonically_increasing_id())  # stable: it numbers rows that are written
    tail = seen.select("row", F.explode(F.arrays_zip("words", "times", "others")).alias("t")).select("row", F.col("t.words").alias("h"), "t.times", "t.others")
    rare = counts.where(f"c * {HEAD} < {total}")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1)) * F.col("times")
    sums = (
        tail.join(rare, "h", "left")
        .groupBy("row")
        .agg(
            F.sum(log).alias("tail_logs"),
            F.sum(F.when(F.col("others"), log).otherwise(0.0)).alias("tail_other_logs"),
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        )
    )
    none, zero = F.lit(0.0), F.lit(0)
    base_log = float(np.log10(total + 0.1 * (kinds + 1)))
    return seen.join(sums, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_logs") + F.coalesce("tail_logs", none) - F.col("n_tokens") * base_log).alias("base_score"),
        (F.col("class_logs") + F.col("head_other_logs") + F.coalesce("tail_other_logs", none)).alias("score"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, learnt from nine tenths of them."""
    return score_documents(table(spark, sf_dir, "documents"))
