"""Document quality by co-training two views.

One classifier sees the text's shape (characters, character pairs, repeated
words), the other the page's metadata (language, source, length). Both are
logistic regressions. In each round either view labels the unlabelled documents
that it is most sure of, and they join the other view's training rows. Scores
are calibrated on labelled documents that were kept out, and the calibrated log
odds of both views are added, less the prior's, to score every document.

The first classifiers are fitted on at most LABELLED labelled documents, those with
the smallest hashes of doc_id, one row of each, whose features, not their texts, go to the driver. A
round of co-training is one pass over all other documents: each task labels those
that a view is sure of and adds up what a Newton step of the other view needs (a
gradient and a curvature for each label), so that sums of a fixed size, added up in
tasks, are all that is gathered. Pseudo-labels weigh as much as the labelled rows
together, at most, and in their proportion of good and bad.

A null text is empty, other nulls are values of their own; texts of any length are
read whole, and an empty table gives no rows. If a doc_id has
several labels their mean counts. Without labels of both kinds every document
gets the score 1 and is kept. Repeated rows get equal scores (up to rounding); extra columns are
ignored, or passed through by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talelake.llm import textblocks as tb
from talelake.llm.common import table

#: Most labelled rows that are fitted on, and tasks that add up the sums of a round.
LABELLED, ADDERS = 8000, 32
#: Rounds of co-training, and how sure a view must be of a label that it gives to the other.
ROUNDS, SURE = 3, 0.98

# each printable ASCII sign for itself; letters by case, digits, white space, control and other bytes as classes
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 5, 6
for _k, _c in enumerate(_SIGNS):
    _KIND[_c] = 7 + _k
_KINDS = 7 + len(_SIGNS)
_COARSE = np.minimum(_KIND, 7)
#: Widths of the views.
TEXT_WIDTH, META_WIDTH = _KINDS + 64 + 6, 16 + 64 + 6


def text_features(column: pa.Array) -> np.ndarray:
    """Shape of each text, one row each."""
    data, offsets = tb.utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    coarse = _COARSE[data]
    same = row[1:] == row[:-1]
    pairs = np.bincount((row[1:] * 64 + coarse[1:] * 8 + coarse[:-1])[same], minlength=n * 64).reshape(n, 64)
    hashes, at = tb.words(data, offsets)
    words = np.bincount(at, minlength=n)
    again = np.bincount(at[1:][(at[1:] == at[:-1]) & (hashes[1:] == hashes[:-1])], minlength=n)
    _, first = np.unique(hashes ^ tb.mix(at.astype(np.uint64)), return_index=True)
    distinct = np.bincount(at[first], minlength=n)
    some, length = np.maximum(words, 1), np.maximum(size, 1)
    rest = [np.log1p(size), np.log1p(words), size / some, again / some, distinct / some, np.log1p(words) * distinct / some]
    return np.hstack([np.sqrt(kinds / length[:, None]), np.sqrt(pairs / length[:, None]), np.stack(rest, 1)]).astype(np.float32)


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Metadata of each document: hashed names and the length."""
    n = len(lang)
    out = np.zeros((n, META_WIDTH), np.float32)
    for values, low, wide in ((lang, 0, 16), (source, 16, 64)):
        known = {v: low + zlib.crc32(repr(v).encode()) % wide for v in set(values)}
        out[np.arange(n), [known[v] for v in values]] = 1
    size = np.log1p(np.array([max(0, c or 0) for c in n_chars], float))
    out[:, 80], out[:, 81], out[:, 82] = size, size**2 / 10, [c is None for c in n_chars]
    for k, least in enumerate((4.0, 6.0, 8.0)):
        out[:, 83 + k] = size < least
    return out


@dataclass
class View:
    """Logistic regression on standardised features, and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.margin(x) + self.shift, -20, 20)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Weights of a ridge logistic regression; the last column, of ones, is not shrunk."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w


#: Ridge of the views' regressions.
RIDGE = 4.0


def fit_view(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> View:
    x = x.astype(float)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    w = _newton(np.hstack([(x - mean) / scale, np.ones((len(x), 1))]), y, ridge)
    return View(mean, scale, w[:-1], float(w[-1]))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """Platt scaling with the usual smoothed targets."""
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = _newton(np.stack([view.margin(x), np.ones(len(x))], 1), target, 1e-2)
    view.slope, view.shift = max(float(w[0]), 0.0), float(w[1])
    return view


@dataclass
class Model:
    """Both views and the prior's log odds."""

    text: View
    meta: View
    prior: float

    def logit(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return self.text.logit(text) + self.meta.logit(meta) - self.prior


def _sums(view: View, x: np.ndarray, y: float) -> np.ndarray:
    """Number, gradient and curvature of rows with the label y at the view's weights, in one array."""
    z = np.hstack([(x - view.mean) / view.scale, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(z @ np.append(view.weight, view.bias), -30, 30)))
    return np.concatenate(([len(x)], z.T @ (p - y), ((z * (p * (1 - p) + 1e-6)[:, None]).T @ z).ravel()))


def pseudo_sums(views: list[View], features: list[np.ndarray]) -> np.ndarray:
    """For each view and label 0 and 1: the sums of the rows that the other view is sure of."""
    out = []
    for me, other in ((0, 1), (1, 0)):
        logit = views[other].logit(features[other])
        for y in (0.0, 1.0):
            sure = (logit if y else -logit) >= np.log(SURE / (1 - SURE))
            out.append(_sums(views[me], features[me][sure].astype(float), y))
    return np.concatenate(out)


def newton_step(view: View, x: np.ndarray, y: np.ndarray, pseudo: list[np.ndarray], ridge: float) -> View:
    """The view after one step on labelled rows and the sums of pseudo-labelled ones (label 0, label 1)."""
    d = len(view.weight) + 1
    labelled = [_sums(view, x[y == v].astype(float), v) for v in (0.0, 1.0)]
    total = labelled[0][1:] + labelled[1][1:]
    found = [p[0] for p in pseudo]
    if min(found) > 0:
        share = min(1.0, sum(found) / len(x))
        for own, more in zip(labelled, pseudo, strict=True):
            total = total + more[1:] * (share * own[0] / more[0])
    w = np.append(view.weight, view.bias)
    penalty = np.full(d, ridge)
    penalty[-1] = 1e-6
    step = np.linalg.solve(total[d:].reshape(d, d) + np.diag(penalty), total[:d] + penalty * w)
    w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    return View(view.mean, view.scale, w[:-1], float(w[-1]))


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, check: np.ndarray, unlabelled: Callable[[list[View]], np.ndarray | None], rounds: int = ROUNDS) -> Model | None:
    """label: 1 or 0; check: rows that only calibrate; unlabelled: ``pseudo_sums`` over all other documents, None without any."""
    train, held = ~check, check
    if not held.any():
        held = train
    if not (set(label[train]) == set(label[held]) == {0.0, 1.0}):
        return None
    features = [text, meta]
    views = [calibrate(fit_view(x[train], label[train]), x[held], label[held]) for x in features]
    for _ in range(rounds):
        sums = unlabelled(views)
        if sums is None:
            break
        new, at = [], 0
        for view, x in zip(views, features, strict=True):
            d = len(view.weight) + 1
            size = 1 + d + d * d
            new.append(calibrate(newton_step(view, x[train], label[train], [sums[at : at + size], sums[at + size : at + 2 * size]], RIDGE), x[held], label[held]))
            at += 2 * size
        views = new
    rate = (label[held].sum() + 1) / (held.sum() + 2)
    return Model(*views, float(np.log(rate / (1 - rate))))


def _features(docs: DataFrame) -> DataFrame:
    """id and both views' features; docs: id, text, lang, source, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = text_features(batch.column(1))
            meta = meta_features(*(batch.column(k).to_pylist() for k in (2, 3, 4)))
            columns = [batch.column(0), *(pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32())) for x in (text, meta))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "y"])

    return docs.mapInArrow(run, "id long, x array<float>, y array<float>")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))


def _unlabelled_sums(rows: DataFrame, ids: list[int], views: list[View]) -> np.ndarray | None:
    """``pseudo_sums`` over all rows but those with the given ids."""
    shared = rows.sparkSession.sparkContext.broadcast((views, np.array(sorted(ids), np.int64)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, known = shared.value
        total = None
        for batch in batches:
            for low in range(0, len(batch), 2048):
                part = batch.slice(low, 2048)
                own = part.column(0).to_pylist()
                part = part.filter(pa.array(~np.isin(np.array([-1 if i is None else i for i in own], np.int64), known) | np.array([i is None for i in own], bool)))
                found = pseudo_sums(views, [text_features(part.column(1)), meta_features(*(part.column(k).to_pylist() for k in (2, 3, 4)))])
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0):
                total = row.values.to_numpy() if total is None else total + row.values.to_numpy()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    # ADDERS rows at most come to the driver
    found = rows.mapInArrow(add, "sums array<double>").repartition(ADDERS).mapInArrow(add_up, "sums array<double>").toArrow()["sums"]
    return sum(row.values.to_numpy() for row in found) if len(found) else None


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rounds: int = ROUNDS, labelled: int = LABELLED) -> Model | None:
    """The model from documents (doc_id, text, lang, source, n_chars) and labels (doc_id, label_col)."""
    by_hash = [F.xxhash64("id"), "id"]
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("label"))
    rows = _plain(docs)
    ids = rows.select("id").where("id is not null").distinct()
    picked = ids.join(known, "id").orderBy(*by_hash).limit(labelled).toArrow()
    if not len(picked):
        return None
    few = docs.sparkSession.createDataFrame(picked.select(["id"]))
    # arrays are copied: what comes from Arrow is read-only
    # one row for each id, the one with the smallest features: an id may be that of any number of rows
    features = _features(rows.join(F.broadcast(few), "id", "left_semi")).groupBy("id").agg(F.min(F.struct("x", "y")).alias("v"))
    table_ = features.select("id", "v.*").toArrow()
    label_of = dict(zip(picked["id"].to_pylist(), picked["label"].to_pylist(), strict=True))
    order = np.argsort(table_["id"].to_numpy(), kind="stable")
    found = [np.stack([v.values.to_numpy() for v in table_[c]])[order] for c in ("x", "y")] if len(table_) else []
    if not found:
        return None
    ids_ = table_["id"].to_numpy()[order]
    label = np.array([label_of[i] for i in ids_.tolist()])
    check = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in ids_.tolist()])
    return co_train(*found, label, check, lambda views: _unlabelled_sums(rows, picked["id"].to_pylist(), views), rounds)


def _scorer(model: Model | None) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    def score(batch: pa.RecordBatch):
        n = len(batch)
        if model is None or not n:
            return np.ones(n), np.ones(n), np.ones(n)
        parts = [batch.slice(low, 512) for low in range(0, n, 512)]
        text = np.concatenate([model.text.logit(text_features(p.column(1))) for p in parts])
        meta = np.concatenate([model.meta.logit(meta_features(*(p.column(k).to_pylist() for k in (2, 3, 4)))) for p in parts])
        return tuple(1 / (1 + np.exp(-z)) for z in (text, meta, text + meta - model.prior))

    return score


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_score, metadata_score, quality_score and kept of each row."""
    score = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta, both = map(pa.array, score(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), text, meta, both, pa.array(both.to_numpy() >= 0.5)], ["doc_id", "text_score", "metadata_score", "quality_score", "kept"])

    return _plain(docs).mapInArrow(run, "doc_id long, text_score double, metadata_score double, quality_score double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, that the model keeps."""
    score = _scorer(model)
    five = [docs.columns.index(c) for c in ("doc_id", "text", "lang", "source", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, both = score(pa.RecordBatch.from_arrays([batch.column(k) for k in five], ["id", "text", "lang", "source", "n_chars"]))
            yield batch.filter(pa.array(both >= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the labels table."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
