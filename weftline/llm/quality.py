"""Quality classifier: naive Bayes support vectors (NB-SVM).

Features are the distinct words, punctuation runs and their bigrams of a document, hashed to
2**BITS buckets. The class log-count ratios are counted on the executors over at most
COUNT_PER_CLASS labelled rows of each class, whole texts, chosen by a hash of the id, so that the
labels can be broadcast and no text is shuffled. A linear hinge-loss model over the ratio-scaled indicators is fitted by dual
coordinate descent on at most PER_CLASS rows of each class with texts of at most TRAIN_CHARS
characters; a quarter of that sample is kept apart to turn margins into probabilities.

Cases: null and empty texts have no features and get the intercept's score; without labels of
both classes the score is the label mean (0.5 without labels); texts of any length are scored whole
(only fitting leaves out rows beyond TRAIN_CHARS, before its sample is drawn); rows that repeat an
id or text are scored each for itself, and equal texts get equal scores (ties); a null id stays null
and is never trained on; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.llm.common import prepare
from weftline.llm.labelled import bounded_sample

COUNT_PER_CLASS, PER_CLASS, TRAIN_CHARS = 20_000, 3000, 20_000
BITS = 18
ALPHA, C, EPOCHS = 1.0, 0.1, 12
THRESHOLD = 0.3
#: Byte classes: 0 white space and control, 1 punctuation, 2 word.
_CLASS = np.where(tokens.WORD > 0, 2, np.where(np.arange(256) > 32, 1, 0)).astype(np.int8)
_LOWER = np.where(tokens.WORD > 0, tokens.WORD, np.arange(256)).astype(np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each document, flat, and where each document's begin (with an end)."""
    kind = _CLASS[data]
    keep = kind > 0
    starts = keep.copy()
    starts[1:] &= kind[1:] != kind[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    starts[inner] = keep[inner]
    h, at = tokens.run_hashes(_LOWER[data], keep, starts)
    n = len(offsets) - 1
    doc = np.searchsorted(offsets, at, "right") - 1
    with np.errstate(over="ignore"):
        two = tokens.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[doc[:-1] == doc[1:]]
    shift = np.uint64(64 - BITS)
    key = np.concatenate([(doc << BITS) | (h >> shift).astype(np.int64), (doc[:-1][doc[:-1] == doc[1:]] << BITS) | (two >> shift).astype(np.int64)])
    key.sort()
    key = key[np.diff(key, prepend=-1) != 0]
    return key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(n + 1))


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float, scale: float, shift: float):
        self.weights, self.bias, self.scale, self.shift = weights.astype(np.float32), bias, scale, shift

    def margins(self, feature: np.ndarray, begin: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[feature], dtype=np.float64)])
        size = np.maximum(np.diff(begin), 1)
        return self.bias + (total[begin[1:]] - total[begin[:-1]]) / np.sqrt(size)

    def probabilities(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -700, 700)))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, dim: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the intercept) of a linear L1-loss SVM by dual coordinate descent; y is -1 or 1."""
    w, alpha = np.zeros(dim + 1), np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            f, v = rows[i]
            slope = y[i] * (w[f] @ v + w[dim]) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                w[dim] += step
                alpha[i] = new
    return w


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels to margins by Newton steps, with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        r, h = weight * (p - y), weight * p * (1 - p)
        g = np.array([(r * margin).sum() + 1e-2 * a, r.sum() + 1e-2 * b])
        m = np.array([[(h * margin**2).sum() + 1e-2, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-2]])
        da, db = np.linalg.solve(m, g)
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
    return max(a, 1e-3), b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_per_class: int = COUNT_PER_CLASS, per_class: int = PER_CLASS, train_chars: int = TRAIN_CHARS) -> QualityModel:
    """Fit on labels (doc_id, y)."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for lo, hi, data, off in tokens.text_slices(batch.column("text")):
                f, begin = features(data, off)
                mine = np.repeat(y[lo:hi], np.diff(begin))
                for v in (0, 1):
                    total[v] += np.bincount(f[mine == v], minlength=1 << BITS)
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], names=["f", "n0", "n1"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tokens.text_slices(batch.column("text")):
                f, begin = features(data, off)
                each = [f[begin[i] : begin[i + 1]].astype(np.int32).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), pa.array(each, pa.binary())], names=["doc_id", "y", "f"])

    counted, sizes = bounded_sample(labels, count_per_class)
    counts = src.join(F.broadcast(counted), "doc_id").select("text", "y").mapInArrow(count, "f int, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # 2**BITS rows at most
    short = src.filter(F.length("text") <= train_chars)
    sample, _ = bounded_sample(labels.join(short.select("doc_id").distinct(), "doc_id", "left_semi"), per_class)
    if min(sizes.get(0, 0), sizes.get(1, 0)) == 0:
        mean = 0.5 if not sizes else float(sizes.get(1, 0) > 0)
        return QualityModel(np.zeros(1 << BITS), 0.0, 1.0, float(np.log((mean + 1e-6) / (1 - mean + 1e-6))))
    n = np.full((2, 1 << BITS), ALPHA)
    at = counts.column("f").to_numpy()
    for v in (0, 1):
        n[v][at] += counts.column(f"n{v}").to_numpy()
    ratio = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    rows = short.join(F.broadcast(sample), "doc_id").mapInArrow(collect, "doc_id bigint, y int, f binary").toArrow().sort_by("doc_id")
    y = rows.column("y").to_numpy()
    f = [np.frombuffer(x.as_py(), np.int32) for x in rows.column("f")]
    got = np.bincount(y, minlength=2)
    weight = np.array([sizes[v] / max(1, got[v]) for v in (0, 1)])[y]
    weight /= weight.mean()
    x = [(i, ratio[i] / np.sqrt(max(1, len(i)))) for i in f]
    apart = np.arange(len(y)) % 4 == 3
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)
    fit = np.flatnonzero(~apart)
    w = dual_descent([x[i] for i in fit], np.where(y[fit] == 1, 1.0, -1.0), C * weight[fit] * 10, 1 << BITS)
    model = QualityModel(w[:-1] * ratio, float(w[-1]), 1.0, 0.0)
    check = np.flatnonzero(apart) if apart.any() else fit
    m = np.array([float(w[x[i][0]] @ x[i][1] + w[-1]) for i in check])
    model.scale, model.shift = calibrate(m, y[check], weight[check])
    return model


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (probability of label 1), margin."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tokens.text_slices(batch.column("text")):
                m = model.margins(*features(data, off))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(model.probabilities(m)), pa.array(m)], names=["doc_id", "score", "margin"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double, margin double")
