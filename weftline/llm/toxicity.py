"""Toxicity by multiple-instance learning: sentence scores, a noisy-or over them, document labels only.

A sentence (a run between . ! ? and line ends) is a bag of hashed words and of the first PREFIXES
bytes of longer words (for inflected and compound forms), with a logistic score p, less that of
a sentence without weighted features: such sentences add nothing, however many there are. A
document is toxic unless all of its sentences and a base of its own are not: 1 - (1 - base) prod(1 - p).
Features that toxic documents have significantly more often get weights, which are fitted to
document labels by full-batch AdaGrad on the noisy-or likelihood, over a sample of at most
PER_CLASS rows of each class, whole texts of any length, weighted back to the class sizes. The
same sentence scores then locate the offending sentences.

Cases: null and empty texts have no sentences and get the score of an empty document, the
base alone; without labels of both classes the score is the label mean (0 without labels); texts of
any length are read whole, in training too; rows that repeat an id or text are scored each for
itself, and equal texts get equal scores (ties); a null id stays null and is never trained on; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.llm.common import discard, prepare, save
from weftline.llm.labelled import bounded_sample

PER_CLASS = 4000
BITS = 20
PREFIXES = (4, 5, 6)
#: A feature is used if at least so many toxic documents have it, and its share among them exceeds that among the others by so many standard errors.
LEAST_DOCS, LEAST_EXCESS = 5, 4.0
THRESHOLD = 0.3
#: The logit of a sentence before its weights. Low, so that many sentences of little weight add up to little.
BIAS = -8.0
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature and sentence of each word and prefix, the document of each sentence, and each sentence's first byte."""
    h, at, first = tokens.words(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    ends = np.cumsum(_END[data])
    key = ends[at] + doc  # grows with either
    new = np.diff(key, prepend=-1) > 0
    of = np.cumsum(new) - 1
    low = tokens.WORD[data]
    parts = [(h, of)] + [(p, of[which]) for p, which in (tokens.prefix_hashes(low, at, k) for k in PREFIXES)]
    feature = np.concatenate([p for p, _ in parts]) >> np.uint64(64 - BITS)
    return feature.astype(np.int64), np.concatenate([s for _, s in parts]), doc[new], at[new]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _excess(z: np.ndarray) -> np.ndarray:
    """The hazard of sentences with logit z beyond that of a sentence without weighted features."""
    return np.maximum(_softplus(z) - _softplus(BIAS), 0)


class ToxicityModel:
    def __init__(self, weights: np.ndarray, base: float):
        self.weights, self.base = weights.astype(np.float32), base

    def hazards(self, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Of each sentence; 1 - exp(-hazard) is its score."""
        return _excess(BIAS + np.bincount(sentence, self.weights[feature], n))

    def documents(self, hazard: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return -np.expm1(-np.bincount(doc, hazard, n) - self.base)


def chosen(in_toxic: np.ndarray, in_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Which features get weights, by the number of documents of each class that have them and the sizes of the classes."""
    if not toxic or not clean:
        return np.zeros(len(in_toxic), bool)
    rate = (in_toxic + in_clean + 1) / (toxic + clean + 2)
    excess = (in_toxic / toxic - in_clean / clean) / np.sqrt(rate * (1 - rate) * (1 / toxic + 1 / clean))
    return (in_toxic >= LEAST_DOCS) & (excess >= LEAST_EXCESS)


def fit(y: np.ndarray, weight: np.ndarray, feature: np.ndarray, sentence: np.ndarray, doc_of: np.ndarray, rounds: int = 150, l2: float = 1e-2) -> ToxicityModel:
    """y, weight: per document; feature, sentence: per word or prefix that gets a weight; doc_of: per sentence with such."""
    n = len(y)
    dense = np.zeros(1 << BITS)
    mean = float(np.average(y, weights=weight)) if n else 0.0
    if n == 0 or y.min() == y.max():
        mean = min(max(mean, 0.0), 1 - 1e-6)
        return ToxicityModel(dense, -np.log1p(-mean))
    used, f = np.unique(feature, return_inverse=True)
    w, c = np.zeros(len(used)), float(np.log(-np.log1p(-mean)))
    gw, gc = np.full(len(used), 1e-8), 1e-8
    total = weight.sum()
    for step in range(rounds):
        rate = 0.5 if step < rounds * 2 // 3 else 0.15
        z = BIAS + np.bincount(sentence, w[f], len(doc_of))
        hazard = np.bincount(doc_of, _excess(z), n) + np.exp(c)
        p = -np.expm1(-hazard)
        # d loss / d hazard: 1 for label 0, -(1-p)/p for label 1
        slope = weight * np.where(y == 1, -(1 - p) / np.maximum(p, 1e-9), 1.0)
        g = slope[doc_of] * (z >= BIAS) / (1 + np.exp(-np.clip(z, -60, 60)))
        grad = np.bincount(f, g[sentence], len(used)) + l2 * total / 100 * w
        total_c = slope.sum() * np.exp(c)
        gw += grad**2
        gc += total_c**2
        w -= rate * grad / np.sqrt(gw)
        c -= rate * total_c / np.sqrt(gc)
    dense[used] = w
    return ToxicityModel(dense, float(np.exp(c)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on labels (doc_id, y): features are made and counted on the executors, the driver gets those with weights."""
    prepare(docs.sparkSession)
    sample, sizes = bounded_sample(labels, per_class)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = save(rows.select("doc_id", "text", F.col("y").cast("int").alias("y")), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            y = batch.column("y").to_numpy()
            for lo, hi, data, off in tokens.text_slices(batch.column("text")):
                feature, sentence, doc, _ = sentences(data, off)
                pair = np.unique(doc[sentence] * (1 << BITS) + feature)
                of, code = y[lo + (pair >> BITS)], pair & ((1 << BITS) - 1)
                for v in (0, 1):
                    seen[v] += np.bincount(code[of == v], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[1][some].astype(np.int64)), pa.array(seen[0][some].astype(np.int64))], names=["feature", "in_toxic", "in_clean"])

    got = dict(rows.groupBy("y").count().collect())
    counted = rows.mapInArrow(count, "feature bigint, in_toxic bigint, in_clean bigint").groupBy("feature").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_clean").alias("in_clean"))
    counted = counted.filter(F.col("in_toxic") >= LEAST_DOCS).toArrow()
    features, in_toxic, in_clean = (counted.column(k).to_numpy() for k in ("feature", "in_toxic", "in_clean"))
    used = np.sort(features[chosen(in_toxic, in_clean, got.get(1, 0), got.get(0, 0))])

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_used = np.zeros(1 << BITS, bool)
        is_used[used] = True
        for batch in batches:
            for lo, hi, data, off in tokens.text_slices(batch.column("text")):
                feature, sentence, doc, _ = sentences(data, off)
                keep = is_used[feature]
                feature, sentence = feature[keep], sentence[keep]
                by = np.argsort(sentence, kind="stable")
                feature, sentence = feature[by], sentence[by]
                cut = np.searchsorted(doc[sentence], np.arange(hi - lo + 1))
                f = [feature[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(hi - lo)]
                s = [np.unique(sentence[cut[i] : cut[i + 1]], return_inverse=True)[1].astype(np.int32).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), pa.array(f, pa.binary()), pa.array(s, pa.binary())], names=["doc_id", "y", "f", "s"])

    found = rows.mapInArrow(weighted, "doc_id bigint, y int, f binary, s binary").toArrow().sort_by("doc_id")
    discard(rows)
    y = found.column("y").to_numpy()
    f = [np.frombuffer(x.as_py(), np.int32) for x in found.column("f")]
    s = [np.frombuffer(x.as_py(), np.int32) for x in found.column("s")]
    counts = np.array([int(x[-1]) + 1 if len(x) else 0 for x in s], np.int64)
    base = np.cumsum(counts) - counts
    weight = np.array([sizes.get(v, 0) / max(1, got.get(v, 0)) for v in (0, 1)])[y] if len(y) else np.zeros(0)
    feature = np.concatenate(f).astype(np.int64) if f else np.zeros(0, np.int64)
    sentence = np.concatenate([x + b for x, b in zip(s, base)]) if s else np.zeros(0, np.int64)
    return fit(y, weight, feature, sentence.astype(np.int64), np.repeat(np.arange(len(y)), counts))


SCORES = "doc_id bigint, score double, sentences array<string>, sentence_scores array<double>"


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, and the sentences that reach the threshold alone, with their scores."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tokens.text_slices(batch.column("text")):
                feature, sentence, doc, at = sentences(data, off)
                hazard = model.hazards(feature, sentence, len(doc))
                p = -np.expm1(-hazard)
                bad = np.flatnonzero(p >= threshold)
                stops = np.flatnonzero(_END[data])
                texts = []
                for i in bad.tolist():
                    k = int(np.searchsorted(stops, at[i]))
                    end = min(int(stops[k]) + 1 if k < len(stops) else len(data), int(off[doc[i] + 1]))
                    texts.append(data[at[i] : end].tobytes().decode("utf-8", "replace").strip())
                cut = np.searchsorted(doc[bad], np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), pa.array(np.clip(model.documents(hazard, doc, hi - lo), 0, 1)),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(texts, pa.string())), tokens.lists(p[bad].astype(np.float64), cut, pa.float64()),
                ], names=["doc_id", "score", "sentences", "sentence_scores"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORES)
