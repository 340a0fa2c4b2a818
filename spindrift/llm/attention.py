"""Quality by attention-based multiple-instance learning.

A text is a bag of passages. Every passage is encoded: counts of its characters and words pass a
learned layer; gated attention (tanh times sigmoid, softmax over the bag) weighs the passages, and
a logistic unit scores the weighted representation. Only documents are labelled; which passages
matter is learned from that.

A text of n words has passages of max(PASSAGE, n / MOST_PASSAGES) words, so that a bag is bounded
and yet every word of the text counts.

The model is fitted on the driver over at most 2 * TRAIN_ROWS labelled documents, taken by a digest
of their ids; scoring is a map over the texts.

Defined cases: null and empty texts, and texts without a word, are one passage of zeros and get
the model's score of that; without labels of both classes every score is the share of label 1,
or 0.5; a document labelled twice is a sample twice; null ids and labels are not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flatwords import MULTIPLIER, NEWLINE, chunks, mix, words
from .rules import LETTER, SHOUT, SYMBOL, UPPER, repeated
from .runtime import by_text, in_fold, table

PASSAGE, MOST_PASSAGES = 64, 64
#: Labelled documents of each class that the model is fitted on, at most.
TRAIN_ROWS = 2000
HIDDEN, GATES, EPOCHS, RATE, DECAY = 16, 8, 400, 0.01, 1e-3
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[list(b".,;:")] = True
BAR = np.zeros(256, bool)
BAR[ord("|")] = True
FEATURES = 17


def encode(raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a chunk's texts, and the number of passages of each text."""
    n = len(texts) - 1
    w = words(raw, texts)
    count = np.bincount(w.text, minlength=n)
    size = np.maximum(PASSAGE, -(-count // MOST_PASSAGES))
    bags = np.maximum(-(-count // size), 1)
    first = np.cumsum(count) - count
    inside = (np.arange(len(w.hash)) - first[w.text]) // size[w.text]
    passage = (np.cumsum(bags) - bags)[w.text] + inside
    total = int(bags.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if not len(w.hash):
        return out, bags
    at = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    rows = passage[at]
    begin = w.start[at]
    stop = np.r_[begin[1:], w.end[-1]]
    # A passage's bytes end with its text.
    stop = np.minimum(stop, texts[1:][w.text[at]])

    def held(flags: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(flags)]
        return (c[stop] - c[begin]).astype(np.float32)

    def added(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float32), at)

    k = added(np.ones(len(w.hash)))
    letters, marks = np.r_[0, np.cumsum(LETTER[raw])], np.r_[0, np.cumsum(SYMBOL[raw])]
    lettered, marked = letters[w.end] > letters[w.start], marks[w.end] > marks[w.start]
    length = (w.end - w.start).astype(np.float32)
    same = np.r_[False, (w.hash[1:] == w.hash[:-1]) & (passage[1:] == passage[:-1])]
    _, unique = np.unique(mix(w.hash + passage.astype(np.uint64) * MULTIPLIER), return_index=True)
    mean = added(np.minimum(length, 40)) / k
    columns = [
        np.ones(len(k)),
        np.log1p(k),
        np.minimum(held(SYMBOL[raw]) / k, 4),
        added(marked & lettered) / k,
        added(~lettered) / k,
        held(UPPER[raw]) / np.maximum(held(LETTER[raw]), 1),
        np.minimum(held(SHOUT[raw]) / k, 3),
        np.minimum(held(DIGIT[raw]) / k, 3),
        mean,
        np.sqrt(np.maximum(added(np.minimum(length, 40) ** 2) / k - mean**2, 0)),
        added(same) / k,
        np.bincount(passage[unique], minlength=total)[rows] / k,
        added(repeated(w)) / k,
        np.minimum(held(raw == NEWLINE) / k, 1),
        np.minimum(held(STOP[raw]) / k, 2),
        np.minimum(held(BAR[raw]) / k, 2),
        added(length == 1) / k,
    ]
    out[rows] = np.stack(columns, 1)
    return out, bags


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def scores(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        return forward(self.weights, (x - self.mean) / self.scale, bags)["score"]


def forward(p: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
    at = np.cumsum(bags) - bags
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * s) @ p["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), bags))
    a = e / np.repeat(np.add.reduceat(e, at), bags)
    z = np.add.reduceat(h * a[:, None], at, axis=0)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}


def fit(x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Full-batch Adam on the weighted logistic loss; the same result each time."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1), np.ones(1), {}, float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(0), x.std(0) + 0.01
    mean[0], scale[0] = 0, 1
    x = (x - mean) / scale
    rng = np.random.default_rng(0)
    shape = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "w": (GATES,), "c": (HIDDEN,), "d": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shape.items()}
    m1, m2 = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}
    at, weight = np.cumsum(bags) - bags, weight / weight.sum()
    for step in range(1, EPOCHS + 1):
        f = forward(p, x, bags)
        error = (f["score"] - y) * weight
        dz = np.repeat(error[:, None] * p["c"], bags, axis=0)
        dh = f["a"][:, None] * dz
        # Softmax: how each passage's attention moves the weighted sum.
        along = (dz * f["h"]).sum(1)
        mean_along = np.repeat(np.add.reduceat(f["a"] * along, at), bags)
        de = f["a"] * (along - mean_along)
        dg = de[:, None] * p["w"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = dh + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        g = {"W": x.T @ dx, "b": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ error, "d": np.array([error.sum()])}
        for k in p:
            grad = g[k] + (DECAY * p[k] / len(p) if k not in "bd" else 0)
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
            p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def training_sample(labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id and label of at most so many labelled rows of each class outside of the held-out fold, and how many rows each class has there."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), folds, held_out)).select("doc_id", F.col(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    parts = [usable.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), sizes


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    sample, sizes = training_sample(labels, "quality", FOLDS, HELD_OUT, TRAIN_ROWS)
    # At most 2 * TRAIN_ROWS rows of two numbers.
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, at in chunks(batch.column(1)):
                x, bags = encode(raw, at)
                ends = np.cumsum(bags)
                cells = [x[e - k : e].tobytes() for e, k in zip(ends.tolist(), bags.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(cells, pa.binary())], names=["label", "x"])

    rows = by_text(known).mapInArrow(run, "label int, x binary").collect()  # 64 passages of 17 numbers a document at most
    rows.sort(key=lambda r: (r["label"], bytes(r["x"])))
    y = np.array([r["label"] for r in rows], float)
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    weight = np.array([sizes[int(v)] / max((y == v).sum(), 1) for v in y])
    return fit(np.concatenate(parts) if parts else np.zeros((0, FEATURES)), np.array([len(x) for x in parts], int), y, weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, at in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.scores(*encode(raw, at)), pa.float64())], names=["doc_id", "score"])

    return by_text(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op1_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op1_quality_attention": op1_quality_attention}
ORACLES: dict[str, str] = {}
