"""Toxicity by a support vector machine with a subsequence string kernel.

The kernel of two words sums, over all subsequences of three letters, the product of their
weights in both; a subsequence's weight falls by GAP for each letter that it skips, within SPAN
letters, and word bounds count as letters. So an insult keeps most of its value with letters put
in or left out. Signs inside a word are skipped, digits stand for the letters they look like, and
runs of single letters are read as one word too.

Training: of a bounded sample of labelled sentences' documents (a toxic label says that some
sentence holds an insult, not which), the words that toxic ones hold far more often than others are
the witnesses. LANDMARKS of them and of other words span the Nyström approximation of the kernel's
space, in which a linear machine separates witnesses from words of clean texts. As the kernel is
a sum over subsequences, a word's kernels with all landmarks are one walk over its subsequences,
most of which no landmark has. A text's score is a logistic function, fitted on the other half of the
sample, of its nearest word to a witness, of its two highest words, of how many words lie above two levels and of how many there are.

Defined cases: null and empty texts and texts without letters have no word, and get the score of that;
without labels of both classes every score is the share of label 1, or 0; equal texts have equal
scores; words of any length are scored whole; null ids and labels are not trained on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import training_sample
from .runtime import by_text, in_fold, table

SPAN, GAP = 6, 0.5
#: The normalised kernel is raised to this power, which is a kernel too and tells near words apart; ridge of the machine.
POWER, RIDGE = 2, 1e-3
#: Labelled documents of each class in the sample, at most; words taken from it; landmarks; least z-score of a witness.
TRAIN_ROWS, WITNESSES, OTHERS, LANDMARKS, LEAST_Z = 5000, 600, 6000, 96, 4.0
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Words whose values a worker remembers; bounds memory, changes no result.
REMEMBERED = 300_000
OPEN, CLOSE = 62, 63
#: Numbers that sum a text up.
SUMMARY = 11
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
#: Digits read as letters (fixed values).
LOOKALIKES = str.maketrans("013457", "oieast")


def _letter_classes() -> np.ndarray:
    """Class of each code point below 0x250: 1 to 26 for a to z, 27 to 61 for other letters, 0 to skip."""
    out = np.zeros(0x250, np.int32)
    for c in range(0x250):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % 35
    return out


CLASSES = _letter_classes()


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of words with their bounds, in one row, and each word's length there. A word without letters has length 2."""
    text = "".join([f"\1{w}\2" for w in words]).translate(LOOKALIKES)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    near = points < 0x250
    out = np.where(near, CLASSES[np.where(near, points, 0)], 27 + points % 35)
    out[points == 1], out[points == 2] = OPEN, CLOSE
    word = np.cumsum(points == 1) - 1
    kept = out > 0
    return out[kept], np.bincount(word[kept], minlength=len(words))


def norms(lengths: np.ndarray) -> np.ndarray:
    """The square root of the kernel of a word with itself if no subsequence came twice."""
    n = lengths.astype(float)
    total = np.zeros(len(n))
    for a in range(1, SPAN - 1):
        for b in range(1, SPAN - a):
            total += np.maximum(n - a - b, 0) * GAP ** (2 * (a + b - 2))
    return np.sqrt(np.maximum(total, 1e-9))


def subsequences(letters: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Places, codes and weight of all subsequences, by their two steps."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    for a in range(1, SPAN - 1):
        for b in range(1, SPAN - a):
            m = len(letters) - a - b
            if m <= 0:
                continue
            at = np.flatnonzero(word[:m] == word[a + b :])
            yield at, letters[at] << 12 | letters[at + a] << 6 | letters[at + a + b], GAP ** (a + b - 2)


@dataclass
class Landmarks:
    """The landmarks' subsequences: place[code] is 0 or the code's row; a row's entries are landmarks and weights."""

    n: int
    place: np.ndarray
    first: np.ndarray
    count: np.ndarray
    landmark: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Landmarks:
        letters, lengths = spelled(words)
        word = np.repeat(np.arange(len(words)), lengths)
        found = [(code * len(words) + word[at], np.full(len(at), w)) for at, code, w in subsequences(letters, lengths)]
        key, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        weight = np.bincount(inverse, np.concatenate([w for _, w in found]))
        code, landmark = key // len(words), key % len(words)
        codes, first, count = np.unique(code, return_index=True, return_counts=True)
        place = np.zeros(1 << 18, np.int32)
        place[codes] = np.arange(1, len(codes) + 1)
        return Landmarks(len(words), place, np.r_[0, first], np.r_[0, count], landmark, weight / norms(lengths)[landmark])

    def kernel(self, words: list[str]) -> np.ndarray:
        """The kernel of each word with each landmark, to the power of POWER."""
        letters, lengths = spelled(words)
        word = np.repeat(np.arange(len(words)), lengths)
        out = np.zeros(len(words) * self.n)
        for at, code, weight in subsequences(letters, lengths):
            row = self.place[code]
            hit = np.flatnonzero(row)
            row, at = row[hit], at[hit]
            times = self.count[row]
            entry = np.repeat(self.first[row] - np.r_[0, np.cumsum(times)[:-1]] if len(row) else row, times) + np.arange(times.sum())
            cell = np.repeat(word[at] * self.n, times) + self.landmark[entry]
            out += np.bincount(cell, weight * self.weight[entry], minlength=len(out))
        return (out.reshape(len(words), self.n) / norms(lengths)[:, None]) ** POWER


def parts(text: str) -> set[str]:
    """Different words of a text: split at white space, lower case; runs of single letters also joined."""
    text = text.lower()
    out = set(text.split())
    for run in SPACED.findall(text):
        out.add("".join(run.split()))
    return out


def step(x: float, low: float, high: float) -> float:
    return min(max((x - low) / (high - low), 0.0), 1.0)


@dataclass
class Machine:
    landmarks: Landmarks | None
    weights: np.ndarray
    bias: float
    witnesses: int
    logistic: np.ndarray
    constant: float | None = None

    def texts(self, texts: list[str], known: dict[str, tuple[float, float]]) -> np.ndarray:
        """Of each text: its nearest word to a witness and its highest words by steps, how many words lie above two levels, and how many there are."""
        sets = [parts(t) for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set().union(*sets) - known.keys()) if sets else []
        for a in range(0, len(new), 8_000):
            some = new[a : a + 8_000]
            kernel = self.landmarks.kernel(some)
            known.update(zip(some, zip((kernel @ self.weights + self.bias).tolist(), kernel[:, : self.witnesses].max(1).tolist(), strict=True), strict=True))
        out = np.zeros((len(texts), SUMMARY))
        value = known.__getitem__
        for i, words in enumerate(sets):
            values = [*map(value, words), (-1.0, 0.0), (-1.0, 0.0)]
            high = sorted([v for v, _ in values], reverse=True)
            near = max([k for _, k in values])
            first, second = high[:2]
            out[i] = 1, step(near, 0.6, 0.9), step(near, 0.9, 1.0), step(first, -0.5, 0.3), step(first, 0.3, 0.6), step(first, 0.6, 0.8), step(first, 0.8, 1.0), step(second, 0.3, 0.8), math.log1p(sum(v > 0.3 for v in high)), math.log1p(sum(v > 0.6 for v in high)), math.log1p(len(words))
        return out

    def scores(self, texts: list[str], known: dict[str, tuple[float, float]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.texts(texts, known) @ self.logistic, -30, 30)))


def train_words(witnesses: list[str], counts: np.ndarray, others: list[str]) -> Machine:
    """The machine of words: Nyström map over landmarks, squared hinge loss, Newton steps.

    Landmarks are the first witnesses and the other words that come nearest to witnesses.
    """
    own = witnesses[: LANDMARKS * 2 // 3]
    near = np.argsort(-Landmarks.of(own).kernel(others).max(1), kind="stable") if others else []
    chosen = own + [others[i] for i in near[: LANDMARKS - len(own)]]
    marks = Landmarks.of(chosen)
    words = witnesses + others
    values, vectors = np.linalg.eigh(marks.kernel(chosen))
    fine = values > 1e-4 * values.max()
    root = vectors[:, fine] / np.sqrt(values[fine])
    x = np.c_[marks.kernel(words) @ root, np.ones(len(words))]
    y = np.r_[np.ones(len(witnesses)), -np.ones(len(others))]
    # Either class counts as much; of witnesses the commoner ones more.
    c = np.r_[np.sqrt(counts), np.ones(len(others))]
    c[y > 0] /= c[y > 0].sum()
    c[y < 0] /= c[y < 0].sum()
    v = np.zeros(x.shape[1])
    ridge = RIDGE * np.eye(len(v))
    ridge[-1, -1] = 1e-9
    for _ in range(30):
        slack = np.maximum(1 - y * (x @ v), 0)
        act = slack > 0
        grad = -2 * (x[act] * (c[act] * y[act] * slack[act])[:, None]).sum(0) + 2 * ridge @ v
        hess = 2 * (x[act] * c[act][:, None]).T @ x[act] + 2 * ridge
        new = v - np.linalg.solve(hess, grad)
        if np.abs(new - v).max() < 1e-8:
            break
        v = new
    return Machine(marks, root @ v[:-1], float(v[-1]), len(own), np.zeros(SUMMARY))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    v = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 0.02 * v
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(len(v))
        v = v - np.linalg.solve(hess, grad)
    return v


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    sample, sizes = training_sample(labels, "toxic", FOLDS, HELD_OUT, TRAIN_ROWS)
    if len(sizes) < 2:
        return Machine(None, np.zeros(0), 0.0, 0, np.zeros(SUMMARY), float(max(sizes, default=0)))
    sample = sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)))
    # At most 2 * TRAIN_ROWS rows of three numbers.
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "half", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = sorted(parts(text or ""))
                words = [w for w in words if len(w) <= 40]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(words), pa.int32()), pa.array(words, pa.string())], names=["label", "word"])

    found = known.filter("half = 0").select("label", "text").mapInArrow(split, "label int, word string")
    found = found.select("label", F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("word")).filter("word != ''")
    each = found.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    halves = {(r["label"], r["half"]): r["count"] for r in sample.groupBy("label", "half").count().collect()}
    n1, n0 = halves.get((1, 0), 0) + 1, halves.get((0, 0), 0) + 1
    share = (F.col("toxic") + F.col("clean") + 1) / (n1 + n0)
    each = each.withColumn("z", (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(share * (1 / n1 + 1 / n0)))
    # Bounded: the first words of three orders.
    best = each.filter((F.col("toxic") >= 3) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "word").limit(WITNESSES).collect()
    plain = each.filter("z < 0.5 AND clean > 0")
    others = {r["word"] for order in (F.desc("clean"), F.xxhash64("word")) for r in plain.orderBy(order, "word").limit(OTHERS // 2).collect()}
    if not best:
        return Machine(None, np.zeros(0), 0.0, 0, np.zeros(SUMMARY), sizes.get(1, 0) / sum(sizes.values()))
    machine = train_words([r["word"] for r in best], np.array([r["toxic"] for r in best], float), sorted(others))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: dict[str, tuple[float, float]] = {}
        for batch in batches:
            x = machine.texts([t or "" for t in batch.column(1).to_pylist()], values)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, j]) for j in range(SUMMARY))], names=["label", *(f"x{j}" for j in range(SUMMARY))])

    rows = known.filter("half = 1").select("label", "text").mapInArrow(summed, "label int, " + ", ".join(f"x{j} double" for j in range(SUMMARY))).collect()
    data = np.array(sorted(tuple(r) for r in rows), float).reshape(-1, 1 + SUMMARY)
    y = data[:, 0]
    weight = np.array([sizes[int(v)] / max((y == v).sum(), 1) for v in y])
    machine.logistic = _logistic(data[:, 1:], y, weight * len(y) / max(weight.sum(), 1e-9))
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # landmarks and a table of 2**18 places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, float]] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a in range(0, len(texts), 256):
                some = texts[a : a + 256]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(some)), pa.array(sent.value.scores(some, known), pa.float64())], names=["doc_id", "score"])

    return by_text(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op10_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity_kernel": op10_toxicity_kernel}
ORACLES: dict[str, str] = {}
