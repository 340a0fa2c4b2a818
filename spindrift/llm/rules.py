"""Quality rules as weak supervision.

Each rule looks at counts of a whole text and votes good, bad, or abstains. Nobody has labels:
expectation-maximisation over the counts of all vote patterns of the corpus estimates how often
each rule is right on good and on bad documents, and how common good ones are; a document's
posterior probability of being good follows from its votes, and replaces passing every rule.

A pattern is one of 3 ** len(RULES) numbers, so what reaches the driver is bounded however large
the corpus is, and it counts every document.

Defined cases: a null text counts as the empty text, whose base fails; texts without words have
zero counts; a corpus of no rows gives no rows; equal rows are judged alike. The verdict
depends on the text alone once the accuracies are set. Columns besides doc_id and text may have any
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flatwords import MULTIPLIER, NEWLINE, SOLID, VALUE, Words, chunks, mix, powers, words
from .runtime import by_text, checkpoint, frugal, table

WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
#: Keep a document whose posterior is at least this.
KEEP = 0.5

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = True  # a leading byte beyond ASCII counts as a letter
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
SHOUT = np.zeros(256, bool)
SHOUT[list(b"!?")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_distinct", "n_bare", "n_marked", "n_echoes")


def _per_text(flags: np.ndarray, texts: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[texts[1:]] - total[texts[:-1]]


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Different hashes of each text."""
    if not len(hashes):
        return np.zeros(n, np.int64)
    key = mix(hashes + owner.astype(np.uint64) * MULTIPLIER)
    _, at = np.unique(key, return_index=True)
    return np.bincount(owner[at], minlength=n)


def repeated(w: Words) -> np.ndarray:
    """Whether each word stands in a run of WINDOW words that its text has twice or more."""
    if len(w.hash) < WINDOW:
        return np.zeros(len(w.hash), bool)
    m = len(w.hash) - WINDOW + 1
    key = np.zeros(m, np.uint64)
    for i in range(WINDOW):
        key = key * np.uint64(0xD1342543DE82EF95) + w.hash[i : m + i]
    at = np.flatnonzero(w.text[:m] == w.text[WINDOW - 1 :])
    key = mix(key[at] + w.text[at].astype(np.uint64) * MULTIPLIER)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = at[order[np.r_[False, same] | np.r_[same, False]]] if len(at) else at
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def measure(raw: np.ndarray, texts: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text of a chunk."""
    n = len(texts) - 1
    w = words(raw, texts)
    out = {"n_words": np.bincount(w.text, minlength=n)}
    solid = SOLID[raw]
    out["word_chars"] = _per_text(solid & (raw & 0xC0 != 0x80), texts)
    out["n_symbols"] = _per_text(SYMBOL[raw], texts)
    out["n_upper"] = _per_text(UPPER[raw], texts)
    out["n_letters"] = _per_text(LETTER[raw], texts)
    out["n_shouts"] = _per_text(SHOUT[raw], texts)

    # Lines: bounds at line feeds and at the bounds of texts.
    feeds = np.flatnonzero(raw == NEWLINE)
    begin = np.sort(np.r_[texts[:-1], feeds + 1])
    stop = np.sort(np.r_[feeds, texts[1:]])
    power, inverse = powers(len(raw) + 1)
    total = np.r_[np.uint64(0), np.cumsum(VALUE[raw] * power[: len(raw)], dtype=np.uint64)]
    owner = np.repeat(np.arange(n), _per_text(raw == NEWLINE, texts) + 1)
    held = np.searchsorted(w.start, stop) > np.searchsorted(w.start, begin)
    line, owner = mix((total[stop] - total[begin]) * inverse[begin] + (stop - begin).astype(np.uint64))[held], owner[held]
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(line, owner, n)

    out["n_echoes"] = np.bincount(w.text[1:][(w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])], minlength=n)
    out["n_distinct"] = _distinct(w.hash, w.text, n)
    letters = np.r_[0, np.cumsum(LETTER[raw])]
    out["n_bare"] = np.bincount(w.text[letters[w.end] == letters[w.start]], minlength=n)

    marks = np.r_[0, np.cumsum(SYMBOL[raw])]
    out["n_marked"] = np.bincount(w.text[(marks[w.end] > marks[w.start]) & (letters[w.end] > letters[w.start])], minlength=n)

    out["n_repeat_words"] = np.bincount(w.text[repeated(w)], minlength=n)
    return out


@dataclass(frozen=True)
class Rule:
    """Votes bad beyond one bound of a ratio of counts and good within the other; between them it abstains."""

    name: str
    above: str
    below: str
    good: tuple[float, float]
    bad: tuple[float, float]  # votes bad outside of this

    def vote(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        """0 bad, 1 good, 2 abstains. An empty denominator abstains."""
        under = counts[self.below] if self.below else np.ones_like(counts[self.above])
        ratio = counts[self.above] / np.maximum(under, 1)
        fine = (ratio >= self.good[0]) & (ratio <= self.good[1])
        poor = (ratio < self.bad[0]) | (ratio > self.bad[1])
        return np.where(under == 0, 2, np.where(poor, 0, np.where(fine, 1, 2)))


INF, NEVER = math.inf, (1.0, 0.0)
#: That a fault is absent says little, so rules that look for one fault vote bad or abstain.
RULES = (
    Rule("words of usual length", "word_chars", "n_words", (3.0, 9.0), (2.0, 15.0)),
    Rule("many different words", "n_distinct", "n_words", (0.3, 1), (0.05, 1)),
    Rule("few symbols", "n_symbols", "n_words", NEVER, (0, 0.25)),
    Rule("new lines", "n_dup_lines", "n_lines", NEVER, (0, 0.5)),
    Rule("new passages", "n_repeat_words", "n_words", NEVER, (0, 0.25)),
    Rule("not all capitals", "n_upper", "n_letters", NEVER, (0, 0.4)),
    Rule("calm", "n_shouts", "n_words", NEVER, (0, 0.3)),
    Rule("neighbours differ", "n_echoes", "n_words", NEVER, (0, 0.25)),
    Rule("plain words", "n_marked", "n_words", NEVER, (0, 0.25)),
    Rule("words have letters", "n_bare", "n_words", NEVER, (0, 0.25)),
)


def pattern(counts: dict[str, np.ndarray]) -> np.ndarray:
    return sum(rule.vote(counts) * 3**j for j, rule in enumerate(RULES))


@dataclass(frozen=True)
class Accuracies:
    """How common good documents are, and the chances of each rule's outcomes (bad, good, abstains) in either class."""

    prior: float
    if_good: tuple[tuple[float, ...], ...]
    if_bad: tuple[tuple[float, ...], ...]

    def accuracy(self, j: int) -> float:
        """Of the rule's votes, the share that is right."""
        g, b = self.if_good[j], self.if_bad[j]
        right = self.prior * g[1] + (1 - self.prior) * b[0]
        return right / (right + self.prior * g[0] + (1 - self.prior) * b[1])

    def log_odds(self, j: int, vote: int) -> float:
        return math.log(self.if_good[j][vote] / self.if_bad[j][vote])


#: Chances to start from: rules are seldom wrong on good documents, and each finds some of the bad ones.
FROM_GOOD, FROM_BAD = (0.002, 0.6, 0.398), (0.3, 0.4, 0.3)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Accuracies:
    """Expectation-maximisation over the number of documents with each pattern.

    Most documents are taken to be good. A pseudo-count of the starting chances keeps all
    chances off 0 and 1. So that the classes do not change places, bad votes that would be commoner among good
    documents than among bad ones make all of the rule's outcomes equally common in both: such a rule's vote tells nothing.
    The share of good documents stays between a half and 0.99.
    """
    k = len(RULES)
    votes = np.array([patterns // 3**j % 3 for j in range(k)], int).T.reshape(len(patterns), k)
    said = np.stack([(votes == v).astype(float) for v in range(3)])  # vote, pattern, rule
    start_good, start_bad = np.array(FROM_GOOD)[:, None].repeat(k, 1), np.array(FROM_BAD)[:, None].repeat(k, 1)
    prior, good, bad = 0.9, start_good, start_bad
    for _ in range(rounds if len(patterns) else 0):
        odds = math.log(prior / (1 - prior)) + np.einsum("vpk,vk->p", said, np.log(good / bad))
        p = counts / (1 + np.exp(-np.clip(odds, -500, 500)))
        q = counts - p
        prior = min(max((p.sum() + 9) / (counts.sum() + 10), 0.5), 0.99)
        good = (np.einsum("p,vpk->vk", p, said) + start_good) / (p.sum() + 1)
        bad = (np.einsum("p,vpk->vk", q, said) + start_bad) / (q.sum() + 1)
        wrong = good[0] > bad[0]
        both = (good * p.sum() + bad * q.sum()) / max(counts.sum(), 1)
        good, bad = np.where(wrong, both, good), np.where(wrong, both, bad)
    return Accuracies(float(prior), tuple(map(tuple, good.T.tolist())), tuple(map(tuple, bad.T.tolist())))


def posterior(votes: Column, known: Accuracies) -> Column:
    """Probability of being good, from the pattern's digits."""
    odds = F.lit(math.log(known.prior / (1 - known.prior)))
    for j in range(len(RULES)):
        digit = F.pmod(F.floor(votes / 3**j), F.lit(3))
        odds = odds + F.when(digit == 0, known.log_odds(j, 0)).when(digit == 1, known.log_odds(j, 1)).otherwise(known.log_odds(j, 2))
    return 1 / (1 + F.exp(-odds))


def _measured(column: pa.Array) -> dict[str, np.ndarray]:
    parts = [measure(raw, at) for _, _, raw, at in chunks(column)]
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS}


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and votes of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _measured(batch.column(1))
            columns = [pa.array(counts[c], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(pattern(counts), pa.int64())], names=["doc_id", *COUNTS, "votes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_text(docs.select("doc_id", "text")).mapInArrow(frugal(run), f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, votes long")


def learned(votes: DataFrame) -> Accuracies:
    """Accuracies from a column votes of all documents whose base did not fail."""
    rows = votes.groupBy("votes").count().collect()  # 3 ** len(RULES) rows at most
    return estimate(np.array([r["votes"] for r in rows], np.int64), np.array([r["count"] for r in rows], float))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, posterior and kept of every document."""
    counts = checkpoint(counted(docs))
    known = learned(counts.filter(~base_failed()))
    judged = counts.withColumn("base_failed", base_failed()).withColumn("posterior", posterior(F.col("votes"), known))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with docs' columns.

    The texts are counted twice, first for the accuracies and then for the verdict, as that is
    cheaper than to store them in between.
    """
    known = learned(counted(docs).filter(~base_failed()).select("votes"))
    place, names, schema = docs.columns.index("text"), docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _measured(batch.column(place))
            votes = pattern(counts)
            odds = np.full(len(votes), math.log(known.prior / (1 - known.prior)))
            for j in range(len(RULES)):
                odds += np.array([known.log_odds(j, v) for v in range(3)])[votes // 3**j % 3]
            fine = (counts["n_words"] >= LEAST_WORDS) & (100 * counts["n_repeat_words"] <= MOST_REPEATED_PERCENT * counts["n_words"])
            kept = fine & (1 / (1 + np.exp(-odds)) >= KEEP)
            yield batch.filter(pa.array(kept)).rename_columns(names)

    return by_text(docs).mapInArrow(frugal(run), schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES: dict[str, str] = {}
