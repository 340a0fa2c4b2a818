"""Checks of content, and classes of queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T

#: What an issue takes off the score (fixed values).
PENALTIES = {"high": 0.5, "medium": 0.3, "low": 0.2}
QUESTION_WORDS = ("what", "who", "when", "where", "why", "how", "which", "is", "are")


def _issue(when: Column, kind: str, severity: str) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))


def validate(docs: DataFrame, banned: Sequence[str], *, text: str = "text", least_chars: int = 100, least_readability: float = 0.7, sections: Sequence[str] = (), passing: float = 0.7) -> DataFrame:
    """docs with issues (kind and severity), score (1 less the penalties, 0 at least) and is_valid."""
    words = T.words(F.col(text))
    checks = [
        _issue(F.length(text) < least_chars, "length", "high"),
        _issue(T.readability(F.col(text)) < least_readability, "readability", "medium"),
        _issue(reduce(lambda a, b: a | b, [F.array_contains("_words", w) for w in banned], F.lit(False)), "banned words", "low"),
        *[_issue(~F.lower(text).contains(s.lower()), f"missing section {s}", "medium") for s in sections],
    ]
    checked = docs.withColumn("_words", words).withColumn("issues", F.array_compact(F.array(*checks))).drop("_words")
    taken = F.aggregate("issues", F.lit(0.0), lambda total, i: total + F.when(i["severity"] == "high", PENALTIES["high"]).when(i["severity"] == "medium", PENALTIES["medium"]).otherwise(PENALTIES["low"]))
    return checked.withColumn("score", F.greatest(F.lit(0.0), 1 - taken)).withColumn("is_valid", F.col("score") >= passing)


def report(validated: DataFrame, by: str) -> DataFrame:
    return validated.groupBy(by).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.count_if("is_valid").alias("n_valid"))


def query_type(text: Column) -> Column:
    first = F.regexp_extract(F.lower(text), r"^\s*([\p{L}]+)", 1)
    return F.when(first.isin(*QUESTION_WORDS) | text.rlike(r"\?\s*$"), "question").when(F.size(T.words(text)) <= 3, "topic").otherwise("statement")


def concepts(text: Column, known: Sequence[str]) -> Column:
    """Those of the known words that the text has, in their order."""
    words = T.words(text)
    return F.filter(F.array(*map(F.lit, known)), lambda k: F.array_contains(words, k))


def in_range(value: Column, low: float, high: float) -> Column:
    return value.between(low, high)


def has_keys(metadata: Column, keys: Sequence[str]) -> Column:
    return F.forall(F.array(*map(F.lit, keys)), lambda k: F.array_contains(F.map_keys(metadata), k))


def has_extension(path: Column, allowed: Sequence[str]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)).isin(*[a.lstrip(".").lower() for a in allowed])
