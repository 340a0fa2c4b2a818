"""Reranking and scoring of hits, facets and tags."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_page(hits: DataFrame, page: str, alpha: float = 0.1) -> DataFrame:
    return hits.withColumn("score", F.col("score") * (1 + F.exp(-alpha * F.col(page))))


def by_context(hits: DataFrame, context_similarity: Column, beta: float = 0.2) -> DataFrame:
    return hits.withColumn("score", F.col("score") * (1 + beta * context_similarity))


def by_metadata(hits: DataFrame, target: Mapping[str, Any], gamma: float = 0.3) -> DataFrame:
    """Mean agreement with the target: 1 / (1 + difference) of numbers, equality of others."""
    parts = []
    for name, value in target.items():
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            parts.append(F.coalesce(1 / (1 + F.abs(F.col(name) - value)), F.lit(0.0)))
        else:
            parts.append(F.col(name).eqNullSafe(F.lit(value)).cast("double"))
    return hits.withColumn("score", F.col("score") * (1 + gamma * reduce(lambda a, b: a + b, parts) / len(parts)))


def educational(hits: DataFrame, topics: Sequence[str], level: str, intent: str) -> DataFrame:
    """Half the vector score, .3 educational and .2 curricular fit. hits: score, topics, level and intent."""
    wanted = F.array(*map(F.lit, topics)).cast("array<string>")
    shared = F.size(F.array_intersect("topics", wanted))
    fit = 0.4 * shared / max(len(topics), 1) + F.when(F.col("level") == level, 0.3).otherwise(0.15) + F.when(F.col("intent") == intent, 0.3).otherwise(0.15)
    curriculum = shared / len(topics) if topics else F.lit(0.5)
    return hits.withColumns({"educational": fit, "curriculum": curriculum}).withColumn("final_score", 0.5 * F.col("score") + 0.3 * F.col("educational") + 0.2 * F.col("curriculum"))


def adapted_level(level: Column) -> Column:
    return F.when(level == "beginner", "basic").when(level == "advanced", "advanced").otherwise("intermediate")


def rank_features(hits: DataFrame, query: Mapping[str, float] | None, pagerank: str = "pagerank", features: str = "features") -> DataFrame:
    """hits with rank_score: ten times the cosine of the query's and the row's tag features, plus its page rank. Without query features the page rank alone."""
    if not query:
        return hits.withColumn("rank_score", F.coalesce(F.col(pagerank).cast("double"), F.lit(0.0)))
    size = math.sqrt(sum(v * v for k, v in query.items() if k != "pagerank"))
    wanted = F.create_map(*[F.lit(x) for k, v in query.items() if k != "pagerank" for x in (k, float(v))])
    entries = F.map_entries(F.col(features))
    dot = F.aggregate(entries, F.lit(0.0), lambda t, e: t + e["value"] * F.coalesce(F.element_at(wanted, e["key"]), F.lit(0.0)))
    norm = F.sqrt(F.aggregate(entries, F.lit(0.0), lambda t, e: t + e["value"] * e["value"]))
    return hits.withColumn("rank_score", F.coalesce(10 * F.try_divide(dot, norm * size), F.lit(0.0)) + F.coalesce(F.col(pagerank).cast("double"), F.lit(0.0)))


def mixed(hits: DataFrame, parts: Mapping[str, float], out: str = "score") -> DataFrame:
    """Weighted sum of score columns."""
    return hits.withColumn(out, reduce(lambda a, b: a + b, [F.col(c) * w for c, w in parts.items()]))


def weighted_words(content: Column, title: Column, important: Column, question: Column) -> Column:
    """Words of a record's fields, the title's twice, the important ones five and the questions' six times."""
    return F.flatten(F.concat(F.array(content), F.array_repeat(title, 2), F.array_repeat(important, 5), F.array_repeat(question, 6)))


def by_model(hits: DataFrame, model: Callable[[Column, Column], Column], query: str, text: str = "text", token_weight: float = 0.3, model_weight: float = 0.7) -> DataFrame:
    """Token and rank scores with a model's score of (query, text), such as an Arrow function."""
    return hits.withColumn("score", token_weight * (F.col("token_score") + F.col("rank_score")) + model_weight * model(F.lit(query), F.col(text)))


def facets(hits: DataFrame, field: str) -> DataFrame:
    return hits.groupBy(field).agg(F.count("*").alias("n")).orderBy(F.desc("n"), field)


def smoothed_shares(rows: DataFrame, tag: str, smoothing: int = 1000) -> DataFrame:
    """tag, n and share: (n + 1) over all counts plus smoothing."""
    counts = rows.groupBy(tag).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(tag, "n", ((F.col("n") + 1) / (F.col("total") + smoothing)).alias("share"))


def tag_scores(hits: DataFrame, tag: str, prior: DataFrame, top: int = 3, smoothing: int = 1000, floor: int | None = None) -> DataFrame:
    """The top tags of hits by how much commoner they are there than in prior (tag, share). floor: least score (as of queries); without it tags of score 0 go."""
    counts = hits.groupBy(tag).agg(F.count("*").alias("n"))
    joined = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).join(prior.select(tag, "share"), tag, "left")
    raw = 0.1 * (F.col("n") + 1) / (F.col("total") + smoothing) / F.greatest(F.lit(1e-6), F.coalesce("share", F.lit(0.0001)))
    scored = joined.select(tag, F.bround(raw * 10).cast("long").alias("tag_score")).orderBy(F.desc("tag_score"), tag).limit(top)
    return scored.filter("tag_score > 0") if floor is None else scored.withColumn("tag_score", F.greatest("tag_score", F.lit(floor).cast("long")))


def result_analysis(hits: DataFrame, least: float, fields: Sequence[str]) -> DataFrame:
    """One row: count, mean, max and min score, how many reach least, and each field's share of rows that have it. Of no hits all but the counts are null."""
    return hits.agg(
        F.count("*").alias("total"),
        F.avg("score").alias("avg_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        F.count_if(F.col("score") >= least).alias("above"),
        *[F.avg(F.col(f).isNotNull().cast("double")).alias(f"coverage_{f}") for f in fields],
    )


def prerequisite_hits(results: DataFrame, docs: DataFrame, k: int = 2, key: str = "doc_id") -> DataFrame:
    """key, found and rank: for each result the first k documents, by key, that have a topic among its prerequisites.

    results: key and prerequisites; docs: key and topics. Only the first k documents of a topic can be among those, so no more meet the results.
    """
    have = docs.select(F.col(key).alias("found"), F.explode(F.array_distinct("topics")).alias("topic"))
    first = have.withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy("found"))).filter(F.col("n") <= k)
    wanted = results.select(key, F.explode(F.array_distinct("prerequisites")).alias("topic"))
    met = wanted.join(first, "topic").select(key, "found").distinct()
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("found"))).filter(F.col("rank") <= k)


def with_defaults(hits: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    return hits.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})
