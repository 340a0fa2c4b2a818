"""Search requests as expressions: leaves that score rows, fusions of them, and filters, compiled to one plan.

A leaf scores rows of a table: Text by weighted words and neighbouring words in boosted fields, Words by how often words
occur, Dense by a vector, Sparse by a map of weights. A Fusion joins its parts' scores by key. A Where restricts what lies
below it: it is pushed under every leaf, so rows that it drops are neither scored nor ranked. compile() gives key and score;
search() adds order, page and fields, and a second, relaxed expression for searches without hits.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vector as V

from . import search as S

#: What a search without hits asks for instead: a smaller share of words, and this similarity.
RELAXED_MATCH, RELAXED_SIMILARITY = 0.1, 0.17


class Match:
    """A node of an expression."""


@dataclass(frozen=True)
class Text(Match):
    """Words' weights, and twice the larger weight for neighbouring words that stand together in a field; each times the largest boost of a field with it.

    At least min_match of the words (and one) must occur in some field. top: only so many of the best rows.
    """

    query: str
    fields: Mapping[str, float] = field(default_factory=lambda: {"text": 1.0})
    min_match: float = 0.3
    top: int | None = None


@dataclass(frozen=True)
class Words(Match):
    """Occurrences of the words of the query in a field, over their number."""

    query: str
    field: str = "text"
    top: int | None = None


@dataclass(frozen=True)
class Dense(Match):
    """Similarity of a vector column; at least similarity, if given."""

    vector: Sequence[float]
    field: str = "embedding"
    metric: str = "cosine"
    similarity: float | None = None
    top: int | None = 10


@dataclass(frozen=True)
class Sparse(Match):
    """Dot product with a map column; rows of score 0 are no hits."""

    weights: Mapping[Any, float]
    field: str = "features"
    top: int | None = 10


@dataclass(frozen=True)
class Where(Match):
    """part, of the rows that the filters (as search.where takes them) keep."""

    filters: Mapping[str, Any]
    part: Match


@dataclass(frozen=True)
class Fusion(Match):
    """The parts' scores as one, of rows that any of them has found; a part that has not found a row counts 0.

    how: weighted_sum; max (of the weighted scores); or ranks, the weighted sum of 1 / (60 + rank), for which parts need a top.
    """

    parts: Sequence[Match]
    weights: Sequence[float] = ()
    how: str = "weighted_sum"
    top: int | None = None


#: Added to ranks before they are inverted.
RANK_ROOM = 60


def compile(expression: Match, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and score of the rows that the expression finds."""
    match expression:
        case Where(filters, part):
            return compile(part, rows.filter(S.where(filters)), key)
        case Fusion():
            return _fused(expression, rows, key)
        case Text():
            found = _text(expression, rows, key)
        case Words(query, name):
            terms = S.query_words(query)
            counted = S._counted(rows.select(key, name), terms, name)
            found = counted.select(key, (F.aggregate("tf", F.lit(0), lambda a, x: a + x) / float(len(terms))).alias("score")).filter("score > 0")
        case Dense(vector, name, metric, similarity):
            value = V.similarity(F.col(name), V.literal(vector), metric)
            scored = rows.filter(F.size(name) == len(vector)).select(key, (-value if metric in ("euclidean", "manhattan") else value).alias("score")).filter("score IS NOT NULL")
            found = scored if similarity is None else scored.filter(F.col("score") >= similarity)
        case Sparse(weights, name):
            wanted = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
            found = rows.filter(F.col(name).isNotNull()).select(key, S.sparse_dot(wanted, F.col(name)).alias("score")).filter("score != 0")
        case _:
            raise ValueError(f"not an expression: {expression!r}")
    return found if expression.top is None else S.top(found, expression.top, key=key)


def _text(e: Text, rows: DataFrame, key: str) -> DataFrame:
    if not e.fields:
        raise ValueError("a text match needs fields")
    terms = list(dict.fromkeys(S.query_words(e.query)))
    weight = {t: 1.5 * math.log(len(t) + 1) for t in terms}
    split = rows.select(key, *e.fields)
    for i, name in enumerate(e.fields):
        split = S.once(split, f"_w{i}", T.words(F.coalesce(F.col(name), F.lit("")))).withColumn(f"_j{i}", F.concat(F.lit(" "), F.array_join(f"_w{i}", " "), F.lit(" ")))
    boosts = list(e.fields.values())

    def best(holds: Sequence[Column]) -> Column:
        """The largest boost of the fields that hold something, 0 if none does."""
        found = [F.when(h, F.lit(float(b))).otherwise(0.0) for h, b in zip(holds, boosts, strict=True)]
        return found[0] if len(found) == 1 else F.greatest(*found)

    own = {t: [F.array_contains(f"_w{i}", t) for i in range(len(boosts))] for t in terms}
    together = [(a, b, [F.col(f"_j{i}").contains(f" {a} {b} ") for i in range(len(boosts))]) for a, b in zip(terms, terms[1:])]
    score = reduce(lambda x, y: x + y, [weight[t] * best(own[t]) for t in terms] + [2 * max(weight[a], weight[b]) * best(h) for a, b, h in together])
    matched = reduce(lambda x, y: x + y, [reduce(lambda x, y: x | y, own[t]).cast("int") for t in terms])
    return split.select(key, score.alias("score"), matched.alias("_n")).filter(F.col("_n") >= max(1, int(e.min_match * len(terms)))).drop("_n")


def _fused(e: Fusion, rows: DataFrame, key: str) -> DataFrame:
    weights = list(e.weights) or [1.0] * len(e.parts)
    if not e.parts or len(weights) != len(e.parts):
        raise ValueError("a fusion needs parts, and a weight for each")
    if e.how not in ("weighted_sum", "max", "ranks"):
        raise ValueError(f"unknown fusion: {e.how}")
    each = []
    for part, w in zip(e.parts, weights, strict=True):
        found = compile(part, rows, key)
        if e.how == "ranks":
            if getattr(part, "top", None) is None:
                raise ValueError("ranks are fused of parts with a top")
            # One list of no more than top rows, numbered in its order.
            found = found.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), key))).alias("l")).select(F.posexplode("l").alias("i", "x"))
            found = found.select(F.col(f"x.{key}").alias(key), (1.0 / (RANK_ROOM + 1 + F.col("i"))).alias("score"))
        each.append(found.select(key, (F.col("score") * F.lit(float(w))).alias("score")))
    # The parts as rows of one table: a key's scores meet in one aggregation, however many parts there are.
    total = F.max("score") if e.how == "max" else F.sum("score")
    out = reduce(DataFrame.unionByName, each).groupBy(key).agg(total.alias("score"))
    return out if e.top is None else S.top(out, e.top, key=key)


def relaxed(expression: Match) -> Match:
    """The expression with fewer words required and another similarity."""
    match expression:
        case Text():
            return replace(expression, min_match=RELAXED_MATCH)
        case Dense(similarity=s) if s is not None:
            return replace(expression, similarity=RELAXED_SIMILARITY)
        case Where():
            return replace(expression, part=relaxed(expression.part))
        case Fusion():
            return replace(expression, parts=[relaxed(p) for p in expression.parts])
    return expression


def search(rows: DataFrame, expression: Match | None, *, key: str = "doc_id", filters: Mapping[str, Any] | None = None, order: Sequence[tuple[str, bool]] = (), page: int = 1, size: int = 10, fields: Sequence[str] = (), relax: bool = True) -> DataFrame:
    """A page of hits: key, score and fields.

    order: pairs of a column and whether it falls, before the falling score and the key. Without an expression all rows are hits
    of score 0. relax: an expression without hits is searched once more, relaxed.
    """
    kept = rows.filter(S.where(filters))
    names = list(dict.fromkeys([*fields, *(n for n, _ in order)]))
    if expression is None:
        hits = kept.select(key, F.lit(0.0).alias("score"), *names)
    else:
        found = compile(expression, kept, key)
        if relax and found.isEmpty():
            found = compile(relaxed(expression), kept, key)
        hits = found if not names else found.join(kept.select(key, *names), key)
    by = [F.desc(n) if falls else F.asc(n) for n, falls in order]
    return S.page(hits, page, size, *by, F.desc("score"), F.asc(key)).select(key, "score", *fields)
