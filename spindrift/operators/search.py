"""Retrieval: keyword, BM25, vector and hybrid search, fusion and filters.

All rankings end with the key, so ties have one order. Queries and query vectors are parameters of the
plan; a search reads the corpus once and keeps k rows of each task before anything is exchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vector as V

OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "any": lambda c, v: F.arrays_overlap(c, F.array(*map(F.lit, v))),
}


def where(filters: Mapping[str, Any] | None) -> Column:
    """All of: column equals value, is in a list of values, or (operator, value)."""
    conditions = []
    for name, value in (filters or {}).items():
        if isinstance(value, tuple):
            conditions.append(OPERATORS[value[0]](F.col(name), value[1]))
        else:
            conditions.append(OPERATORS["in" if isinstance(value, list) else "eq"](F.col(name), value))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


RENAMED = {"kb_ids": "kb_id", "doc_ids": "doc_id"}


def request_filters(request: Mapping[str, Any], fields: Sequence[str] = ("kb_ids", "doc_ids", "knowledge_graph_kwd", "available_int", "entity_kwd", "from_entity_kwd", "to_entity_kwd")) -> dict[str, Any]:
    """Filters that a search request states."""
    return {RENAMED.get(k, k): request[k] for k in fields if request.get(k) not in (None, [], "")}


def top(df: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    if k < 1:
        raise ValueError("k must be positive")
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def check_weights(semantic: float, keyword: float) -> None:
    if not (0 <= semantic <= 1 and 0 <= keyword <= 1) or abs(semantic + keyword - 1) > 1e-6:
        raise ValueError("weights must lie in [0, 1] and sum to 1")


# --- vectors

def vector_search(vectors: DataFrame, query: Sequence[float], k: int, *, metric: str = "cosine", filters: Mapping[str, Any] | None = None, threshold: float | None = None, strict: bool = False, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, score of the k most similar vectors. Filters come first; threshold is at least, or above if strict."""
    if threshold is not None and not -1 <= threshold <= 1:
        raise ValueError("threshold must lie in [-1, 1]")
    value = V.similarity(F.col(vector), V.literal(query), metric)
    scored = vectors.filter(where(filters)).withColumn("score", -value if metric in ("euclidean", "manhattan") else value).filter("score IS NOT NULL")
    if threshold is not None:
        scored = scored.filter(F.col("score") > threshold if strict else F.col("score") >= threshold)
    return top(scored, k, key=key)


def semantic_search(vectors: DataFrame, query: Sequence[float], k: int, *, threshold: float = 0.0, filters: Mapping[str, Any] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, key: str = "vec_id") -> DataFrame:
    """Dot product of at least threshold; rerank may reorder the k hits."""
    hits = vector_search(vectors, query, k, metric="dot", threshold=threshold, filters=filters, key=key)
    return rerank(hits) if rerank else hits


def batch_search(vectors: DataFrame, queries: Sequence[tuple[Any, Sequence[float]]], k: int, *, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, key, score and rank: the k most similar vectors of each query, by cosine.

    Each Arrow batch is one matrix product with the queries, of which at most k rows a query leave the task's
    batch; so what is exchanged does not grow with the number of vectors times queries.
    """
    ids = [int(q) for q, _ in queries]
    matrix = np.array([v for _, v in queries], float)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    sent = vectors.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                some = batch.slice(start, block)
                lists = some.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                good = np.flatnonzero(sizes == sent.value.shape[1])
                if not len(good):
                    continue
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
                at = np.cumsum(sizes) - sizes
                x = values[at[good][:, None] + np.arange(sent.value.shape[1])]
                norms = np.linalg.norm(x, axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = (x @ sent.value.T) / norms[:, None]
                keys = some.column(0).to_numpy(zero_copy_only=False)[good]
                fine = np.flatnonzero(norms > 0)
                scores, keys = scores[fine], keys[fine]
                n = min(k, len(keys))
                if not n:
                    continue
                least = -np.partition(-scores, n - 1, axis=0)[n - 1]
                found = []
                for j in range(len(ids)):
                    near = np.flatnonzero(scores[:, j] >= least[j])
                    found.append(near[np.lexsort((keys[near], -scores[near, j]))[:n]])
                best, of = np.concatenate(found), np.repeat(np.arange(len(ids)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[of]), pa.array(keys[best]), pa.array(scores[best, of])], names=["query_id", key, "score"])

    kind = vectors.schema[key].dataType.simpleString()
    near = vectors.select(key, vector).mapInArrow(run, f"query_id long, {key} {kind}, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked.filter(F.col("rank") <= k)


# --- words

def query_words(query: str) -> list[str]:
    import re

    found = re.findall(r"\w+", query.lower())
    if not found:
        raise ValueError("empty query")
    return found


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a generator, unlike a projection, is not copied into each use and filter of it."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def occurrences(text: Column, terms: Sequence[str]) -> Column:
    """The words of a text that are among terms, in order; other words are not listed."""
    sign = T.WORD.removesuffix("+")
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?<!{sign})(?:{'|'.join(dict.fromkeys(terms))})(?!{sign})"), F.lit(0))


def _counted(docs: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """docs with columns n_words and tf (count of each term). A null text has no words."""
    docs = docs.withColumn(text, F.coalesce(text, F.lit("")))
    counted = once(docs, "_found", occurrences(F.col(text), terms))
    # array_remove is one pass over the words, without a lambda.
    tf = F.array(*[F.size("_found") - F.size(F.array_remove("_found", t)) for t in terms])
    return counted.withColumns({"n_words": F.regexp_count(F.lower(text), F.lit(T.WORD)), "tf": tf}).drop("_found")


def keyword_search(docs: DataFrame, query: str, k: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """score is how often the query's words occur (repeated words count again) over their number; exact_match: the query stands in the text."""
    terms = query_words(query)
    # A text without any term is dropped before it is split into words.
    some = docs.filter(reduce(lambda a, b: a | b, [F.lower(text).contains(t) for t in set(terms)]))
    scored = _counted(some, terms, text).withColumn("score", F.aggregate("tf", F.lit(0), lambda a, x: a + x) / float(len(terms)))
    return top(scored.filter("score > 0").withColumn("exact_match", F.lower(text).contains(query.lower())), k, key=key)


def inverted_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key and tf: one row for each term of each document."""
    return docs.select(key, F.explode(T.words(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def index_search(index: DataFrame, query: str, k: int, key: str = "doc_id") -> DataFrame:
    """keyword_search's scores from an inverted index that is stored by term."""
    terms = query_words(query)
    weights = {t: terms.count(t) for t in terms}
    times = F.element_at(F.create_map(*[F.lit(x) for t, n in weights.items() for x in (t, n)]), F.col("term"))
    return top(index.filter(F.col("term").isin(*weights)).groupBy(key).agg((F.sum(F.col("tf") * times) / float(len(terms))).alias("score")), k, key=key)


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(F.array_distinct(T.words(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, query: str, *, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and bm25 of every document. An idf below 0 becomes epsilon times the corpus's mean idf."""
    terms = query_words(query)
    counted = _counted(docs, terms, text).select(key, "n_words", "tf")
    n_df = [F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    sums = counted.agg(F.count("*").alias("n"), F.avg("n_words").alias("mean_words"), *n_df)
    freq = document_frequencies(docs, text).crossJoin(F.broadcast(docs.agg(F.count("*").alias("total"))))
    mean_idf = freq.agg(F.avg(F.log(F.col("total") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("mean_idf"))
    # One row of statistics.
    joined = counted.crossJoin(F.broadcast(sums.crossJoin(mean_idf)))
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = F.col(f"df{i}"), F.col("tf")[i]
        idf = F.log(F.col("n") - df + 0.5) - F.log(df + 0.5)
        idf = F.when(df == 0, 0.0).when(idf < 0, epsilon * F.col("mean_idf")).otherwise(idf)
        score = score + idf * F.try_divide(tf * (k1 + 1), tf + k1 * (1 - b + b * F.col("n_words") / F.col("mean_words")))
    return joined.select(key, score.alias("bm25"))


# --- both

def combine(semantic: DataFrame, keyword: DataFrame, semantic_weight: float, keyword_weight: float, boost: float = 1.0, key: str = "doc_id") -> DataFrame:
    """Full outer join of key, score (and exact_match) by weighted sum; a keyword hit with an exact match counts boost times."""
    s = semantic.select(key, F.col("score").alias("semantic_score"))
    w = keyword.select(key, F.col("score").alias("keyword_score"), F.when(F.col("exact_match"), boost).otherwise(1.0).alias("boost"))
    joined = s.join(w, key, "full_outer").fillna({"semantic_score": 0.0, "keyword_score": 0.0, "boost": 1.0})
    return joined.withColumn("score", F.col("boost") * (semantic_weight * F.col("semantic_score") + keyword_weight * F.col("keyword_score")))


def hybrid_search(docs: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float], k: int, *, semantic_weight: float = 0.7, keyword_weight: float = 0.3, boost: float = 1.0, filters: Mapping[str, Any] | None = None, post_filter: bool = True, explain: bool = False) -> DataFrame:
    """The k best of the semantic and the keyword search's k best. Filters come after both, or before both if not post_filter.

    docs: doc_id and text; vectors: vec_id (the doc_id) and embedding.
    """
    check_weights(semantic_weight, keyword_weight)
    source = docs if post_filter else docs.filter(where(filters))
    own = vectors.withColumnRenamed("vec_id", "doc_id")
    own = own.join(source.select("doc_id"), "doc_id", "left_semi") if not post_filter else own
    semantic = vector_search(own, vector, k, metric="dot", key="doc_id").select("doc_id", "score")
    keyword = keyword_search(source, query, k).select("doc_id", "score", "exact_match")
    # At most 2 k rows meet the documents' fields.
    combined = combine(semantic, keyword, semantic_weight, keyword_weight, boost)
    if post_filter and filters:
        names = [c for c in docs.columns if c == "doc_id" or c in filters]
        combined = docs.select(names).join(F.broadcast(combined), "doc_id").filter(where(filters))
    hits = top(combined, k).select("doc_id", "semantic_score", "keyword_score", "score")
    if explain:
        hits = hits.withColumn("explanation", F.struct("semantic_score", "keyword_score", F.lit(semantic_weight).alias("semantic_weight"), F.lit(keyword_weight).alias("keyword_weight")))
    return hits


def fuse_queries(results: Sequence[DataFrame], k: int, method: str = "max", key: str = "doc_id") -> DataFrame:
    """One ranking of several queries' hits: each document by its max, mean or sum of scores."""
    how = {"max": F.max, "mean": F.avg, "sum": F.sum}[method]
    both = reduce(DataFrame.unionByName, [r.select(key, "score") for r in results])
    return top(both.groupBy(key).agg(how("score").alias("score")), k, key=key)


def merge_ranked(lists: Sequence[tuple[str, float, DataFrame]], k: int, key: str = "doc_id") -> DataFrame:
    """Lists of (name, weight, hits) in order: a document counts once, from the first list that has it, times that list's weight."""
    each = [d.select(key, (F.col("score") * w).alias("score"), F.lit(name).alias("source"), F.lit(i).alias("_order")) for i, (name, w, d) in enumerate(lists)]
    first = reduce(DataFrame.unionByName, each).groupBy(key).agg(F.min_by(F.struct("score", "source"), "_order").alias("first"))
    return top(first.select(key, "first.score", "first.source"), k, key=key)


def bm25_vector(docs: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float], k: int, weight: float = 0.7) -> DataFrame:
    """weight times the dot product plus the rest times BM25, for documents that have a vector."""
    dots = vectors.select(F.col("vec_id").alias("doc_id"), V.dot(F.col("embedding"), V.literal(vector)).alias("vector_score"))
    joined = bm25(docs, query).join(dots, "doc_id")
    return top(joined.withColumn("score", weight * F.col("vector_score") + (1 - weight) * F.col("bm25")), k)


def token_similarity(docs: DataFrame, query: Mapping[str, float], text: str = "text") -> DataFrame:
    """docs with token_score: of the query words' weights, what the text's words share (a word's weight there by token_weight)."""
    total = sum(query.values())
    if total <= 0:
        raise ValueError("the query has no weight")
    own = F.array_distinct(T.words(F.col(text)))
    counted = docs.withColumn("_words", own)
    shared = reduce(lambda a, b: a + b, [F.when(F.array_contains("_words", t), F.least(F.lit(float(w)), T.token_weight(F.lit(t)))).otherwise(0.0) for t, w in query.items()])
    return counted.withColumn("token_score", shared / total).drop("_words")


def full_text(docs: DataFrame, query: str, min_match: float = 0.3, text: str = "text") -> DataFrame:
    """doc_id and score: words' weights plus twice the larger weight for neighbouring words that stand together; at least min_match of the words must occur."""
    import math

    terms = list(dict.fromkeys(query_words(query)))
    weight = {t: 1.5 * math.log(len(t) + 1) for t in terms}
    words = once(docs, "_words", T.words(F.col(text))).withColumn("_joined", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
    hit = [F.array_contains("_words", t).cast("int") for t in terms]
    pairs = [(a, b) for a, b in zip(terms, terms[1:])]
    phrase = [F.when(F.col("_joined").contains(f" {a} {b} "), 2 * max(weight[a], weight[b])).otherwise(0.0) for a, b in pairs]
    score = reduce(lambda a, b: a + b, [h * F.lit(weight[t]) for h, t in zip(hit, terms, strict=True)] + phrase)
    matched = reduce(lambda a, b: a + b, hit)
    return words.withColumns({"matched": matched, "score": score}).filter(F.col("matched") >= max(1, int(min_match * len(terms)))).drop("_words", "_joined")


def relaxed(docs: DataFrame, query: str, min_match: float = 0.3, relaxed_match: float = 0.1) -> DataFrame:
    """full_text; if nothing matches, once more with fewer words required."""
    found = full_text(docs, query, min_match)
    return full_text(docs, query, relaxed_match) if found.isEmpty() else found


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two maps from place to value."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda total, e: total + e["value"] * F.coalesce(F.element_at(b, e["key"]), F.lit(0.0)))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page number (from 1) of an order."""
    if number < 1 or size < 1:
        raise ValueError("pages start at 1 and have rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def has_next(total: int, number: int, size: int) -> bool:
    return total > number * size
