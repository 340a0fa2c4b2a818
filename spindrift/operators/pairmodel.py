"""A model that reads a query and a text together: fitted on pairs, applied to hits of many queries at once.

What it sees of a pair is how the query's words stand in the text: which share of them and of their neighbouring pairs occurs, how
early the first one stands, and how dense they are. All of that is Spark expressions, so scoring stays in the plan; the weights are fitted by
Spark's logistic regression and are plain numbers that can be kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T

from .lineage import checkpointed

#: What the model sees of a pair, in the order of its weights.
SEEN = ("share", "neighbours", "early", "density")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is made once a row however often use names it, also within inner functions."""
    return F.transform(F.array(value), use)[0]


def seen(query: Column, text: Column) -> dict[str, Column]:
    """The numbers of SEEN, each from 0 to 1, of a query's and a text's words (arrays; null: none)."""
    numbers = seen_at_once(query, text)
    return {name: numbers[name] for name in SEEN}


def seen_at_once(query: Column, text: Column) -> Column:
    """A struct of the numbers of SEEN, each from 0 to 1, of a query's and a text's words (arrays; null: none)."""
    none = F.array().cast("array<string>")
    given = F.struct(F.coalesce(query, none).alias("q"), F.coalesce(text, none).alias("w"))
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    def placed(g: Column) -> Column:
        distinct = F.array_distinct(g["q"])
        places = F.filter(F.transform(distinct, lambda x: F.array_position(g["w"], x)), lambda p: p > 0)
        joined = F.concat(F.lit(" "), F.array_join(g["w"], " "), F.lit(" "))
        return F.struct(g["q"].alias("q"), g["w"].alias("w"), F.size(distinct).alias("n"), places.alias("places"), joined.alias("joined"))

    def numbers(g: Column) -> Column:
        q = g["q"]
        pairs = F.transform(F.sequence(F.lit(1), F.size(q) - 1), lambda i: F.concat(F.lit(" "), F.element_at(q, i), F.lit(" "), F.element_at(q, i + 1), F.lit(" ")))
        together = F.size(F.filter(pairs, lambda p: F.contains(g["joined"], p)))
        return F.struct(
            share(F.size(g["places"]), g["n"]).alias("share"),
            F.when(F.size(q) > 1, together / (F.size(q) - 1)).otherwise(0.0).alias("neighbours"),
            F.coalesce(1 / F.array_min(g["places"]), F.lit(0.0)).alias("early"),
            share(F.size(F.filter(g["w"], lambda x: F.array_contains(q, x))), F.size(g["w"])).alias("density"),
        )

    return _bound(_bound(given, placed), numbers)


@dataclass(frozen=True)
class PairModel:
    weights: tuple[float, ...]
    bias: float

    def __call__(self, query: Column, text: Column) -> Column:
        """Score from 0 to 1 of a query and a text, as rerank.by_model takes it."""

        def score(numbers: Column) -> Column:
            total = F.lit(self.bias)
            for name, weight in zip(SEEN, self.weights, strict=True):
                total = total + weight * numbers[name]
            return 1 / (1 + F.exp(-total))

        return _bound(seen_at_once(T.words(query), T.words(text)), score)


def fit(pairs: DataFrame, ridge: float = 1e-3) -> PairModel:
    """The model of labelled pairs: query and text (strings) and label (0 or 1). Without pairs of both labels every score is a half."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = pairs.filter("label IS NOT NULL").select(F.col("label").cast("double").alias("label"), seen_at_once(T.words(F.col("query")), T.words(F.col("text"))).alias("n"))
    rows = checkpointed(rows.select("label", *(F.col(f"n.{n}").cast("double").alias(n) for n in SEEN)))
    if rows.select("label").distinct().count() < 2:
        return PairModel((0.0,) * len(SEEN), 0.0)
    given = VectorAssembler(inputCols=list(SEEN), outputCol="features").transform(rows)
    fitted = LogisticRegression(regParam=ridge, maxIter=100, tol=1e-9).fit(given)
    return PairModel(tuple(float(x) for x in fitted.coefficients), float(fitted.intercept))


def own_pairs(docs: DataFrame, key: str, text: str, n: int = 6, per: int = 1, of: int = 1) -> DataFrame:
    """Training pairs without labels from people: query, text and label.

    The query is n neighbouring words of a text, from a place that the key picks, taken out of it every other time by half; the text is its own
    (label 1) or that of the document before in the order of hashed keys within a bucket (label 0). per of of documents take part.
    """
    w = T.words(F.col(text))
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    rows = docs.filter(F.pmod(F.xxhash64(key, F.lit("pairs")), F.lit(of)) < per).select(F.col(key).alias("_k"), F.col(text).alias("text"), w.alias("w"), h.alias("h")).filter(F.size("w") >= 2 * n)
    at = F.pmod(F.col("h"), F.size("w") - n + 1).cast("int") + 1
    # Half of the queries keep only every other word, so that neighbours are no sure sign.
    words = F.slice("w", at, F.lit(n))
    words = F.when(F.col("h") % 2 == 0, words).otherwise(F.filter(words, lambda x, i: i % 2 == 0))
    # Each query meets one other text, found by the next smaller hash in one of many buckets.
    turn = Window.partitionBy((F.col("h") % 1024).alias("b")).orderBy("h", "_k")
    rows = rows.select(F.array_join(words, " ").alias("query"), "text", F.lag("text").over(turn).alias("other"))
    return rows.select("query", F.explode(F.array(F.struct("text", F.lit(1).alias("label")), F.struct(F.col("other").alias("text"), F.lit(0).alias("label")))).alias("p")).select("query", "p.text", "p.label").filter("text IS NOT NULL")


def reranked(hits: DataFrame, queries: DataFrame, docs: DataFrame, model: PairModel, *, query: str = "query_id", key: str = "doc_id", text: str = "text", k: int | None = None) -> DataFrame:
    """hits (query, key and other columns) with model_score in place of score, and rank in it, of many queries at once; k: at most so many a query.

    queries: query and words (a string). Hits meet their query and their text by joins on their keys; texts are only read for documents that are hits.
    """
    texts = docs.select(F.col(key), F.col(text).alias("_text"))
    scored = hits.join(queries.select(query, F.col("words").alias("_words")), query).join(texts, key).withColumn("score", model(F.col("_words"), F.col("_text"))).drop("_words", "_text")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key)))
    return ranked.filter(F.col("rank") <= k) if k else ranked
