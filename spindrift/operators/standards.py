"""Similarity of standards and what content covers of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T


def map_by_keywords(standards: DataFrame, least: float, known: DataFrame | None = None) -> DataFrame:
    """a, b and similarity: pairs of standards of one subject whose keywords' Jaccard similarity is above least, found by shared keywords.

    standards: standard_id, subject and keywords. known: a, b and similarity of mappings that take precedence.
    """
    x = standards.select("subject", F.col("standard_id").alias("a"), F.size("keywords").alias("m"), F.explode("keywords").alias("k"))
    y = standards.select("subject", F.col("standard_id").alias("b"), F.size("keywords").alias("n"), F.explode("keywords").alias("k"))
    shared = x.join(y, ["subject", "k"]).filter("a < b").groupBy("a", "b", "m", "n").agg(F.count("*").alias("s"))
    found = shared.select("a", "b", (F.col("s") / (F.col("m") + F.col("n") - F.col("s"))).alias("similarity"))
    if known is not None:
        found = found.join(known.withColumnRenamed("similarity", "_known"), ["a", "b"], "left").select("a", "b", F.coalesce("_known", "similarity").alias("similarity"))
    return found.filter(F.col("similarity") > least)


def coverage(standards: DataFrame, standard: str, docs: DataFrame, doc: str, least: float = 0.0) -> DataFrame:
    """standard, doc and coverage: share of the standard's keywords in the document, above least."""
    k = standards.select(standard, F.size("keywords").alias("_n"), F.explode("keywords").alias("_k"))
    w = docs.select(doc, F.explode(F.array_distinct(T.words(F.col("text")))).alias("_k"))
    return w.join(k, "_k").groupBy(standard, doc).agg((F.count("*") / F.first("_n")).alias("coverage")).filter(F.col("coverage") > least)


def tfidf_similarity(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys and similarity: cosine of the two texts' TF-IDF with the two as corpus (smoothed idf; words of two letters or more)."""
    word = F.lit(r"[\p{L}\p{N}_]{2,}")
    u = pairs.select(*keys, F.explode(F.regexp_extract_all(F.lower(x), word, F.lit(0))).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("q"))
    v = pairs.select(*keys, F.explode(F.regexp_extract_all(F.lower(y), word, F.lit(0))).alias("t"), F.lit(0).alias("p"), F.lit(1).alias("q"))
    counts = u.unionByName(v).groupBy(*keys, "t").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    idf = F.log(F.lit(3.0) / (1 + (F.col("p") > 0).cast("int") + (F.col("q") > 0).cast("int"))) + 1
    w = counts.select(*keys, (F.col("p") * idf).alias("p"), (F.col("q") * idf).alias("q"))
    cosine = F.try_divide(F.sum(F.col("p") * F.col("q")), F.sqrt(F.sum(F.col("p") * F.col("p"))) * F.sqrt(F.sum(F.col("q") * F.col("q"))))
    return w.groupBy(*keys).agg(F.coalesce(cosine, F.lit(0.0)).alias("similarity"))


def report(standards: DataFrame) -> DataFrame:
    """level, name and n: standards in all, by type and by subject."""
    g = standards.groupingSets([[F.col("standard_type")], [F.col("subject_area")], []], "standard_type", "subject_area").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "subject").otherwise("total")
    return g.select(level.alias("level"), F.coalesce("standard_type", "subject_area", F.lit("all")).alias("name"), "n")


def grade_gaps(standards: DataFrame, subject: str, grades: str, low: int = 1, high: int = 12) -> DataFrame:
    """subject and grade of grades that no standard of the subject has."""
    wanted = standards.select(subject).distinct().withColumn("grade", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return wanted.join(standards.select(subject, F.explode(F.col(grades).cast("array<int>")).alias("grade")), [subject, "grade"], "left_anti")
