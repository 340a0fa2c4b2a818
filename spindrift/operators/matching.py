"""Matching texts with topics, answers with their sources, and checks across modalities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vector as V


def best_topic(files: DataFrame, topics: DataFrame, least: float = 0.3) -> DataFrame:
    """path, topic and score: the topic whose keywords' Jaccard similarity with the words of the path is largest, if above least; else the parent folder.

    files: path; topics: topic and keywords. Joined by shared words.
    """
    words = files.select("path", F.array_distinct(T.words(F.regexp_replace("path", "[_/.-]", " "))).alias("w"))
    x = words.select("path", F.size("w").alias("m"), F.explode("w").alias("k"))
    y = topics.select("topic", F.size(F.array_distinct("keywords")).alias("n"), F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("k"))
    shared = x.join(y, "k").groupBy("path", "topic", "m", "n").agg(F.count("*").alias("s"))
    scored = shared.select("path", "topic", (F.col("s") / (F.col("m") + F.col("n") - F.col("s"))).alias("score")).filter(F.col("score") > least)
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "topic"))).filter("r = 1").drop("r")
    parent = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    return files.select("path").join(ranked, "path", "left").select("path", F.coalesce("topic", parent).alias("topic"), F.coalesce("score", F.lit(0.0)).alias("score"))


#: Thresholds of citations, tried from the first down (fixed values).
CITATION_LEVELS = (0.63, 0.63 * 0.8, 0.63 * 0.8**2, 0.63 * 0.8**3)


def citations(similarities: DataFrame, most: int = 4) -> DataFrame:
    """piece, chunk and similarity of what each piece of an answer cites.

    The threshold is the first of CITATION_LEVELS that some piece's best chunk (times .99) reaches; a piece whose best does
    reach it cites up to most chunks within a hundredth of its best. similarities: piece, chunk and similarity.
    """
    best = 0.99 * F.max("similarity").over(Window.partitionBy("piece"))
    rows = similarities.withColumn("_best", best)
    top = rows.agg(F.max("_best").alias("_top"))
    level = None
    for t in CITATION_LEVELS:
        level = F.when(F.col("_top") >= t, t) if level is None else level.when(F.col("_top") >= t, t)
    near = rows.crossJoin(F.broadcast(top.withColumn("_level", level))).filter((F.col("_best") >= F.col("_level")) & (F.col("similarity") > F.col("_best")))
    placed = near.withColumn("r", F.row_number().over(Window.partitionBy("piece").orderBy(F.desc("similarity"), "chunk")))
    return placed.filter(F.col("r") <= most).select("piece", "chunk", "similarity")


def consistency(rows: DataFrame, a: str, b: str, other: float = 0.8) -> DataFrame:
    """rows with similarity of two modalities' vectors and confidence: the mean with another check's score, at most 1."""
    return rows.withColumn("similarity", V.cosine(F.col(a), F.col(b))).withColumn("confidence", F.least(F.lit(1.0), (F.col("similarity") + other) / 2))


def path_metadata(path: Column, subjects: Sequence[str], levels: Mapping[str, str]) -> Column:
    """Struct of subject (the first part of a path that is known) and level (of the first part that matches a pattern)."""
    parts = F.transform(F.split(path, "/"), F.lower)
    subject = F.get(F.filter(parts, lambda p: p.isin(*[s.lower() for s in subjects])), 0)
    return F.struct(subject.alias("subject"), T.first_match(F.lower(path), levels, "unknown").alias("level"))


def without_contents(lines: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """Lines without a table of contents: from a line that says so to the next line that starts as the table's first entry does."""
    w = Window.partitionBy(key).orderBy(order)
    marked = lines.withColumn("_toc", F.trim(F.lower(line)).rlike(r"^(contents|table of contents|acknowledge(ments?)?)$"))
    marked = marked.withColumn("_entry", F.when(F.col("_toc"), F.substring(F.lead(line).over(w), 1, 3))).withColumn("_at", F.when(F.col("_toc"), F.col(order)))
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({"_entry": F.last("_entry", ignorenulls=True).over(up), "_at": F.last("_at", ignorenulls=True).over(up)})
    again = (F.col(order) > F.col("_at") + 1) & (F.substring(line, 1, 3) == F.col("_entry"))
    body = F.max(again.cast("int")).over(up)
    return marked.withColumn("_body", F.coalesce(body, F.lit(0))).filter(F.col("_at").isNull() | (F.col("_body") == 1)).drop("_toc", "_entry", "_at", "_body")


def colon_titles(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with title: what stands before a colon at the line's end, after the last sentence mark."""
    return lines.withColumn("title", F.when(F.trim(line).rlike("[:：]$"), F.trim(F.regexp_extract(F.trim(line), r"([^.!?。！？;；]+)[:：]$", 1))))


def bullet_style(lines: DataFrame, styles: Mapping[str, str], key: str = "doc_id", line: str = "line") -> DataFrame:
    """key and style: the pattern that most lines match, the first of equals; none if no line matches any."""
    counts = lines.groupBy(key).agg(*[F.count_if(F.col(line).rlike(p)).alias(f"_{i}") for i, p in enumerate(styles.values())])
    most = F.greatest(*[F.col(f"_{i}") for i in range(len(styles))])
    out = F.when(most == 0, F.lit(None))
    for i, name in enumerate(styles):
        out = out.when(F.col(f"_{i}") == most, name)
    return counts.select(key, out.alias("style"))
