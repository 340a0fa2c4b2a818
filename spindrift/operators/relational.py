"""Relational extras: as-of and range joins, and joins of skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, *values: str) -> DataFrame:
    """left with the values of the right row of the same key that is last at or before its time: one sort of the union."""
    marked = left.withColumns({v: F.lit(None).cast(right.schema[v].dataType) for v in values}).withColumn("_left", F.lit(True)).withColumn("_row", F.struct(*left.columns))
    other = right.select(key, ts, *values).withColumn("_left", F.lit(False)).withColumn("_row", F.lit(None).cast(marked.schema["_row"].dataType))
    both = marked.select(key, ts, *values, "_left", "_row").unionByName(other.select(key, ts, *values, "_left", "_row"))
    # At equal times the right row comes first.
    w = Window.partitionBy(key).orderBy(ts, "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(~F.col("_left"), F.struct(*values)), ignorenulls=True).over(w)
    return both.withColumn("_found", last).filter("_left").select("_row.*", *[F.col("_found")[v].alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of points within [low, high] of ranges, joined by bins of a width; a range has as many copies as it touches bins."""
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "_bin").filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_bin")


def salted_join(large: DataFrame, small: DataFrame, key: str, parts: int, spread: Column) -> DataFrame:
    """Equi-join in which each key's rows of large are dealt over parts by a column, and small is repeated as often."""
    l = large.withColumn("_salt", F.pmod(F.hash(spread), F.lit(parts)))  # noqa: E741
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # Spark's estimate of s leaves out its copies; a merge join does not hold them in memory.
    return l.join(s.hint("merge"), [key, "_salt"]).drop("_salt")
