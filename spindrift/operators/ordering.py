"""Numbers of rows in an order over the whole table, and what rests on them, without a window that holds all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed

#: Bits of monotonically_increasing_id that number a partition's rows.
WITHIN = 33


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """df with each row's place in the order, from 0. The order must be total, or equal rows may change places.

    Rows are dealt to ranges, sorted there and stored; the number of rows of each range (one for each partition) reaches the driver.
    """
    stored = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = stored.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", WITHIN)
    before, offsets = 0, []
    for r in at.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((r["p"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, "_p long, _from long")
    joined = at.join(F.broadcast(starts), part == F.col("_p"))
    return joined.withColumn(name, F.col("_from") + F.col("_id").bitwiseAND((1 << WITHIN) - 1)).drop("_id", "_p", "_from")


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the key's md5."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def choices(df: DataFrame, k: int, order: str, seed: int) -> DataFrame:
    """Rows drawn with replacement, with times, how often each was drawn: k draws, or as many as there are rows if they are fewer.

    Each draw takes any row alike. Draws depend on the seed and the rows' order alone, so reruns and other partitionings agree.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    rows = numbered(df, order, name="_number")
    n = rows.count()
    draws = df.sparkSession.range(min(k, n)).select(F.floor(uniform(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))) * n).alias("_number"))
    return rows.join(draws.groupBy("_number").agg(F.count("*").alias("times")), "_number").drop("_number")
