"""Mixes sources to target weights by Pareto order sampling.

Every document of a source has an expected number of copies r = min(2, c * a), where a falls
slowly with the document's size class and c brings the expected words of the source to its
target. floor(r) copies are certain. The fraction p = r - floor(r) is drawn: documents rank by
the odds of a uniform number over the odds of p (Pareto order sampling), and the source takes
them in that order until its words are reached. The uniform number is a digest of the id, so
reruns agree.

No step needs the rows of a source in one task: the cut in a source's ranking is found in a
histogram of the ranks (BINS rows a source, summed before the shuffle), and only the documents
of the one bin that holds the cut are ordered.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own
and comes last; equal ids draw equal numbers and are told apart by size only, so exactly equal
rows are interchangeable; a null id draws as the empty text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import checkpoint, table, word_count

#: Of all words, the share that the mix holds; copies of a source at most; weights by source in code-point order.
SHARE, MOST_COPIES, WEIGHTS = 1.5, 2, (3, 1, 2)
#: a = 2 ** (-DAMPING * size class): longer documents are drawn a little less often.
DAMPING = 0.0625
#: Bins of the ranking's histogram. A bin of a source of n documents holds about n / BINS.
BINS = 16384


def water_level(items: DataFrame, by: list[str], total: Column) -> DataFrame:
    """Adds column level: sum over a group of least(cap, level * weight) is total.

    items has columns cap and weight above 0, and few rows (one for each source, or for each
    source and size class). Where the caps hold everything the level is null.
    """
    if not by:
        items = items.withColumn("_all", F.lit(0))
    ordered = Window.partitionBy(*(by or ["_all"])).orderBy((F.col("cap") / F.col("weight")), "cap")
    below = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    at = (total - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("weight").over(rest)
    fits = F.when(F.col("_at") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(ordered).alias("n"), F.col("_at").alias("at")))
    everything = Window.partitionBy(*(by or ["_all"]))
    out = items.withColumn("_at", at).withColumn("_fits", fits).withColumn("level", F.min("_fits").over(everything)["at"])
    return out.drop("_at", "_fits", "_all")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target, from rows of source and source_size."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("weight", weight).withColumn("_sum", F.sum("source_size").over(Window.partitionBy()))
    leveled = water_level(ranked.withColumn("cap", MOST_COPIES * F.col("source_size")), [], SHARE * F.col("_sum"))
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double"))
    return leveled.select("source", "source_size", target.alias("target"))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the key's md5."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return (digits.cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def _size_class(size: Column) -> Column:
    return F.length(F.bin(size))


def copies(sizes: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """From rows of doc_id, source and size: the same rows with source_size, target and n_copies.

    sizes must be cheap to read again (a checkpoint). rows: the same rows with further columns, tie among them (which orders rows of
    equal doc_id and size), to be returned instead; of them only those at a source's cut are shuffled.
    """
    spark = sizes.sparkSession
    classes = sizes.groupBy("source", _size_class(F.col("size")).alias("size_class")).agg(F.sum("size").alias("class_size"))
    classes = checkpoint(classes)
    targets = source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")))
    affinity = F.pow(F.lit(2.0), -DAMPING * F.col("size_class"))
    rated = (
        classes.filter("class_size > 0")
        .join(targets, classes["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumns({"cap": (MOST_COPIES * F.col("class_size")).cast("double"), "weight": F.col("class_size") * affinity})
    )
    rated = water_level(rated, ["source"], F.col("target"))
    rate = F.coalesce(F.least(F.lit(float(MOST_COPIES)), F.col("level") * affinity), F.lit(float(MOST_COPIES)))
    rated = rated.withColumn("_rate", F.round(rate, 9)).select(
        F.col("source").alias("_s"), F.col("size_class").alias("_c"), F.floor("_rate").alias("_whole"), (F.col("_rate") - F.floor("_rate")).alias("_p")
    )
    rated, targets = checkpoint(rated), checkpoint(targets.withColumnRenamed("source", "_t"))

    def small(df: DataFrame) -> DataFrame:
        """Broadcast if it is small (a row for each source and class); else joined by a shuffle."""
        return F.broadcast(df) if df.count() <= 50_000 else df

    rated = small(rated)

    def ranked(df: DataFrame) -> DataFrame:
        drawn = df.withColumn("_c", _size_class(F.col("size"))).alias("d")
        drawn = drawn.join(rated.alias("r"), F.col("d.source").eqNullSafe(F.col("_s")) & (F.col("d._c") == F.col("r._c")), "left")
        drawn = drawn.select("d.*", F.coalesce("_whole", F.lit(0)).alias("_whole"), F.coalesce("_p", F.lit(0.0)).alias("_p")).drop("_c")
        u = uniform(F.col("doc_id"))
        odds = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
        return drawn.withColumn("_rank", F.when(F.col("_p") > 0, odds / (1 + odds))).withColumn("_bin", F.floor(F.col("_rank") * BINS).cast("int"))

    drawn = ranked(sizes)
    sums = drawn.groupBy("source", "_bin").agg(F.sum("size").alias("_words"), F.sum(F.col("size") * F.col("_whole")).alias("_sure"))
    sums = checkpoint(sums.withColumn("_words", F.when(F.col("_bin").isNotNull(), F.col("_words")).otherwise(0)))
    by = Window.partitionBy("source").orderBy(F.col("_bin").asc_nulls_first())
    sums = sums.withColumns({"_all_sure": F.sum("_sure").over(Window.partitionBy("source")), "_to": F.sum("_words").over(by)})
    joined = sums.join(small(targets), F.col("source").eqNullSafe(F.col("_t")))
    need = F.col("target") - F.col("_all_sure")
    cuts = joined.filter(F.col("_bin").isNotNull() & (F.col("_to") >= need)).groupBy("source").agg(
        F.min(F.struct("_bin", (F.col("_to") - F.col("_words")).alias("before"), need.alias("need"))).alias("_cut")
    )
    cuts = targets.join(cuts, F.col("_t").eqNullSafe(F.col("source")), "left").select("_t", "source_size", "target", "_cut")
    cuts = checkpoint(cuts)
    drawn = drawn if rows is None else ranked(rows)
    drawn = drawn.join(small(cuts), F.col("source").eqNullSafe(F.col("_t")), "left").drop("_t")
    at = F.when(F.col("_bin") == F.col("_cut._bin"), F.lit(True)).otherwise(False)
    sure = drawn.filter(~at).withColumn("_drawn", F.coalesce((F.col("_bin") < F.col("_cut._bin")) | (F.col("_cut").isNull() & F.col("_bin").isNotNull()), F.lit(False)))
    order = ["_rank", "doc_id", "size"] + ([] if rows is None else ["tie"])
    at_cut = Window.partitionBy("source", "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = drawn.filter(at).withColumn("_drawn", F.col("_cut.before") + F.sum("size").over(at_cut) - F.col("size") / 2 <= F.col("_cut.need"))
    out = sure.unionByName(last)
    return out.withColumn("n_copies", F.when(F.col("size") > 0, F.col("_whole") + F.col("_drawn").cast("int")).otherwise(0)).drop("_whole", "_p", "_rank", "_bin", "_cut", "_drawn")


def sized(docs: DataFrame) -> DataFrame:
    return checkpoint(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them. A document of size 0 is left out.

    The number of copies depends on doc_id, source and size alone, so equal rows agree on it
    unless the source's cut falls between them. Columns may have any names.
    """
    text = F.coalesce("text", F.lit(""))
    # A row's columns lie in a struct, so that their names do not matter.
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(text).alias("tie"), F.struct("*").alias("r"))
    took = copies(sized(docs), rows).filter("n_copies > 0")
    taken = took.select("r", F.explode(F.array_repeat(F.lit(0), F.col("n_copies").cast("int"))))
    return taken.select(*(F.col("r").getField(c).alias(c) for c in docs.columns))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = copies(sized(table(spark, sf_dir, "documents")))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


ORACLE = f"""
WITH base AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
classes AS (SELECT source, length(bin(size)) AS k, CAST(sum(size) AS BIGINT) AS class_size FROM base GROUP BY ALL),
sources AS (SELECT source, CAST(sum(class_size) AS BIGINT) AS source_size FROM classes GROUP BY ALL),
weighted AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight, {MOST_COPIES} * source_size AS cap, {SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM sources),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, cap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv, row_number() OVER (ORDER BY cap / weight, cap) AS n FROM weighted WHERE cap > 0),
targets AS (SELECT w.source, w.source_size, coalesce(least(w.cap::DOUBLE, (SELECT min_by(lv, n) FROM levels WHERE lv * weight <= cap) * w.weight), w.cap::DOUBLE) AS target FROM weighted w),
rated AS (SELECT c.source, k, class_size, target, {MOST_COPIES}.0::DOUBLE * class_size AS cap, class_size * pow(2.0::DOUBLE, -{DAMPING}::DOUBLE * k) AS weight FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source WHERE class_size > 0),
steps AS (SELECT *, (target - coalesce(sum(cap) OVER (PARTITION BY source ORDER BY cap / weight, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY source ORDER BY cap / weight, cap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv, row_number() OVER (PARTITION BY source ORDER BY cap / weight, cap) AS n FROM rated),
found AS (SELECT source, min_by(lv, n) AS level FROM steps WHERE lv * weight <= cap GROUP BY source),
rates AS (SELECT s.source, s.k, round(coalesce(least({MOST_COPIES}.0::DOUBLE, level * pow(2.0::DOUBLE, -{DAMPING}::DOUBLE * s.k)), {MOST_COPIES}.0::DOUBLE), 9) AS rate FROM steps s LEFT JOIN found f ON s.source IS NOT DISTINCT FROM f.source),
drawn AS (SELECT b.*, floor(coalesce(rate, 0)) AS whole, coalesce(rate - floor(rate), 0) AS p, (('0x' || substr(md5(b.doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / {2**52}.0::DOUBLE AS u FROM base b LEFT JOIN rates r ON b.source IS NOT DISTINCT FROM r.source AND length(bin(b.size)) = r.k),
ranked AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM drawn),
cut AS (SELECT r.*, t.source_size, t.target, t.target - sum(r.size * whole) OVER (PARTITION BY r.source) AS need, sum(CASE WHEN odds IS NOT NULL THEN r.size END) OVER (PARTITION BY r.source ORDER BY odds NULLS LAST, doc_id, r.size ROWS UNBOUNDED PRECEDING) AS upto FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN odds IS NOT NULL AND upto - size / 2 <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM cut
"""

QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLES = {"op4_mix_sources": ORACLE}
