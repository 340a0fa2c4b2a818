"""Feedback, experiments, metrics and errors: group statistics, trends and alerts.

"Now" is always a parameter, so results do not depend on when a query runs. Spread is that of the population,
percentiles interpolate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of feedback types in the overall score (fixed values); other types have none.
TYPE_WEIGHTS = {"relevance": 0.3, "accuracy": 0.3, "clarity": 0.2, "engagement": 0.2}


def since(rows: DataFrame, now: Column | str, days: int, ts: str = "ts") -> DataFrame:
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return rows.filter(F.col(ts) >= now - F.make_interval(days=F.lit(days)))


def stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.avg(value).alias("avg_score"), F.count(value).alias("n"), F.min(value).alias("min_score"), F.max(value).alias("max_score"), F.median(value).alias("median_score"))


def low_queries(rows: DataFrame, by: str, value: str, threshold: float, limit: int) -> DataFrame:
    """The worst groups with a mean below threshold."""
    return rows.groupBy(by).agg(F.avg(value).alias("avg_score"), F.count(value).alias("n")).filter(F.col("avg_score") < threshold).orderBy("avg_score", by).limit(limit)


def daily(rows: DataFrame, value: str, ts: str = "ts") -> DataFrame:
    return rows.groupBy(F.to_date(ts).alias("day")).agg(F.avg(value).alias("avg_score"), F.count(value).alias("n")).orderBy("day")


def steady_mean(value: str) -> Column:
    """Mean that does not hang on the order of rows: values are added as decimals of 12 places, or as doubles if one is no such number."""
    exact = F.col(value).try_cast("decimal(28,12)")
    return F.when(F.count(exact) == F.count(value), F.try_divide(F.sum(exact).cast("double"), F.count(value))).otherwise(F.avg(value))


def content_metrics(rows: DataFrame, content: str, kind: str, value: str, weights: Mapping[str, float]) -> DataFrame:
    """content, kind, mean, std, n and overall: the weighted mean of the kinds that the content has, added in their order."""
    each = rows.groupBy(content, kind).agg(steady_mean(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    w = F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col(kind))
    all_ = Window.partitionBy(content).orderBy(kind).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return each.withColumn("_w", w).withColumn("overall", F.try_divide(F.sum(F.col("mean") * F.col("_w")).over(all_), F.sum("_w").over(all_))).drop("_w")


def outcomes(rows: DataFrame, by: str, outcome: str) -> DataFrame:
    """by, mode (ties: by name) and counts of outcomes."""
    counts = rows.groupBy(by, outcome).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), outcome)))
    return ranked.groupBy(by).agg(F.max(F.when(F.col("_r") == 1, F.col(outcome))).alias("mode"), F.sum("n").alias("total"), F.count("*").alias("kinds"))


def trend(slope: Column, n: Column, step: float = 0.1) -> Column:
    return F.when(n < 2, "insufficient_data").when(slope > step, "increasing").when(slope < -step, "decreasing").otherwise("stable")


def slopes(rows: DataFrame, by: str, value: str, order: Sequence[str]) -> DataFrame:
    """by, n, slope over the place in order, and trend."""
    placed = rows.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    out = placed.groupBy(by).agg(F.count(value).alias("n"), F.regr_slope(F.col(value), F.col("_i")).alias("slope"))
    return out.withColumn("trend", trend(F.col("slope"), F.col("n")))


def recent_mean(rows: DataFrame, by: str, value: str, order: Sequence[str], last: int = 5) -> DataFrame:
    """by, max and the mean of the last rows."""
    newest = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_r", newest).groupBy(by).agg(F.max(value).alias("max_score"), F.avg(F.when(F.col("_r") <= last, F.col(value))).alias("recent_avg"))


def improvement(rows: DataFrame, by: str, score: Column, order: Column) -> DataFrame:
    """by and rate: last score less the first, over the number of rows."""
    return rows.groupBy(by).agg(F.try_divide(F.max_by(score, order) - F.min_by(score, order), F.count("*")).alias("rate"))


def alerts(metrics: DataFrame, least_overall: float = 0.4, least_mean: float = 0.7, least_n: int = 5) -> DataFrame:
    """Rows of content_metrics with severity: low overall, or a weak kind with enough feedback; others go."""
    severity = F.when(F.col("overall") < least_overall, "alert").when((F.col("mean") < least_mean) & (F.col("n") >= least_n), "suggestion")
    return metrics.withColumn("severity", severity).filter("severity IS NOT NULL")


def experiment_stats(results: DataFrame, variant: str, metrics: str) -> DataFrame:
    """variant, metric, n, mean, std, median and p95, from a map of metrics."""
    each = results.select(variant, F.explode(metrics).alias("metric", "value"))
    return each.groupBy(variant, "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.median("value").alias("median"), F.percentile("value", 0.95).alias("p95")
    )


def winner(stats_: DataFrame, metric: str, variant: str) -> DataFrame:
    return stats_.filter(F.col("metric") == metric).orderBy(F.desc("mean"), variant).limit(1).select(variant, "mean")


def draw(key: Column) -> Column:
    """A number in [0, 1) from the key's md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def assigned(rows: DataFrame, key: str, variants: Sequence[tuple[str, float]]) -> DataFrame:
    """rows with variant: the first whose cumulative share reaches the key's draw."""
    u, total, out = draw(F.col(key)), 0.0, None
    for name, share in variants:
        total += share
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return rows.withColumn("variant", out.otherwise(variants[-1][0]))


def metric_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def performance_report(samples: DataFrame) -> DataFrame:
    """One row from samples of latency, is_error and is_hit."""
    return samples.agg(
        F.count("*").alias("samples"),
        F.avg("latency").alias("avg_latency"),
        F.percentile("latency", 0.95).alias("p95_latency"),
        F.coalesce(F.try_divide(F.count_if("is_error"), F.count("*")), F.lit(0.0)).alias("error_rate"),
        F.coalesce(F.try_divide(F.count_if("is_hit"), F.count_if(F.col("is_hit").isNotNull())), F.lit(0.0)).alias("cache_hit_rate"),
        F.min("ts").alias("since"),
        F.max("ts").alias("until"),
    )


def error_rollup(errors: DataFrame, category: str, severity: str) -> DataFrame:
    """Counts by category, by severity and in all; level says which."""
    grouped = errors.groupingSets([[F.col(category)], [F.col(severity)], []], category, severity).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 1, "category").when(F.col("g") == 2, "severity").otherwise("total")
    return grouped.select(level.alias("level"), F.coalesce(category, severity, F.lit("all")).alias("name"), "n")


def latest(rows: DataFrame, keys: Sequence[str], order: Column, *values: str) -> DataFrame:
    """The last row's values of each key: last write wins."""
    return rows.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def fixed_windows(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """key, window_start, n, allowed and rejected. A window opens at the first event after the last one's end, so it is a fold over each key's times."""
    times = events.groupBy(key).agg(F.array_sort(F.collect_list(F.unix_micros(F.col(ts).cast("timestamp")))).alias("_t"))
    span = seconds * 1_000_000
    fold = F.aggregate(
        "_t",
        F.array().cast("array<struct<start: bigint, n: bigint>>"),
        lambda done, t: F.when(
            (F.size(done) == 0) | (t - F.element_at(done, -1)["start"] > span), F.concat(done, F.array(F.struct(t.alias("start"), F.lit(1).cast("bigint").alias("n"))))
        ).otherwise(
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), (F.element_at(done, -1)["n"] + 1).alias("n"))))
        ),
    )
    each = times.select(key, F.explode(fold).alias("w"))
    return each.select(key, F.timestamp_micros("w.start").alias("window_start"), F.col("w.n").alias("n"), F.least(F.col("w.n"), F.lit(limit)).alias("allowed"), F.greatest(F.col("w.n") - limit, F.lit(0)).alias("rejected"))
