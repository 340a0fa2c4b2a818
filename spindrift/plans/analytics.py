"""Feedback, experiments, monitoring and errors over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import feedback as A
from spindrift.sources.tables import read

from .catalog import query
from .search import rounded

NOW = "2024-01-31 00:00:00"
RECENT = f"ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY"


def _recent(spark, d):
    return A.since(read(spark, d, "events"), NOW, 14)


@query(f"SELECT event_type, round(avg(value), 6) AS avg_score, count(value) AS n, min(value) AS min_score, max(value) AS max_score, round(median(value), 6) AS median_score FROM events WHERE {RECENT} GROUP BY event_type")
def feedback_stats(spark, d):
    return rounded(A.stats(_recent(spark, d), "event_type", "value"), "avg_score", "median_score")


@query("SELECT user_id, round(avg(value), 6) AS avg_score, count(value) AS n FROM events GROUP BY user_id HAVING avg(value) < 40 ORDER BY avg(value), user_id LIMIT 20")
def feedback_low_queries(spark, d):
    return rounded(A.low_queries(read(spark, d, "events"), "user_id", "value", 40, 20), "avg_score")


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS avg_score, count(value) AS n FROM events WHERE {RECENT} GROUP BY day")
def feedback_trend_daily(spark, d):
    return rounded(A.daily(_recent(spark, d), "value").withColumn("day", F.col("day").cast("string")), "avg_score")


KINDS = {"view": 0.3, "click": 0.3, "purchase": 0.2, "signup": 0.2}


def _metrics(spark, d):
    """Values have two places, so a mean of few may lie half-way between two numbers of six places: noise of its sum must not decide."""
    metrics = A.content_metrics(read(spark, d, "events"), "user_id", "event_type", "value", KINDS)
    return metrics.withColumns({c: F.round(c, 12) for c in ("mean", "overall")})


METRICS = f"""SELECT user_id, event_type, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n, CASE event_type {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in KINDS.items())} END AS w FROM events GROUP BY ALL"""


@query(f"SELECT user_id, event_type, round(mean, 6) AS mean, round(std, 6) AS std, n, round(sum(mean * w) OVER (PARTITION BY user_id) / sum(w) OVER (PARTITION BY user_id), 6) AS overall FROM ({METRICS})")
def content_metrics(spark, d):
    return rounded(_metrics(spark, d), "mean", "std", "overall")


@query(f"""WITH m AS (SELECT user_id, event_type, mean, n, sum(mean * w) OVER (PARTITION BY user_id) / sum(w) OVER (PARTITION BY user_id) AS overall FROM ({METRICS}))
SELECT user_id, event_type, round(overall, 6) AS overall, CASE WHEN overall < 40 THEN 'alert' ELSE 'suggestion' END AS severity FROM m WHERE overall < 40 OR (mean < 45 AND n >= 5)""")
def feedback_alerts(spark, d):
    return rounded(A.alerts(_metrics(spark, d), 40, 45, 5).select("user_id", "event_type", "overall", "severity"), "overall")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c)
SELECT user_id, max(CASE WHEN r = 1 THEN event_type END) AS mode, sum(n)::BIGINT AS total, count(*) AS kinds FROM r GROUP BY user_id""")
def outcome_mode(spark, d):
    return A.outcomes(read(spark, d, "events"), "user_id", "event_type")


@query("""WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), s AS (SELECT user_id, count(value) AS n, regr_slope(value, i) AS slope FROM p GROUP BY user_id)
SELECT user_id, n, round(slope, 6) AS slope, CASE WHEN n < 2 THEN 'insufficient_data' WHEN slope > 0.1 THEN 'increasing' WHEN slope < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM s""")
def trend_slope(spark, d):
    return rounded(A.slopes(read(spark, d, "events"), "user_id", "value", ["ts", "event_id"]), "slope")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, max(value) AS max_score, round(avg(CASE WHEN r <= 5 THEN value END), 6) AS recent_avg FROM r GROUP BY user_id""")
def recent_mean(spark, d):
    return rounded(A.recent_mean(read(spark, d, "events"), "user_id", "value", ["ts", "event_id"]), "recent_avg")


SCORES = {"purchase": 4, "signup": 3, "click": 2, "view": 1}


@query(f"""WITH e AS (SELECT *, CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in SCORES.items())} ELSE 0 END AS s FROM events)
SELECT user_id, round((arg_max(s, (ts, event_id)) - arg_min(s, (ts, event_id))) / count(*), 6) AS rate FROM e GROUP BY user_id""")
def improvement_rate(spark, d):
    score = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in SCORES.items() for x in (k, v)]), F.col("event_type")), F.lit(0))
    return rounded(A.improvement(read(spark, d, "events"), "user_id", score, F.struct("ts", "event_id")), "rate")


VARIANTS = [("control", 0.5), ("wide", 0.3), ("deep", 0.2)]
DRAW = "('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
ASSIGNED = f"SELECT *, CASE WHEN {DRAW} < 0.5 THEN 'control' WHEN {DRAW} < 0.8 THEN 'wide' ELSE 'deep' END AS variant FROM events"
AB = f"""SELECT variant, metric, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std, median(v) AS median, quantile_cont(v, 0.95) AS p95 FROM (
SELECT variant, 'value' AS metric, value AS v FROM ({ASSIGNED}) UNION ALL SELECT variant, 'hour', hour(ts)::DOUBLE FROM ({ASSIGNED})) GROUP BY ALL"""


def _assigned(spark, d):
    return A.assigned(read(spark, d, "events"), "user_id", VARIANTS)


def _ab(spark, d):
    metrics = F.create_map(F.lit("value"), F.col("value"), F.lit("hour"), F.hour("ts").cast("double"))
    return A.experiment_stats(_assigned(spark, d).withColumn("metrics", metrics), "variant", "metrics")


@query(f"SELECT variant, metric, n, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, round(p95, 6) AS p95 FROM ({AB})")
def ab_stats(spark, d):
    return rounded(_ab(spark, d), "mean", "std", "median", "p95")


@query(f"SELECT variant, round(mean, 6) AS mean FROM ({AB}) WHERE metric = 'value' ORDER BY {'mean'} DESC, variant LIMIT 1")
def ab_winner(spark, d):
    return rounded(A.winner(_ab(spark, d), "value", "variant"), "mean")


@query(f"SELECT variant, count(DISTINCT user_id) AS users, count(*) AS n FROM ({ASSIGNED}) GROUP BY variant")
def ab_assign(spark, d):
    return _assigned(spark, d).groupBy("variant").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, count(value) AS n FROM events GROUP BY event_type")
def metric_summary(spark, d):
    return rounded(A.metric_summary(read(spark, d, "events"), "event_type", "value"), "mean", "median")


@query("""SELECT count(*) AS samples, round(avg(value), 6) AS avg_latency, round(quantile_cont(value, 0.95), 6) AS p95_latency, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate,
round(count(*) FILTER (value < 50) / count(value), 6) AS cache_hit_rate, min(ts) AS since, max(ts) AS until FROM events""")
def metrics_report(spark, d):
    samples = read(spark, d, "events").select(F.col("value").alias("latency"), (F.col("event_type") == "error").alias("is_error"), (F.col("value") < 50).alias("is_hit"), "ts")
    return rounded(A.performance_report(samples), "avg_latency", "p95_latency", "error_rate", "cache_hit_rate")


SEVERITY = "CASE WHEN value > 100 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END"


@query(f"""SELECT 'category' AS level, event_type AS name, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'severity', {SEVERITY}, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM events""")
def error_rollup(spark, d):
    errors = read(spark, d, "events").select(F.col("event_type").alias("category"), F.when(F.col("value") > 100, "high").when(F.col("value") > 30, "medium").otherwise("low").alias("severity"))
    return A.error_rollup(errors, "category", "severity")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def progress_latest(spark, d):
    """Last write wins for each user and type."""
    return A.latest(read(spark, d, "events"), ["user_id", "event_type"], F.struct("ts", "event_id"), "value")


@query("""WITH RECURSIVE e AS (SELECT event_type AS operation, epoch_us(ts) AS t FROM events),
w AS (SELECT operation, min(t) AS s FROM e GROUP BY operation UNION ALL SELECT w.operation, (SELECT min(t) FROM e WHERE e.operation = w.operation AND t > w.s + 3600000000) FROM w WHERE EXISTS (SELECT 1 FROM e WHERE e.operation = w.operation AND t > w.s + 3600000000)),
n AS (SELECT w.operation, w.s, count(*) AS n FROM w JOIN e ON e.operation = w.operation AND e.t BETWEEN w.s AND w.s + 3600000000 GROUP BY ALL)
SELECT operation, s AS window_start, n, least(n, 5) AS allowed, greatest(n - 5, 0) AS rejected FROM n""")
def rate_limit_windows(spark, d):
    """Windows of an hour that open with the first request after the last one's end, of five requests each."""
    events = read(spark, d, "events").withColumnRenamed("event_type", "operation")
    return A.fixed_windows(events, "operation", "ts", 3600, 5).withColumn("window_start", F.unix_micros("window_start"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY) AS kept FROM events GROUP BY event_type")
def metric_retention(spark, d):
    """What a retention of seven days keeps."""
    events = read(spark, d, "events")
    kept = A.since(events, NOW, 7).groupBy("event_type").agg(F.count("*").alias("kept"))
    return events.groupBy("event_type").agg(F.count("*").alias("n")).join(kept, "event_type", "left").fillna({"kept": 0})
