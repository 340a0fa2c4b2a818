"""Streaming operators over the events table, drained once; the SQL is the batch equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators.lineage import shared_folder
from spindrift.streaming import events as E
from spindrift.streaming import monitor as M

from . import analytics  # noqa: F401
from .catalog import ORACLES, query


def _folder(spark):
    return shared_folder(spark) + "/streams"


def _events(spark, d):
    return E.stream_of(spark, f"{d}/events.parquet")


def _micros(df, *names):
    return df.withColumns({n: F.unix_micros(F.col(n).cast("timestamp")) for n in names})


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    out = E.run_available(E.tumbling(_events(spark, d), "event_type"), _folder(spark), "complete")
    return _micros(out.withColumn("mean", F.round("mean", 6)), "start")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts) - u.k * INTERVAL 1 HOUR) AS start, event_type, count(*) AS n FROM events, unnest([0, 1]) AS u(k) GROUP BY ALL")
def stream_sliding(spark, d):
    return _micros(E.run_available(E.sliding(_events(spark, d), "event_type"), _folder(spark), "complete"), "start")


@query("""WITH e AS (SELECT user_id, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000)::INT, 1) AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, g""")
def stream_session(spark, d):
    return _micros(E.run_available(E.sessions(_events(spark, d), "user_id"), _folder(spark), "complete"), "start", "end")


@query("SELECT user_id, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL")
def stream_dedup(spark, d):
    """Each event arrives twice and counts once."""
    events = _events(spark, d)
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = E.run_available(E.deduplicated(twice, ["event_id"], late=None).select("event_id", "user_id", "event_type"), _folder(spark))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY ALL")
def stream_feedback(spark, d):
    out = E.run_available(E.feedback(_events(spark, d), "user_id", "event_type"), _folder(spark), "complete")
    return out.withColumn("mean", F.round("mean", 6))


@query("SELECT event_id, c_mktsegment AS segment FROM events LEFT JOIN customer ON user_id = c_custkey")
def stream_enriched(spark, d):
    customers = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return E.run_available(E.enriched(_events(spark, d), customers, "user_id").select("event_id", "segment"), _folder(spark))


@query("SELECT CASE WHEN event_type = 'view' THEN 'text: ' || user_id WHEN event_type = 'click' THEN 'image: received' ELSE 'error: unknown type' END AS reply, count(*) AS n FROM events GROUP BY ALL")
def stream_messages(spark, d):
    """A loop of JSON messages in and replies out."""
    kind = F.when(F.col("event_type") == "view", "text").when(F.col("event_type") == "click", "image").otherwise("other")
    messages = _events(spark, d).select(F.to_json(F.struct(kind.alias("type"), F.col("user_id").cast("string").alias("content"))).alias("value"))
    return E.run_available(E.dispatched(messages), _folder(spark)).groupBy("reply").agg(F.count("*").alias("n"))


@query(f"SELECT operation AS event_type, sum(n)::BIGINT AS n, sum(allowed)::BIGINT AS allowed FROM ({ORACLES['rate_limit_windows']}) GROUP BY operation")
def stream_rate_limit(spark, d):
    """Events of each type that pass a limit of five an hour, with state for each key."""
    out = E.run_available(E.rate_limited(_events(spark, d), "event_type", 3600, 5), _folder(spark))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"))


FAILED = ("error", "click", "view")
DAY = 86_400


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type IN {FAILED} AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, false AS skipped, 0 AS c, []::BIGINT[] AS l FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT e.user_id, e.n, e.event_id, x.c0 >= 3, CASE WHEN x.c0 >= 3 THEN x.c0 WHEN failed THEN x.c0 + 1 ELSE 0 END, CASE WHEN x.c0 < 3 AND failed THEN list_append(x.l0, e.t + {DAY * 1_000_000}) ELSE x.l0 END
FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1, LATERAL (SELECT CASE WHEN len(list_filter(r.l, lambda y: y <= e.t)) > 0 THEN 0 ELSE r.c END AS c0, list_filter(r.l, lambda y: y > e.t) AS l0) x)
SELECT user_id, event_id, skipped, c::INT AS failures FROM r WHERE n > 0""")
def stream_failover(spark, d):
    """Users stand for models, some kinds of events for failures."""
    calls = _events(spark, d).withColumn("failed", F.col("event_type").isin(*FAILED))
    return E.run_available(M.failover(calls, "user_id", "event_id", reset_seconds=DAY), _folder(spark))


@query("""WITH w AS (SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, avg(value) AS m, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
s AS (SELECT *, lead(start) OVER (PARTITION BY event_type ORDER BY start) AS nx, avg(m) OVER (PARTITION BY event_type ORDER BY start ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS recent FROM w)
SELECT event_type, start, n, round(m, 9) AS mean, round(recent, 9) AS recent, m > 20 AS alert FROM s WHERE nx IS NOT NULL""")
def stream_sampler(spark, d):
    """Hourly samples of each kind of event, with the mean of the last twelve."""
    out = E.run_available(M.sampled(_events(spark, d), "event_type", seconds=3600, keep=12, most=20.0), _folder(spark))
    return out.select("event_type", "start", "n", F.round("mean", 9).alias("mean"), F.round("recent", 9).alias("recent"), "alert")
