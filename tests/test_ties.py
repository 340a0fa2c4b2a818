"""Values that lie half-way between two results: the order of rows must not decide."""

import itertools
import math
from datetime import datetime, timedelta

import duckdb

from spindrift.operators import feedback as A
from spindrift.plans import catalog

catalog.load()
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_means_of_all_orders(spark, tmp_path):
    # (0.1 + 0.2 + 0.3 + 0.0000004 * 5) / 4 lies half-way; in doubles 0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1.
    values = [0.1, 0.2, 0.3, 0.000002]
    rows = [(i * 10 + j, datetime(2024, 1, 1), i, "view", v, None) for i, order in enumerate(itertools.permutations(values)) for j, v in enumerate(order)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("feedback_alerts", "content_metrics"):
        assert {r["overall"] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} == {0.150001}
    exact = {r["mean"] for r in A.content_metrics(spark.createDataFrame(rows, EVENTS), "user_id", "event_type", "value", {"view": 1.0}).collect()}
    assert exact == {0.600002 / 4}


def test_means_of_values_that_are_no_decimals(spark):
    rows = [("a", math.nan), ("a", 1.0), ("b", math.inf), ("b", 1.0), ("c", None), ("d", 1e300), ("d", 3e300), ("e", 1.5), ("e", None), ("e", 2.5)]
    means = {r["kind"]: r["mean"] for r in A.content_metrics(spark.createDataFrame([("x", *r) for r in rows], "content string, kind string, value double"), "content", "kind", "value", {}).collect()}
    assert math.isnan(means.pop("a")) and means == {"b": math.inf, "c": None, "d": 2e300, "e": 2.0}


def test_half_seconds_go_to_the_even_one(spark, tmp_path):
    start = datetime(2024, 1, 1)
    times = [start + timedelta(milliseconds=500 * i) for i in range(8)] + [datetime(1969, 12, 31, 23, 59, 58, 500000), datetime(1969, 12, 31, 23, 59, 59, 500000)]
    spark.createDataFrame([(i, t, 0, "view", 1.0, None) for i, t in enumerate(times)], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = sorted(map(tuple, catalog.QUERIES["ttl_expiry"](spark, str(tmp_path)).collect()))
    assert found == sorted(db.sql(catalog.ORACLES["ttl_expiry"]).fetchall())
