"""Versions of a collection, and monitors with state, against plain versions."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from spindrift.operators import versions as Y
from spindrift.streaming import events as E
from spindrift.streaming import monitor as M


def test_versions_hold_what_plain_dictionaries_hold(spark, tmp_path):
    draw, kind = random.Random(5), "id long, v string"
    store = Y.Collection.create(spark, f"{tmp_path}/c", "id", kind)
    now, kept = {}, [{}]
    for step in range(14):
        what = draw.choice(["upsert"] * 4 + ["delete", "delete", "clear", "restore", "compact"])
        before = store.version.number
        if what == "upsert":
            new = {draw.randrange(20): f"{step}" for _ in range(6)}
            store, now = store.upsert(spark.createDataFrame(list(new.items()), kind)), now | new
        elif what == "delete":
            gone = {draw.randrange(20) for _ in range(5)}
            store, now = store.delete(spark.createDataFrame([(i,) for i in gone], "id long")), {i: v for i, v in now.items() if i not in gone}
        elif what == "clear":
            store, now = store.clear(), {}
        elif what == "restore":
            n = draw.randrange(len(kept))
            store, now = store.restore(n), dict(kept[n])
        else:
            store = store.compact()
        kept += [now] * (store.version.number - before)
        assert {r["id"]: r["v"] for r in store.rows().collect()} == now
    for n, wanted in enumerate(kept):
        assert {r["id"]: r["v"] for r in Y.Collection.open(spark, f"{tmp_path}/c", n).rows().collect()} == wanted
    assert Y.Collection.open(spark, f"{tmp_path}/c").version == store.version and store.history().count() == len(kept)


def test_versions_refuse_what_would_be_lost(spark, tmp_path):
    store = Y.Collection.create(spark, f"{tmp_path}/c", "id", "id long, v string")
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    one = store.upsert(rows)
    with pytest.raises(Exception, match="(?i)already exists"):
        store.upsert(rows)
    with pytest.raises(Exception, match="(?i)already exists"):
        Y.Collection.create(spark, f"{tmp_path}/c", "id", "id long")
    with pytest.raises(ValueError):
        one.restore(99)
    for i in range(Y.MOST_FOLDERS + 2):
        one = one.upsert(spark.createDataFrame([(i, "b")], "id long, v string"))
    assert len(one.version.folders) <= Y.MOST_FOLDERS and one.rows().count() == Y.MOST_FOLDERS + 2


def events(spark, tmp_path, rows, schema):
    """A stream of two files, the first ones in time first."""
    half = len(rows) // 2
    for i, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e.parquet/part={i}")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/e.parquet").schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/e.parquet")


def test_failover_as_a_plain_loop(spark, tmp_path):
    draw, rows = random.Random(2), []
    for i in range(600):
        rows.append((f"m{draw.randrange(3)}", i, i * 70_000_000 + draw.randrange(1000), draw.random() < 0.7))
    stream = events(spark, tmp_path, rows, "model string, call long, ts long, failed boolean")
    found = {r["call"]: (r["skipped"], r["failures"]) for r in E.run_available(M.failover(stream, "model", "call"), f"{tmp_path}/s").collect()}
    wanted, count, log = {}, {}, {}
    for model, call, at, failed in rows:
        # A reset is due for each failure; those that came due since the last call empty the count.
        due = [r for r in log.get(model, []) if r <= at]
        log[model] = [r for r in log.get(model, []) if r > at]
        count[model] = 0 if due else count.get(model, 0)
        skipped = count[model] >= 3
        if not skipped and failed:
            count[model] += 1
            log[model].append(at + 300_000_000)
        elif not skipped:
            count[model] = 0
        wanted[call] = skipped, count[model]
    assert found == wanted and sum(s for s, _ in wanted.values()) >= 5


def test_sampler_as_a_plain_loop(spark, tmp_path):
    draw, rows, at = random.Random(4), [], 0
    for i in range(500):
        at += draw.choice([1_000_000, 20_000_000, 200_000_000])
        rows.append((f"k{draw.randrange(2)}", at, draw.choice([None, 0.5, 1.0, 3.0])))
    stream = events(spark, tmp_path, rows, "kind string, ts long, value double")
    found = {(r["kind"], r["start"]): (round(r["mean"], 9), r["n"], round(r["recent"], 9), r["alert"]) for r in E.run_available(M.sampled(stream, "kind", keep=4, most=1.5), f"{tmp_path}/s").collect()}
    wanted = {}
    for kind in ("k0", "k1"):
        windows = {}
        for k, ts, v in rows:
            if k == kind and v is not None:
                windows.setdefault(ts // 60_000_000 * 60_000_000, []).append(v)
        ring = deque(maxlen=4)
        for start in sorted(windows)[:-1]:
            mean = sum(windows[start]) / len(windows[start])
            ring.append(mean)
            wanted[kind, start] = round(mean, 9), len(windows[start]), round(sum(ring) / len(ring), 9), mean > 1.5
    assert found == wanted and any(w[3] for w in wanted.values())


def test_updates_keep_the_last_row_of_a_key(spark, tmp_path):
    """Three files, a batch each: without keys all updates stay, with keys each key's last one."""
    for i in range(3):
        spark.createDataFrame([(f"k{j}", 1) for j in range(i, 4)], "kind string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    counts = lambda: E.stream_of(spark, f"{tmp_path}/t").groupBy("kind").agg(F.count("*").alias("n"))
    wanted = {r["kind"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/t").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    last = E.run_available(counts(), f"{tmp_path}/a", "update", keys=["kind"])
    assert last.columns == ["kind", "n"] and {r["kind"]: r["n"] for r in last.collect()} == wanted and last.count() == 4
    every = E.run_available(counts(), f"{tmp_path}/b", "update")
    assert every.columns == ["kind", "n"] and every.count() == 9 and set(map(tuple, last.collect())) <= set(map(tuple, every.collect()))
    none = E.run_available(counts().filter("n < 0"), f"{tmp_path}/c", "update", keys=["kind"])
    assert none.count() == 0
