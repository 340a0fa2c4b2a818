"""Monitors with state: failover counters of models, and a sampler with a ring buffer and alert rules.

Both keep a bounded state for each key and take a micro-batch's events in order of time, then of id; a later micro-batch comes
after them. Files for each trigger bound what a key has in one. Events without a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Failures from which on a model is skipped, seconds after a failure at which its count starts anew, seconds of a sample.
MOST_FAILURES, RESET_SECONDS, SAMPLE_SECONDS = 3, 300, 60


def _sorted(parts: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """Columns of a key's rows, ts in microseconds first, by time and then by the first of columns."""
    whole = [p for p in parts]
    times = np.concatenate([p["ts"].to_numpy("datetime64[us]").astype(np.int64) for p in whole])
    others = [np.concatenate([p[c].to_numpy() for p in whole]) for c in columns]
    order = np.lexsort((others[0], times)) if others else np.argsort(times, kind="stable")
    return [times[order], *(o[order] for o in others)]


class Breaker:
    """A model's failures in a row, and when the failures so far start the count anew."""

    def __init__(self, count: int = 0, resets: list[int] | None = None, most: int = MOST_FAILURES, reset: int = RESET_SECONDS * 1_000_000):
        self.count, self.resets, self.most, self.reset = count, list(resets or []), most, reset

    def call(self, at: int, failed: bool) -> bool:
        """Whether the model is skipped. A model that is called counts a failure, or starts anew after a success."""
        if any(r <= at for r in self.resets):
            self.count = 0
            self.resets = [r for r in self.resets if r > at]
        if self.count >= self.most:
            return True
        if failed:
            self.count += 1
            self.resets.append(at + self.reset)
        else:
            self.count = 0
        return False


def failover(calls: DataFrame, model: str, call: str, *, most: int = MOST_FAILURES, reset_seconds: int = RESET_SECONDS) -> DataFrame:
    """model, call, skipped and failures (after the call) of each call, from model, call (a whole number), ts and failed.

    The state of a model is its count and a time for each failure of the last reset_seconds.
    """

    def step(k: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(*(state.get if state.exists else ()), most=most, reset=reset_seconds * 1_000_000)
        times, ids, failed = _sorted(parts, call, "failed")
        skipped, counts = [], []
        for at, f in zip(times.tolist(), failed.tolist(), strict=True):
            skipped.append(breaker.call(at, bool(f)))
            counts.append(breaker.count)
        state.update((breaker.count, breaker.resets))
        yield pd.DataFrame({model: k[0], call: ids, "skipped": skipped, "failures": counts})

    kind = calls.schema[model].dataType.simpleString()
    rows = calls.select(model, F.col(call).cast("long").alias(call), "ts", "failed").filter("ts IS NOT NULL AND failed IS NOT NULL")
    return rows.groupBy(model).applyInPandasWithState(step, f"{model} {kind}, {call} long, skipped boolean, failures int", "count int, resets array<long>", "append", GroupStateTimeout.NoTimeout)


def sampled(events: DataFrame, key: str, value: str = "value", *, seconds: int = SAMPLE_SECONDS, keep: int = 60, most: float | None = None) -> DataFrame:
    """key, start, mean, n, recent and alert: a sample of each window once an event after it has come.

    recent is the mean of the last keep samples, this one among them, which the state holds as a ring; alert says that the sample
    exceeds most. A window without events has no sample; an event of a window that is closed counts in the open one.
    """
    width = seconds * 1_000_000

    def step(k: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, total, n, ring, place = state.get if state.exists else (None, 0.0, 0, [], 0)
        ring, out = list(ring), []
        times, values = _sorted(parts, value)
        for at, x in zip((times // width * width).tolist(), values.tolist(), strict=True):
            if start is not None and at > start:
                mean = total / n
                if len(ring) < keep:
                    ring.append(mean)
                else:
                    ring[place] = mean
                place = (place + 1) % keep
                out.append((start, mean, n, sum(ring) / len(ring), most is not None and mean > most))
                start, total, n = at, 0.0, 0
            start = at if start is None else start
            total, n = total + x, n + 1
        state.update((start, total, n, ring, place))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pd.DataFrame({key: [k[0]] * len(out), "start": np.array(columns[0], np.int64), "mean": np.array(columns[1], float), "n": np.array(columns[2], np.int64), "recent": np.array(columns[3], float), "alert": np.array(columns[4], bool)})

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "ts", F.col(value).cast("double").alias(value)).filter(F.col("ts").isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, start long, mean double, n long, recent double, alert boolean", "start long, total double, n long, ring array<double>, place int", "append", GroupStateTimeout.NoTimeout
    )
