"""Streaming versions of the metrics over a table of events, and the loops over messages.

All are functions from a streaming (or batch) DataFrame to one; run_available drains what is there, so they can be
tested and compared with batch results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a Parquet table; its times as timestamps with time zone."""
    schema = spark.read.parquet(path).schema
    # As a pattern the path may be one file as well as a folder.
    pattern = f"{path[:-1]}[{path[-1]}]"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def tumbling(events: DataFrame, by: str, width: str = "1 hour", late: str = "2 hours", value: str = "value") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return w.select(F.col("window.start").alias("start"), by, "n", "mean")


def sliding(events: DataFrame, by: str, width: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), by).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def deduplicated(events: DataFrame, keys: list[str], late: str | None = "2 hours") -> DataFrame:
    """The first event of each key. Without late, in whatever order events come: the state then holds all keys.

    With late, events older than the newest time of the batches before, less late, are lost.
    """
    if late is None:
        return events.dropDuplicates(keys)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def feedback(events: DataFrame, content: str, kind: str, value: str = "value") -> DataFrame:
    """Running mean and number of each content's kinds, for update or complete mode."""
    return events.groupBy(content, kind).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def alerts(samples: DataFrame, most: float, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Windows whose mean value exceeds a limit."""
    w = samples.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.avg("value").alias("mean"))
    return w.filter(F.col("mean") > most).select(F.col("window.start").alias("start"), "mean")


def enriched(events: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Stream with a static table."""
    return events.join(table, key, "left")


def dispatched(messages: DataFrame) -> DataFrame:
    """type, content and reply of JSON messages; unknown types get an error."""
    parsed = messages.select(F.from_json("value", "type STRING, content STRING, cross_modal BOOLEAN").alias("m")).select("m.*")
    reply = F.when(F.col("type") == "text", F.concat(F.lit("text: "), F.col("content"))).when(F.col("type").isin("image", "audio"), F.concat(F.col("type"), F.lit(": received"))).otherwise("error: unknown type")
    return parsed.select("type", "content", reply.alias("reply"))


def rate_limited(events: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """key, ts, and allowed: in windows that open with the first event after the last one's end, limit events pass.

    Events of a micro-batch come in order of time, those of a later one after them. Of a key's events in it, only the times are held
    (8 bytes each); files for each trigger bound their number. Events without a time are left out.
    """
    width = seconds * 1_000_000

    def step(k: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        times = np.sort(np.concatenate([p["ts"].to_numpy("datetime64[us]").astype(np.int64) for p in parts]))
        allowed = np.zeros(len(times), bool)
        a = 0
        while a < len(times):
            if start is None or times[a] - start > width:
                start, n = int(times[a]), 0
            b = int(np.searchsorted(times, start + width, "right"))
            allowed[a:b] = n + 1 + np.arange(b - a) <= limit
            n += b - a
            a = b
        if start is not None:
            state.update((start, n))
        for a in range(0, len(times), 1 << 16):
            yield pd.DataFrame({key: k[0], "ts": times[a : a + (1 << 16)].astype("datetime64[us]").astype("datetime64[ns]"), "allowed": allowed[a : a + (1 << 16)]})

    return events.select(key, "ts").filter("ts IS NOT NULL").groupBy(key).applyInPandasWithState(step, f"{key} string, ts timestamp, allowed boolean", "start long, n long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append", name: str | None = None, each: Callable[[DataFrame, int], None] | None = None, keys: Sequence[str] = ()) -> DataFrame | None:
    """Runs a stream over what is there, into Parquet files in folder, which driver and executors share; or calls each with every batch.

    In update mode every batch has a folder of its own, which a replayed batch writes anew; of rows of equal keys the last batch's stays (without keys, all).
    """
    name = name or f"stream_{uuid.uuid4().hex}"
    spark, path = stream.sparkSession, f"{folder}/{name}-rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True)
    if each:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
    elif mode == "complete":
        # A batch is the whole table, so the last one stays.
        spark.createDataFrame([], stream.schema).write.parquet(path)
        writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start().awaitTermination()
    else:
        kept = StructType([*stream.schema.fields, StructField("_batch", LongType())])
        spark.createDataFrame([], kept).write.parquet(f"{path}/none")
        writer.foreachBatch(lambda rows, i: rows.withColumn("_batch", F.lit(i).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{i}")).start().awaitTermination()
        rows = spark.read.schema(kept).option("recursiveFileLookup", "true").parquet(path)
        if keys:
            last = F.max_by(F.struct(*stream.columns), "_batch").alias("r")
            return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(last).select("r.*")
        return rows.select(*stream.columns)
    return spark.read.schema(stream.schema).parquet(path)
