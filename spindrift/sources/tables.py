"""The tables that stand in for a document store, and schemas of the records around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Records of the store's surroundings, as DDL.
SCHEMAS = {
    "document": "id STRING, text STRING, metadata STRUCT<source STRING, created_at TIMESTAMP, language STRING, category STRING, tags ARRAY<STRING>>, embedding ARRAY<FLOAT>",
    "chunk": "document_id STRING, chunk_id STRING, chunk_index INT, text STRING, start INT, end INT, metadata MAP<STRING, STRING>",
    "vector": "id STRING, vector ARRAY<FLOAT>, metadata MAP<STRING, STRING>, timestamp TIMESTAMP",
    "feedback": "id BIGINT, query_id STRING, result_id STRING, feedback_type STRING, score DOUBLE, metadata STRING, timestamp TIMESTAMP",
    "feedback_entry": "feedback_id STRING, user_id STRING, content_id STRING, timestamp TIMESTAMP, feedback_type STRING, rating DOUBLE, learning_outcome STRING, comments STRING, metadata MAP<STRING, STRING>",
    "experiment_result": "variant_id STRING, metrics MAP<STRING, DOUBLE>, timestamp STRING, user_id STRING, query_id STRING",
    "error_event": "error_id STRING, timestamp TIMESTAMP, category STRING, severity STRING, message STRING, stack_trace STRING, context MAP<STRING, STRING>, recovery_steps ARRAY<STRING>, resolved BOOLEAN, resolution_time TIMESTAMP",
    "topic": "id STRING, name STRING, prerequisites ARRAY<STRING>, difficulty STRING, subject STRING, learning_objectives ARRAY<STRING>, estimated_duration INT",
    "standard": "standard_id STRING, standard_type STRING, subject_area STRING, grade_level ARRAY<INT>, description STRING, prerequisites ARRAY<STRING>, learning_objectives ARRAY<STRING>, keywords ARRAY<STRING>",
    "query_metric": "timestamp TIMESTAMP, query_text STRING, duration_ms DOUBLE, num_chunks INT, num_tokens INT, cache_hit BOOLEAN, labels MAP<STRING, STRING>",
}
