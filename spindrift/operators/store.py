"""Changes to a vector store that is a table: each gives the table after the change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of table whose key new does not have."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def insert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Adds rows without a key under a digest of what they hold."""
    body = F.to_json(F.struct(*[c for c in new.columns if c != key]))
    return table.unionByName(new.withColumn(key, F.sha2(body, 256)))


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def deleted_count(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One row: how many rows delete takes out."""
    return table.join(ids.select(key), key, "left_semi").agg(F.count("*").alias("deleted"))


def get(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == value)


def merged(old: Column, new: Column) -> Column:
    """Map with new's entries over old's."""
    return F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def merge_metadata(table: DataFrame, changes: DataFrame, key: str, metadata: str = "metadata") -> DataFrame:
    """table with the metadata of changes (key and metadata) merged in."""
    joined = table.join(changes.select(key, F.col(metadata).alias("_new")), key, "left")
    return joined.withColumn(metadata, F.when(F.col("_new").isNull(), F.col(metadata)).otherwise(merged(F.col(metadata), F.col("_new")))).drop("_new")


def info(table: DataFrame, name: str, vector: str = "embedding") -> DataFrame:
    return table.agg(F.count("*").alias("n_vectors"), F.max(F.size(vector)).alias("dimension")).select(F.lit(name).alias("name"), "dimension", "n_vectors", F.lit("ready").alias("status"))


def expired(created: Column, ttl_seconds: Column, now: Column) -> Column:
    """Whether an entry's time is over; without a time to live never."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(created.cast("timestamp"))
    return F.coalesce((ttl_seconds > 0) & (age > ttl_seconds), F.lit(False))


def age_hours(created: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 3.6e9


def chunk_list(chunks: DataFrame, key: str, value, order: Sequence[str], most: int = 1024, offset: int = 0) -> DataFrame:
    return chunks.filter(F.col(key) == value).orderBy(*order).offset(offset).limit(most)


def run_sql(spark, sql: str, **args) -> DataFrame:
    """A query over registered views, with named parameters."""
    return spark.sql(sql, args=args)
