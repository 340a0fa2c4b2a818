"""Aggregates over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import vector as V


def centroids(vectors: DataFrame, by: str, *, weight: str | None = None, unit: bool = True, vector: str = "embedding") -> DataFrame:
    """by and centroid: mean (weighted by a column) of each group's vectors, of length 1 if unit. Sums are taken by place before the shuffle."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    places = vectors.select(by, w.alias("_w"), F.posexplode(F.col(vector).cast("array<double>")).alias("_i", "_x"))
    means = places.groupBy(by, "_i").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"))
    out = means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))
    return out.withColumn("centroid", V.normalized(F.col("centroid"))) if unit else out


def quality(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: how many vectors and dimensions, share of zeros, mean and spread of norms."""
    rows = vectors.select(F.size(vector).alias("dims"), V.norm(F.col(vector)).alias("norm"), F.size(F.filter(vector, lambda x: F.abs(x) < 1e-6)).alias("zeros"))
    return rows.agg(F.count("*").alias("n_vectors"), F.max("dims").alias("dims"), F.try_divide(F.sum("zeros"), F.sum("dims")).alias("zero_share"), F.avg("norm").alias("mean_norm"), F.stddev_pop("norm").alias("std_norm"))


def chain_similarity(vectors: DataFrame, chain: str, order: str, vector: str = "embedding") -> DataFrame:
    """Mean and spread of the cosine of neighbours in each chain."""
    following = F.lead(vector).over(Window.partitionBy(chain).orderBy(order))
    pairs = vectors.select(chain, V.cosine(F.col(vector), following).alias("s")).filter("s IS NOT NULL")
    return pairs.groupBy(chain).agg(F.avg("s").alias("mean_similarity"), F.stddev_pop("s").alias("std_similarity"))


def pooled(tokens: DataFrame, by: str, order: str, how: str = "mean", vector: str = "embedding") -> DataFrame:
    """One vector of a group's token vectors: mean, max, or weighted (falling linearly with the place)."""
    n = F.count("*").over(Window.partitionBy(by))
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    weighted = tokens.withColumn("_w", 1 - place / n if how == "weighted" else F.lit(1.0))
    places = weighted.select(by, "_w", F.posexplode(F.col(vector).cast("array<double>")).alias("_i", "_x"))
    value = {"mean": F.avg("_x"), "max": F.max("_x"), "weighted": F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")}[how]
    cells = places.groupBy(by, "_i").agg(value.alias("_m"))
    return cells.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("pooled"))


def clustered(vectors: DataFrame, k: int, seed: int = 42, vector: str = "embedding") -> DataFrame:
    """vectors with cluster, by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows).transform(rows).drop("_v")


def reduced(vectors: DataFrame, dims: int = 2, vector: str = "embedding") -> DataFrame:
    """vectors with reduced: principal components of the centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(rows).transform(rows)
    out = PCA(k=dims, inputCol="_c", outputCol="_p").fit(centred).transform(centred)
    return out.withColumn("reduced", vector_to_array("_p")).drop("_v", "_c", "_p")
