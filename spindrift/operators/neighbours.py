"""The nearest vectors of each of many query vectors: an exact join in blocks, and an inverted file that probes a part.

Both deal queries and vectors to cells and let each cell's block of queries meet its block of vectors in one matrix product
within a task, of which no more than k rows a query leave it. Nothing passes through the driver but counts and, for the
inverted file, its centroids.

Similarity is the cosine. Null vectors, and those with a null or non-finite entry or of length zero, are neither found nor
answered; vectors of different sizes do not meet. Ids are whole numbers, none twice on a side. Equal scores rank by id.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import checkpointed, shared_folder

#: Rows of a block of vectors and of a block of queries: what a task holds of either side.
BLOCK_ROWS, BLOCK_QUERIES = 50_000, 50_000
#: Queries of one matrix product.
AT_ONCE = 256
#: Rows of the sample that centroids are fitted on, for each centroid, and rounds of fitting.
SAMPLE_ROWS, ROUNDS = 64, 8
#: Vectors whose exact neighbours set the number of probes.
TUNE_QUERIES = 256
#: Centroids at most: they are sent to every task.
MOST_CELLS = 65_536


def _sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v and size of the vectors that can be compared."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(good).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.size(vector).alias("size"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows of a column of lists of one size."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    # Scaled first, so that squares of large entries stay finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of queries, ids of rows, scores: the k best rows of each query, in parts."""
    n = min(k, len(ids))
    for start in range(0, len(queries), AT_ONCE):
        scores = queries[start : start + AT_ONCE] @ rows.T
        least = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
        at, of = np.nonzero(scores >= least[:, None])
        order = np.lexsort((ids[of], -scores[at, of], at))
        at, of = at[order], of[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < n
        yield query_ids[start + at[kept]], ids[of[kept]], scores[at[kept], of[kept]]


HITS = "query_id long, id long, score double"


def _in_cells(queries: DataFrame, vectors: DataFrame, cell: list[str], k: int) -> DataFrame:
    """query_id, id and score of the k best of each query and cell. Both sides have cell's columns, id and v."""

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and rows.num_rows:
            found = list(nearest(_matrix(asked["v"]), asked["id"].to_numpy(), _matrix(rows["v"]), rows["id"].to_numpy(), k))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "score"), columns, strict=True)))

    return queries.groupBy(*cell).cogroup(vectors.groupBy(*cell)).applyInArrow(meet, HITS)


def _best(hits: DataFrame, k: int, key: str) -> DataFrame:
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("id").alias(key), "score", "rank")


def _blocks(n: int, rows: int) -> int:
    return max(1, -(-n // rows))


def _dealt(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def vector_join(vectors: DataFrame, queries: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, key, score and rank: the k most similar vectors of each query, among all of them.

    Both sides are dealt to the cells of a grid by hashes of their ids: a block of queries goes to each block of vectors, so
    the vectors are sent once for each block of queries and are read once.
    """
    if k < 1:
        raise ValueError("k must be positive")
    n_rows, n_asked = _blocks(vectors.count(), block_rows), _blocks(queries.count(), block_queries)
    rows = _sound(vectors, key, vector).withColumn("i", _dealt(n_rows)).withColumn("j", F.explode(F.array(*map(F.lit, range(n_asked)))))
    asked = _sound(queries, key, vector).withColumn("j", _dealt(n_asked)).withColumn("i", F.explode(F.array(*map(F.lit, range(n_rows)))))
    return _best(_in_cells(asked, rows, ["size", "i", "j"], k), k, key)


class InvertedFile:
    """Vectors by their nearest centroid, as Parquet. Centroids are fitted on a sample; every vector is stored."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, key: str):
        self.spark, self.path, self.centroids, self.key = spark, path, centroids, key

    @staticmethod
    def build(vectors: DataFrame, path: str | None = None, *, cells: int | None = None, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, seed: int = 7) -> InvertedFile:
        """cells: by default the square root of the number of vectors. Centroids come from at most SAMPLE_ROWS rows a cell (those of least hash).

        A cell of more than block_rows vectors is split into blocks. All vectors must have one size.
        """
        spark = vectors.sparkSession
        path = path or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
        sound = _sound(vectors, key, vector)
        sizes = sound.groupBy("size").count().collect()
        if len(sizes) > 1:
            raise ValueError("vectors have different sizes")
        n = sizes[0]["count"] if sizes else 0
        cells = min(cells or max(1, math.isqrt(n)), MOST_CELLS)
        sample = sound.select("v").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE_ROWS * cells).toArrow()
        centroids = fit_centroids(_matrix(sample["v"]), cells, seed) if sample.num_rows else np.zeros((1, 1))
        placed = placed_in(sound, centroids, 1).select("id", "v", F.col("cells")[0].alias("cell"))
        placed.write.parquet(f"{path}/placed")
        placed = spark.read.schema("id long, v array<double>, cell int").parquet(f"{path}/placed")
        blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        blocks.coalesce(1).write.parquet(f"{path}/blocks")
        return InvertedFile(spark, path, centroids, key)

    def search(self, queries: DataFrame, k: int, probes: int, *, vector: str = "embedding") -> DataFrame:
        """query_id, key, score and rank: the k most similar among the vectors of each query's nearest cells, of which probes are looked at."""
        # One row for each centroid, of which there are MOST_CELLS at most.
        blocks = F.broadcast(self.spark.read.schema("cell int, blocks int").parquet(f"{self.path}/blocks"))
        asked = placed_in(_sound(queries, self.key, vector).filter(F.col("size") == self.centroids.shape[1]), self.centroids, probes)
        asked = asked.select("id", "v", F.explode("cells").alias("cell")).join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        rows = self.spark.read.schema("id long, v array<double>, cell int").parquet(f"{self.path}/placed").join(blocks, "cell")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        # A cell's queries are dealt to groups of about BLOCK_QUERIES, each of which meets the cell's blocks.
        groups = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("groups"))
        groups = F.broadcast(checkpointed(groups))
        asked = asked.join(groups, "cell").withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")).drop("groups")
        rows = rows.join(groups, "cell").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        return _best(_in_cells(asked, rows, ["cell", "block", "group"], k), k, self.key)

    def probes_for(self, vectors: DataFrame, k: int, recall: float, *, vector: str = "embedding", seed: int = 11) -> int:
        """How many cells hold this share of the k nearest other vectors of TUNE_QUERIES vectors (those of least hash), by an exact search of all rows."""
        some = vectors.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(self.key, F.lit(seed)), self.key).limit(TUNE_QUERIES)
        asked = _sound(some, self.key, vector).toArrow()
        if not asked.num_rows:
            return 1
        queries = self.spark.createDataFrame(asked).select(F.col("id").alias(self.key), F.col("v").alias(vector))
        placed = self.spark.read.schema("id long, v array<double>, cell int").parquet(f"{self.path}/placed").select(F.col("id").alias(self.key), "cell")
        hits = vector_join(vectors, queries, k + 1, key=self.key, vector=vector).filter(F.col("query_id") != F.col(self.key))
        pairs = hits.join(placed, self.key).select("query_id", "cell").collect()
        order = np.argsort(-(_matrix(asked["v"]) @ self.centroids.T), axis=1, kind="stable")
        place = {q: np.argsort(o) for q, o in zip(asked["id"].to_pylist(), order, strict=True)}
        needed = sorted(int(place[r["query_id"]][r["cell"]]) + 1 for r in pairs)
        return needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)] if needed else 1


def fit_centroids(x: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Unit centroids of unit rows by rounds of nearest means; a centroid that no row is nearest to takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own, near = np.zeros(len(x), np.int64), np.zeros(len(x))
        for start in range(0, len(x), 4096):
            scores = x[start : start + 4096] @ centroids.T
            own[start : start + 4096], near[start : start + 4096] = scores.argmax(1), scores.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        sums[empty] = x[np.argsort(near)[: len(empty)]]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centroids


def placed_in(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """id, v and cells: the n nearest centroids of each row."""
    sent, n = rows.sparkSession.sparkContext.broadcast(centroids), min(n, len(centroids))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                some = batch.slice(start, 1024)
                scores = _matrix(some.column(1)) @ sent.value.T
                cells = np.argpartition(-scores, n - 1, axis=1)[:, :n].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * n), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), lists], names=["id", "v", "cells"])

    return rows.select("id", "v").mapInArrow(place, "id long, v array<double>, cells array<int>")
