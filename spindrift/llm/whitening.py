"""Whitens vectors by the covariance of all of them.

Columns are summed first; then one aggregation holds a generated SQL expression, the sum of the
centred values' products, for each pair of dimensions of the upper triangle. The triangle is cut
into tiles of TILE by TILE pairs, which are the aggregation's groups, so that any number of
dimensions takes the same expressions and tasks send a row of sums for each tile. The covariance (a number for each pair of dimensions) reaches
the driver, where LAPACK takes it apart; rows are projected in Arrow batches. A last aggregation
of the same kind measures how far the projected values' covariance is from the identity.

Values become whole numbers, floor(SCALE * c) + SHIFT, so sums are exact; what a product takes is
n * x - S (exact) over n.

Defined cases: a vector that is null or holds a null or non-finite entry is dropped, and so is one
that has not the length that most of the others have (the larger of two lengths that are as
common), or has none. Repeated rows count each. A component without variance (its eigenvalue is
below EPSILON of the trace) has whitened null and is left out of identity_error. An empty table
gives no rows. Columns but the id and the vector are not read, ids may be null. Whole numbers
are 64 bits: a value beyond them is an error, not a wrong sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table, written

#: x = floor(SCALE * c) + SHIFT. Components that are returned at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Eigenvalues below this share of the trace count as zero.
EPSILON = 1e-12
#: Tasks whose sums meet in the first of two steps. Side of a tile of dimension pairs: TILE ** 2 sums stay below the 100 columns up to which
#: Spark compiles an aggregation as a whole.
GROUPS, TILE = 64, 8


def fit_list(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and x, the whole numbers of each vector that remains."""
    v = F.col(vector).cast("array<double>")
    sound = vectors.filter(F.col(vector).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    lengths = sound.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = lengths[0]["size"] if lengths else 0
    return sound.filter((F.size(vector) == size) & F.lit(size > 0)).select(F.col(key).alias("key"), F.transform(v, lambda c: F.floor(F.lit(SCALE) * c) + SHIFT).alias("x"))


def sums(df: DataFrame, values: Column, d: int) -> list:
    """Sum of each of the d places of an array column, and the number of rows at the end; by task, by group of tasks, then over all."""
    columns = df.select(*(values[i].alias(f"c{i}") for i in range(d)))
    by_group = columns.groupBy((F.spark_partition_id() % GROUPS).alias("g")).agg(*(F.expr(f"sum(c{i}) AS c{i}") for i in range(d)), F.count("*").alias("n"))
    return list(by_group.agg(*(F.expr(f"sum(c{i})") for i in range(d)), F.sum("n")).first())


def pair_sums(side: int = TILE) -> list[str]:
    """SQL for the products of each dimension of a tile's rows with each of its columns."""
    return [f"sum(get(a, {i}) * get(b, {j})) AS p{i}_{j}" for i in range(side) for j in range(side)]


def covariance(df: DataFrame, centred: Column, d: int, n: int) -> np.ndarray:
    """Covariance of an array column's d places, already centred, with divisor n."""
    blocks = -(-d // TILE)
    tiles = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(blocks) for j in range(i, blocks)))
    each = df.select(centred.alias("c")).select("c", F.explode(tiles).alias("t"))
    sides = each.select("t", F.slice("c", F.col("t.i") * TILE + 1, TILE).alias("a"), F.slice("c", F.col("t.j") * TILE + 1, TILE).alias("b"))
    out = np.zeros((blocks * TILE, blocks * TILE))
    for r in sides.groupBy("t").agg(*map(F.expr, pair_sums())).collect():
        at = slice(r["t"]["i"] * TILE, (r["t"]["i"] + 1) * TILE), slice(r["t"]["j"] * TILE, (r["t"]["j"] + 1) * TILE)
        out[at] = np.array([x or 0.0 for x in r[1:]]).reshape(TILE, TILE) / n
    upper = np.triu(out[:d, :d])
    return upper + np.triu(upper, 1).T


class Whitening:
    """What fit finds: n, S (sums of whole numbers), eigenvalues and unit eigenvectors by falling eigenvalue, trace."""

    def __init__(self, n: int, sums: list[int], covariances: np.ndarray):
        self.n, self.sums = n, sums
        values, vectors = np.linalg.eigh(covariances)
        self.values, self.vectors = values[::-1].copy(), vectors[:, ::-1].copy()
        self.trace = float(np.trace(covariances))
        self.explained = [float(e / self.trace) if self.trace > 0 else None for e in self.values]
        self.sound = [bool(e > EPSILON * self.trace) for e in self.values]


def fit(vectors: DataFrame) -> Whitening | None:
    """vectors: fit_list's rows, cheap to read again. None if there are none."""
    first = vectors.select(F.size("x").alias("size")).first()
    if first is None:
        return None
    d = first["size"]
    *total, n = sums(vectors, F.col("x"), d)
    centred = F.array(*((F.lit(n) * F.col("x")[i] - F.lit(s)).cast("double") / F.lit(float(n)) for i, s in enumerate(total)))
    return Whitening(n, total, covariance(vectors, centred, d, n))


def whiten(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """key, deviation and whitened (an array of a value for each of the first components) of fit_list's rows."""
    k = min(components, len(model.sums))
    scale = np.array([1 / np.sqrt(e) if ok else 0.0 for e, ok in zip(model.values[:k], model.sound, strict=False)])
    weights, n, sums, d, sound = model.vectors[:, :k] * scale, model.n, np.array(model.sums, np.int64), len(model.sums), np.array(model.sound[:k])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            centred = (n * x - sums) / n
            z = centred @ weights
            missing = np.broadcast_to(~sound, z.shape).ravel()
            values = pa.array(z.ravel(), mask=missing if missing.any() else None)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * k), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["key", "x", "whitened"])

    kind = vectors.schema["key"].dataType.simpleString()
    out = vectors.mapInArrow(project, f"key {kind}, x array<bigint>, whitened array<double>")
    deviations = [F.col("x")[i] * F.lit(n) - F.lit(s) for i, s in enumerate(model.sums)]
    deviation = F.aggregate(F.array(*deviations), F.lit(0).cast("long"), lambda total, c: total + c * c)
    return out.select("key", deviation.alias("deviation"), "whitened")


def identity_error(whitened: DataFrame, model: Whitening, components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity. whitened: whiten's rows."""
    kept = [i for i in range(min(components, len(model.sums))) if model.sound[i]]
    if not kept:
        return 0.0
    kept_values = F.array(*(F.col("whitened")[i] for i in kept))
    *total, n = sums(whitened, kept_values, len(kept))
    centred = F.array(*(F.col("whitened")[i] - F.lit(s / n) for i, s in zip(kept, total, strict=True)))
    return float(np.abs(covariance(whitened, centred, len(kept), n) - np.eye(len(kept))).max())


RESULT = "vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_rows(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component."""
    whole = written(fit_list(vectors, key, vector))
    model = fit(whole)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT.format(kind=vectors.schema[key].dataType.simpleString()))
    rows = written(whiten(whole, model, components))
    error = identity_error(rows, model, components)
    explained = F.array(*(F.lit(e).cast("double") for e in model.explained[:components]))
    each = rows.select("key", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        F.col("key").alias("vec_id"), (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitened_vectors": op13_whitened_vectors}
#: Eigenvectors are beyond SQL; tests compare with numpy.
ORACLES: dict[str, str] = {}
