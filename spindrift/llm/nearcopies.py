"""Near copies by improved consistent weighted sampling over TF-IDF shingles.

A text's features are its runs of SHINGLE words (ASCII letters in lower case), each weighing its count times
an inverse document frequency. Each of BANDS * ROWS hashes samples one shingle of a text with
probability proportional to weight, the same one in two texts with the probability of their weighted
Jaccard similarity. Texts that agree in all hashes of a band are candidates, and linked if their weighted
Jaccard similarity, computed from all their shingles, is 0.8 or more. Classes are the connected
components of links and of equal texts.

Document frequencies are counted over all texts, exactly for each shingle that is frequent enough to matter (see frequencies()). The
inverse goes with their logarithm from 1 (in all texts) to 1 + STRENGTH (rare; a parameter). With a STRENGTH of 1, copies of a text with thousands of
near copies fall below 0.8, as their few edits are rare and all that they share is not. For sampling, weights are rounded to a grid of factor GRID, and only the shingle of a
sample is kept (0-bit sampling); links use exact weights.

Large groups: equal texts are one node. In each band's bucket every node is compared with one of its
nodes, the one that shares most buckets with others; links join most of a bucket at once, and only nodes
that still are in different components are compared with each other. Of these, pairs are left out
that cannot be similar, as maps of their shingles differ in too many bits. So a group of n near copies
takes about n comparisons, and no link between components is lost.

Defined cases: a null text is the empty text; texts of fewer words than SHINGLE have one shorter run; texts
without a word are near only equal ones; equal rows are in one class; a null doc_id has a
class like any other (whose id is null only if all its ids are).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .flatwords import chunks, mix, shingles, words
from .histogram import BUCKETS, histogram
from .runtime import by_text, checkpoint, frugal, table

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 5
#: Shingles whose document frequencies are known at most; step of the grid of weights.
LISTED, GRID = 1 << 18, 1.1
#: What a rare shingle weighs more than one of all texts.
STRENGTH = 0.25
#: Texts of a chunk: their numbers take 12 of 64 bits, a shingle 52.
TEXTS, BITS = 1 << 12, 52
#: Nodes whose shingles may be asked for by a broadcast; beyond it by a shuffle.
BROADCAST_ROWS = 200_000
DRAWS = 1 << 16
#: Words of a map of shingles.
MAP = 16


def _bags(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle and count of each different shingle of a chunk's texts, in order of both."""
    hashes, owner = shingles(words(raw, at, True), SHINGLE)
    key = owner.astype(np.uint64) << np.uint64(BITS) | hashes >> np.uint64(64 - BITS)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> np.uint64(BITS)).astype(np.int64), key & np.uint64(2**BITS - 1), count


@dataclass(frozen=True)
class Frequencies:
    """Inverse document frequencies: of the listed shingles, and of all others."""

    shingle: np.ndarray  # in order
    idf: np.ndarray
    other: float
    listed: np.ndarray  # whether a bucket holds a listed shingle

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(shingles), self.other)
        some = np.flatnonzero(self.listed[(shingles % np.uint64(BUCKETS)).astype(np.int64)])
        if len(some):
            asked = shingles[some]
            at = np.minimum(np.searchsorted(self.shingle, asked), len(self.shingle) - 1)
            out[some] = np.where(self.shingle[at] == asked, self.idf[at], self.other)
        return out


def inverse(df: np.ndarray, n: int, least: int, strength: float = STRENGTH) -> np.ndarray:
    """From 1, of a shingle of all n documents, to 1 + strength, of one of at most least documents."""
    if n <= least:
        return np.full(np.shape(df), 1 + strength)
    return 1 + strength * np.log(n / np.clip(df, least, n)) / np.log(n / least)


def frequencies(docs: DataFrame, strength: float = STRENGTH) -> Frequencies:
    """Exact document frequencies of all shingles of at least one in LISTED of all pairs of a document and a shingle, rounded up.

    Those of LISTED shingles would make up all pairs, so no more than LISTED reach the driver; rarer ones weigh as much as the rarest listed.
    """

    def buckets(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, raw, at in chunks(texts, rows=TEXTS):
            yield _bags(raw, at)[1] % np.uint64(BUCKETS)

    texts = by_text(docs.select("text"))
    counts = histogram(texts, buckets)
    least = max(1, -(-int(counts.sum()) // LISTED))
    sent = docs.sparkSession.sparkContext.broadcast(counts >= least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, waiting = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, place = np.unique(np.concatenate([shingle, *held]), return_inverse=True)
            return every, np.bincount(place, np.r_[n, np.ones(waiting, np.int64)], minlength=len(every)).astype(np.int64)

        for batch in batches:
            for _, _, raw, at in chunks(batch.column(0), rows=TEXTS):
                found = _bags(raw, at)[1]
                held.append(found[sent.value[(found % np.uint64(BUCKETS)).astype(np.int64)]])
                waiting += len(held[-1])
                if waiting > 1 << 20:
                    shingle, n = merged()
                    held, waiting = [], 0
        shingle, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    rows = texts.mapInArrow(frugal(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas()
    shingle, n = rows["shingle"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(shingle)
    listed = np.zeros(BUCKETS, bool)
    listed[(shingle % np.uint64(BUCKETS)).astype(np.int64)] = True
    total = docs.count()
    return Frequencies(shingle[order], inverse(n[order], total, least, strength), 1 + strength, listed)


class Sampler:
    """Consistent weighted samples of many texts at once.

    The Gamma and uniform draws of a shingle under a hash come from a table of DRAWS triples, at a place that
    the hash picks. For each step of the weight grid the table's outcome is computed once; the least
    outcome of a text, and of equal ones the least shingle, is its sample.
    """

    def __init__(self) -> None:
        rng = np.random.default_rng(1)
        u = rng.random((5, DRAWS))
        self.r = -np.log(u[0] * u[1])
        self.c = np.log(-np.log(u[2] * u[3]))
        self.beta = u[4]
        self.factors = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        self.levels: dict[int, np.ndarray] = {}

    def outcomes(self, level: int) -> np.ndarray:
        if level not in self.levels:
            t = np.floor(level * np.log(GRID) / self.r + self.beta)
            a = (self.c - self.r * (t - self.beta) - self.r).astype(np.float32).view(np.uint32)
            # The order of floats as unsigned integers.
            a = np.where(a >> 31 == 1, ~a, a | np.uint32(0x80000000))
            self.levels[level] = a.astype(np.uint64) << np.uint64(32)
        return self.levels[level]

    def __call__(self, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that have shingles, and the keys of their bands."""
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        level, place = np.unique(np.rint(np.log(weight) / np.log(GRID)).astype(np.int64), return_inverse=True)
        drawn = np.concatenate([self.outcomes(x) for x in level.tolist()])
        offset = place.astype(np.uint64) * np.uint64(DRAWS)
        h = mix(shingle)
        low = h & np.uint64(0xFFFFFFFF)
        keys = np.empty((len(first), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(first), band + 1, np.uint64)
            for factor in self.factors[band * ROWS : band * ROWS + ROWS]:
                at = (h * factor >> np.uint64(48)) + offset
                least = np.minimum.reduceat(drawn[at] | low, first)
                key = mix(key * np.uint64(0xD1342543DE82EF95) + (least & np.uint64(0xFFFFFFFF)))
            keys[:, band] = key
        return text[first], keys


def signed(docs: DataFrame, idf: Frequencies) -> DataFrame:
    """doc_id, node (a digest of the text), weight (total) and bands (keys, empty for a text without words) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sampler()
        for batch in batches:
            for a, b, raw, at in chunks(batch.column(2), rows=TEXTS):
                text, shingle, count = _bags(raw, at)
                weight = count * sent.value.of(shingle)
                total = np.bincount(text, weight, minlength=b - a)
                lengths, keys = np.zeros(b - a, np.int64), np.zeros(0, np.uint64)
                if len(text):
                    owner, keys = sample(text, shingle, weight)
                    lengths[owner] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(keys.reshape(-1).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(total, pa.float64()), bands], names=["doc_id", "node", "weight", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_text(docs.select("doc_id", _node(docs), "text")).mapInArrow(frugal(run), f"doc_id {kind}, node binary, weight double, bands array<long>")


def _node(docs: DataFrame):
    return F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))).alias("node")


def bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles and counts (binary: 64-bit integers; 16-bit ones, or 64-bit where a count needs it) of the wanted nodes."""
    wanted = wanted.select(F.col("node").alias("_n"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    own = docs.select(_node(docs), "text").join(wanted, F.col("node") == F.col("_n"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, at in chunks(batch.column(1), rows=TEXTS):
                text, shingle, count = _bags(raw, at)
                bound = np.searchsorted(text, np.arange(b - a + 1))
                cells = [(shingle[s:e].tobytes(), _packed(count[s:e])) for s, e in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s for s, _ in cells], pa.binary()), pa.array([c for _, c in cells], pa.binary())], names=["node", "shingles", "counts"])

    return by_text(own).mapInArrow(frugal(run), "node binary, shingles binary, counts binary").dropDuplicates(["node"])


def _packed(count: np.ndarray) -> bytes:
    if (count == 1).all():
        return b""
    return count.astype("<u2" if count.max() < 1 << 16 else "<u8").tobytes()


def _counts(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n}").astype(float) if packed else np.ones(n)


def similarity(a: bytes, m: bytes, b: bytes, n: bytes, idf: Frequencies) -> float:
    """Weighted Jaccard similarity of two bags."""
    u, v = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    x, y = _counts(m, len(u)), _counts(n, len(v))
    x, y = x * idf.of(u), y * idf.of(v)
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    same = np.flatnonzero(v[at] == u)
    shared = np.minimum(x[same], y[at[same]]).sum()
    return float(shared / (x.sum() + y.sum() - shared))


def verified(docs: DataFrame, pairs: DataFrame, idf: Frequencies) -> DataFrame:
    """u and v of the pairs whose weighted Jaccard similarity is SIMILAR or more."""
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    held = checkpoint(bags(docs, checkpoint(nodes)))
    left = held.select(F.col("node").alias("u"), F.col("shingles").alias("a"), F.col("counts").alias("m"))
    right = held.select(F.col("node").alias("v"), F.col("shingles").alias("b"), F.col("counts").alias("n"))
    sent = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "m", "b", "n")]
            fine = [similarity(*row, sent.value) >= SIMILAR for row in zip(*columns, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(fine, pa.bool_()))

    return pairs.join(left, "u").join(right, "v").mapInArrow(frugal(run), "u binary, v binary")


def maps(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and bits: MAP 64-bit words, in which each shingle of the node sets one bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a in batch.column(1).to_pylist():
                bits = np.zeros(64 * MAP, bool)
                bits[(mix(np.frombuffer(a, np.uint64)) % np.uint64(64 * MAP)).astype(np.int64)] = True
                rows.append(np.packbits(bits).view("<i8"))
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * MAP, pa.int32()), pa.array(flat, pa.int64()))], names=["node", "bits"])

    return bags(docs, nodes).mapInArrow(frugal(run), "node binary, bits array<long>")


def classes(docs: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """doc_id, node and class_node: a digest of each document's text and the least one of its class. strength: what a rare shingle weighs more than one of all texts."""
    idf = frequencies(docs, strength)
    each = checkpoint(signed(docs, idf))
    nodes = each.groupBy("node").agg(F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    buckets = checkpoint(nodes.select("node", "weight", F.explode("bands").alias("band")))
    sizes = checkpoint(buckets.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"))
    live = checkpoint(buckets.join(sizes, "band"))
    # A bucket's center is the node that meets most others in all its buckets: of copies of one text, that text or nearly so.
    live = checkpoint(live.join(live.groupBy("node").agg(F.sum("n").alias("met")), "node"))
    centers = checkpoint(live.groupBy("band").agg(F.max(F.struct("met", "node", "weight")).alias("c")).select("band", F.col("c.node").alias("center"), F.col("c.weight").alias("center_weight")))
    # What two texts weigh bounds their similarity.
    alike = lambda x, y: F.least(x, y) >= SIMILAR * F.greatest(x, y)
    first = live.join(centers, "band").filter((F.col("node") != F.col("center")) & alike(F.col("weight"), F.col("center_weight")))
    first = checkpoint(first.select(F.col("center").alias("u"), F.col("node").alias("v")).distinct())
    found = checkpoint(verified(docs, first, idf))
    joined = components(found)

    # Buckets that still hold two components: their nodes, but for those already compared, meet once.
    open_ = live.join(joined.select(F.col("u").alias("node"), F.col("v").alias("own")), "node", "left")
    open_ = checkpoint(open_.select("band", "node", "weight", F.coalesce("own", "node").alias("own")))
    mixed = open_.groupBy("band").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low != high").select("band")
    left = checkpoint(open_.join(checkpoint(mixed), "band", "left_semi"))
    drawn = checkpoint(maps(docs, left.select("node").distinct()))
    left = checkpoint(left.join(drawn, "node").join(left.groupBy("node").agg(F.collect_set("band").alias("bands")), "node"))
    # Bits that differ are shingles that differ, each of which weighs 1 at least; similar texts differ
    # by a ninth of what both weigh at most.
    x, y = left.alias("x"), left.alias("y")
    apart = reduce(lambda s, i: s + F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])), range(1, MAP), F.bit_count(F.col("x.bits")[0].bitwiseXOR(F.col("y.bits")[0])))
    # A pair meets in the least of its common buckets only.
    once = F.col("x.band") == F.array_min(F.array_intersect("x.bands", "y.bands"))
    bound = apart <= (F.col("x.weight") + F.col("y.weight")) * (1 - SIMILAR) / (1 + SIMILAR) * (1 + 1e-9)
    rest = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.own") != F.col("y.own")) & alike(F.col("x.weight"), F.col("y.weight")) & bound & once)
    rest = rest.select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct()
    compared = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    rest = checkpoint(rest.join(compared, ["u", "v"], "left_anti"))
    more = checkpoint(verified(docs, rest, idf))
    if not more.isEmpty():
        joined = components(found.unionByName(more))
    named = each.join(joined.select(F.col("u").alias("node"), F.col("v").alias("own")), "node", "left")
    return named.select("doc_id", "node", F.coalesce("own", "node").alias("class_node"))


def near_copies(docs: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size and text_id of every document."""
    found = checkpoint(classes(docs, strength))
    sizes = found.groupBy("class_node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return found.join(sizes, "class_node").select("doc_id", "class_id", "class_size", F.lower(F.hex("node")).alias("text_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies: of the least doc_id, then of the least digest of its text; any one of equal rows."""
    found = checkpoint(classes(docs))
    first = found.groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")).select("first")
    # A row's columns lie in a struct, so that their names do not matter.
    rows = docs.select(F.struct("*").alias("r"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("own"))
    kept = rows.join(first, F.col("r.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("own") == F.col("first.node")), "left_semi")
    # Rows of equal doc_id and text: a task's least of each suffices before the shuffle.
    kept = kept.withColumn("id", F.col("r.doc_id")).dropDuplicates(["id", "own"])
    return kept.select(*(F.col("r").getField(c).alias(c) for c in docs.columns))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


QUERIES = {"op6_near_copies": op6_near_copies}
ORACLES: dict[str, str] = {}
