"""A stored inverted index: postings as Parquet, read by term, with top-k searches that skip blocks.

Layout of the folder:

* postings/segment=S/bucket=B: a row for each term and block of a segment. A term's bucket is a hash of it. Documents are
  dealt to blocks of about `span` by a hash of their key, the same for all terms of a segment, so that a block's bounds of
  several terms add up. A row holds the block's keys, term frequencies and document lengths, their sums, and the bounds: the
  largest frequency and the least length.
* stored/segment=S/part=P: the documents' columns and their number of words, by a hash of the key.
* commits/commit=N: the segments that are live, and counts. What no commit names is not read, so a writer that dies leaves
  the index as it was; of two writers of one commit the second fails.
* means/commit=N: number of terms and mean idf, once a search has asked for them.

A top-k search reads the bounds of its terms' blocks first. The blocks of the largest bounds are scored; their k-th best
score is a threshold, and only blocks whose bounds reach it are scored in full. Results equal those of a full scan.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from spindrift.functions import text as T
from spindrift.functions import vector as V

from . import search as S
from .lineage import shared_folder

#: Buckets of terms, parts of stored documents, documents of a block, blocks that give the threshold.
BUCKETS, PARTS, SPAN, SEEDS = 32, 16, 256, 64
#: Bounds of a threshold are compared with this much room for rounding.
ROOM = 1e-9
#: Blocks of a bucket that one task writes, and tasks that write a bucket, at most (a power of two).
SLOT_BLOCKS, SPREAD = 1000, 64
#: Documents that a task stores and words that a task splits, about.
TASK_DOCS, TASK_WORDS = 8192, 500_000
#: Counts up when the files' columns change.
LAYOUT = 2


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _blocks(n_docs: int, span: int) -> int:
    """Number of blocks; large ones are multiples of SPREAD, so that segments deal their blocks to slots alike."""
    n = max(1, -(-n_docs // span))
    return n if n < 10 * SPREAD else -(-n // SPREAD) * SPREAD


def _slots(n_blocks: int) -> int:
    """Tasks that write a bucket: a power of two that divides the number of blocks, or one."""
    return min(SPREAD, 1 << max(0, (n_blocks // SLOT_BLOCKS).bit_length() - 1))


@dataclass(frozen=True)
class Commit:
    number: int
    segments: tuple[str, ...]
    blocks: tuple[int, ...]
    n_docs: int
    n_words: int


class Index:
    """An index of documents by key and text. Keys of one type, none twice; a null text has no words."""

    def __init__(self, spark: SparkSession, path: str, commit: Commit, about: Mapping[str, Any]):
        self.spark, self.path, self.commit = spark, path, commit
        self.key, self.text, self.buckets, self.parts, self.span = (about[x] for x in ("key", "text", "buckets", "parts", "span"))
        self.key_type, self.fields = about["key_type"], about["fields"]

    # --- writing

    @staticmethod
    def build(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, parts: int = PARTS, span: int = SPAN) -> Index:
        """A new index at path, which must not hold one."""
        about = {"key": key, "text": text, "buckets": buckets, "parts": parts, "span": span, "key_type": docs.schema[key].dataType.simpleString(), "fields": docs.schema.json()}
        empty = Index(docs.sparkSession, path, Commit(0, (), (), 0, 0), about)
        return empty.append(docs)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        """The index as its last commit left it."""
        last = spark.read.parquet(f"{path}/commits").orderBy(F.desc("commit")).first()
        commit = Commit(last["commit"], tuple(last["segments"]), tuple(last["blocks"]), last["n_docs"], last["n_words"])
        return Index(spark, path, commit, last.asDict())

    def append(self, docs: DataFrame) -> Index:
        """The index with further documents, as a segment of their own; what is there is not read."""
        n_docs = docs.count()
        # A part has as many tasks as it has documents for.
        tasks = self.parts * max(1, -(-n_docs // (TASK_DOCS * self.parts)))
        counted = docs.withColumn("n_words", F.coalesce(F.regexp_count(F.lower(self.text), F.lit(T.WORD)), F.lit(0)))
        dealt = counted.withColumn("part", self._part()).repartitionById(tasks, F.pmod(F.xxhash64(self.key), F.lit(tasks)).cast("int"))
        segment, stored, n_docs, n_words = self._store(dealt)
        n_blocks = _blocks(n_docs, self.span)
        # A task has whole blocks, so that counting and packing their words takes no further shuffle.
        tasks = max(1, min(n_blocks, max(-(-n_words // TASK_WORDS), min(self.spark.sparkContext.defaultParallelism, n_words * 4 // TASK_WORDS))))
        own = stored.select(self.key, "n_words", self.text, self._block(n_blocks)).repartition(tasks, "block")
        terms = own.select("block", self.key, "n_words", F.explode(T.words(F.col(self.text))).alias("term")).groupBy("block", "term", self.key, "n_words").agg(F.count("*").cast("int").alias("tf"))
        slots = _slots(n_blocks)
        packed = self._packed(terms, "block", "term").withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        self._write(packed.repartitionById(self.buckets * slots, (F.col("bucket") * slots + F.pmod("block", F.lit(slots))).cast("int")), segment)
        return self._commit((*self.commit.segments, segment), (*self.commit.blocks, n_blocks), self.commit.n_docs + n_docs, self.commit.n_words + n_words)

    def merge(self) -> Index:
        """All segments as one, whose blocks are dealt anew. No text is split into words again, and none is shuffled: it stays in its part."""
        segment, *_ = self._store(self._stored(self.commit.segments).drop("segment"))
        n_blocks = _blocks(self.commit.n_docs, self.span)
        slots = _slots(n_blocks)
        # A block of old lies in one slot if its segment's blocks are a multiple of slots; those of smaller segments are taken apart.
        rows = reduce(DataFrame.unionByName, (self._slotted(s, n, slots) for s, n in zip(self.commit.segments, self.commit.blocks, strict=True)))
        dealt = rows.repartition(self.buckets * slots, "bucket", "slot")
        each = _unpacked(dealt, self.key, "bucket", "slot", "term").withColumn("block", self._block(n_blocks))
        self._write(self._packed(each, "bucket", "slot", "term", "block"), segment)
        return self._commit((segment,), (n_blocks,), self.commit.n_docs, self.commit.n_words)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _block(self, n_blocks: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n_blocks)).cast("int").alias("block")

    def _slotted(self, segment: str, n_blocks: int, slots: int) -> DataFrame:
        rows = self._postings((segment,))
        if n_blocks % slots == 0:
            return rows.select("bucket", F.pmod("block", F.lit(slots)).alias("slot"), "term", "keys", "tfs", "words")
        each = _unpacked(rows, self.key, "bucket", "term").withColumn("slot", self._block(slots))
        return each.select("bucket", "slot", "term", F.array(self.key).alias("keys"), F.array("tf").alias("tfs"), F.array("n_words").alias("words"))

    def _store(self, dealt: DataFrame) -> tuple[str, DataFrame, int, int]:
        """Writes documents with n_words and part; the segment, its rows, and how many documents and words it has."""
        segment = uuid.uuid4().hex
        dealt.sortWithinPartitions("part", self.key).write.partitionBy("part").parquet(f"{self.path}/stored/segment={segment}")
        stored = self._stored((segment,))
        n, words = stored.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
        return segment, stored, n, words

    def _packed(self, each: DataFrame, *by: str) -> DataFrame:
        """A row for the postings (key, tf, n_words) of each group."""
        packed = each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(self.key, "tf", "n_words"))).alias("p"), F.sum("tf").alias("total"))
        return packed.select(
            *by, F.size("p").alias("n"), F.array_max("p.tf").alias("max_tf"), F.array_min("p.n_words").alias("min_words"), "total",
            F.col(f"p.{self.key}").alias("keys"), F.col("p.tf").alias("tfs"), F.col("p.n_words").alias("words"),
        )

    def _write(self, packed: DataFrame, segment: str) -> None:
        """Writes the rows as they are dealt. A file is ordered by term, so a reader skips to its terms."""
        rows = packed.select("bucket", "term", "block", "n", "max_tf", "min_words", "total", "keys", "tfs", "words")
        rows.sortWithinPartitions("bucket", "term", "block").write.option("parquet.block.size", 4 << 20).partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")

    def _commit(self, segments: tuple[str, ...], blocks: tuple[int, ...], n_docs: int, n_words: int) -> Index:
        number = self.commit.number + 1
        row = (number, list(segments), list(blocks), n_docs, n_words, self.key, self.text, self.key_type, self.fields, self.buckets, self.parts, self.span)
        kind = "number int, segments array<string>, blocks array<int>, n_docs long, n_words long, key string, text string, key_type string, fields string, buckets int, parts int, span int"
        _local(self.spark, [row], kind).write.parquet(f"{self.path}/commits/commit={number}")
        return Index(self.spark, self.path, Commit(number, segments, blocks, n_docs, n_words), vars(self))

    # --- reading

    def _stored(self, segments: Sequence[str]) -> DataFrame:
        schema = StructType([*StructType.fromJson(json.loads(self.fields)).fields, *StructType.fromDDL("n_words int, segment string, part int").fields])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/stored").parquet(*(f"{self.path}/stored/segment={s}" for s in segments))

    def stored(self) -> DataFrame:
        """The documents' columns and n_words."""
        return self._stored(self.commit.segments).drop("segment", "part")

    def fetch(self, keys: Sequence[Any]) -> DataFrame:
        """The stored rows of some keys, from their parts only."""
        kind = self.key_type
        parts = F.pmod(F.xxhash64(F.col("k").cast(kind)), F.lit(self.parts)).cast("int")
        wanted = _local(self.spark, [(k,) for k in keys], f"k {kind}").select(parts.alias("p")).distinct().collect()
        rows = self._stored(self.commit.segments).filter(F.col("part").isin([r["p"] for r in wanted]) & F.col(self.key).isin(list(keys)))
        return rows.drop("segment", "part")

    def _postings(self, segments: Sequence[str]) -> DataFrame:
        k = self.key_type
        schema = f"term string, block int, n int, max_tf int, min_words int, total long, keys array<{k}>, tfs array<int>, words array<int>, segment string, bucket int"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/postings").parquet(*(f"{self.path}/postings/segment={s}" for s in segments))

    def _frequencies(self, segments: Sequence[str]) -> DataFrame:
        return self._postings(segments).groupBy("term").agg(F.sum("n").alias("df"))

    def frequencies(self) -> DataFrame:
        """term, df and total (occurrences)."""
        return self._postings(self.commit.segments).groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("total"))

    @functools.cached_property
    def means(self) -> tuple[int, float]:
        """Number of terms and mean idf of all terms, stored beside the commit."""
        at = f"{self.path}/means/commit={self.commit.number}"
        if not _exists(self.spark, f"{at}/_SUCCESS"):
            df, n = F.col("df"), self.commit.n_docs
            sums = self._frequencies(self.commit.segments).agg(F.count("*").alias("n_terms"), F.avg(F.log(n - df + 0.5) - F.log(df + 0.5)).alias("mean_idf"))
            sums.write.mode("overwrite").parquet(at)
        return tuple(self.spark.read.schema("n_terms long, mean_idf double").parquet(at).first())

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """The blocks of some terms: other buckets are not read, and of a file only what may hold the terms."""
        buckets = [r[0] for r in _local(self.spark, [(t,) for t in terms], "t string").select(bucket_of(F.col("t"), self.buckets)).distinct().collect()]
        return self._postings(self.commit.segments).filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))

    # --- scoring

    def _scored(self, blocks: DataFrame, scores: Mapping[str, Any]) -> DataFrame:
        """key and score of each document of the blocks: the sum of its terms' scores of (tf, n_words)."""
        each = _unpacked(blocks, self.key, "term")
        return each.groupBy(self.key).agg(F.sum(_by_term(scores, F.col("tf"), F.col("n_words"))).alias("score"))

    def best(self, scores: Mapping[str, Any], k: int, blocks: DataFrame | None = None) -> DataFrame:
        """key and score of the k best documents. scores: of each term a function of (tf, n_words) that rises with tf and falls with n_words."""
        if k < 1:
            raise ValueError("k must be positive")
        blocks = self.postings(list(scores)) if blocks is None else blocks
        bound = F.greatest(_by_term(scores, F.col("max_tf"), F.col("min_words")), F.lit(0.0))
        bounds = blocks.groupBy("segment", "block").agg(F.sum(bound).alias("bound"))
        first = bounds.orderBy(F.desc("bound"), "segment", "block").limit(SEEDS + 1).collect()
        if len(first) <= SEEDS:
            return S.top(self._scored(blocks, scores), k, key=self.key)
        named = F.struct("segment", "block").isin([F.struct(F.lit(r["segment"]), F.lit(r["block"])) for r in first[:SEEDS]])
        seeds = S.top(self._scored(blocks.filter(named), scores), k, key=self.key).collect()
        if len(seeds) < k:
            return S.top(self._scored(blocks, scores), k, key=self.key)
        least = seeds[-1]["score"]
        kept = bounds.filter(F.col("bound") >= least - ROOM * abs(least) - ROOM).select("segment", "block")
        return S.top(self._scored(blocks.join(kept, ["segment", "block"], "left_semi"), scores), k, key=self.key)

    def keyword(self, query: str, k: int) -> DataFrame:
        """key, score and exact_match as search.keyword_search gives them."""
        terms = S.query_words(query)
        n = float(len(terms))
        hits = self.best({t: (lambda tf, _, times=terms.count(t): tf * times / n) for t in dict.fromkeys(terms)}, k).collect()
        found = _local(self.spark, hits, f"{self.key} {self.key_type}, score double")
        texts = self.fetch([h[0] for h in hits]).select(self.key, F.lower(self.text).contains(query.lower()).alias("exact_match"))
        return S.top(found.join(F.broadcast(texts), self.key), k, key=self.key)

    def _bm25_scores(self, blocks: DataFrame, terms: Sequence[str], k1: float, b: float, epsilon: float) -> dict[str, Any]:
        df = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        n, mean = self.commit.n_docs, self.commit.n_words / max(1, self.commit.n_docs)
        out = {}
        for t in dict.fromkeys(terms):
            if t in df:
                idf = math.log(n - df[t] + 0.5) - math.log(df[t] + 0.5)
                idf = terms.count(t) * (idf if idf >= 0 else epsilon * self.means[1])
                out[t] = lambda tf, words, idf=idf: F.lit(idf) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * words / F.lit(mean))))
        return out

    def bm25(self, query: str, k: int | None = None, *, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
        """key and bm25 of the k best documents as search.bm25 gives them; without k, of all documents that hold a term (the others have 0)."""
        terms = S.query_words(query)
        blocks = self.postings(list(dict.fromkeys(terms)))
        scores = self._bm25_scores(blocks, terms, k1, b, epsilon)
        if k is None:
            return self._scored(blocks, scores).withColumnRenamed("score", "bm25") if scores else self._none()
        hits = self.best(scores, k, blocks).collect() if scores else []
        rows = _local(self.spark, hits, f"{self.key} {self.key_type}, score double")
        if len(hits) < k or hits[-1]["score"] < 0:
            # Documents without any of the words have 0 and rank with the others.
            own = self._scored(blocks, scores).select(self.key) if scores else self._none().select(self.key)
            others = self.stored().select(self.key).join(own, self.key, "left_anti").orderBy(self.key).limit(k)
            rows = rows.unionByName(others.withColumn("score", F.lit(0.0)))
        return S.top(rows, k, key=self.key).withColumnRenamed("score", "bm25")

    def _none(self) -> DataFrame:
        return _local(self.spark, [], f"{self.key} {self.key_type}, bm25 double")

    # --- both

    def bm25_vector(self, vectors: DataFrame, query: str, vector: Sequence[float], k: int, weight: float = 0.7) -> DataFrame:
        """search.bm25_vector's rows."""
        dots = vectors.select(F.col("vec_id").alias(self.key), V.dot(F.col("embedding"), V.literal(vector)).alias("vector_score"))
        own = dots.join(self.stored().select(self.key), self.key, "left_semi").join(self.bm25(query), self.key, "left")
        scored = own.withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
        return S.top(scored.withColumn("score", weight * F.col("vector_score") + (1 - weight) * F.col("bm25")), k, key=self.key)

    def hybrid(self, vectors: DataFrame, query: str, vector: Sequence[float], k: int, *, semantic_weight: float = 0.7, keyword_weight: float = 0.3, boost: float = 1.0, filters: Mapping[str, Any] | None = None) -> DataFrame:
        """search.hybrid_search's rows, filters last; only the hits' stored fields are read."""
        S.check_weights(semantic_weight, keyword_weight)
        own = vectors.withColumnRenamed("vec_id", self.key)
        semantic = S.vector_search(own, vector, k, metric="dot", key=self.key).select(self.key, "score")
        combined = S.combine(semantic, self.keyword(query, k), semantic_weight, keyword_weight, boost, key=self.key)
        if filters:
            hits = combined.collect()
            combined = _local(self.spark, hits, combined.schema)
            fields = self.fetch([h[0] for h in hits]).select(self.key, *filters)
            combined = combined.join(F.broadcast(fields), self.key).filter(S.where(filters))
        return S.top(combined, k, key=self.key).select(self.key, "semantic_score", "keyword_score", "score")


def _by_term(scores: Mapping[str, Any], tf: Column, n_words: Column) -> Column:
    return reduce(lambda out, t: F.when(F.col("term") == t, scores[t](tf, n_words)).otherwise(out), scores, F.lit(0.0))


def _unpacked(rows: DataFrame, key: str, *others: str) -> DataFrame:
    """others, key, tf and n_words of each posting."""
    each = rows.select(*others, F.explode(F.arrays_zip("keys", "tfs", "words")).alias("p"))
    return each.select(*others, F.col("p.keys").alias(key), F.col("p.tfs").alias("tf"), F.col("p.words").alias("n_words"))


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _local(spark: SparkSession, rows: Sequence[tuple], schema: Any) -> DataFrame:
    """A few rows as a part of the plan, which takes no job to read."""
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kinds, strict=True)], names=kinds.names), kinds)


_opened: dict[tuple[str, str], Index] = {}


def new_path(spark: SparkSession) -> str:
    """A place for an index in the shared folder."""
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


def index_of(spark: SparkSession, path: str, **options: Any) -> Index:
    """The index of the documents at path, in the shared folder: built once for a state of their files, then opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length").collect()
    state = hashlib.md5(repr((sorted(map(tuple, files)), sorted(options.items()), LAYOUT)).encode()).hexdigest()
    at = f"{shared_folder(spark)}/index-{state}"
    if (spark.sparkContext.applicationId, state) not in _opened:
        there = _exists(spark, f"{at}/commits/commit=1/_SUCCESS")
        _opened[spark.sparkContext.applicationId, state] = Index.open(spark, at) if there else Index.build(spark.read.parquet(path), at, **options)
    return _opened[spark.sparkContext.applicationId, state]
