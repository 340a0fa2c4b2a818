"""Weights of terms, synonyms, and segmentation by a dictionary."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T

from .search import document_frequencies


#: Bits of the filter of frequent n-grams; hashes that a task sorts at once; characters of text to a part, and powers of two of parts at least and at most.
FILTER, SORTED, CHARS, PARTS = 28, 1 << 22, 1 << 25, (8, 20)


def idf(n: Column, df: Column) -> Column:
    return F.log10(10 + (n - df + 0.5) / (df + 0.5))


def term_weights(queries: DataFrame, corpus: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """key, term and weight: count times idf, of sum 1 in each query."""
    counts = queries.select(key, F.explode(T.words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    joined = counts.join(document_frequencies(corpus, text), "term", "left").crossJoin(F.broadcast(corpus.agg(F.count("*").alias("n"))))
    weighted = joined.withColumn("w", F.col("tf") * idf(F.col("n"), F.coalesce("df", F.lit(0))))
    return weighted.select(key, "term", (F.col("w") / F.sum("w").over(Window.partitionBy(key))).alias("weight"))


def frequent_ngrams(docs: DataFrame, n: int, more: int, text: str = "text") -> DataFrame:
    """gram and n (how often) of the runs of n words that occur more than so often.

    Most runs are rare, so their hashes are counted first, at a few bytes each: 32 bits and the number of a part. A filter of the hashes that are
    frequent then goes to all tasks, and only runs that pass it are shuffled and counted by their words. A hash may stand for several runs,
    so the filter lets some rare runs pass, but no frequent one is lost.
    """
    return passing(docs, n, more, text).groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > more)


def passing(docs: DataFrame, n: int, more: int, text: str = "text") -> DataFrame:
    """gram: each run of n words whose hash is, by the filter, one of a frequent run."""
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    bits = min(max(PARTS[0], (chars // CHARS).bit_length()), PARTS[1])
    grams = docs.select(T.words(F.col(text)).alias("words")).select(F.explode(T.ngrams(F.col("words"), n)).alias("gram"))

    def packed(hash_: np.ndarray) -> pa.RecordBatch:
        """A row for each part: its hashes in order, each at most more + 1 times, as four planes of bytes, which compress well."""
        key = np.sort(hash_.view(np.uint64) >> np.uint64(32 - bits))
        key = key[np.r_[np.ones(min(more + 1, len(key)), bool), key[more + 1 :] != key[: -more - 1]]]
        at = np.searchsorted(key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32))
        at = np.r_[at, len(key)]
        some = np.flatnonzero(np.diff(at))
        low = key.astype("<u4")
        bodies = [low[at[i] : at[i + 1]].view(np.uint8).reshape(-1, 4).T.tobytes() for i in some.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(bodies, pa.binary())], names=["part", "body"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += len(held[-1])
            if size >= SORTED:
                yield packed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield packed(np.concatenate(held))

    def frequent(part: int, bodies: list[bytes]) -> pa.RecordBatch:
        low = np.concatenate([np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4")[:, 0] for b in bodies])
        low.sort()
        often = low[more:][low[more:] == low[: max(len(low) - more, 0)]]
        slot = np.unique(often.astype(np.uint64) >> np.uint64(32 + bits - FILTER))
        marks = np.zeros(1 << FILTER - bits, np.uint8)
        marks[slot.astype(np.int64)] = 1
        # As numbers where they are few, else as bits.
        few = 32 * len(slot) < len(marks)
        body = slot.astype("<u4").tobytes() if few else np.packbits(marks, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([few]), pa.array([body], pa.binary())], names=["part", "few", "slots"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for number, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != part and held:
                    yield frequent(part, held)
                    held = []
                part = number
                held.append(body)
        if held:
            yield frequent(part, held)

    rows = grams.select(F.xxhash64("gram").alias("hash")).mapInArrow(deal, "part int, body binary").repartition("part").sortWithinPartitions("part")
    marks = np.zeros((1 << bits, 1 << FILTER - bits - 3), np.uint8)
    for r in rows.mapInArrow(count, "part int, few boolean, slots binary").collect():
        if r["few"]:
            slot = np.frombuffer(r["slots"], "<u4")
            np.bitwise_or.at(marks[r["part"]], slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        else:
            marks[r["part"]] = np.frombuffer(r["slots"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(marks.reshape(-1))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        for batch in batches:
            slot = batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER)
            fine = (marks[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine.astype(bool)))], names=["gram"])

    return grams.select("gram", F.xxhash64("gram").alias("hash")).mapInArrow(filtered, "gram string")


def synonyms(rows: DataFrame, table: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """keys, term and synonym for each known word of a text. table: term and synonym."""
    return rows.select(*keys, F.explode(F.array_distinct(T.words(F.col(text)))).alias("term")).join(table, "term").select(*keys, "term", "synonym")


def segmenter(dictionary: Mapping[str, int]):
    """Arrow function of a text without spaces: its words by the dictionary, the better of longest match forward and backward.

    Of the two the one with fewer words is taken, then the one whose words are more frequent. The dictionary is sent with the function, so it
    should be of bounded size.
    """
    longest = max(map(len, dictionary), default=1)

    def forward(s: str) -> list[str]:
        out, i = [], 0
        while i < len(s):
            n = next((n for n in range(min(longest, len(s) - i), 1, -1) if s[i : i + n] in dictionary), 1)
            out.append(s[i : i + n])
            i += n
        return out

    def backward(s: str) -> list[str]:
        out, i = [], len(s)
        while i > 0:
            n = next((n for n in range(min(longest, i), 1, -1) if s[i - n : i] in dictionary), 1)
            out.append(s[i - n : i])
            i -= n
        return out[::-1]

    def best(s: str) -> list[str]:
        return min((forward(s), backward(s)), key=lambda w: (len(w), -sum(dictionary.get(x, 0) for x in w)))

    @F.pandas_udf("array<string>")
    def segment(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: None if t is None else best(t))

    return segment


#: Endings that the stemmer takes off, longest first, and what is put there (fixed values).
ENDINGS = (("ational", "ate"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("ization", "ize"), ("ation", "ate"), ("ness", ""), ("ment", ""), ("ies", "y"), ("ing", ""), ("ed", ""), ("ly", ""), ("s", ""))


def stemmed(word: Column) -> Column:
    """Word without the first of ENDINGS that leaves three letters or more."""
    out = None
    for ending, put in ENDINGS:
        hit = word.rlike(f"^.{{3,}}{ending}$") & (~word.endswith("ss") if ending == "s" else F.lit(True))
        value = F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(put))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(word)
