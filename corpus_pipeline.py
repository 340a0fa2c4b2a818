"""Training documents from raw ones, in stages.

STAGES are (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a
DataFrame that may be written and read again as the next one's docs; all but the last return the columns of docs.

1. quality_rules: documents that the rules reject go.
2. line_dedup: lines that nearly repeat an earlier line go from the texts.
3. near_copies: one document of each class of near copies stays.
4. mix_sources: documents are taken as often as their source's target says.
5. byte_pairs: ids and decoded texts, as digests.

Null and empty texts fail the quality rules. A text whose lines all go in stage 2 is the empty text
in stage 3, where one of them stays, and is not taken in stage 4. Equal rows count as one document up to stage 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import bpe, linejoin, mixing, nearcopies, rules
from spindrift.llm.runtime import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linejoin.remove(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(docs, bpe.vocabulary()))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("mix_sources", mix_sources),
    ("byte_pairs", byte_pairs),
]

#: The rules' estimates, the samples and the merges are beyond SQL. Tests hold each stage's operator against a plain version, and run() against
#: the stages called one by one; there is no plain version of the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
