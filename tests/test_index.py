"""The stored index and the vector indexes against full scans."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spindrift.operators import index as I
from spindrift.operators import neighbours as N
from spindrift.operators import search as S

WORDS = [f"w{i}" for i in range(60)] + ["é", "日本", "the"]


def corpus(spark, n, seed):
    draw = random.Random(seed)
    rows = [(i * 7, " ".join(draw.choices(WORDS, [1 / (j + 1) for j in range(len(WORDS))], k=draw.randint(0, 40))), "en" if i % 3 else "fr") for i in range(n)]
    rows += [(100_003, None, "en"), (100_004, "", "en"), (100_005, "W1 w1, w2 w9! w2", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark, 1200, 1).cache()


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return I.Index.build(docs, f"{tmp_path_factory.mktemp('index')}/i", span=8)


def plain(df, *columns):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("query", ["w1 w2", "w40", "the w0 w0 é", "日本 w55 w56", "nothing here", "w3 nothing"])
@pytest.mark.parametrize("k", [1, 7, 40])
def test_searches_equal_full_scans(docs, index, query, k):
    assert len(index.commit.blocks) == 1 and index.commit.blocks[0] > I.SEEDS  # so that blocks are skipped
    assert plain(index.keyword(query, k), "doc_id", "score", "exact_match") == plain(S.keyword_search(docs, query, k), "doc_id", "score", "exact_match")
    assert plain(index.bm25(query, k), "doc_id", "bm25") == plain(S.top(S.bm25(docs, query), k, score="bm25"), "doc_id", "bm25")


def test_weak_blocks_are_not_scored(index, monkeypatch):
    seen, scored = [], I.Index._scored
    monkeypatch.setattr(I.Index, "_scored", lambda self, blocks, scores: (seen.append(blocks.select("segment", "block").distinct().count()), scored(self, blocks, scores))[1])
    index.best({"w50": lambda tf, n: tf * 3.0 - n / 1000, "w0": lambda tf, n: tf * 0.01 - n / 1000}, 3).collect()
    every = index.postings(["w50", "w0"]).select("segment", "block").distinct().count()
    assert len(seen) == 2 and seen[0] == I.SEEDS and seen[1] < every / 2


def test_only_the_terms_buckets_are_read(index):
    plan = index.postings(["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]
    assert "PushedFilters" in plan and "EqualTo(term,w1)" in plan
    assert {r[0] for r in index.postings(["w1"]).select("term").distinct().collect()} == {"w1"}


def test_segments_append_merge_and_reopen(spark, docs, tmp_path):
    more = corpus(spark, 30, 2).filter("doc_id < 100000").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    both = docs.unionByName(more)
    first = I.Index.build(docs, f"{tmp_path}/i", span=8)
    second = first.append(more)
    merged = second.merge()
    wanted = plain(S.top(S.bm25(both, "w1 w7"), 9, score="bm25"), "doc_id", "bm25")
    for index in (second, merged, I.Index.open(spark, f"{tmp_path}/i")):
        assert plain(index.bm25("w1 w7", 9), "doc_id", "bm25") == wanted
        assert index.commit.n_docs == both.count() and index.means[0] == both.select(F.explode(S.T.words(F.col("text")))).distinct().count()
    assert plain(first.bm25("w1 w7", 9), "doc_id", "bm25") == plain(S.top(S.bm25(docs, "w1 w7"), 9, score="bm25"), "doc_id", "bm25")
    assert len(second.commit.segments) == 2 and len(merged.commit.segments) == 1
    # Of two writers that go on from one commit, the second fails and changes nothing.
    with pytest.raises(Exception, match="(?i)already exists"):
        second.append(more)
    assert I.Index.open(spark, f"{tmp_path}/i").commit == merged.commit
    assert sorted(r[0] for r in merged.fetch([7, 1_000_007, 5]).select("doc_id").collect()) == [7, 1_000_007]


def test_postings_are_shuffled_once_and_packed(spark, docs, tmp_path, monkeypatch):
    plans, write = [], I.Index._write
    monkeypatch.setattr(I.Index, "_write", lambda self, packed, segment: (plans.append(packed._jdf.queryExecution().executedPlan().toString()), write(self, packed, segment))[1])
    index = I.Index.build(docs.filter("doc_id % 3 > 0"), f"{tmp_path}/i", span=8).append(docs.filter("doc_id % 3 = 0")).merge()
    # Building: texts by block, then packed rows. Merging: packed rows alone.
    assert [p.count("Exchange") for p in plans] == [2, 2, 1]
    assert plain(index.frequencies().orderBy("term"), "term", "df", "total") == plain(S.inverted_index(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy("term"), "term", "df", "total")


def test_segments_of_several_slots_merge(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "SPREAD", 4)
    monkeypatch.setattr(I, "SLOT_BLOCKS", 8)
    late = F.col("doc_id") % 5 == 0
    parts = I.Index.build(docs.filter(~late), f"{tmp_path}/i", span=8).append(docs.filter(late))
    assert parts.commit.blocks[0] % 4 == 0 and parts.commit.blocks[1] % 4 and I._slots(parts.commit.blocks[0]) == 4
    merged = parts.merge()
    rows = merged._postings(merged.commit.segments)
    assert rows.count() == rows.select("term", "block").distinct().count()
    wanted = plain(S.top(S.bm25(docs, "w1 w7"), 40, score="bm25"), "doc_id", "bm25")
    assert plain(parts.bm25("w1 w7", 40), "doc_id", "bm25") == plain(merged.bm25("w1 w7", 40), "doc_id", "bm25") == wanted
    assert sorted(r[0] for r in merged.fetch([7, 14, 100_003]).select("doc_id").collect()) == [7, 14, 100_003]


def test_index_of_no_documents(docs, tmp_path):
    empty = I.Index.build(docs.filter("false"), f"{tmp_path}/i")
    assert empty.keyword("w1", 5).count() == 0 and empty.bm25("w1", 5).count() == 0
    assert empty.append(docs.limit(5)).commit.n_docs == 5


def test_an_index_is_built_once_for_a_state_of_the_files(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/d.parquet")
    one = I.index_of(spark, f"{tmp_path}/d.parquet")
    assert I.index_of(spark, f"{tmp_path}/d.parquet") is one
    time.sleep(1)
    docs.limit(10).write.mode("overwrite").parquet(f"{tmp_path}/d.parquet")
    assert I.index_of(spark, f"{tmp_path}/d.parquet").commit.n_docs == 10


# --- vectors


def clustered(spark, n):
    draw = random.Random(n)
    centres = [[draw.gauss(0, 1) for _ in range(12)] for _ in range(20)]
    # A third of all vectors lie around one centre.
    rows = [(i, [c + draw.gauss(0, 0.4) for c in centres[0 if i % 3 == 0 else i % 20]]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, [0.0] * 12), (n + 1, None), (None, [1.0] * 12)], "vec_id long, embedding array<float>").repartition(4)


def test_probes_find_nine_in_ten(spark):
    vectors = clustered(spark, 3000)
    file = N.InvertedFile.build(vectors, block_rows=100)
    queries = vectors.filter("vec_id % 20 = 0")
    exact = {(r["query_id"], r["vec_id"]) for r in N.vector_join(vectors, queries, 10).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in file.search(queries, 10, file.probes_for(vectors, 10, 0.95)).collect()}
    assert len(exact) == 1500 and len(found & exact) >= 0.9 * len(exact)
    # All cells: the exact search.
    every = {(r["query_id"], r["vec_id"]) for r in file.search(queries, 10, len(file.centroids)).collect()}
    assert every == exact
    stored = spark.read.parquet(f"{file.path}/placed")
    assert stored.count() == stored.select("id").distinct().count() == 3000


def test_recall_of_the_registered_search(spark, data):
    from spindrift.plans import catalog

    catalog.load()
    row = catalog.QUERIES["ann_recall"](spark, data).first()
    assert row["recall"] >= 0.9 and row["n_exact"] > 0


def test_vectors_of_several_sizes(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [0.5, 0.5, 0.0]), (5, [1e300, 1e300]), (6, [float("nan"), 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [(r["query_id"], r["vec_id"], r["rank"], round(r["score"], 6)) for r in N.vector_join(vectors, vectors, 2).orderBy("query_id", "rank").collect()]
    assert found == [(1, 1, 1, 1.0), (1, 2, 2, 0.707107), (2, 2, 1, 1.0), (2, 5, 2, 1.0), (3, 3, 1, 1.0), (3, 4, 2, 0.707107), (4, 4, 1, 1.0), (4, 3, 2, 0.707107), (5, 2, 1, 1.0), (5, 5, 2, 1.0)]
    with pytest.raises(ValueError):
        N.InvertedFile.build(vectors)
    none = N.InvertedFile.build(vectors.filter("false"))
    assert none.search(vectors, 3, 2).count() == 0
