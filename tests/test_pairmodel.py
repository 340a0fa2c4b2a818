"""The model of pairs against plain loops, gradients and pairs that it was not fitted on."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import pairmodel as P


def plain(query, text):
    q, w = (re.findall(r"\w+", (x or "").lower()) for x in (query, text))
    places = [w.index(x) + 1 for x in dict.fromkeys(q) if x in w]
    near = [any(w[i : i + 2] == q[j : j + 2] for i in range(len(w) - 1)) for j in range(len(q) - 1)]
    return (
        len(places) / len(set(q)) if q else 0.0, sum(near) / len(near) if near else 0.0, 1 / min(places) if places else 0.0, sum(x in q for x in w) / len(w) if w else 0.0,
    )


def test_numbers_and_scores_as_plain_loops(spark):
    draw = random.Random(1)
    some = lambda n: " ".join(draw.choice("abcdef") for _ in range(draw.randint(0, n)))
    rows = [(i, some(4), some(12)) for i in range(300)] + [(300, None, "a b"), (301, "a b", None), (302, "", ""), (303, "a a a", "b a a")]
    df = spark.createDataFrame(rows, "id int, query string, text string").repartition(3)
    numbers = P.seen(T.words(F.col("query")), T.words(F.col("text")))
    model = P.PairModel((1.0, -2.0, 0.5, 3.0), -0.25)
    found = {r["id"]: r for r in df.select("id", model(F.col("query"), F.col("text")).alias("score"), *(c.alias(n) for n, c in numbers.items())).collect()}
    for i, q, t in rows:
        x = plain(q, t)
        assert [found[i][n] for n in P.SEEN] == pytest.approx(x), (q, t)
        assert found[i]["score"] == pytest.approx(1 / (1 + math.exp(0.25 - sum(a * b for a, b in zip(model.weights, x, strict=True)))))


def test_fit_stands_where_the_loss_is_flat(spark):
    """At the weights found no coordinate's change lowers the penalised loss by more than rounding."""
    draw = random.Random(2)
    rows = []
    for _ in range(400):
        q, t = (" ".join(draw.choice("abcdefgh") for _ in range(n)) for n in (3, 10))
        x = plain(q, t)
        rows.append((q, t, int(draw.random() < 1 / (1 + math.exp(-(3 * x[0] - x[1] - 1))))))
    model = P.fit(spark.createDataFrame(rows, "query string, text string, label int"), ridge=0.01)
    data = [(plain(q, t), y) for q, t, y in rows]
    mean = [sum(x[j] for x, _ in data) / len(data) for j in range(4)]
    spread = [math.sqrt(sum((x[j] - mean[j]) ** 2 for x, _ in data) / (len(data) - 1)) for j in range(4)]

    def loss(w, b):
        """Spark's ridge is on weights of standardised numbers."""
        fit = sum(math.log1p(math.exp(-(2 * y - 1) * (b + sum(a * c for a, c in zip(w, x, strict=True))))) for x, y in data) / len(data)
        return fit + 0.005 * sum((a * s) ** 2 for a, s in zip(w, spread, strict=True))

    best = loss(model.weights, model.bias)
    for j in range(5):
        for change in (-0.05, 0.05):
            w = [a + change * (j == i) for i, a in enumerate(model.weights)]
            assert loss(w, model.bias + change * (j == 4)) > best - 1e-9
    one = P.fit(spark.createDataFrame([("a", "a", 1)], "query string, text string, label int"))
    assert one.weights == (0.0,) * 4 and one.bias == 0.0


def test_unseen_pairs_and_many_queries(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    model = P.fit(P.own_pairs(docs.filter("doc_id % 2 = 0"), "doc_id", "text"))
    unseen = P.own_pairs(docs.filter("doc_id % 2 = 1"), "doc_id", "text")
    right = unseen.select(((model(F.col("query"), F.col("text")) >= 0.5).cast("int") == F.col("label")).cast("double").alias("fine")).agg(F.avg("fine"), F.count("*")).first()
    assert right[0] > 0.9 and right[1] > 40
    hits = spark.createDataFrame([(q, d) for q in range(3) for d in range(10)], "query_id int, doc_id long")
    asked = spark.createDataFrame([(0, "the ertion"), (1, ""), (2, None)], "query_id int, words string")
    rows = P.reranked(hits, asked, docs, model, k=4).collect()
    assert sorted((r["query_id"], r["rank"]) for r in rows) == [(q, n) for q in range(3) for n in range(1, 5)]
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 1] == [0, 1, 2, 3]
    assert P.reranked(hits.filter("doc_id > 99"), asked, docs, model).count() == 0


def test_words_of_long_texts_are_taken_once(spark):
    """A pair's words are not taken anew for each word that is compared."""
    import time

    text = " ".join(f"word{i % 977} other{i}" for i in range(60_000))
    df = spark.createDataFrame([(" ".join(f"word{i}" for i in range(3000)), text)], "query string, text string")
    start = time.time()
    score = df.select(P.PairModel((1.0, 0.0, 0.0, 0.0), 0.0)(F.col("query"), F.col("text")).alias("s")).first()["s"]
    assert score == pytest.approx(1 / (1 + math.exp(-977 / 3000)))
    assert time.time() - start < 30
