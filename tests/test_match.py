"""Match expressions: what the plan does with filters, relaxation, and wrong input."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import match as X
from spindrift.operators import search as S

ROWS = [(1, "red apple pie", "fruit", [1.0, 0.0], {"a": 1.0}), (2, "green apple", "fruit red", [0.8, 0.6], {"b": 2.0}), (3, "red car", "car", [0.0, 1.0], None), (4, None, None, None, {"a": -1.0, "b": 1.0}), (5, "pie chart of red things and apple pie", "chart", [-1.0, 0.0], {})]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, title string, embedding array<double>, features map<string,double>")


def found(df):
    return {r["doc_id"]: round(r["score"], 6) for r in df.collect()}


def test_text_equals_full_text(rows):
    for m in (0.1, 0.5, 1.0):
        wanted = {r["doc_id"]: round(r["score"], 6) for r in S.full_text(rows.fillna({"text": ""}), "red apple pie", m).collect()}
        assert found(X.compile(X.Text("red apple pie", min_match=m), rows)) == wanted


def test_fields_count_by_their_boost(rows):
    one = found(X.compile(X.Text("red", {"text": 1.0, "title": 10.0}), rows))
    assert one[2] == pytest.approx(10 * one[1], rel=1e-5) and set(one) == {1, 2, 3, 5}


def test_leaves(rows):
    assert found(X.compile(X.Dense([2.0, 0.0], similarity=0.0, top=None), rows)) == {1: 1.0, 2: 0.8, 3: 0.0}
    assert found(X.compile(X.Dense([1.0, 0.0, 0.0]), rows)) == {}
    assert found(X.compile(X.Sparse({"a": 2.0, "b": 1.0}), rows)) == {1: 2.0, 2: 2.0, 4: -1.0}
    assert found(X.compile(X.Words("apple pie", top=2), rows)) == {5: 1.5, 1: 1.0}


def test_fusions(rows):
    parts = [X.Dense([1.0, 0.0], top=2), X.Words("apple", top=3)]
    assert found(X.compile(X.Fusion(parts, (0.5, 2.0)), rows)) == {1: 2.5, 2: 2.4, 5: 2.0}
    assert found(X.compile(X.Fusion(parts, (0.5, 2.0), how="max", top=1), rows)) == {1: 2.0}
    ranks = found(X.compile(X.Fusion(parts, how="ranks"), rows))
    assert ranks == {1: round(2 / 61, 6), 2: round(2 / 62, 6), 5: round(1 / 63, 6)}
    nested = X.Fusion([X.Fusion(parts, (1.0, 0.0)), X.Sparse({"b": 1.0})], (1.0, 1.0))
    assert found(X.compile(nested, rows))[2] == 2.8


def test_filters_lie_below_rankings(rows):
    e = X.Where({"title": "car"}, X.Fusion([X.Dense([1.0, 0.0], top=1), X.Words("red", top=1)]))
    assert found(X.compile(e, rows)) == {3: 1.0}
    plan = X.compile(e, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") >= 2 and plan.index("GlobalLimit") < plan.index("title")


def test_pages_order_and_relaxation(rows):
    page = X.search(rows, X.Text("red apple"), order=[("title", True)], page=1, size=2, fields=["title"]).collect()
    assert [(r["doc_id"], r["title"]) for r in page] == [(2, "fruit red"), (1, "fruit")]
    assert [r["doc_id"] for r in X.search(rows, None, filters={"doc_id": ("gt", 2)}, order=[("doc_id", True)], size=2).collect()] == [5, 4]
    wide = X.Text("red one two three four five six seven eight nine", min_match=0.3)
    assert set(found(X.search(rows, wide))) == {1, 3, 5} and found(X.search(rows, wide, relax=False)) == {}
    near = X.Dense([0.2, -1.0], similarity=0.9)
    assert X.relaxed(X.Where({}, X.Fusion([near, wide]))) == X.Where({}, X.Fusion([X.Dense([0.2, -1.0], similarity=0.17), X.Text(wide.query, min_match=0.1)]))


def test_wrong_expressions(rows):
    for e in (X.Fusion([]), X.Fusion([X.Words("a")], (1.0, 2.0)), X.Fusion([X.Words("a")], how="other"), X.Fusion([X.Words("a")], how="ranks"), X.Text("a", {}), "text", X.Words("")):
        with pytest.raises(ValueError):
            X.compile(e, rows)
    assert X.compile(X.Fusion([X.Words("red"), X.Dense([1.0, 0.0])]), rows.filter(F.lit(False))).count() == 0
