"""Global numbers and sampling with replacement."""

from collections import Counter

import pytest

from spindrift.operators import ordering as R


def test_numbers_follow_the_order(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5003 AS x", "id").repartition(7)
    rows = R.numbered(df, "x", "id").collect()
    assert [r["number"] for r in sorted(rows, key=lambda r: (r["x"], r["id"]))] == list(range(5000))
    assert R.numbered(df.limit(0), "x").count() == 0


def test_draws_are_exact_and_repeatable(spark):
    df = spark.range(300).selectExpr("id AS doc_id", "id AS _x").repartition(5)
    one = {r["doc_id"]: r["times"] for r in R.choices(df, 200, "doc_id", 3).collect()}
    assert sum(one.values()) == 200 and max(one.values()) > 1
    assert one == {r["doc_id"]: r["times"] for r in R.choices(df.repartition(2), 200, "doc_id", 3).collect()}
    assert one != {r["doc_id"]: r["times"] for r in R.choices(df, 200, "doc_id", 4).collect()}
    assert sum(r["times"] for r in R.choices(df, 9999, "doc_id", 3).collect()) == 300
    assert R.choices(df, 0, "doc_id", 3).count() == 0 == R.choices(df.limit(0), 5, "doc_id", 3).count()
    with pytest.raises(ValueError):
        R.choices(df, -1, "doc_id", 1)


def test_every_row_is_drawn_alike(spark):
    """Over many seeds each of ten rows is drawn about a tenth of the time."""
    df, seen = spark.range(10).selectExpr("id AS doc_id"), Counter()
    n = df.count()
    draws = spark.range(20_000).selectExpr("id")
    for r in draws.select((R.uniform(draws["id"]) * n).cast("int").alias("i")).groupBy("i").count().collect():
        seen[r["i"]] = r["count"]
    assert set(seen) == set(range(10)) and all(abs(c - 2000) < 200 for c in seen.values())
