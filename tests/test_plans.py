"""Plans whose cost must not outgrow the tables."""

from pyspark.sql import functions as F

from spindrift.operators import boxes as B
from spindrift.operators import relational as R
from spindrift.plans import catalog

catalog.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_salted_join_are_not_broadcast(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).write.parquet(f"{tmp_path}/s")
    large, small = spark.range(5000).select((F.col("id") % 1500).alias("k"), F.col("id").alias("i")), spark.read.parquet(f"{tmp_path}/s")
    joined = R.salted_join(large, small, "k", 8, F.col("i"))
    assert "Broadcast" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert joined.count() == 3 * 1000 + 500


def test_header_rows_sort_rows_and_not_cells(spark):
    rows = [("a", 1, "name", False), ("a", 1, "size", False), ("a", 2, "1", False), ("a", 2, "2", False), ("a", 3, "3", False), ("a", 3, "4", False)]
    rows += [("b", 1, "x", True), ("b", 1, "y", True), ("b", 2, "word", False), ("b", 2, "other", False), ("c", 1, None, True), ("c", 2, None, False)]
    found = B.header_rows(spark.createDataFrame(rows, "tbl string, row long, text string, is_header boolean"), "tbl")
    assert sorted(map(tuple, found.collect())) == [("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0)]
    last = plan(found).split("Window")[-1]
    assert "text" not in last.split("HashAggregate")[0]


def test_words_of_merged_terms_are_not_shuffled(spark, data):
    found = plan(catalog.QUERIES["merged_terms"](spark, data))
    # Whole texts by document (below the words), then counts by term.
    assert found.count("Exchange hashpartitioning") == 2
    assert found.index("Generate posexplode") < found.index("REPARTITION_BY_NUM")
