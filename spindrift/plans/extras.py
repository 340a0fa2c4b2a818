"""Relational operations beyond retrieval, over the star schema and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.operators import ordering as O
from spindrift.operators import relational as R
from spindrift.operators import vectors as A
from spindrift.sources.tables import read

from .catalog import query


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount))::DOUBLE, 2) AS sum_disc_price, round(avg(l_discount)::DOUBLE, 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    rows = read(spark, d, "lineitem").filter(F.col("l_shipdate") <= "1998-09-02")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"), 2).alias("sum_disc_price"), F.round(F.avg("l_discount").cast("double"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount))::DOUBLE, 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = s_nationkey GROUP BY n_name""")
def star_join(spark, d):
    t = lambda n: read(spark, d, n)
    j = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"), 2).alias("revenue"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_join(spark, d):
    large = read(spark, d, "lineitem").filter("l_quantity > 45").withColumnRenamed("l_orderkey", "o_orderkey")
    return read(spark, d, "orders").join(large, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT n_nationkey, r_regionkey, n_name, r_name FROM (SELECT * FROM nation WHERE n_regionkey < 3) FULL JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey = r_regionkey")
def full_join(spark, d):
    n, r = read(spark, d, "nation").filter("n_regionkey < 3"), read(spark, d, "region").filter("r_regionkey > 1")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "full_outer").select("n_nationkey", "r_regionkey", "n_name", "r_name")


@query("SELECT lang, source, count(*) AS n, grouping_id(lang, source) AS level FROM documents GROUP BY ROLLUP (lang, source)")
def rollup(spark, d):
    return read(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.grouping_id("lang", "source").alias("level"))


@query("SELECT lang, source, count(*) AS n, grouping_id(lang, source) AS level FROM documents GROUP BY CUBE (lang, source)")
def cube(spark, d):
    return read(spark, d, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.grouping_id("lang", "source").alias("level"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de FROM documents GROUP BY source")
def pivot(spark, d):
    return read(spark, d, "documents").groupBy("source").pivot("lang", ["en", "fr", "de"]).agg(F.count(F.lit(1))).fillna(0)


@query("""SELECT event_id, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, ntile(4) OVER (PARTITION BY event_type ORDER BY value, event_id) AS quartile, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS previous,
round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 2 PRECEDING), 6) AS moving_sum FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value DESC)""")
def window_functions(spark, d):
    by, at = Window.partitionBy("event_type").orderBy(F.desc("value")), Window.partitionBy("event_type").orderBy("ts", "event_id")
    return read(spark, d, "events").select(
        "event_id", F.rank().over(by).alias("rank"), F.dense_rank().over(by).alias("dense_rank"), F.ntile(4).over(Window.partitionBy("event_type").orderBy("value", "event_id")).alias("quartile"),
        F.lag("value").over(at).alias("previous"), F.round(F.sum("value").over(at.rowsBetween(-2, 0)), 6).alias("moving_sum"),
    )


@query("(SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase') EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 100")
def set_operations(spark, d):
    e = read(spark, d, "events")
    of = lambda c: e.filter(c).select("user_id")
    return of("event_type = 'view'").intersect(of("event_type = 'purchase'")).subtract(of("event_type = 'error' AND value > 100"))


@query("""SELECT p.event_id, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def as_of_join(spark, d):
    """Each purchase with the user's last view before it."""
    e = read(spark, d, "events")
    views = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("last_view"))
    return R.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "last_view").select("event_id", "last_view")


@query("SELECT p_partkey, r.low FROM part, (SELECT n_nationkey * 40 AS low, n_nationkey * 40 + 25 AS high FROM nation) r WHERE p_partkey BETWEEN r.low AND r.high")
def range_join(spark, d):
    ranges = read(spark, d, "nation").select((F.col("n_nationkey") * 40).alias("low"), (F.col("n_nationkey") * 40 + 25).alias("high"))
    return R.range_join(read(spark, d, "part").select("p_partkey"), ranges, "p_partkey", "low", "high", 64.0).select("p_partkey", "low")


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def salted_join(spark, d):
    orders = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = R.salted_join(orders, read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 8, F.col("o_orderkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(None)
def approximate_counts(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("median"))


@query(None)
def vector_clusters(spark, d):
    """Sizes of k-means clusters."""
    return A.clustered(read(spark, d, "embeddings"), 5).groupBy("cluster").agg(F.count("*").alias("n"))


@query(None)
def vector_components(spark, d):
    return A.reduced(read(spark, d, "embeddings")).select("vec_id", F.col("reduced")[0].alias("x"), F.col("reduced")[1].alias("y"))


@query("""WITH e AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, max(x) AS m FROM e GROUP BY ALL) SELECT label, (i - 1)::INT AS dim, round(m, 6) AS value FROM m""")
def token_pooling(spark, d):
    """Largest value of each dimension over a group's vectors."""
    pooled = A.pooled(read(spark, d, "embeddings"), "label", "vec_id", "max")
    return pooled.select("label", F.posexplode("pooled").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), u AS (SELECT floor((('0x' || substr(md5('7:' || g.i), 1, 13))::BIGINT + 0.5::DOUBLE) / {2**52}.0::DOUBLE * (SELECT count(*) FROM documents))::BIGINT AS i FROM generate_series(0, least(500, (SELECT count(*) FROM documents)) - 1) AS g(i))
SELECT doc_id, count(*) AS times FROM u JOIN n ON u.i = n.i GROUP BY doc_id""")
def sample_with_replacement(spark, d):
    return O.choices(read(spark, d, "documents").select("doc_id"), 500, "doc_id", 7)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS number FROM lineitem")
def global_numbers(spark, d):
    """Places in an order of the whole table."""
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return O.numbered(items, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").drop("l_extendedprice")
