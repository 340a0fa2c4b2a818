"""Reports and searches that put several operators together, and layout over images."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import boxes as B
from spindrift.operators import feedback as A
from spindrift.operators import rerank as R
from spindrift.operators import search as S
from spindrift.operators import standards as D
from spindrift.operators import store as W
from spindrift.sources.tables import read

from .analytics import KINDS, METRICS
from .catalog import query
from .layout import BOX, _boxes
from .search import QV, rounded, vector_of


@query(f"""WITH m AS (SELECT user_id, any_value(overall) AS overall FROM (SELECT user_id, sum(mean * w) OVER (PARTITION BY user_id) / sum(w) OVER (PARTITION BY user_id) AS overall FROM ({METRICS})) GROUP BY user_id),
c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT user_id, max(CASE WHEN r = 1 THEN event_type END) AS mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) GROUP BY user_id),
e AS (SELECT user_id, avg(CASE WHEN r <= 5 THEN value END) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) GROUP BY user_id)
SELECT m.user_id, round(overall, 6) AS overall, mode, round(recent, 6) AS recent_avg, overall < 40 AS alert FROM m JOIN o ON m.user_id = o.user_id JOIN e ON m.user_id = e.user_id""")
def content_analysis(spark, d):
    """Overall score, commonest outcome, recent mean and alert of each item."""
    e = read(spark, d, "events")
    overall = A.content_metrics(e, "user_id", "event_type", "value", KINDS).groupBy("user_id").agg(F.first("overall").alias("overall"))
    modes = A.outcomes(e, "user_id", "event_type").select("user_id", "mode")
    recent = A.recent_mean(e, "user_id", "value", ["ts", "event_id"]).select("user_id", "recent_avg")
    return rounded(overall.join(modes, "user_id").join(recent, "user_id").withColumn("alert", F.col("overall") < 40), "overall", "recent_avg")


@query("SELECT user_id, round(avg(m), 6) AS confidence FROM (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL) GROUP BY user_id")
def confidence_rollup(spark, d):
    """Mean of the means of groups."""
    means = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    return rounded(means.groupBy("user_id").agg(F.avg("m").alias("confidence")), "confidence")


@query(f"WITH {BOX}, f AS (SELECT *, coalesce((abs(top - lag(top) OVER w) > 3)::INT, 0) AS fresh FROM b WINDOW w AS (PARTITION BY page ORDER BY top, x0)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY top, x0) AS row FROM f) SELECT page, row::BIGINT AS row, min(x0) AS first_x, count(*) AS n FROM r GROUP BY ALL")
def reading_order(spark, d):
    placed = B.reading_order(_boxes(spark, d), "page", 3)
    return placed.groupBy("page", "row").agg(F.min_by("x0", "place").alias("first_x"), F.count("*").alias("n"))


@query(f"WITH {BOX}, n AS (SELECT *, count(*) OVER (PARTITION BY page) AS n, avg(x0) OVER (PARTITION BY page) AS al, avg(x1) OVER (PARTITION BY page) AS ar, min(x0) OVER (PARTITION BY page) AS ml, max(x1) OVER (PARTITION BY page) AS mr FROM b) SELECT box_id, round(least(CASE WHEN n > 4 THEN al ELSE ml END, x0), 6) AS left, round(greatest(CASE WHEN n > 4 THEN ar ELSE mr END, x1), 6) AS right FROM n")
def aligned_rows(spark, d):
    return rounded(B.aligned(_boxes(spark, d), "page").select("box_id", "left", "right"), "left", "right")


@query("WITH r AS (SELECT p_partkey AS image_id, (p_size + 1)::DOUBLE / (p_partkey % 7 + 1) AS ratio FROM part), b AS (SELECT *, (row_number() OVER (ORDER BY ratio, image_id) - 1) // 16 AS batch FROM r) SELECT batch::BIGINT AS batch, count(*) AS n, round(max(ratio), 6) AS batch_ratio FROM b GROUP BY batch")
def recogniser_batches(spark, d):
    images = read(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") + 1).cast("double").alias("width"), (F.col("p_partkey") % 7 + 1).alias("height"))
    return B.recogniser_batches(images).groupBy("batch").agg(F.count("*").alias("n"), F.round(F.max("batch_ratio"), 6).alias("batch_ratio"))


@query("SELECT user_id AS page, coalesce(string_agg(CASE WHEN value > 60 THEN event_type END, ' ' ORDER BY event_id), '') AS text, round(avg(value), 6) AS confidence FROM events GROUP BY user_id")
def ocr_words(spark, d):
    words = read(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("place"), F.col("event_type").alias("word"), F.col("value").alias("conf"))
    return rounded(B.ocr_words(words, "page"), "confidence")


@query(f"""WITH s AS (SELECT d.doc_id, list_cosine_similarity(embedding::DOUBLE[], {QV}) AS s, lang, n_chars FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id WHERE lang = 'en' ORDER BY s DESC, d.doc_id LIMIT 20)
SELECT doc_id, round(0.5::DOUBLE * s + 0.3::DOUBLE * (CASE WHEN n_chars < 1500 THEN 0.3::DOUBLE ELSE 0.15 END + 0.3::DOUBLE) + 0.2::DOUBLE * 0.5, 6) AS final_score FROM s""")
def educational_retrieval(spark, d):
    """Filter, vector search and educational reranking."""
    joined = read(spark, d, "documents").join(read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    hits = S.vector_search(joined, vector_of(spark, d, 0), 20, filters={"lang": "en"}, key="doc_id")
    hits = hits.withColumns({"topics": F.array().cast("array<string>"), "level": F.when(F.col("n_chars") < 1500, "basic").otherwise("advanced"), "intent": F.col("lang")})
    return rounded(R.educational(hits, [], R_LEVEL, "en").select("doc_id", "final_score"), "final_score")


R_LEVEL = "basic"


@query("""SELECT doc_id, round(length(source) * 2.0::DOUBLE + (n_chars % 5) * 0.5::DOUBLE, 6) AS score FROM documents""")
def sparse_scores(spark, d):
    """Dot products of sparse vectors."""
    own = F.create_map(F.lit(3), F.length("source").cast("double"), F.lit(70), (F.col("n_chars") % 5).cast("double"), F.lit(9), F.lit(1.0))
    wanted = F.create_map(F.lit(3), F.lit(2.0), F.lit(70), F.lit(0.5))
    return rounded(read(spark, d, "documents").select("doc_id", S.sparse_dot(own, wanted).alias("score")), "score")


@query("""WITH s AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS k, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM benchmark),
p AS (SELECT a.item_id AS a, b.item_id AS b, a.k AS ak, b.k AS bk, a.w AS x, b.w AS y FROM s a JOIN s b ON b.item_id = a.item_id + 2), u AS (SELECT a, b, unnest(list_distinct(list_concat(x, y))) AS term, x, y FROM p),
f AS (SELECT a, b, term, len(list_filter(x, lambda v: v = term)) AS p, len(list_filter(y, lambda v: v = term)) AS q FROM u), i AS (SELECT a, b, p * (ln(3.0::DOUBLE / (1 + (p > 0)::INT + (q > 0)::INT)) + 1) AS p, q * (ln(3.0::DOUBLE / (1 + (p > 0)::INT + (q > 0)::INT)) + 1) AS q FROM f),
c AS (SELECT a, b, coalesce(sum(p * q) / nullif(sqrt(sum(p * p)) * sqrt(sum(q * q)), 0), 0) AS c FROM i GROUP BY ALL)
SELECT p.a, p.b, round(0.6::DOUBLE * len(list_intersect(ak, bk)) / (len(ak) + len(bk) - len(list_intersect(ak, bk))) + 0.4::DOUBLE * c, 6) AS similarity FROM p JOIN c ON p.a = c.a AND p.b = c.b""")
def standard_similarity(spark, d):
    """Six tenths keywords' Jaccard similarity and four tenths TF-IDF cosine."""
    items = read(spark, d, "benchmark").select("item_id", "text", F.array_distinct(T.words(F.col("text"))).alias("k"))
    x, y = items.select(F.col("item_id").alias("a"), F.col("text").alias("x"), F.col("k").alias("ak")), items.select(F.col("item_id").alias("b"), F.col("text").alias("y"), F.col("k").alias("bk"))
    pairs = x.join(y, F.col("b") == F.col("a") + 2)
    jaccard = F.size(F.array_intersect("ak", "bk")) / F.size(F.array_union("ak", "bk"))
    joined = pairs.select("a", "b", jaccard.alias("j")).join(D.tfidf_similarity(pairs, ["a", "b"], "x", "y"), ["a", "b"])
    return rounded(joined.select("a", "b", (0.6 * F.col("j") + 0.4 * F.col("similarity")).alias("similarity")), "similarity")


@query("SELECT event_id, ts_us FROM (SELECT event_id, epoch_us(ts) AS ts_us FROM events WHERE user_id = 7 ORDER BY ts, event_id LIMIT 20 OFFSET 5)")
def chunk_listing(spark, d):
    rows = W.chunk_list(read(spark, d, "events"), "user_id", 7, ["ts", "event_id"], most=20, offset=5)
    return rows.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@query("SELECT part.p_partkey, lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[\\s-]+', '_', 'g')) AS snake, len(p_name) AS n FROM part")
def text_cases(spark, d):
    return read(spark, d, "part").select("p_partkey", T.snake_case(F.col("p_name")).alias("snake"), F.length("p_name").cast("long").alias("n"))


@query("SELECT 'x' AS name, count(*) AS n, round(sum((p_size * 1024 * 1024)::DOUBLE / 1048576), 6) AS mb, sum(p_size // 60)::BIGINT AS minutes FROM part")
def unit_conversions(spark, d):
    rows = read(spark, d, "part").select((F.col("p_size") * 1024 * 1024).alias("bytes"), F.col("p_size").alias("seconds"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(F.col("bytes") / 1048576), 6).alias("mb"), F.sum(F.floor(F.col("seconds") / 60)).alias("minutes")).select(F.lit("x").alias("name"), "n", "mb", "minutes")
