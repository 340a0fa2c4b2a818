"""Topics, citations and checks across modalities."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vector as V
from spindrift.operators import chunking as C
from spindrift.operators import matching as M
from spindrift.operators import neighbours as N
from spindrift.sources.tables import read

from .catalog import query
from .search import EVERY, rounded

LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query("""WITH f AS (SELECT DISTINCT url AS path, list_distinct(regexp_extract_all(lower(regexp_replace(url, '[_/.-]', ' ', 'g')), '[\\p{L}\\p{N}_]+')) AS w FROM pages WHERE url NOT LIKE '%?%'),
t AS (SELECT * FROM (VALUES ('english', ['en', 'http', 'com', 'example']), ('french', ['fr', 'blog', 'example']), ('secure', ['https', 'example', 'org', 'en'])) AS v(topic, k)),
s AS (SELECT path, topic, len(list_intersect(w, k)) / (len(w) + len(k) - len(list_intersect(w, k))) AS score FROM f, t),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, topic) AS n FROM s WHERE score > 0.3::DOUBLE)
SELECT f.path, coalesce(topic, regexp_extract(f.path, '([^/]+)/[^/]*$', 1)) AS topic, round(coalesce(score, 0), 6) AS score FROM f LEFT JOIN r ON f.path = r.path AND n = 1""")
def topic_match(spark, d):
    """The best topic of each page by the words of its address."""
    files = read(spark, d, "pages").filter("url NOT LIKE '%?%'").select(F.col("url").alias("path")).distinct()
    topics = spark.createDataFrame([("english", ["en", "http", "com", "example"]), ("french", ["fr", "blog", "example"]), ("secure", ["https", "example", "org", "en"])], "topic string, keywords array<string>")
    return rounded(M.best_topic(files, topics), "score")


@query("""WITH s AS (SELECT a.vec_id AS piece, b.vec_id AS chunk, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < 10 AND b.vec_id >= 10),
m AS (SELECT *, 0.99::DOUBLE * max(s) OVER (PARTITION BY piece) AS best FROM s), t AS (SELECT max(best) AS top FROM m),
l AS (SELECT CASE WHEN top >= 0.63::DOUBLE THEN 0.63::DOUBLE WHEN top >= 0.504::DOUBLE THEN 0.504 WHEN top >= 0.4032::DOUBLE THEN 0.4032 WHEN top >= 0.32256::DOUBLE THEN 0.32256 END AS level FROM t),
r AS (SELECT piece, chunk, s, row_number() OVER (PARTITION BY piece ORDER BY s DESC, chunk) AS n FROM m, l WHERE best >= level AND s > best)
SELECT piece, chunk, round(s, 6) AS similarity FROM r WHERE n <= 4""")
def citations(spark, d):
    """Pieces (here: the first ten vectors) and the chunks that they cite."""
    v = read(spark, d, "embeddings")
    x = v.filter("vec_id < 10").select(F.col("vec_id").alias("piece"), F.col("embedding").alias("u"))
    y = v.filter("vec_id >= 10").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("v"))
    pairs = y.crossJoin(F.broadcast(x)).select("piece", "chunk", V.cosine(F.col("u"), F.col("v")).alias("similarity"))
    return rounded(M.citations(pairs), "similarity")


@query(f"""WITH s AS (SELECT a.vec_id AS piece, b.vec_id AS chunk, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % {EVERY} = 0 AND b.vec_id != a.vec_id),
m AS (SELECT *, 0.99::DOUBLE * max(s) OVER (PARTITION BY piece) AS best FROM s), t AS (SELECT max(best) AS top FROM m),
l AS (SELECT CASE WHEN top >= 0.63::DOUBLE THEN 0.63::DOUBLE WHEN top >= 0.504::DOUBLE THEN 0.504 WHEN top >= 0.4032::DOUBLE THEN 0.4032 WHEN top >= 0.32256::DOUBLE THEN 0.32256 END AS level FROM t),
r AS (SELECT piece, chunk, s, row_number() OVER (PARTITION BY piece ORDER BY s DESC, chunk) AS n FROM m, l WHERE best >= level AND s > best)
SELECT piece, chunk, round(s, 6) AS similarity FROM r WHERE n <= 4""")
def citations_all(spark, d):
    """Every vector whose id is divisible by EVERY is a piece, all others are chunks; citations, as its SQL, takes ten pieces."""
    v = read(spark, d, "embeddings")
    return rounded(cited(v, v.filter(F.col("vec_id") % EVERY == 0)), "similarity")


def cited(vectors, pieces, most=4):
    """What M.citations gives for each piece and all vectors but itself: no more than a piece's most nearest matter, so no others are kept."""
    hits = N.vector_join(vectors, pieces, most + 1).filter("query_id != vec_id")
    return M.citations(hits.select(F.col("query_id").alias("piece"), F.col("vec_id").alias("chunk"), F.col("score").alias("similarity")), most)


@query("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, round(least(1, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 0.8::DOUBLE) / 2), 6) AS confidence FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 7""")
def cross_modal_consistency(spark, d):
    v = read(spark, d, "embeddings")
    j = v.select("vec_id", F.col("embedding").alias("u")).join(v.select((F.col("vec_id") - 7).alias("vec_id"), F.col("embedding").alias("v")), "vec_id")
    return rounded(M.consistency(j, "u", "v").select("vec_id", "similarity", "confidence"), "similarity", "confidence")


@query("""SELECT page_id, regexp_extract(lower(url), '/(en|fr|de|es)/', 1) AS subject, CASE WHEN lower(url) LIKE '%blog%' THEN 'basic' WHEN lower(url) LIKE '%www%' THEN 'advanced' ELSE 'unknown' END AS level FROM pages WHERE regexp_matches(lower(url), '/(en|fr|de|es)/')""")
def path_metadata(spark, d):
    pages = read(spark, d, "pages").filter(F.lower("url").rlike("/(en|fr|de|es)/"))
    return pages.select("page_id", M.path_metadata(F.col("url"), ("en", "fr", "de", "es"), {"basic": "blog", "advanced": "www"}).alias("m")).select("page_id", "m.*")


@query(f"""WITH {LINES}, c AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '^[A-Z][a-z]+ ')) AS a, count(*) FILTER (regexp_matches(line, '[|]')) AS b, count(*) FILTER (regexp_matches(line, '!!')) AS c FROM l GROUP BY doc_id)
SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a = greatest(a, b, c) THEN 'prose' WHEN b = greatest(a, b, c) THEN 'table' ELSE 'shout' END AS style FROM c""")
def bullet_style(spark, d):
    """The style that most lines of a document have."""
    return M.bullet_style(C.lines(read(spark, d, "documents")), {"prose": "^[A-Z][a-z]+ ", "table": "[|]", "shout": "!!"})




@query(None)
def stems(spark, d):
    from spindrift.operators import terms as K

    words = read(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("w"))
    return words.select(K.stemmed(F.col("w")).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))
