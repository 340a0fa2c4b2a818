"""Search, fusion, reranking and facets over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vector as V
from spindrift.operators import index as I
from spindrift.operators import neighbours as N
from spindrift.operators import rerank as R
from spindrift.operators import search as S
from spindrift.sources.tables import read

from .catalog import query

WORDS = "the ertion of thtion"
TERMS = WORDS.split()
QV = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def vector_of(spark: SparkSession, d: str, i: int) -> list[float]:
    """The query's vector: one row."""
    return [float(x) for x in read(spark, d, "embeddings").filter(F.col("vec_id") == i).first()["embedding"]]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def stored_index(spark: SparkSession, d: str) -> I.Index:
    """The stored index of the documents: built by the first query that needs it, read by the others."""
    return I.index_of(spark, f"{d}/documents.parquet")


def _dots(threshold: str = "", where: str = "") -> str:
    return f"SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], {QV}) AS s FROM embeddings {where}"


KEYWORD = f"""SELECT doc_id, {" + ".join(f"len(list_filter(w, lambda x: x = '{t}'))" for t in TERMS)} AS hits, lower(text) LIKE '%{WORDS}%' AS exact_match
FROM (SELECT doc_id, text, {TOKENS} AS w FROM documents)"""


@query(f"""WITH s AS (SELECT vec_id AS doc_id, list_dot_product(embedding::DOUBLE[], {QV}) AS s FROM embeddings ORDER BY s DESC, doc_id LIMIT 20),
k AS (SELECT doc_id, hits / {float(len(TERMS))}::DOUBLE AS s, exact_match FROM ({KEYWORD}) WHERE hits > 0 ORDER BY s DESC, doc_id LIMIT 20),
c AS (SELECT coalesce(s.doc_id, k.doc_id) AS doc_id, coalesce(s.s, 0) AS semantic_score, coalesce(k.s, 0) AS keyword_score, CASE WHEN exact_match THEN 1.2::DOUBLE ELSE 1 END AS boost FROM s FULL JOIN k ON s.doc_id = k.doc_id),
t AS (SELECT c.doc_id, semantic_score, keyword_score, boost * (0.7::DOUBLE * semantic_score + 0.3::DOUBLE * keyword_score) AS score FROM c JOIN documents d ON c.doc_id = d.doc_id WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 20)
SELECT doc_id, round(semantic_score, 6) AS semantic_score, round(keyword_score, 6) AS keyword_score, round(score, 6) AS score FROM t""")
def hybrid_search_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = stored_index(spark, d).hybrid(read(spark, d, "embeddings"), WORDS, vector_of(spark, d, 0), 20, boost=1.2, filters={"lang": "en"})
    return rounded(hits, "semantic_score", "keyword_score", "score")


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_dots()}) ORDER BY s DESC, vec_id LIMIT 10")
def semantic_topk(spark, d):
    return rounded(S.semantic_search(read(spark, d, "embeddings"), vector_of(spark, d, 0), 10, threshold=-1.0).select("vec_id", "score"), "score")


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_dots(where='WHERE label = 3')}) ORDER BY s DESC, vec_id LIMIT 10")
def semantic_topk_filtered(spark, d):
    return rounded(S.semantic_search(read(spark, d, "embeddings"), vector_of(spark, d, 0), 10, threshold=-1.0, filters={"label": 3}).select("vec_id", "score"), "score")


COSINE = f"SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], {QV}) AS s FROM embeddings"


@query(f"SELECT vec_id, label, round(s, 6) AS score FROM ({COSINE}) WHERE s > 0.1::DOUBLE ORDER BY s DESC, vec_id LIMIT 50")
def semantic_threshold(spark, d):
    return rounded(S.vector_search(read(spark, d, "embeddings"), vector_of(spark, d, 0), 50, threshold=0.1, strict=True).select("vec_id", "label", "score"), "score")


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({COSINE}) WHERE vec_id > 3 AND label IN (1, 2, 5) ORDER BY s DESC, vec_id LIMIT 15")
def vector_search_operators(spark, d):
    hits = S.vector_search(read(spark, d, "embeddings"), vector_of(spark, d, 0), 15, filters={"vec_id": ("gt", 3), "label": [1, 2, 5]})
    return rounded(hits.select("vec_id", "score"), "score")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 8),
r AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS s FROM embeddings, q),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM r)
SELECT query_id, vec_id, round(s, 6) AS score, rank::INT AS rank FROM n WHERE rank <= 5""")
def batch_vector_topk(spark, d):
    vectors = read(spark, d, "embeddings")
    queries = [(r["vec_id"], r["embedding"]) for r in vectors.filter("vec_id < 8").orderBy("vec_id").collect()]
    return rounded(S.batch_search(vectors, queries, 5), "score")


#: The vectors that are queries of a search of many: one in so many.
EVERY = 20


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % {EVERY} = 0),
r AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS s FROM embeddings, q),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM r)
SELECT query_id, vec_id, round(s, 6) AS score, rank::INT AS rank FROM n WHERE rank <= 5""")
def batch_vector_topk_all(spark, d):
    """Every vector whose id is divisible by EVERY among all; batch_vector_topk, as its SQL, takes eight."""
    vectors = read(spark, d, "embeddings")
    return rounded(N.vector_join(vectors, vectors.filter(F.col("vec_id") % EVERY == 0), 5), "score")


#: Hits of an approximate search, and the share of the exact ones that its number of probes is set for.
ANN_HITS, ANN_RECALL = 10, 0.95


def _inverted_file(spark, d):
    vectors = read(spark, d, "embeddings")
    file = N.InvertedFile.build(vectors)
    return vectors, file.search(vectors.filter(F.col("vec_id") % EVERY == 0), ANN_HITS, file.probes_for(vectors, ANN_HITS, ANN_RECALL))


@query(None)
def ann_topk(spark, d):
    """Every vector whose id is divisible by EVERY among those of its nearest cells."""
    return rounded(_inverted_file(spark, d)[1], "score")


@query(None)
def ann_recall(spark, d):
    """How many of the exact nearest vectors ann_topk finds."""
    vectors, found = _inverted_file(spark, d)
    exact = N.vector_join(vectors, vectors.filter(F.col("vec_id") % EVERY == 0), ANN_HITS)
    own = found.select("query_id", "vec_id", F.lit(1).alias("found"))
    return exact.join(own, ["query_id", "vec_id"], "left").agg(F.count("*").alias("n_exact"), F.count("found").alias("n_found"), F.round(F.avg(F.coalesce("found", F.lit(0))), 6).alias("recall"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean,
round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_metrics(spark, d):
    """Each vector with the next one, by three measures."""
    x = read(spark, d, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("u"))
    y = read(spark, d, "embeddings").select(F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    j = x.join(y, F.col("b") == F.col("a") + 1)
    return rounded(j.select("a", "b", *[V.similarity(F.col("u"), F.col("v"), m).alias(m) for m in ("cosine", "euclidean", "dot")]), "cosine", "euclidean", "dot")


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {QV}), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {QV}), vec_id LIMIT 10")
def euclid_topk(spark, d):
    hits = S.vector_search(read(spark, d, "embeddings"), vector_of(spark, d, 0), 10, metric="euclidean")
    return hits.select("vec_id", F.round(-F.col("score"), 6).alias("distance"))


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, round(v[1] / n, 6) AS x0, round(v[2] / n, 6) AS x1, round(v[64] / n, 6) AS x63, round(n, 6) AS norm FROM n""")
def normalize_vectors(spark, d):
    v = read(spark, d, "embeddings").withColumn("u", V.normalized(F.col("embedding")))
    return v.select("vec_id", *[F.round(F.col("u")[i], 6).alias(f"x{i}") for i in (0, 1, 63)], F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("""WITH e AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL),
n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)
SELECT m.label, (i - 1)::INT AS dim, round(m / n, 6) AS value FROM m JOIN n ON m.label = n.label""")
def centroid_by_label(spark, d):
    """Mean vector of each label, of length 1."""
    from spindrift.operators import vectors as A

    return A.centroids(read(spark, d, "embeddings"), "label").select("label", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, sum(x * (1 + vec_id % 5)) / sum(1 + vec_id % 5) AS m FROM e GROUP BY ALL)
SELECT label, (i - 1)::INT AS dim, round(m, 6) AS value FROM m""")
def vector_weighted_mean(spark, d):
    from spindrift.operators import vectors as A

    weighted = read(spark, d, "embeddings").withColumn("w", 1 + F.col("vec_id") % 5)
    return A.centroids(weighted, "label", weight="w", unit=False).select("label", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("""WITH n AS (SELECT len(embedding) AS dims, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, list_sum(list_transform(embedding, lambda x: CASE WHEN abs(x) < 1e-6 THEN 1 ELSE 0 END)) AS z FROM embeddings)
SELECT count(*) AS n_vectors, max(dims)::INT AS dims, round(sum(z) / sum(dims), 6) AS zero_share, round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm FROM n""")
def embedding_quality(spark, d):
    from spindrift.operators import vectors as A

    return rounded(A.quality(read(spark, d, "embeddings")), "zero_share", "mean_norm", "std_norm")


@query("""SELECT label, round(avg(s), 6) AS mean_similarity, round(stddev_pop(s), 6) AS std_similarity FROM (
SELECT label, list_cosine_similarity(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS s FROM embeddings) WHERE s IS NOT NULL GROUP BY label""")
def chain_similarity(spark, d):
    """Similarity of neighbours in each label's chain."""
    from spindrift.operators import vectors as A

    return rounded(A.chain_similarity(read(spark, d, "embeddings"), "label", "vec_id"), "mean_similarity", "std_similarity")


@query(f"SELECT doc_id, round(hits / {float(len(TERMS))}::DOUBLE, 6) AS score, exact_match FROM ({KEYWORD}) WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 20")
def keyword_search(spark, d):
    return rounded(stored_index(spark, d).keyword(WORDS, 20).select("doc_id", "score", "exact_match"), "score")


@query("SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%the and%'")
def exact_match(spark, d):
    return read(spark, d, "documents").filter(F.lower("text").contains("the and")).select("doc_id", "source")


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def inverted_index_df(spark, d):
    return stored_index(spark, d).frequencies()


@query(f"SELECT doc_id, round(sum(CASE term {' '.join(f'''WHEN '{t}' THEN {TERMS.count(t)}''' for t in TERMS)} END) / {float(len(TERMS))}::DOUBLE, 6) AS score FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) WHERE term IN ({', '.join(f'''{t!r}''' for t in TERMS)}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 25")
def index_search(spark, d):
    """Keyword search through the inverted index."""
    return rounded(S.index_search(S.inverted_index(read(spark, d, "documents")), WORDS, 25), "score")


BM25 = f"""w AS (SELECT doc_id, {TOKENS} AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, {", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(TERMS))} FROM w),
g AS (SELECT count(*) AS total, avg(n) AS mean, {", ".join(f"sum((f{i} > 0)::INT) AS df{i}" for i in range(len(TERMS)))} FROM c),
v AS (SELECT avg(ln((SELECT total FROM g) - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE)) AS mean_idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY term)),
i AS (SELECT total, mean, {", ".join(f"CASE WHEN df{i} = 0 THEN 0 WHEN ln(total - df{i} + 0.5::DOUBLE) - ln(df{i} + 0.5::DOUBLE) < 0 THEN 0.25::DOUBLE * mean_idf ELSE ln(total - df{i} + 0.5::DOUBLE) - ln(df{i} + 0.5::DOUBLE) END AS i{i}" for i in range(len(TERMS)))} FROM g, v),
b AS (SELECT doc_id, {" + ".join(f"i{i} * (f{i} * 2.5::DOUBLE / (f{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)))" for i in range(len(TERMS)))} AS bm25 FROM c, i)"""


@query(f"WITH {BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM b ORDER BY b.bm25 DESC, doc_id LIMIT 20")
def bm25_topk(spark, d):
    return rounded(stored_index(spark, d).bm25(WORDS, 20), "bm25")


@query(f"""WITH {BM25}, s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], {QV}) AS s FROM embeddings),
h AS (SELECT doc_id, s, bm25, 0.7::DOUBLE * s + 0.3::DOUBLE * bm25 AS score FROM b JOIN s ON doc_id = vec_id ORDER BY score DESC, doc_id LIMIT 20)
SELECT doc_id, round(s, 6) AS vector_score, round(bm25, 6) AS bm25, round(score, 6) AS score FROM h""")
def bm25_vector_hybrid(spark, d):
    hits = stored_index(spark, d).bm25_vector(read(spark, d, "embeddings"), WORDS, vector_of(spark, d, 0), 20)
    return rounded(hits.select("doc_id", "vector_score", "bm25", "score"), "vector_score", "bm25", "score")


@query(f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), f AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term), g AS (SELECT count(*) AS n FROM documents)
SELECT (SELECT n FROM g) AS n_docs, (SELECT count(*) FROM t) AS n_words, count(*) AS n_terms, sum(df)::BIGINT AS n_postings, round(avg(ln((SELECT n FROM g) - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE)), 6) AS mean_idf FROM f""")
def index_build(spark, d):
    """A new index of all documents, and what it counts."""
    index = I.Index.build(read(spark, d, "documents"), I.new_path(spark))
    n_terms, mean_idf = index.means
    counts = index.frequencies().agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return counts.select(F.lit(index.commit.n_docs).cast("long").alias("n_docs"), F.lit(index.commit.n_words).cast("long").alias("n_words"), "n_terms", "n_postings", F.round(F.lit(mean_idf), 6).alias("mean_idf"))


@query(f"WITH {BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM b ORDER BY b.bm25 DESC, doc_id LIMIT 20")
def index_segments(spark, d):
    """BM25 over an index of three segments, two of them appended."""
    docs = read(spark, d, "documents")
    part = F.col("doc_id") % 10
    index = I.Index.build(docs.filter(part > 1), I.new_path(spark)).append(docs.filter(part == 0)).append(docs.filter(part == 1))
    return rounded(index.bm25(WORDS, 20), "bm25")


@query(f"WITH {BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM b ORDER BY b.bm25 DESC, doc_id LIMIT 20")
def index_merged(spark, d):
    """BM25 over two segments that were merged."""
    docs = read(spark, d, "documents")
    late = F.col("doc_id") % 3 == 0
    return rounded(I.Index.build(docs.filter(~late), I.new_path(spark)).append(docs.filter(late)).merge().bm25(WORDS, 20), "bm25")


WEIGHTS = {"the": 1.0, "ertion": 2.5, "andthe": 0.5, "of": 0.7}
TOKEN_SCORE = f"({' + '.join(f'''CASE WHEN list_contains(w, '{t}') THEN least({w}::DOUBLE, 1.5::DOUBLE * ln({len(t)} + 1.0::DOUBLE)) ELSE 0 END''' for t, w in WEIGHTS.items())}) / {sum(WEIGHTS.values())}::DOUBLE"


@query(f"SELECT doc_id, round({TOKEN_SCORE}, 6) AS token_score FROM (SELECT doc_id, {TOKENS} AS w FROM documents)")
def token_similarity(spark, d):
    return rounded(S.token_similarity(read(spark, d, "documents"), WEIGHTS).select("doc_id", "token_score"), "token_score")


@query(f"""SELECT doc_id, round(t, 6) AS token_score, round(c, 6) AS vector_score, round(0.3::DOUBLE * t + 0.7::DOUBLE * c, 6) AS score FROM
(SELECT doc_id, {TOKEN_SCORE} AS t FROM (SELECT doc_id, {TOKENS} AS w FROM documents)) JOIN (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {QV}) AS c FROM embeddings) ON doc_id = vec_id ORDER BY 0.3::DOUBLE * t + 0.7::DOUBLE * c DESC, doc_id LIMIT 30""")
def hybrid_similarity(spark, d):
    tokens = S.token_similarity(read(spark, d, "documents").select("doc_id", "text"), WEIGHTS)
    cosines = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), V.cosine(F.col("embedding"), V.literal(vector_of(spark, d, 0))).alias("vector_score"))
    hits = R.mixed(tokens.join(cosines, "doc_id"), {"token_score": 0.3, "vector_score": 0.7})
    return rounded(S.top(hits, 30).select("doc_id", "token_score", "vector_score", "score"), "token_score", "vector_score", "score")


def _kw(words: str, k: int, name: str) -> str:
    terms = words.split()
    return f"{name} AS (SELECT doc_id, ({' + '.join(f'''len(list_filter(w, lambda x: x = '{t}'))''' for t in terms)}) / {float(len(terms))}::DOUBLE AS score FROM (SELECT doc_id, {TOKENS} AS w FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {k})"


@query(f"WITH {_kw('the of', 15, 'a')}, {_kw('ertion', 15, 'b')}, {_kw('and thtion', 15, 'c')} SELECT doc_id, round(max(score), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY doc_id ORDER BY max(score) DESC, doc_id LIMIT 15")
def multi_query_max(spark, d):
    index = stored_index(spark, d)
    return rounded(S.fuse_queries([index.keyword(q, 15) for q in ("the of", "ertion", "and thtion")], 15), "score")


@query(f"""WITH a AS (SELECT vec_id AS doc_id, list_dot_product(embedding::DOUBLE[], {QV}) AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT 10), {_kw('the of', 30, 'b')},
u AS (SELECT doc_id, score * 0.7::DOUBLE AS score, 'semantic' AS source, 0 AS o FROM a UNION ALL SELECT doc_id, score * 0.3::DOUBLE, 'keyword', 1 FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS n FROM u)
SELECT doc_id, round(score, 6) AS score, source FROM f WHERE n = 1 ORDER BY f.score DESC, doc_id LIMIT 20""")
def rank_dedup_fusion(spark, d):
    semantic = S.semantic_search(read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), vector_of(spark, d, 0), 10, threshold=-1.0, key="doc_id")
    keyword = S.keyword_search(read(spark, d, "documents"), "the of", 30)
    return rounded(S.merge_ranked([("semantic", 0.7, semantic), ("keyword", 0.3, keyword)], 20), "score")


FULL = " + ".join([f"(CASE WHEN list_contains(w, '{t}') THEN 1.5::DOUBLE * ln({len(t)} + 1.0::DOUBLE) ELSE 0 END)" for t in TERMS] + [f"(CASE WHEN ' ' || array_to_string(w, ' ') || ' ' LIKE '% {a} {b} %' THEN 3.0::DOUBLE * ln({max(len(a), len(b))} + 1.0::DOUBLE) ELSE 0 END)" for a, b in zip(TERMS, TERMS[1:])])


@query(f"SELECT doc_id, matched::INT AS matched, round(score, 6) AS score FROM (SELECT doc_id, {' + '.join(f'''list_contains(w, '{t}')::INT''' for t in TERMS)} AS matched, {FULL} AS score FROM (SELECT doc_id, {TOKENS} AS w FROM documents)) q WHERE matched >= 2 ORDER BY q.score DESC, doc_id LIMIT 40")
def full_text_search(spark, d):
    hits = S.full_text(read(spark, d, "documents"), WORDS, 0.5)
    return rounded(S.top(hits, 40).select("doc_id", "matched", "score"), "score")


HITS = f"(SELECT doc_id, hits / {float(len(TERMS))}::DOUBLE AS s FROM ({KEYWORD}) WHERE hits > 0 ORDER BY s DESC, doc_id LIMIT 60)"


def _hits(spark, d, k=60):
    return S.keyword_search(read(spark, d, "documents"), WORDS, k)


@query(f"SELECT doc_id, page, round(s * (1 + exp(-0.1::DOUBLE * page)), 6) AS score FROM (SELECT h.doc_id, s, (n_chars // 1000)::BIGINT AS page FROM {HITS} h JOIN documents d ON h.doc_id = d.doc_id)")
def rerank_page_position(spark, d):
    hits = _hits(spark, d).withColumn("page", F.floor(F.col("n_chars") / 1000))
    return rounded(R.by_page(hits, "page").select("doc_id", "page", "score"), "score")


@query(f"SELECT h.doc_id, round(s * (1 + 0.3::DOUBLE * ((lang = 'en')::INT + (source = 'src1')::INT + 1 / (1 + abs(n_chars - 1000))) / 3), 6) AS score FROM {HITS} h JOIN documents d ON h.doc_id = d.doc_id")
def rerank_metadata(spark, d):
    return rounded(R.by_metadata(_hits(spark, d), {"lang": "en", "source": "src1", "n_chars": 1000}).select("doc_id", "score"), "score")


@query(f"""WITH h AS (SELECT h.doc_id, s, list_filter(['the', 'and', 'ertion', 'que'], lambda t: list_contains({TOKENS}, t)) AS topics, CASE WHEN n_chars < 1500 THEN 'basic' ELSE 'advanced' END AS level, lang AS intent FROM {HITS} h JOIN documents d ON h.doc_id = d.doc_id),
e AS (SELECT doc_id, s, len(list_intersect(topics, ['the', 'ertion', 'que'])) AS n, CASE WHEN level = 'basic' THEN 0.3::DOUBLE ELSE 0.15 END + CASE WHEN intent = 'en' THEN 0.3::DOUBLE ELSE 0.15 END AS r FROM h)
SELECT doc_id, round(0.4::DOUBLE * n / 3 + r, 6) AS educational, round(n / 3, 6) AS curriculum, round(0.5::DOUBLE * s + 0.3::DOUBLE * (0.4::DOUBLE * n / 3 + r) + 0.2::DOUBLE * n / 3, 6) AS final_score FROM e""")
def rerank_educational(spark, d):
    hits = _hits(spark, d)
    topics = F.filter(F.array(*map(F.lit, ("the", "and", "ertion", "que"))), lambda t: F.array_contains(T.words(F.col("text")), t))
    hits = hits.withColumns({"topics": topics, "level": F.when(F.col("n_chars") < 1500, "basic").otherwise("advanced"), "intent": F.col("lang")})
    scored = R.educational(hits, ["the", "ertion", "que"], "basic", "en")
    return rounded(scored.select("doc_id", "educational", "curriculum", "final_score"), "educational", "curriculum", "final_score")


@query(f"SELECT source, count(*) AS n FROM {HITS} h JOIN documents d ON h.doc_id = d.doc_id GROUP BY source")
def retrieval_facets(spark, d):
    return R.facets(_hits(spark, d), "source")


@query(f"SELECT doc_id, round(s, 6) AS score FROM {HITS} h WHERE s >= 0.2::DOUBLE ORDER BY s DESC, doc_id LIMIT 10 OFFSET 10")
def retrieval_page(spark, d):
    hits = _hits(spark, d).filter("score >= 0.2")
    return rounded(S.page(hits.select("doc_id", "score"), 2, 10, F.desc("score"), F.asc("doc_id")), "score")


@query("SELECT source, count(*) AS n, round((count(*) + 1) / (sum(count(*)) OVER () + 1000), 6) AS share FROM documents GROUP BY source")
def tag_facets_smoothed(spark, d):
    return rounded(R.smoothed_shares(read(spark, d, "documents"), "source"), "share")


@query("""WITH p AS (SELECT source, (count(*) + 1) / (sum(count(*)) OVER () + 1000) AS share FROM documents GROUP BY source), h AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total FROM documents WHERE lang = 'fr' GROUP BY source)
SELECT h.source, round_even(1.0::DOUBLE * 0.1::DOUBLE * (n + 1) / (total + 1000) / greatest(1e-6, share) * 10, 0)::BIGINT AS tag_score FROM h JOIN p ON h.source = p.source ORDER BY tag_score DESC, h.source LIMIT 3""")
def tag_scores(spark, d):
    docs = read(spark, d, "documents")
    return R.tag_scores(docs.filter("lang = 'fr'"), "source", R.smoothed_shares(docs, "source"), floor=0)


@query("""WITH f AS (SELECT d.doc_id, coalesce(quality, 0) AS pagerank, length(source) AS a, n_chars % 7 AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, round(coalesce(10 * (2.0::DOUBLE * a + 1.0::DOUBLE * b) / nullif(sqrt((a * a + b * b)::DOUBLE) * sqrt(5.0::DOUBLE), 0), 0) + pagerank, 6) AS rank_score FROM f""")
def rank_feature_scores(spark, d):
    joined = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    features = F.create_map(F.lit("a"), F.length("source").cast("double"), F.lit("b"), (F.col("n_chars") % 7).cast("double"))
    hits = joined.select("doc_id", F.coalesce("quality", F.lit(0)).alias("pagerank"), features.alias("features"))
    return rounded(R.rank_features(hits, {"a": 2.0, "b": 1.0}).select("doc_id", "rank_score"), "rank_score")


@query(f"SELECT count(*) AS total, round(avg(s), 6) AS avg_score, round(max(s), 6) AS max_score, round(min(s), 6) AS min_score, count(*) FILTER (s >= 1) AS above, round(avg((quality IS NOT NULL)::INT), 6) AS coverage_quality FROM {HITS} h LEFT JOIN labels l ON h.doc_id = l.doc_id")
def result_analysis(spark, d):
    hits = _hits(spark, d).join(read(spark, d, "labels"), "doc_id", "left")
    return rounded(R.result_analysis(hits, 1.0, ["quality"]), "avg_score", "max_score", "min_score", "coverage_quality")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' OR source = 'src3'")
def access_filter(spark, d):
    """Public rows (here: English) or rows of the reader's department (here: a source)."""
    return read(spark, d, "documents").filter(S.where({"lang": "en"}) | S.where({"source": "src3"})).select("doc_id", "lang", "source")


@query(f"""WITH m AS (SELECT 'text' AS modality, 1.0::DOUBLE AS f UNION ALL SELECT 'image', -1.0 UNION ALL SELECT 'audio', 0.5),
r AS (SELECT modality, vec_id, list_cosine_similarity(list_transform(embedding::DOUBLE[], lambda x: x * f), {QV}) AS s FROM embeddings, m), n AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY s DESC, vec_id) AS rank FROM r)
SELECT modality, vec_id, round(s, 6) AS score, rank::INT AS rank FROM n WHERE rank <= 3""")
def multimodal_topk(spark, d):
    """The three nearest vectors of each modality's query, in one pass."""
    q = vector_of(spark, d, 0)
    names, signs = ("text", "image", "audio"), (1.0, -1.0, 0.5)
    hits = S.batch_search(read(spark, d, "embeddings"), [(i, [x * s for x in q]) for i, s in enumerate(signs)], 3)
    modality = F.element_at(F.array(*map(F.lit, names)), (F.col("query_id") + 1).cast("int"))
    return rounded(hits.select(modality.alias("modality"), "vec_id", "score", "rank"), "score")
