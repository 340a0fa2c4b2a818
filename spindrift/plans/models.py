"""Reranking by a model of pairs. The weights written out here are parameters, so that SQL can give the same rows; one query fits its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import neighbours as N
from spindrift.operators import pairmodel as P
from spindrift.operators import rerank as R
from spindrift.sources.tables import read

from .catalog import query
from .search import BM25, HITS, QV, TOKENS, WORDS, _hits, rounded, stored_index, vector_of

MODEL = P.PairModel((3.0, 2.0, 0.5, 4.0), -2.5)


def _scored(q: str, w: str) -> str:
    """The model's score in SQL of two lists of words, with its weights as numbers."""
    places = f"list_filter(list_transform(list_distinct({q}), lambda x: list_position({w}, x)), lambda p: p > 0)"
    pairs = f"list_transform(range(1, len({q})), lambda i: ' ' || {q}[i] || ' ' || {q}[i + 1] || ' ')"
    together = f"len(list_filter({pairs}, lambda p: contains(' ' || array_to_string({w}, ' ') || ' ', p)))"
    share = f"coalesce(len({places}) / nullif(len(list_distinct({q})), 0), 0)"
    dense = f"coalesce(len(list_filter({w}, lambda x: list_contains({q}, x))) / nullif(len({w}), 0), 0)"
    near = f"CASE WHEN len({q}) > 1 THEN {together} / (len({q}) - 1) ELSE 0 END"
    total = f"-2.5::DOUBLE + 3.0::DOUBLE * {share} + 2.0::DOUBLE * {near} + 0.5::DOUBLE * coalesce(1.0::DOUBLE / list_min({places}), 0) + 4.0::DOUBLE * {dense}"
    return f"1 / (1 + exp(-({total})))"


ASKED = f"(SELECT doc_id, {TOKENS} AS w, regexp_extract_all('{WORDS}', '[\\p{{L}}\\p{{N}}_]+') AS q FROM documents)"


@query(f"""WITH l AS (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id)
SELECT h.doc_id, round(s, 6) AS token_score, round(0.3::DOUBLE * (s + coalesce(quality, 0)) + 0.7::DOUBLE * {_scored('q', 'w')}, 6) AS score FROM {HITS} h JOIN {ASKED} a ON a.doc_id = h.doc_id LEFT JOIN l ON l.doc_id = h.doc_id""")
def model_rerank(spark, d):
    """Keyword hits by token score, label and the model."""
    hits = _hits(spark, d).join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    hits = hits.withColumns({"token_score": F.col("score"), "rank_score": F.coalesce("quality", F.lit(0)).cast("double")})
    return rounded(R.by_model(hits, MODEL, WORDS).select("doc_id", "token_score", "score"), "token_score", "score")


@query(f"""WITH {BM25}, s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], {QV}) AS s FROM embeddings),
h AS (SELECT doc_id, 0.7::DOUBLE * s + 0.3::DOUBLE * bm25 AS first FROM b JOIN s ON doc_id = vec_id ORDER BY first DESC, doc_id LIMIT 20)
SELECT h.doc_id, round({_scored('q', 'w')}, 6) AS score, row_number() OVER (ORDER BY {_scored('q', 'w')} DESC, h.doc_id)::INT AS rank FROM h JOIN {ASKED} a ON a.doc_id = h.doc_id""")
def bm25_vector_model_rerank(spark, d):
    """The hybrid's hits, whose scores the model's replace."""
    hits = stored_index(spark, d).bm25_vector(read(spark, d, "embeddings"), WORDS, vector_of(spark, d, 0), 20)
    asked = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(WORDS).alias("words"))
    ranked = P.reranked(hits.select(F.lit(0).alias("query_id"), "doc_id"), asked, read(spark, d, "documents"), MODEL)
    return rounded(ranked.select("doc_id", "score", "rank"), "score")


QUESTION = f"(SELECT doc_id AS query_id, ({TOKENS})[3:10] AS q FROM documents WHERE doc_id % 20 = 0)"


@query(f"""WITH n AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
p AS (SELECT n.query_id, n.doc_id, {_scored('q', 'w')} AS s FROM n JOIN {QUESTION} q ON q.query_id = n.query_id JOIN (SELECT doc_id, {TOKENS} AS w FROM documents) d ON d.doc_id = n.doc_id WHERE n <= 8)
SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id)::INT AS rank FROM p""")
def vector_hits_model_rerank(spark, d):
    """Of every twentieth vector the eight nearest, reranked for eight words of the document of the same id."""
    vectors, docs = read(spark, d, "embeddings"), read(spark, d, "documents")
    hits = N.vector_join(vectors, vectors.filter("vec_id % 20 = 0"), 8).select("query_id", F.col("vec_id").alias("doc_id"))
    asked = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(T.words(F.col("text")), 3, 8), " ").alias("words"))
    return rounded(P.reranked(hits, asked, docs, MODEL).select("query_id", "doc_id", "score", "rank"), "score")


@query(None)
def fitted_model_rerank(spark, d):
    """Keyword hits by a model fitted on pairs of the documents' own words; tests hold it against plain loops and pairs that it did not see."""
    docs = read(spark, d, "documents")
    model = P.fit(P.own_pairs(docs, "doc_id", "text"))
    hits = _hits(spark, d).withColumns({"token_score": F.col("score"), "rank_score": F.lit(0.0)})
    return rounded(R.by_model(hits, model, WORDS).select("doc_id", "token_score", "score"), "token_score", "score")
