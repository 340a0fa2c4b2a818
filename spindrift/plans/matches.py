"""Search requests written as match expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import match as X
from spindrift.operators import search as S
from spindrift.sources.tables import read

from .catalog import query
from .search import FULL, KEYWORD, QV, TERMS, TOKENS, WORDS, rounded, vector_of

DENSE = f"SELECT vec_id AS doc_id, list_dot_product(embedding::DOUBLE[], {QV}) AS s, list_cosine_similarity(embedding::DOUBLE[], {QV}) AS c FROM embeddings"
MATCHED = " + ".join(f"list_contains(w, '{t}')::INT" for t in TERMS)


def _with_vectors(spark, d):
    """Documents with their vector, if they have one."""
    return read(spark, d, "documents").join(read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")


@query(f"""WITH s AS (SELECT e.doc_id, 0.7::DOUBLE * s AS s FROM ({DENSE}) e JOIN documents d ON e.doc_id = d.doc_id WHERE lang = 'en' ORDER BY e.s DESC, e.doc_id LIMIT 20),
k AS (SELECT k.doc_id, 0.3::DOUBLE * hits / {float(len(TERMS))}::DOUBLE AS s FROM ({KEYWORD}) k JOIN documents d ON k.doc_id = d.doc_id WHERE hits > 0 AND lang = 'en' ORDER BY hits DESC, k.doc_id LIMIT 20)
SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM k) GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 20""")
def match_hybrid(spark, d):
    """Hybrid search as an expression: the filter is below both rankings."""
    parts = [X.Dense(vector_of(spark, d, 0), metric="dot", top=20), X.Words(WORDS, top=20)]
    return rounded(X.compile(X.Where({"lang": "en"}, X.Fusion(parts, (0.7, 0.3), top=20)), _with_vectors(spark, d)), "score")


@query(f"SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, {MATCHED} AS matched, {FULL} AS score FROM (SELECT doc_id, {TOKENS} AS w FROM documents)) q WHERE matched >= 2 ORDER BY q.score DESC, doc_id LIMIT 40")
def match_full_text(spark, d):
    """Full-text search as an expression."""
    return rounded(X.compile(X.Text(WORDS, min_match=0.5, top=40), read(spark, d, "documents")), "score")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t, regexp_extract_all(lower(source), '[\\p{L}\\p{N}_]+') AS s FROM documents),
b AS (SELECT doc_id, CASE WHEN list_contains(s, 'src1') THEN 10 WHEN list_contains(t, 'src1') THEN 2 ELSE 0 END AS b1, CASE WHEN list_contains(s, 'the') THEN 10 WHEN list_contains(t, 'the') THEN 2 ELSE 0 END AS b2, CASE WHEN list_contains(s, 'of') THEN 10 WHEN list_contains(t, 'of') THEN 2 ELSE 0 END AS b3,
CASE WHEN ' ' || array_to_string(t, ' ') || ' ' LIKE '% src1 the %' THEN 2 ELSE 0 END AS p1, CASE WHEN ' ' || array_to_string(t, ' ') || ' ' LIKE '% the of %' THEN 2 ELSE 0 END AS p2 FROM w),
c AS (SELECT doc_id, 1.5::DOUBLE * (ln(5.0::DOUBLE) * b1 + ln(4.0::DOUBLE) * b2 + ln(3.0::DOUBLE) * b3 + 2 * ln(5.0::DOUBLE) * p1 + 2 * ln(4.0::DOUBLE) * p2) AS score, (b1 > 0)::INT + (b2 > 0)::INT + (b3 > 0)::INT AS n FROM b)
SELECT doc_id, round(c.score, 6) AS score FROM c WHERE n >= 2 ORDER BY c.score DESC, doc_id LIMIT 50""")
def match_boosted_fields(spark, d):
    """Two fields of different boosts."""
    return rounded(X.compile(X.Text("src1 the of", {"source": 10.0, "text": 2.0}, min_match=0.7, top=50), read(spark, d, "documents")), "score")


@query(f"""WITH t AS (SELECT doc_id, 0.05::DOUBLE * ({FULL}) AS s, {MATCHED} AS matched FROM (SELECT doc_id, {TOKENS} AS w FROM documents)),
v AS (SELECT e.doc_id, 0.95::DOUBLE * c AS s FROM ({DENSE}) e JOIN documents d ON e.doc_id = d.doc_id WHERE c >= 0.1::DOUBLE ORDER BY c DESC, e.doc_id LIMIT 30),
f AS (SELECT doc_id, sum(s) AS score FROM (SELECT doc_id, s FROM t WHERE matched >= 1 UNION ALL SELECT * FROM v) GROUP BY doc_id)
SELECT f.doc_id, round(f.score, 6) AS score, lang FROM f JOIN documents d ON f.doc_id = d.doc_id ORDER BY lang, f.score DESC, f.doc_id LIMIT 15 OFFSET 15""")
def match_fused_page(spark, d):
    """The second page of text and vector, weighted 5 to 95, by language and score."""
    fused = X.Fusion([X.Text(WORDS, min_match=0.3), X.Dense(vector_of(spark, d, 0), similarity=0.1, top=30)], (0.05, 0.95))
    return rounded(X.search(_with_vectors(spark, d), fused, order=[("lang", False)], page=2, size=15, fields=["lang"]), "score")


@query(f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents), s AS (SELECT doc_id, 2.0::DOUBLE * len(list_filter(w, lambda x: x = 'the')) + 3.0::DOUBLE * len(list_filter(w, lambda x: x = 'ertion')) AS s FROM w),
a AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM s WHERE s != 0 ORDER BY s DESC, doc_id LIMIT 25), b AS (SELECT e.doc_id, row_number() OVER (ORDER BY c DESC, e.doc_id) AS r FROM ({DENSE}) e JOIN documents d ON e.doc_id = d.doc_id ORDER BY c DESC, e.doc_id LIMIT 25)
SELECT doc_id, round(sum(1 / (60 + r)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id""")
def match_sparse_ranks(spark, d):
    """A sparse and a dense ranking, fused by ranks."""
    def times(t):
        return F.size(F.filter("w", lambda y: y == t)).cast("double")

    features = F.create_map(*[x for t in ("the", "ertion", "of") for x in (F.lit(t), times(t))])
    rows = S.once(_with_vectors(spark, d), "w", T.words(F.col("text"))).withColumn("features", features)
    parts = [X.Sparse({"the": 2.0, "ertion": 3.0}, top=25), X.Dense(vector_of(spark, d, 0), top=25)]
    return rounded(X.compile(X.Fusion(parts, how="ranks"), rows), "score")
