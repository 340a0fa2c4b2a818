"""Segmentation, glued terms and term weights by a dictionary of the documents' words."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import segment as G
from spindrift.sources.tables import read

from .catalog import query
from .search import rounded

#: Words of the dictionary: the most frequent ones.
ENTRIES = 20_000
STOP = ("of", "de", "la", "in")


#: Documents whose words one task sorts, about.
TASK_DOCS = 2048


@query(None)
def segmented_text(spark, d):
    """Benchmark texts without their spaces, cut into words of the documents."""
    counts = read(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    lines = [f"{r['w']} {r['n'] * 1000} w" for r in counts.orderBy(F.desc("n"), "w").limit(ENTRIES).toLocalIterator()]
    joined = F.regexp_replace("text", r"[^\p{L}\p{N}_]+", "")
    words = read(spark, d, "benchmark").select("item_id", G.segmenter(G.dictionary(lines))(joined).alias("words"))
    return words.select("item_id", F.size("words").alias("n_words"), F.md5(F.array_join("words", " ").cast("binary")).alias("digest"))


SHORT = "(length({0}) = 1 OR regexp_matches({0}, '^[0-9a-z]{{1,2}}$'))"
LONGER = "(length({0}) > 1 AND NOT regexp_matches({0}, '^[0-9a-zA-Z]'))"


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS i FROM w),
n AS (SELECT *, lead(t) OVER o AS nx, lag(t) OVER o AS pv FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, coalesce(CASE i WHEN 0 THEN {SHORT.format("t")} AND {LONGER.format("nx")} WHEN 1 THEN {SHORT.format("pv")} AND {LONGER.format("t")} END, false) AS paired FROM n),
s AS (SELECT *, {SHORT.format("t")} AND t NOT IN {STOP} AND NOT paired AS short FROM p),
r AS (SELECT *, CASE WHEN paired THEN i = 0 ELSE NOT coalesce(short AND lag(short) OVER (PARTITION BY doc_id ORDER BY i), false) END AS fresh FROM s),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY doc_id, run) AS n FROM g),
m AS (SELECT doc_id, run, CASE WHEN paired THEN 0 ELSE least(p // 2, greatest(ceil((n - 4) / 2.0::DOUBLE)::BIGINT, 0)) END AS part, string_agg(t, ' ' ORDER BY i) AS term, min(i) AS first FROM k GROUP BY 1, 2, 3)
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY term""")
def merged_terms(spark, d):
    """Terms of documents' words, short neighbours glued."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    # Whole texts are dealt to tasks, so that their words are sorted and counted there without a shuffle of words.
    dealt = docs.repartition(max(spark.sparkContext.defaultParallelism, -(-docs.count() // TASK_DOCS)), "doc_id")
    tokens = dealt.select("doc_id", F.posexplode(T.words(F.col("text"))).alias("place", "token"))
    each = G.merged_tokens(tokens, STOP).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("n"), F.count("doc_id").alias("n_docs"))


@query(r"""WITH t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark), d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents),
e AS (SELECT term, count(*) AS freq, count(DISTINCT doc_id) AS df, CASE WHEN length(term) > 8 THEN 'corp' END AS kind, CASE WHEN length(term) = 3 THEN 'n' WHEN length(term) = 4 THEN 'd' END AS tag FROM d GROUP BY term),
j AS (SELECT item_id, t.term, freq, df, kind, tag, regexp_matches(t.term, '^[0-9. -]{2,}$') AS digits, regexp_matches(t.term, '^[a-z. -]+$') AS letters FROM t LEFT JOIN e ON t.term = e.term),
c AS (SELECT item_id, term, CASE WHEN digits THEN 3 WHEN coalesce(freq, 0) > 0 THEN greatest(freq, 10) WHEN letters THEN 300 ELSE 10 END AS f, CASE WHEN digits THEN 5 WHEN df IS NOT NULL THEN df + 3 WHEN letters THEN 300 ELSE 3 END AS g,
CASE WHEN regexp_matches(term, '^[0-9,.]{2,}$') THEN 2 WHEN regexp_matches(term, '^[a-z]{1,2}$') THEN 0.01 WHEN kind = 'corp' THEN 3 ELSE 1 END::DOUBLE * CASE tag WHEN 'n' THEN 2 WHEN 'd' THEN 0.3 ELSE 1 END::DOUBLE AS factor FROM j),
w AS (SELECT item_id, term, (0.3::DOUBLE * log10(10 + (10000000 - f + 0.5::DOUBLE) / (f + 0.5::DOUBLE)) + 0.7::DOUBLE * log10(10 + (1000000000 - g + 0.5::DOUBLE) / (g + 0.5::DOUBLE))) * factor AS w FROM c)
SELECT item_id, term, round(w / sum(w) OVER (PARTITION BY item_id), 6) AS weight FROM w""")
def dictionary_weights(spark, d):
    """Weights of benchmark terms by the documents' counts; long words stand for companies, words of three and four letters for nouns and adverbs."""
    words = read(spark, d, "documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("freq"), F.countDistinct("doc_id").alias("df"))
    n = F.length("term")
    entries = words.withColumns({"kind": F.when(n > 8, "corp"), "tag": F.when(n == 3, "n").when(n == 4, "d")})
    terms = read(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    return rounded(G.weighted_terms(terms, entries, "item_id"), "weight")
