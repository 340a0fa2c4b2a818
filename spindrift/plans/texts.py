"""Text functions over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import chunking as C
from spindrift.operators import standards as D
from spindrift.operators import terms as K
from spindrift.operators import validation as L
from spindrift.sources.tables import read

from .catalog import query
from .search import rounded

COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _md5(column):
    return F.md5(column.cast("binary"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest, len(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_chars FROM pages")
def clean_html(spark, d):
    text = T.collapsed(T.without_tags(F.col("html"), " "))
    return read(spark, d, "pages").select("page_id", _md5(text).alias("digest"), F.length(text).cast("long").alias("n_chars"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\$[^$]+\$', '', 'g'), '\\\[.*?\\\]', '', 'g'), '\\[a-zA-Z]+\{[^}]*\}', '', 'g')) AS digest FROM documents")
def clean_latex(spark, d):
    return read(spark, d, "documents").select("doc_id", _md5(T.without_latex(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[^\p{L}\p{N}_\s.,!?-]', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def sanitize(spark, d):
    return read(spark, d, "documents").select("doc_id", _md5(T.sanitized(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '[\w\.-]+@[\w\.-]+')) AS email FROM documents")
def emails(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(T.emails(F.col("text"))).alias("email"))


@query(r"""SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\s<>"]+|www\.[^\s<>"]+')) AS url FROM documents""")
def urls(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(T.urls(F.col("text"))).alias("url"))


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x != '') AS w FROM documents)
SELECT doc_id, len(text) AS char_count, len(w) AS word_count, len(regexp_split_to_array(text, '[.!?]+')) AS sentence_count, round(coalesce(list_sum(list_transform(w, lambda x: len(x))) / nullif(len(w), 0), 0), 6) AS avg_word_length FROM w""")
def text_metrics(spark, d):
    m = read(spark, d, "documents").select("doc_id", T.metrics(F.col("text")).alias("m")).select("doc_id", "m.*")
    return rounded(m.withColumns({c: F.col(c).cast("long") for c in ("char_count", "word_count", "sentence_count")}), "avg_word_length")


READABLE = r"""SELECT doc_id, text, (greatest(0, 1 - coalesce(len(w) / nullif(s, 0), 0) / 40) + greatest(0, 1 - coalesce(l / nullif(len(w), 0), 0) / 10)) / 2 AS r FROM (
SELECT doc_id, text, w, list_sum(list_transform(w, lambda x: len(x))) AS l, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) != '')) AS s FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x != '') AS w FROM documents))"""


@query(f"SELECT doc_id, round(r, 6) AS readability FROM ({READABLE})")
def readability(spark, d):
    return rounded(read(spark, d, "documents").select("doc_id", T.readability(F.col("text")).alias("readability")), "readability")


BANNED = ("idiot", "scum", "moron")
ISSUES = f"""SELECT doc_id, text, r, list_filter([CASE WHEN len(text) < 100 THEN 'high' END, CASE WHEN r < 0.7 THEN 'medium' END, CASE WHEN {" OR ".join(f"list_contains(w, '{b}')" for b in BANNED)} THEN 'low' END], lambda x: x IS NOT NULL) AS issues
FROM (SELECT *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM ({READABLE}))"""
SCORE = "greatest(0, 1 - coalesce(list_sum(list_transform(issues, lambda s: CASE s WHEN 'high' THEN 0.5::DOUBLE WHEN 'medium' THEN 0.3 ELSE 0.2 END)), 0))"


@query(f"SELECT doc_id, len(issues) AS n_issues, array_to_string(issues, ',') AS severities, round({SCORE}, 6) AS score, {SCORE} >= 0.7::DOUBLE AS is_valid FROM ({ISSUES})")
def validate_content(spark, d):
    checked = L.validate(read(spark, d, "documents"), BANNED)
    return rounded(checked.select("doc_id", F.size("issues").cast("long").alias("n_issues"), F.array_join(F.transform("issues", lambda i: i["severity"]), ",").alias("severities"), "score", "is_valid"), "score")


@query(f"SELECT d.lang, count(*) AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (score >= 0.7::DOUBLE) AS n_valid FROM (SELECT doc_id, {SCORE} AS score FROM ({ISSUES})) s JOIN documents d ON s.doc_id = d.doc_id GROUP BY d.lang")
def validation_score(spark, d):
    return rounded(L.report(L.validate(read(spark, d, "documents"), BANNED), "lang"), "mean_score")


INTENTS = {"question": r"\?", "greeting": "(?i)^(is|and|the|of)", "request": r"(?i)(^|[^\p{L}])(to|for|with)([^\p{L}]|$)"}


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\?') THEN 'question' WHEN regexp_matches(text, '(?i)^(is|and|the|of)') THEN 'greeting' WHEN regexp_matches(text, '(?i)(^|[^\p{L}])(to|for|with)([^\p{L}]|$)') THEN 'request' ELSE 'general' END AS intent FROM conversations WHERE role = 'user'""")
def intent_classify(spark, d):
    turns = read(spark, d, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", T.first_match(F.col("text"), INTENTS, "general").alias("intent"))


@query(r"""SELECT conv_id, turn, CASE WHEN list_contains(['what', 'who', 'when', 'where', 'why', 'how', 'which', 'is', 'are'], regexp_extract(lower(text), '^\s*([\p{L}]+)', 1)) OR regexp_matches(text, '\?\s*$') THEN 'question' WHEN len(w) <= 3 THEN 'topic' ELSE 'statement' END AS query_type
FROM (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations WHERE role = 'user')""")
def query_type(spark, d):
    turns = read(spark, d, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", L.query_type(F.col("text")).alias("query_type"))


DROP, REPLACE = [r"\d+", r"\b[A-Z]\b"], {"the": "that", "->": " to "}


@query(r"SELECT conv_id, turn, md5(lower(trim(replace(replace(regexp_replace(text, '[0-9]+', ' ', 'g'), 'the', 'that'), '->', ' to ')))) AS digest FROM conversations")
def preprocess_query(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", _md5(T.stripped_terms(F.col("text"), ["[0-9]+"], REPLACE)).alias("digest"))


@query(r"SELECT conv_id, turn, array_to_string(list_filter(['the', 'ertion', 'que', 'und'], lambda k: list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), k)), ',') AS concepts FROM conversations")
def concepts(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(L.concepts(F.col("text"), ("the", "ertion", "que", "und")), ",").alias("concepts"))


@query(r"""SELECT doc_id, len(b) AS n_brackets, regexp_matches(trim(text), '[.!?]\s*$') AS complete FROM (SELECT doc_id, text, regexp_extract_all(text, '[()\[\]{}]') AS b FROM documents)""")
def sentence_checks(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[()\[\]{}]"), F.lit(0))).cast("long").alias("n_brackets"), T.is_complete(F.col("text")).alias("complete"))


@query(None)
def chunk_validity(spark, d):
    return read(spark, d, "documents").select("doc_id", T.is_balanced(F.col("text")).alias("balanced"), T.is_valid_chunk(F.col("text")).alias("valid"))


@query(r"SELECT doc_id, md5('Context: ' || lang || chr(10) || 'Question: ' || left(text, 50) || chr(10) || 'Chunk 1:' || chr(10) || left(text, 20) || chr(10) || chr(10) || 'Chunk 2:' || chr(10) || substr(text, 21, 20)) AS digest FROM documents")
def prompt_assembly(spark, d):
    template = "Context: ${context}\nQuestion: ${question}\n${chunks}"
    chunks = T.numbered(F.array(F.substring("text", 1, 20), F.substring("text", 21, 20)))
    prompt = T.filled(template, {"context": F.col("lang"), "question": F.substring("text", 1, 50), "chunks": chunks}, ("question",))
    return read(spark, d, "documents").select("doc_id", _md5(prompt).alias("digest"))


@query(None)
def prompt_assembly_all(spark, d):
    """A prompt of each whole text and all its chunks; prompt_assembly, as its SQL, takes the first characters."""
    return prompts(read(spark, d, "documents")).select("doc_id", _md5(F.col("prompt")).alias("digest"))


def prompts(docs):
    """doc_id and prompt of every row."""
    template = "Context: ${context}\nQuestion: ${question}\n${chunks}"
    values = {"context": F.col("lang"), "question": F.col("text"), "chunks": T.numbered(C.fixed_array(F.col("text")))}
    return docs.select("doc_id", T.filled(template, values, ("question",)).alias("prompt"))


@query("SELECT doc_id, CASE WHEN len(text) > 40 THEN left(text, 37) || '...' ELSE text END AS short FROM documents")
def truncate_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.truncated(F.col("text"), 40).alias("short"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '(?i)([^\p{L}]|^)(ertion|thtion)([^\p{L}]|$)', '\1<em>\2</em>\3', 'g')) AS digest FROM documents")
def highlight(spark, d):
    marked = F.regexp_replace("text", r"(?i)([^\p{L}]|^)(ertion|thtion)([^\p{L}]|$)", "$1<em>$2</em>$3")
    return read(spark, d, "documents").select("doc_id", _md5(marked).alias("digest"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\d+(?:\.\d+)?|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS t FROM documents),
k AS (SELECT doc_id, t, CASE WHEN regexp_matches(t, '^\d+(\.\d+)?$') THEN 'NUMBER' WHEN regexp_matches(t, '^[\p{P}]+$') THEN 'PUNCTUATION' WHEN regexp_matches(t, '^[^\p{L}\p{N}\s]+$') THEN 'SPECIAL' ELSE 'WORD' END AS kind FROM t)
SELECT kind, count(*) AS n, count(DISTINCT t) AS n_unique, round(avg(len(t)), 6) AS mean_length, round(sum((CASE kind WHEN 'WORD' THEN 1.5::DOUBLE WHEN 'NUMBER' THEN 1.2 ELSE 1 END) * ln(len(t) + 1)), 3) AS weight FROM k GROUP BY kind""")
def token_profile(spark, d):
    tokens = read(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("t")).withColumn("kind", T.token_type(F.col("t")))
    return tokens.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("t").alias("n_unique"), F.round(F.avg(F.length("t")), 6).alias("mean_length"), F.round(F.sum(T.token_weight(F.col("t"))), 3).alias("weight"))


@query(r"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark), f AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL),
g AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT item_id, f.term, tf * log10(10 + (n - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) AS w FROM f LEFT JOIN g ON f.term = g.term, n)
SELECT item_id, term, round(w / sum(w) OVER (PARTITION BY item_id), 6) AS weight FROM w""")
def term_weights(spark, d):
    weights = K.term_weights(read(spark, d, "benchmark"), read(spark, d, "documents"), key="item_id")
    return rounded(weights, "weight")


SYNONYMS = [("the", "that"), ("the", "this"), ("of", "from"), ("ertion", "action")]


@query(f"""SELECT conv_id, turn, t.term, s.synonym FROM (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS term FROM conversations) t JOIN (VALUES {", ".join(map(str, SYNONYMS))}) s(term, synonym) ON t.term = s.term""")
def synonym_expansion(spark, d):
    table = spark.createDataFrame(SYNONYMS, "term string, synonym string")
    return K.synonyms(read(spark, d, "conversations"), table, ["conv_id", "turn"])


@query(r"""WITH s AS (SELECT lang, (len(regexp_extract_all(text, '[A-Za-z]')) / greatest(len(text), 1) > 0.7)::INT AS e FROM documents) SELECT lang, count(*) AS n, round(avg(e), 6) AS latin_share FROM s GROUP BY lang""")
def language_vote(spark, d):
    latin = (F.regexp_count("text", F.lit("[A-Za-z]")) / F.greatest(F.length("text"), F.lit(1)) > 0.7).cast("int")
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(latin), 6).alias("latin_share"))


JACCARD = r"""WITH s AS (SELECT item_id AS a, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS x, item_id % 4 AS g FROM benchmark),
p AS (SELECT s.a, t.a AS b, len(list_intersect(s.x, t.x)) / (len(s.x) + len(t.x) - len(list_intersect(s.x, t.x))) AS j FROM s JOIN s t ON s.g = t.g AND s.a < t.a)"""


@query(JACCARD + " SELECT a, b, round(j, 6) AS similarity FROM p WHERE j > 0.05::DOUBLE")
def standards_map(spark, d):
    """Standards (here: benchmark items) of one subject (the id's remainder) by their keywords."""
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("standard_id"), (F.col("item_id") % 4).alias("subject"), F.array_distinct(T.words(F.col("text"))).alias("keywords"))
    return rounded(D.map_by_keywords(items, 0.05).select("a", "b", "similarity"), "similarity")


@query(r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS term FROM documents), i AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS k FROM benchmark WHERE item_id < 5), k AS (SELECT item_id, len(k) AS n, unnest(k) AS term FROM i)
SELECT item_id, doc_id, round(count(*) / any_value(n), 6) AS coverage FROM k JOIN w ON k.term = w.term GROUP BY ALL HAVING count(*) / any_value(n) > 0.3::DOUBLE""")
def coverage(spark, d):
    """Share of each standard's keywords that a document has, above 0.3."""
    items = read(spark, d, "benchmark").filter("item_id < 5").select("item_id", F.array_distinct(T.words(F.col("text"))).alias("keywords"))
    return rounded(D.coverage(items, "item_id", read(spark, d, "documents"), "doc_id", 0.3), "coverage")


@query(None)
def coverage_all(spark, d):
    """The same of every benchmark item; coverage, as its SQL, takes five."""
    items = read(spark, d, "benchmark").select("item_id", F.array_distinct(T.words(F.col("text"))).alias("keywords"))
    return rounded(D.coverage(items, "item_id", read(spark, d, "documents"), "doc_id", 0.3), "coverage")


@query(r"""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, a.w AS x, b.w AS y FROM t a JOIN t b ON b.item_id = a.item_id + 1),
u AS (SELECT a, b, unnest(list_distinct(list_concat(x, y))) AS term, x, y FROM p),
f AS (SELECT a, b, term, len(list_filter(x, lambda v: v = term)) AS p, len(list_filter(y, lambda v: v = term)) AS q FROM u),
i AS (SELECT a, b, p * (ln(3.0::DOUBLE / (1 + (p > 0)::INT + (q > 0)::INT)) + 1) AS p, q * (ln(3.0::DOUBLE / (1 + (p > 0)::INT + (q > 0)::INT)) + 1) AS q FROM f)
SELECT a, b, round(coalesce(sum(p * q) / nullif(sqrt(sum(p * p)) * sqrt(sum(q * q)), 0), 0), 6) AS similarity FROM i GROUP BY ALL""")
def tfidf_pairs(spark, d):
    """TF-IDF cosine of each item with the next, over the two texts as corpus."""
    items = read(spark, d, "benchmark")
    pairs = items.select(F.col("item_id").alias("a"), F.col("text").alias("x")).join(items.select(F.col("item_id").alias("b"), F.col("text").alias("y")), F.col("b") == F.col("a") + 1)
    return rounded(D.tfidf_similarity(pairs, ["a", "b"], "x", "y"), "similarity")
