"""Tokens, headings, fonts, prerequisites, dates and sound."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import audio as S
from spindrift.functions import text as T
from spindrift.operators import boxes as B
from spindrift.operators import rerank as R
from spindrift.sources.tables import read

from .catalog import query
from .layout import BOX, _boxes
from .search import rounded
from .texts import _md5

STOP_WORDS = ("the", "of", "and", "ertion")
KEPT = r"(regexp_matches(x, '^\d+(\.\d+)?$') OR NOT (regexp_matches(x, '^[\p{P}]+$') OR regexp_matches(x, '^[^\p{L}\p{N}\s]+$')))" + f" AND x NOT IN {STOP_WORDS}"
FINE = r"list_filter(regexp_extract_all(lower({0}), '\d+(?:\.\d+)?|[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]'), lambda x: {1})"


@query(f"SELECT doc_id, md5(array_to_string({FINE.format('text', KEPT)}, ' ')) AS digest FROM documents")
def fine_grained_tokens(spark, d):
    """Words and numbers without stop words."""
    return read(spark, d, "documents").select("doc_id", _md5(T.fine_grained(F.col("text"), STOP_WORDS)).alias("digest"))


@query(f"""WITH k AS (SELECT item_id, list_concat(string_split(text, '. '), flatten(list_transform(string_split(text, '. '), lambda k: {FINE.format('k', 'len(x) >= 2 AND ' + KEPT)}))) AS k FROM benchmark)
SELECT item_id, len(list_distinct(k)) AS n, md5(array_to_string(list_sort(list_distinct(k)), '|')) AS digest FROM k""")
def keyword_growth(spark, d):
    """Phrases as keywords, and the words in them."""
    grown = T.grown_keywords(F.split("text", r"\. "), STOP_WORDS)
    items = read(spark, d, "benchmark").select("item_id", grown.alias("k"))
    return items.select("item_id", F.size("k").cast("long").alias("n"), _md5(F.array_join(F.array_sort("k"), "|")).alias("digest"))


@query(r"SELECT page_id, md5(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS digest FROM pages")
def tight_text(spark, d):
    return read(spark, d, "pages").select("page_id", _md5(T.tight(F.col("html"))).alias("digest"))


@query(f"SELECT doc_id, md5(array_to_string(list_reverse(regexp_extract_all(text, '[{T.LEFT_TO_RIGHT}]+|[^{T.LEFT_TO_RIGHT}]')), '')) AS digest FROM documents")
def right_to_left(spark, d):
    return read(spark, d, "documents").select("doc_id", _md5(T.reversed_script(F.col("text"))).alias("digest"))


DAY = "(1990 + o_orderkey % 30)::VARCHAR || '-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0')"


@query(f"SELECT o_orderkey, try_strptime({DAY}, '%Y-%m-%d') IS NOT NULL AS is_date FROM orders")
def date_check(spark, d):
    """Texts like dates, some of months or days that do not exist."""
    part = lambda n: F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0")
    day = F.concat_ws("-", (1990 + F.col("o_orderkey") % 30).cast("string"), part(14), part(33))
    return read(spark, d, "orders").select("o_orderkey", T.is_date(day).alias("is_date"))


CELL = "CASE " + " ".join(f"WHEN regexp_matches(trim(t), '{p.replace(chr(39), chr(39) * 2)}') THEN '{kind}'" for p, kind in B.CELLS) + " WHEN w > 11 THEN 'Lx' WHEN w > 3 THEN 'Tx' ELSE 'Ot' END"


@query(r"WITH c AS (SELECT doc_id, unnest([source, lang, doc_id::VARCHAR, '20' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '年', '第一季度', left(source, 1), '-' || doc_id || ' kg', text]) AS t FROM documents), "
       r"w AS (SELECT *, len(list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+'), lambda x: len(x) > 1)) AS w FROM c WHERE t IS NOT NULL) "
       f"SELECT doc_id, {CELL} AS kind, count(*) AS n FROM w GROUP BY ALL")  # fmt: skip
def cell_types(spark, d):
    """Types of eight cells made from each document."""
    year = F.concat(F.lit("20"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("年"))
    texts = F.array("source", "lang", F.col("doc_id").cast("string"), year, F.lit("第一季度"), F.left("source", F.lit(1)), F.concat(F.lit("-"), F.col("doc_id").cast("string"), F.lit(" kg")), "text")
    cells = read(spark, d, "documents").select("doc_id", F.explode(texts).alias("t")).filter("t IS NOT NULL")
    return cells.groupBy("doc_id", B.cell_type(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS page, coalesce(median(CASE WHEN l_quantity <> 0 THEN l_quantity::DOUBLE END), 12) AS base FROM lineitem GROUP BY l_orderkey")
def base_font(spark, d):
    """A page is an order, a span's size a line's quantity."""
    return B.base_font(read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "page"), "page", "l_quantity")


@query(f"WITH {BOX} SELECT a.box_id, round((a.x1 - a.x0) / greatest(len(trim(a.kind)), 1), 6) AS char_width, a.bottom - a.top AS height, abs(a.x0 - b.x0) AS x_distance FROM b a LEFT JOIN b ON a.page = b.page AND b.line = a.line + 1")
def block_geometry(spark, d):
    """Width of a character, height, and distance to the page's next box."""
    boxes = _boxes(spark, d)
    following = boxes.select("page", (F.col("line") - 1).alias("line"), F.col("x0").alias("other"))
    joined = boxes.join(following, ["page", "line"], "left")
    width = B.char_width(F.col("x0"), F.col("x1"), F.col("kind"))
    return joined.select("box_id", F.round(width, 6).alias("char_width"), B.block_height(F.col("top"), F.col("bottom")).alias("height"), B.x_distance(F.col("x0"), F.col("other")).alias("x_distance"))


HEADINGS = ("[A-M]", "[N-Z]", "[a-f0-9]")
NOT_TITLE = f"NOT regexp_matches(h, '{T.ARTICLE}') AND (len(regexp_extract_all(h, '\\S+')) > 12 OR (NOT contains(h, ' ') AND len(h) >= 32) OR regexp_matches(h, '{T.NOT_IN_TITLE}'))"
LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(text, '^\\s*(?:{p})') AND NOT regexp_matches(text, '{T.NOT_BULLET}') THEN {i}" for i, p in enumerate(HEADINGS)) + f" WHEN role = 'user' AND NOT ({NOT_TITLE}) THEN 3 ELSE 4 END"


@query(f"""WITH s AS (SELECT conv_id, turn, text, role, string_split(text, '@')[1] AS h FROM conversations), l AS (SELECT conv_id, turn, {LEVEL} AS level FROM s),
c AS (SELECT conv_id, level, count(*) AS n, min(turn) AS first FROM l WHERE level <= 3 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS r FROM c)
SELECT k.conv_id, coalesce(level, 4)::INT AS level FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN b ON k.conv_id = b.conv_id AND r = 1""")
def heading_mode(spark, d):
    """The commonest level of heading of a conversation's turns."""
    sections = read(spark, d, "conversations").withColumn("layout", F.when(F.col("role") == "user", "head").otherwise("text"))
    return B.heading_mode(B.heading_levels(sections, HEADINGS), "conv_id", "turn", len(HEADINGS))


@query("""WITH h AS (SELECT doc_id AS found, unnest([source, lang]) AS topic FROM documents), r AS (SELECT doc_id, unnest(['src' || (doc_id % 7), CASE WHEN doc_id % 3 = 0 THEN 'fr' ELSE 'none' END]) AS topic FROM documents),
j AS (SELECT DISTINCT doc_id, found FROM r JOIN h ON r.topic = h.topic), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY found) AS rank FROM j)
SELECT doc_id, found, rank::INT AS rank FROM k WHERE rank <= 2""")
def prerequisite_hits(spark, d):
    """For each document two that have a topic among its prerequisites."""
    docs = read(spark, d, "documents")
    wanted = F.array(F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")), F.when(F.col("doc_id") % 3 == 0, "fr").otherwise("none"))
    return R.prerequisite_hits(docs.select("doc_id", wanted.alias("prerequisites")), docs.select("doc_id", F.array("source", "lang").alias("topics")))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) + 7 * len(regexp_extract_all(source, '[\p{L}\p{N}_]+')) + 6 * len(regexp_extract_all(lang, '[\p{L}\p{N}_]+')) AS n FROM documents")
def weighted_fields(spark, d):
    """Words of a document's fields, repeated by the fields' weights."""
    words = R.weighted_words(T.words(F.col("text")), T.words(F.col("source")), T.words(F.col("source")), T.words(F.col("lang")))
    return read(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n"))


SOUND = "list_concat(list_transform(range(8), lambda i: 0::DOUBLE), embedding::DOUBLE[], list_transform(range(8), lambda i: 0::DOUBLE))"


@query(f"""WITH p AS (SELECT vec_id, {SOUND} AS x FROM embeddings), f AS (SELECT vec_id, x, unnest(range(0, len(x) - 15, 4)) AS i FROM p),
e AS (SELECT vec_id, sqrt(list_sum(list_transform(x[i + 1:i + 16], lambda v: v * v)) / 16) AS e FROM f), q AS (SELECT vec_id, quantile_cont(e, 0.9) AS s, quantile_cont(e, 0.1) AS n FROM e GROUP BY vec_id)
SELECT q.vec_id, round(CASE WHEN n = 0 THEN 100 ELSE 10 * log10(s / n) END, 6) AS snr, round(embedding[1]::DOUBLE / list_max(list_transform(embedding::DOUBLE[], lambda v: abs(v))), 6) AS first FROM q JOIN embeddings USING (vec_id)""")
def sound_quality(spark, d):
    """Vectors as samples: signal to noise by frames of 16, and the first sample over the peak."""
    sound = read(spark, d, "embeddings").select("vec_id", S.signal_to_noise(F.col("embedding"), 16, 4).alias("snr"), S.peak_normalised(F.col("embedding"))[0].alias("first"))
    return rounded(sound, "snr", "first")
