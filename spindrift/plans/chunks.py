"""Chunkers over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import chunking as C
from spindrift.operators import outline as O
from spindrift.operators import terms as K
from spindrift.sources.tables import read

from .catalog import query

SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\b(Mr|Mrs|Dr|Prof)\.', '\1' || chr(1), 'g'), '([.!?])\s+([A-Z])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s != '')"""


@query(f"SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, chr(10))) AS digest FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def sentence_split(spark, d):
    docs = read(spark, d, "documents").withColumn("s", T.sentences(F.col("text")))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n").cast("binary")).alias("digest"))


@query(None)
def sentence_chunks(spark, d):
    """A fold: tests hold it against a plain loop."""
    chunks = C.sentence_chunks(read(spark, d, "documents"), 512)
    return chunks.select("doc_id", "chunk_index", "chunk_id", F.length("chunk").alias("n_chars"))


@query("""SELECT doc_id, (u.i // 462)::INT AS chunk_index, u.i::INT AS start, md5(substr(text, (u.i + 1)::BIGINT, 512)) AS digest FROM documents, unnest(generate_series(0::BIGINT, greatest(len(text) - 51, 0)::BIGINT, 462::BIGINT)) AS u(i) WHERE len(text) > 0""")
def fixed_chunks(spark, d):
    chunks = C.fixed_chunks(read(spark, d, "documents"))
    return chunks.select("doc_id", "chunk_index", "start", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x != '') AS w FROM documents)
SELECT doc_id, (u.i // 96)::INT AS chunk_index, md5(array_to_string(w[u.i + 1:u.i + 128], ' ')) AS digest FROM w, unnest(generate_series(0, len(w) - 1, 96)) AS u(i) WHERE len(w) > 0""")
def sliding_words(spark, d):
    chunks = C.word_windows(read(spark, d, "documents"), 128, 96)
    return chunks.select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT u.g AS gram FROM w, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS u(g) WHERE len(w) >= 3)
SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) > 3""")
def ngrams(spark, d):
    return K.frequent_ngrams(read(spark, d, "documents"), 3, 3)


KINDS = {"article": r"(^|[^\p{L}])(the|le|la|der|die)([^\p{L}]|$)", "long": r"^.{200,}", "short": r"^.{1,40}$"}


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
k AS (SELECT *, CASE WHEN regexp_matches(line, '(^|[^\p{L}])(the|le|la|der|die)([^\p{L}]|$)') THEN 'article' WHEN len(line) >= 200 THEN 'long' WHEN len(line) BETWEEN 1 AND 40 THEN 'short' ELSE 'general' END AS kind FROM l),
f AS (SELECT *, CASE WHEN kind != lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) OR lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) IS NULL THEN 1 ELSE 0 END AS fresh FROM k),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS segment FROM f)
SELECT doc_id, segment::BIGINT AS segment, any_value(kind) AS kind, min(line_no)::INT AS first, count(*) AS n_lines FROM s GROUP BY doc_id, segment""")
def segment_runs(spark, d):
    return C.segment_runs(read(spark, d, "documents"), KINDS)


@query("SELECT md5(text) AS chunk_id, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, d):
    docs = read(spark, d, "documents")
    return docs.groupBy(C.chunk_id(F.col("text")).alias("chunk_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query(None)
def naive_merge(spark, d):
    return C.naive_merge(read(spark, d, "documents")).select("doc_id", "chunk_index", "n_tokens", F.length("text").alias("n_chars"))


@query(None)
def word_budget_chunks(spark, d):
    return C.word_budget_chunks(read(spark, d, "documents"), 200).select("doc_id", "chunk_index", "n_words")


@query(None)
def accumulated_chunks(spark, d):
    return C.accumulated_chunks(read(spark, d, "documents")).select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"))


@query(None)
def educational_chunks(spark, d):
    return C.educational_chunks(read(spark, d, "documents")).select("doc_id", "segment", "kind", "chunk_index", F.length("chunk").alias("n_chars"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
b AS (SELECT doc_id, line, line_no, line_no // 10 AS batch FROM l) SELECT doc_id, batch::BIGINT AS batch, md5(string_agg(line, '; ' ORDER BY line_no)) AS digest FROM b GROUP BY ALL""")
def row_batches(spark, d):
    batches = C.row_batches(C.lines(read(spark, d, "documents")), "doc_id", "line_no", "line")
    return batches.select("doc_id", "batch", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
v AS (SELECT *, CASE WHEN len(line) <= 20 THEN 1 WHEN len(line) <= 60 THEN 2 END AS level FROM l),
a AS (SELECT *, max(CASE WHEN level = 1 THEN line_no END) OVER w AS one, max(CASE WHEN level <= 2 THEN line_no END) OVER w AS two FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT a.doc_id, a.line_no::INT AS line_no, a.level::INT AS level, h.line AS heading_1, CASE WHEN k.level = 2 THEN k.line END AS heading_2 FROM a LEFT JOIN v h ON h.doc_id = a.doc_id AND h.line_no = a.one LEFT JOIN v k ON k.doc_id = a.doc_id AND k.line_no = a.two""")
def heading_hierarchy(spark, d):
    """Each line with the nearest headings above; here short lines are headings."""
    return C.hierarchy(C.lines(read(spark, d, "documents")), ["^.{0,20}$", "^.{0,60}$"]).drop("line")


LETTERED = "(?:(?:PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN))|(?:Chapter (I+V?|VI*|XI|IX|X))|(?:Section [0-9]+)|(?:Article [0-9]+))"
NUMBERED = r"(?:(?:第[0-9]+章)|(?:第[0-9]+节)|(?:[0-9]{0,2}[\. 、])|(?:[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-])|(?:[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2})|(?:[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}))"
BRACKETED = r"[(（][零一二三四五六七八九十百]+[)）]"
SET_ZERO = rf"(?:第[零一二三四五六七八九十百0-9]+(?:分?编|部分|章|节|条)|{BRACKETED})"
SET_TWO = rf"(?:第[零一二三四五六七八九十百0-9]+(?:章|节)|[零一二三四五六七八九十百]+[ 、]|{BRACKETED}|[(（][0-9]{{0,2}}[)）])"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
v AS (SELECT doc_id, [count(*) FILTER (good AND regexp_matches(line, '^{SET_ZERO}')), count(*) FILTER (good AND regexp_matches(line, '^{NUMBERED}')), count(*) FILTER (good AND regexp_matches(line, '^{SET_TWO}')), count(*) FILTER (good AND regexp_matches(line, '^{LETTERED}'))] AS n
FROM (SELECT *, NOT regexp_matches(line, '^(?:0|[0-9]+ +[0-9~个只-]|[0-9]+[.][.]+)') AS good FROM l) GROUP BY doc_id)
SELECT doc_id, (CASE WHEN list_max(n) = 0 THEN -1 ELSE list_position(n, list_max(n)) - 1 END)::INT AS style FROM v""")
def heading_style(spark, d):
    """The set of heading patterns that most lines of a document begin with."""
    return read(spark, d, "documents").select("doc_id", O.heading_set(F.split("text", "\n")).alias("style"))


def numbered(docs):
    """Documents whose lines become sections: every fifth line a heading by its place, as the texts have few of their own."""
    heads = F.when((F.col("i") % 25) == 0, F.concat(F.lit("PART "), F.element_at(F.array(*map(F.lit, "ONE TWO THREE FOUR FIVE".split())), (F.col("i") % 5 + 1).cast("int")))).when((F.col("i") % 5) == 0, F.concat(F.lit("Section "), F.col("i").cast("string")))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", F.concat_ws("\n", heads, "line").alias("line"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query(None)
def hierarchical_chunks(spark, d):
    """Lines with the headings above them; tests hold it against a plain version."""
    chunks = O.hierarchical_chunks(numbered(read(spark, d, "documents")))
    return chunks.select("doc_id", "style", "chunk_index", F.size("places").alias("n_lines"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query(None)
def question_bullets(spark, d):
    """Order lines as boxes of a page (the order), some of which open numbered questions."""
    items = read(spark, d, "lineitem")
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit(". "), F.when(F.col("l_quantity") % 3 == 0, "What is ").otherwise(""), F.col("l_returnflag"), F.when(F.col("l_quantity") % 7 == 0, ":").otherwise(""))
    boxes = items.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("box"), (F.col("l_quantity") % 13).alias("x0"), (30 * F.col("l_linenumber") - F.col("l_quantity") % 11).alias("top"), text.alias("text"), F.when(F.col("l_quantity") % 5 == 0, "title").otherwise("text").alias("layout"))
    return O.question_bullets(boxes, O.QUESTIONS[5])
