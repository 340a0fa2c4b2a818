"""Prerequisite graphs; here a document's prerequisite is the one of half its id, and a second edge by thirds."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import graph as G
from spindrift.operators import standards as D
from spindrift.sources.tables import read

from .catalog import query

EDGES = "e AS (SELECT doc_id AS node, doc_id // 2 AS prerequisite FROM documents WHERE doc_id > 0 UNION SELECT doc_id, doc_id // 3 FROM documents WHERE doc_id > 2)"


def _nodes(spark, d):
    docs = read(spark, d, "documents")
    wanted = F.array_distinct(F.concat(F.when(F.col("doc_id") > 0, F.array(F.floor(F.col("doc_id") / 2))).otherwise(F.array()), F.when(F.col("doc_id") > 2, F.array(F.floor(F.col("doc_id") / 3))).otherwise(F.array())))
    return docs.select(F.col("doc_id").alias("id"), wanted.alias("prerequisites"), "source", "lang")


@query(f"WITH RECURSIVE {EDGES}, up AS (SELECT node, prerequisite AS ancestor, 1 AS depth FROM e UNION ALL SELECT up.node, e.prerequisite, depth + 1 FROM up JOIN e ON e.node = up.ancestor WHERE depth < 30) SELECT node, ancestor, min(depth)::INT AS depth FROM up GROUP BY ALL")
def ancestors(spark, d):
    return G.ancestors(G.edges(_nodes(spark, d)), 30)


@query(f"WITH RECURSIVE {EDGES}, up AS (SELECT node, prerequisite AS at_, 1 AS depth FROM e UNION ALL SELECT up.node, e.prerequisite, depth + 1 FROM up JOIN e ON e.node = up.at_ WHERE depth < 30) SELECT d.doc_id AS node, coalesce(max(depth), 0)::INT AS level FROM documents d LEFT JOIN up ON up.node = d.doc_id GROUP BY d.doc_id")
def topo_order(spark, d):
    nodes = _nodes(spark, d)
    return G.topological(G.edges(nodes), nodes.withColumnRenamed("id", "node"), 30)


@query(f"""WITH RECURSIVE {EDGES}, t AS (SELECT s.u::BIGINT AS student, doc_id AS node, doc_id * 7919 % 1009 AS place FROM documents, unnest([0, 1, 2, 3, 4]) AS s(u) WHERE doc_id % 5 != s.u OR doc_id < 20),
w AS (SELECT student, t.node, place, prerequisite FROM t JOIN e ON e.node = t.node WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = prerequisite AND doc_id % (student + 3) = 0)),
up AS (SELECT student, node, node AS at_, 0 AS cost FROM t UNION SELECT up.student, up.node, w.prerequisite, cost + CASE WHEN p.node IS NULL THEN NULL WHEN p.place > w.place OR (p.place = w.place AND p.node > w.node) THEN 1 ELSE 0 END
FROM up JOIN w ON w.student = up.student AND w.node = up.at_ LEFT JOIN t p ON p.student = w.student AND p.node = w.prerequisite),
r AS (SELECT student, node, max(cost) + 1 AS turn FROM up GROUP BY ALL HAVING count(*) = count(cost))
SELECT student, node, turn::INT AS turn, row_number() OVER (PARTITION BY student ORDER BY turn, place, node) AS step FROM r JOIN t USING (student, node)""")
def learning_paths(spark, d):
    """Paths of five students, each with a list and completed topics of their own."""
    nodes = _nodes(spark, d)
    each = nodes.select("id", F.explode(F.array(*[F.lit(u).cast("long") for u in range(5)])).alias("student"))
    topics = each.filter("id % 5 != student OR id < 20").select("student", F.col("id").alias("node"), (F.col("id") * 7919 % 1009).alias("place"))
    return G.learning_paths(topics, G.edges(nodes), each.filter("id % (student + 3) = 0").select("student", F.col("id").alias("node")))


@query(f"WITH {EDGES}, c AS (SELECT doc_id AS id FROM documents WHERE doc_id % 3 != 1 OR doc_id < 10) SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM c) AND NOT EXISTS (SELECT 1 FROM e WHERE node = doc_id AND prerequisite NOT IN (SELECT id FROM c))")
def next_topics(spark, d):
    nodes = _nodes(spark, d)
    return G.next_topics(nodes, nodes.filter("id % 3 != 1 OR id < 10").select("id")).select("id")


@query(f"WITH {EDGES} SELECT node, prerequisite FROM e JOIN documents a ON node = a.doc_id JOIN documents b ON prerequisite = b.doc_id WHERE a.lang = 'en' AND b.lang = 'en'")
def induced_subgraph(spark, d):
    nodes = _nodes(spark, d)
    return G.induced(G.edges(nodes), nodes.filter("lang = 'en'").select(F.col("id").alias("node")))


@query(f"""WITH {EDGES}, s AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'completed' WHEN doc_id % 4 = 1 THEN 'in_progress' END AS status FROM documents),
a AS (SELECT count(*) AS n FROM s WHERE coalesce(status, '') NOT IN ('completed', 'in_progress') AND NOT EXISTS (SELECT 1 FROM e WHERE node = id AND prerequisite NOT IN (SELECT id FROM s WHERE status = 'completed')))
SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'in_progress') AS in_progress, any_value(n) AS available, round(100.0::DOUBLE * count(*) FILTER (status = 'completed') / count(*), 6) AS completion FROM s, a""")
def progress_report(spark, d):
    nodes = _nodes(spark, d)
    states = nodes.select("id", F.when(F.col("id") % 4 == 0, "completed").when(F.col("id") % 4 == 1, "in_progress").alias("status")).filter("status IS NOT NULL")
    return G.progress(nodes, states).withColumn("completion", F.round("completion", 6))


@query("""WITH s AS (SELECT p_brand AS subject, (p_size % 12 + 1)::INT AS grade FROM part), w AS (SELECT DISTINCT subject, u.g::INT AS grade FROM s, unnest(generate_series(1, 12)) AS u(g)) SELECT subject, grade FROM w EXCEPT SELECT subject, grade FROM s""")
def grade_gaps(spark, d):
    standards = read(spark, d, "part").select(F.col("p_brand").alias("subject"), F.array((F.col("p_size") % 12 + 1).cast("int")).alias("grades"))
    return D.grade_gaps(standards, "subject", "grades")


@query("SELECT 'type' AS level, lang AS name, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'subject', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'total', 'all', count(*) FROM documents")
def standards_report(spark, d):
    return D.report(read(spark, d, "documents").select(F.col("lang").alias("standard_type"), F.col("source").alias("subject_area")))
