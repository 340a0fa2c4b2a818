"""Changes to stores, and functions over dates, maps and JSON."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import search as S
from spindrift.operators import store as W
from spindrift.operators import versions as Y
from spindrift.operators.lineage import shared_folder
from spindrift.sources.tables import read

from .catalog import query


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 10 != 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 10 = 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 50 = 0")
def upsert(spark, d):
    table = read(spark, d, "embeddings").select("vec_id", "label")
    new = table.filter("vec_id % 10 = 0").withColumn("label", F.col("label") + 100).unionByName(table.filter("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1000000))
    return W.upsert(table, new, "vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def delete_by_ids(spark, d):
    ids = read(spark, d, "labels").withColumnRenamed("doc_id", "vec_id")
    return W.delete(read(spark, d, "embeddings").select("vec_id", "label"), ids, "vec_id")


@query("SELECT count(*) AS deleted FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def delete_count(spark, d):
    return W.deleted_count(read(spark, d, "embeddings"), read(spark, d, "labels").withColumnRenamed("doc_id", "vec_id"), "vec_id")


@query("SELECT d.doc_id, CASE WHEN quality IS NULL THEN lang ELSE 'x' END AS lang, source, quality::VARCHAR AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def metadata_merge(spark, d):
    table = read(spark, d, "documents").select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    changes = read(spark, d, "labels").select("doc_id", F.create_map(F.lit("lang"), F.lit("x"), F.lit("quality"), F.col("quality").cast("string")).alias("metadata"))
    out = W.merge_metadata(table, changes, "doc_id")
    return out.select("doc_id", *[F.element_at("metadata", k).alias(k) for k in ("lang", "source", "quality")])


@query("SELECT 'embeddings' AS name, max(len(embedding))::INT AS dimension, count(*) AS n_vectors, 'ready' AS status FROM embeddings")
def collection_info(spark, d):
    return W.info(read(spark, d, "embeddings"), "embeddings")


@query("SELECT d.doc_id, d.source, e.label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def documents_vectors(spark, d):
    """Foreign-key join of documents and vectors."""
    return read(spark, d, "documents").join(read(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "source", "label")


@query("SELECT event_id, round((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 3600000000.0::DOUBLE, 6) AS age_hours, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 3600000000.0::DOUBLE * 3600 > 86400 AS expired, strftime(ts, '%Y-%m-%d') AS day, epoch(ts)::BIGINT AS epoch FROM events")
def ttl_expiry(spark, d):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    events = read(spark, d, "events")
    # Half seconds go to the even one, as the SQL's cast does.
    seconds = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return events.select("event_id", F.round(W.age_hours(F.col("ts"), now), 6).alias("age_hours"), (W.age_hours(F.col("ts"), now) * 3600 > 86400).alias("expired"), F.date_format("ts", "yyyy-MM-dd").alias("day"), seconds.cast("long").alias("epoch"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events WHERE json_valid(props)")
def json_properties(spark, d):
    events = read(spark, d, "events").filter(F.expr("try_parse_json(props) IS NOT NULL"))
    keys = F.json_object_keys("props")
    return events.select("event_id", F.expr("get_json_object(props, concat('$.', json_object_keys(props)[0]))").alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


@query("SELECT source, count(*) AS n FROM documents WHERE n_chars > 500 GROUP BY source")
def sql_pass_through(spark, d):
    read(spark, d, "documents").createOrReplaceTempView("pass_documents")
    return W.run_sql(spark, "SELECT source, count(*) AS n FROM pass_documents WHERE n_chars > :least GROUP BY source", least=500)


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang IN ('en', 'fr') AND n_chars >= 1000 AND source != 'src2'")
def filter_operators(spark, d):
    docs = read(spark, d, "documents").filter(S.where({"lang": ["en", "fr"], "n_chars": ("gte", 1000), "source": ("ne", "src2")}))
    return docs.select("doc_id", "source", "n_chars")


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25")
def sorted_page(spark, d):
    return S.page(read(spark, d, "documents").select("doc_id", "source", "n_chars"), 2, 25, F.desc("n_chars"), F.asc("doc_id"))


@query("""WITH a AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x FROM embeddings), b AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, x FROM a),
c AS (SELECT * FROM b WHERE vec_id % 5 != 0),
v AS (SELECT 1 AS version, * FROM a UNION ALL SELECT 2, * FROM b UNION ALL SELECT 3, * FROM c UNION ALL SELECT 4, * FROM c UNION ALL SELECT 6, * FROM b)
SELECT version, count(*) AS n, sum(label)::BIGINT AS labels, round(sum(x), 4) AS x FROM v GROUP BY version""")
def versioned_store(spark, d):
    """Versions of a collection after an upsert, a delete, compaction, clearing and restoring."""
    rows = read(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding")[0].cast("double").alias("x"))
    path = f"{shared_folder(spark)}/collection-{uuid.uuid4().hex}"
    one = Y.Collection.create(spark, path, "vec_id", "vec_id long, label long, x double").upsert(rows)
    two = one.upsert(rows.filter("vec_id % 3 = 0").withColumn("label", F.col("label") + 100))
    last = two.delete(rows.filter("vec_id % 5 = 0")).compact().clear().restore(2)
    parts = [Y.Collection.open(spark, path, v).rows().withColumn("version", F.lit(v)) for v in range(1, last.version.number + 1)]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("version").agg(F.count("*").alias("n"), F.sum("label").alias("labels"), F.round(F.sum("x"), 4).alias("x"))
