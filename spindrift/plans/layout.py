"""Layout operators over boxes made from lineitem: a page is an order, a box a line."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.operators import boxes as B
from spindrift.operators import tables as X
from spindrift.sources.tables import read

from .catalog import query
from .search import rounded

LINES = "li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"
BOX = LINES + ", b AS (SELECT l_orderkey AS page, l_orderkey * 10 + l_linenumber AS box_id, l_linenumber::BIGINT AS line, (l_partkey % 50)::DOUBLE AS x0, (l_suppkey % 40)::DOUBLE AS top, (l_partkey % 50 + l_quantity)::DOUBLE AS x1, (l_suppkey % 40 + 5 + l_linenumber)::DOUBLE AS bottom, l_returnflag AS kind, l_discount::DOUBLE * 10 AS score FROM li)"
REGION = "r AS (SELECT page, box_id + 5000000000 AS region_id, x0, top, x1 + 10 AS x1, bottom + 10 AS bottom FROM b WHERE line % 2 = 0)"


def _lines(spark, d):
    """One row for each order and line number."""
    names = ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in names])


def _boxes(spark, d):
    at = lambda c: F.col(c).cast("double")
    return _lines(spark, d).select(
        F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id"), F.col("l_linenumber").cast("long").alias("line"),
        (F.col("l_partkey") % 50).cast("double").alias("x0"), (F.col("l_suppkey") % 40).cast("double").alias("top"), (F.col("l_partkey") % 50 + F.col("l_quantity")).cast("double").alias("x1"),
        (F.col("l_suppkey") % 40 + 5 + F.col("l_linenumber")).cast("double").alias("bottom"), F.col("l_returnflag").alias("kind"), (at("l_discount") * 10).alias("score"),
    )


def _regions(boxes):
    return boxes.filter("line % 2 = 0").select("page", (F.col("box_id") + 5000000000).alias("region_id"), "x0", "top", (F.col("x1") + 10).alias("x1"), (F.col("bottom") + 10).alias("bottom"))


@query(f"WITH {BOX}, f AS (SELECT *, coalesce((abs(top - lag(top) OVER w) > 3)::INT, 0) AS fresh FROM b WINDOW w AS (PARTITION BY page ORDER BY top, x0)) SELECT page, sum_row AS row, count(*) AS n, max(bottom - top) AS height FROM (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY top, x0)::BIGINT AS sum_row FROM f) GROUP BY page, sum_row")
def layout_rows(spark, d):
    return B.rows(_boxes(spark, d), "page", 3).groupBy("page", "row").agg(F.count("*").alias("n"), F.max(F.col("bottom") - F.col("top")).alias("height"))


OVER = "greatest(least(b.x1, r.x1) - greatest(b.x0, r.x0), 0) * greatest(least(b.bottom, r.bottom) - greatest(b.top, r.top), 0) / nullif((b.x1 - b.x0) * (b.bottom - b.top), 0)"


@query(f"WITH {BOX}, {REGION}, p AS (SELECT box_id, region_id, coalesce({OVER}, 0) AS share FROM b JOIN r ON b.page = r.page), n AS (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY share DESC, region_id) AS n FROM p WHERE share >= 0.3::DOUBLE) SELECT box_id, region_id, round(share, 6) AS share FROM n WHERE n = 1")
def box_overlap(spark, d):
    boxes = _boxes(spark, d)
    return rounded(B.best_overlap(boxes, _regions(boxes), "page"), "share")


@query(f"WITH {BOX} SELECT box_id, greatest(0, least(x0, 60)) AS x0, greatest(0, least(x1, 60)) AS x1, greatest(0, least(top, 30)) AS top, greatest(0, least(bottom, 30)) AS bottom FROM b WHERE greatest(0, least(x1, 60)) - greatest(0, least(x0, 60)) > 3 AND greatest(0, least(bottom, 30)) - greatest(0, least(top, 30)) > 3")
def box_clip(spark, d):
    return B.clipped(_boxes(spark, d), 60, 30).select("box_id", "x0", "x1", "top", "bottom")


@query(None)
def box_suppression(spark, d):
    return B.suppressed(_boxes(spark, d), "page").select("page", "box_id", "kind")


@query(None)
def merged_blocks(spark, d):
    return B.merged_blocks(_boxes(spark, d).withColumn("text", F.col("box_id").cast("string")), "page", 4).select("page", "block", "kind", "text")


CELL = LINES + ", c AS (SELECT l_orderkey AS tbl, l_linenumber::BIGINT AS row, u.k::BIGINT AS col, CASE WHEN l_linenumber = 1 THEN 'h' || u.k ELSE (l_partkey * u.k)::VARCHAR END AS text, l_linenumber = 1 AS is_header FROM li, unnest([1, 2, 3]) AS u(k))"


def _cells(spark, d):
    lines = _lines(spark, d).select(F.col("l_orderkey").alias("tbl"), F.col("l_linenumber").cast("long").alias("row"), "l_partkey", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("column"))
    text = F.when(F.col("row") == 1, F.concat(F.lit("h"), F.col("column").cast("string"))).otherwise((F.col("l_partkey") * F.col("column")).cast("string"))
    return lines.select("tbl", "row", "column", text.alias("text"), (F.col("row") == 1).alias("is_header"))


@query(f"""WITH {CELL}, l AS (SELECT tbl, row, string_agg(CASE WHEN is_header THEN '<th>' || text || '</th>' ELSE '<td>' || text || '</td>' END, '' ORDER BY col) AS l FROM c GROUP BY ALL)
SELECT tbl, '<table>' || chr(10) || string_agg('<tr>' || l || '</tr>', chr(10) ORDER BY row) || chr(10) || '</table>' AS html FROM l GROUP BY tbl""")
def html_tables(spark, d):
    return B.html_tables(_cells(spark, d), "tbl")


@query(f"WITH {CELL} SELECT c.tbl, c.row, string_agg(coalesce(h.text || ': ', '') || c.text, '; ' ORDER BY c.col) AS text FROM c LEFT JOIN c h ON h.tbl = c.tbl AND h.col = c.col AND h.is_header WHERE NOT c.is_header GROUP BY ALL")
def described_tables(spark, d):
    return B.described_rows(_cells(spark, d), "tbl")


@query(None)
def header_rows(spark, d):
    return rounded(B.header_rows(_cells(spark, d), "tbl"), "share")


@query("WITH " + LINES + """, s AS (SELECT l_orderkey AS item, l_linenumber AS step, l_partkey % 4 AS index, l_discount::DOUBLE AS prob FROM li), k AS (SELECT *, lag(index) OVER (PARTITION BY item ORDER BY step) AS p FROM s),
t AS (SELECT item, string_agg(['a', 'b', 'c'][index], '' ORDER BY step) AS text, avg(prob) AS c FROM k WHERE (p IS NULL OR p != index) AND index != 0 GROUP BY item)
SELECT s.item, coalesce(any_value(text), '') AS text, round(coalesce(any_value(c), 0), 6) AS confidence FROM s LEFT JOIN t ON s.item = t.item GROUP BY s.item""")
def ctc_decode(spark, d):
    steps = _lines(spark, d).select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("step"), (F.col("l_partkey") % 4).alias("index"), F.col("l_discount").cast("double").alias("prob"))
    characters = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "index long, char string")
    return rounded(B.ctc_decode(steps, "item", characters), "confidence")


@query(f"""WITH {BOX}, c AS (SELECT page, line AS col, x0, x1 FROM b WHERE line <= 4) SELECT b.box_id, min(c.col)::BIGINT AS first, max(c.col)::BIGINT AS last FROM b JOIN c ON b.page = c.page AND (c.x0 + c.x1) / 2 BETWEEN b.x0 AND b.x1 GROUP BY b.box_id""")
def cell_spans(spark, d):
    boxes = _boxes(spark, d)
    return B.spans(boxes, boxes.filter("line <= 4").select("page", F.col("line").alias("column"), "x0", "x1"), "page")


@query(f"WITH {BOX}, {REGION}, p AS (SELECT box_id, region_id AS part_id, coalesce({OVER}, 0) AS share, (r.x1 - r.x0) * (r.bottom - r.top) AS area FROM b JOIN r ON b.page = r.page), n AS (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY share DESC, area, part_id) AS n FROM p WHERE share >= 0.3::DOUBLE) SELECT box_id, part_id, round(share, 6) AS share FROM n WHERE n = 1")
def tightest_parts(spark, d):
    """The part of a page that fits each box most tightly."""
    boxes = _boxes(spark, d)
    return rounded(X.assigned(boxes, _regions(boxes).withColumnRenamed("region_id", "part_id"), "page", band=16.0), "share")


@query(None)
def numbered_cells(spark, d):
    """Rows and columns of order lines as boxes; some have labels. Tests hold it against a plain loop."""
    boxes = _boxes(spark, d).withColumns({"table": F.col("page"), "r": F.when(F.col("line") % 3 == 0, (F.col("top") / 10).cast("int")), "c": F.when(F.col("line") % 2 == 0, (F.col("x0") / 10).cast("int"))})
    return X.numbered_cells(boxes).select("table", "box_id", "row", "column")


@query(None)
def described_texts(spark, d):
    """Texts of tables with short rows packed; tests hold it against a plain loop."""
    cells = _cells(spark, d).filter("column <= 2").withColumns({"column": F.col("column") - 1, "is_header": F.col("is_header") & (F.col("tbl") % 2 == 0)})
    return X.described_texts(cells, "tbl")


@query(None)
def relocated_cells(spark, d):
    """Lines of eight orders as a table with few cells in most columns; tests hold it against a plain loop."""
    table = F.floor(F.col("page") / 8)
    dense = lambda c: (F.dense_rank().over(Window.partitionBy("table").orderBy(c)) - 1).alias(c)
    placed = _boxes(spark, d).select(table.alias("table"), "box_id", "x0", "x1", "top", "bottom", F.when(F.col("line") != 3, F.col("kind")).alias("text"), F.floor(F.col("top") / 4).alias("row"), F.floor(F.col("x0") / 3).alias("column"))
    cells = placed.select("table", "box_id", "x0", "x1", "top", "bottom", "text", dense("row"), dense("column"))
    return X.relocated_cells(cells).select("table", "box_id", "row", "column")


@query(None)
def kept_layouts(spark, d):
    """Regions of a page without those that neighbours hide; some have no score. Tests hold it against a plain loop."""
    boxes = _boxes(spark, d)
    layouts = boxes.filter("line % 2 = 0 OR line > 4").select("page", (F.col("box_id") + 5000000000).alias("part_id"), F.lit("text").alias("kind"), F.when(F.col("line") != 4, F.col("score")).alias("score"), "x0", "top", (F.col("x1") + 10).alias("x1"), (F.col("bottom") + 10).alias("bottom"))
    return X.kept_layouts(layouts, boxes, "page", band=16.0).select("page", "part_id")
