"""Steps from the boxes of a table to its cells and texts: which part a box lies in, running row and column numbers, described rows.

Numbers and packing carry a state from box to box. Boxes are dealt by table, sorted, and streamed, so a table is never gathered, and
only its numbers enter Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boxes import overlap
from .lineage import checkpointed

#: Height of the bands by which boxes and parts find each other.
BAND = 64.0
#: How far a box may reach into the row above, characters below which short rows share a text, signs between cells.
SLACK, SHORT, PAIR, NEXT = 3.0, 64, "：", "; "
#: Columns are cleared of lone cells in tables of at least so many rows (and rows of columns); share from which a layout hides another.
LEAST_LINES, HIDDEN = 4, 0.7


def assigned(boxes: DataFrame, parts: DataFrame, by: str, least: float = 0.3, band: float = BAND) -> DataFrame:
    """box_id, part_id and share: of the parts that cover at least a share of a box the one that covers most, of equals the smallest, then the first id.

    Boxes and parts meet within a page's horizontal bands; a pair that shares several is taken in the first.
    """
    bands = lambda: F.sequence(F.floor(F.col("top") / band), F.floor(F.greatest("top", "bottom") / band))
    a = boxes.select(by, "box_id", "x0", "x1", "top", "bottom", F.explode(bands()).alias("band")).alias("a")
    b = parts.select(by, "part_id", "x0", "x1", "top", "bottom", F.explode(bands()).alias("band")).alias("b")
    touch = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.top") < F.col("b.bottom")) & (F.col("b.top") < F.col("a.bottom"))
    first = F.col("a.band") == F.floor(F.greatest("a.top", "b.top") / band)
    pairs = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.band") == F.col("b.band")) & touch & first)
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.bottom") - F.col("b.top"))
    shares = pairs.select("a.box_id", "b.part_id", overlap("a", "b").alias("share"), area.alias("area")).filter(F.col("share") >= least)
    best = F.min_by(F.struct("part_id", "share"), F.struct((-F.col("share")).alias("s"), "area", "part_id"))
    return shares.groupBy("box_id").agg(best.alias("m")).select("box_id", "m.part_id", "m.share")


def _streamed(rows: DataFrame, by: str, order: list[str], loop, schema: str) -> DataFrame:
    """loop, a generator that is sent each row and gives its number, over each table's rows in order. rows: by, id, what loop takes, then order."""
    given = [c for c in rows.columns if c not in (by, "id", *order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            numbers = []
            keys = batch.column(0).to_pylist()
            for key, *row in zip(keys, *(batch.column(c).to_pylist() for c in given), strict=True):
                if state is None or key != at:
                    at, state = key, loop()
                    next(state)
                numbers.append(state.send(tuple(row)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("id"), pa.array(numbers, pa.int32())], names=[by, "id", "number"])

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def _rows():
    """Sent (label, top, bottom). A row ends where the label changes, or, without labels, where a box begins below the running bottom."""
    number, last, running = 0, None, 0.0
    row = yield None
    while True:
        label, top, bottom = row
        if last is None:
            last, running = (label,), bottom
        elif label != last[0] or (label is None and top >= running - SLACK):
            number, last, running = number + 1, (label,), bottom
        else:
            running = (running + bottom) / 2
        row = yield number


def _columns():
    """Sent (label, page, x0, x1). A column ends where the next label follows on the same page, or where a box of another or no label begins right of the running side."""
    number, last, running = 0, None, 0.0
    row = yield None
    while True:
        label, page, x0, x1 = row
        if last is None:
            running = x1
        elif ((1 if label is None else label) - (1 if last[0] is None else last[0]) == 1 and page == last[1]) or (x0 >= running and (label is None or label != last[0])):
            number, running = number + 1, x1
        else:
            running = (running + x1) / 2
        last = label, page
        row = yield number


def numbered_cells(boxes: DataFrame, table: str = "table") -> DataFrame:
    """boxes with row and column, from 0. boxes: table, box_id, page, x0, x1, top, bottom, and labels r and c of what a box was assigned to (null where to nothing).

    Rows are numbered in order of r (boxes without come by their top), top and x0; columns in order of c, page and x0.
    """
    kind = f"{table} {boxes.schema[table].dataType.simpleString()}, id {boxes.schema['box_id'].dataType.simpleString()}, number int"
    top = F.coalesce(F.min("top").over(Window.partitionBy(table, "r")), F.col("top"))
    placed = boxes.withColumn("_place", F.when(F.col("r").isNull(), F.col("top")).otherwise(top))
    rows = placed.select(table, F.col("box_id").alias("id"), "r", F.col("top").cast("double").alias("t"), F.col("bottom").cast("double").alias("b"), F.col("_place").alias("o1"), F.col("x0").alias("o2"), F.col("box_id").alias("o3"))
    left = F.coalesce(F.min("x0").over(Window.partitionBy(table, "c")), F.col("x0"))
    side = boxes.withColumn("_place", F.when(F.col("c").isNull(), F.col("x0")).otherwise(left))
    columns = side.select(table, F.col("box_id").alias("id"), "c", F.col("page").alias("p"), F.col("x0").cast("double").alias("l"), F.col("x1").cast("double").alias("r"), F.col("_place").alias("o1"), F.col("page").alias("o2"), F.col("top").alias("o3"), F.col("box_id").alias("o4"))
    order = ["o1", "o2", "o3"]
    r = _streamed(rows, table, order, _rows, kind).select(table, F.col("id").alias("box_id"), F.col("number").alias("row"))
    c = _streamed(columns, table, [*order, "o4"], _columns, kind).select(table, F.col("id").alias("box_id"), F.col("number").alias("column"))
    return boxes.join(r, [table, "box_id"]).join(c, [table, "box_id"])


def _lines():
    """Sent a line: its lone place (null if it has several) with that cell's near and far side, its far side, its cells at places of lone cells, and
    the near side and such cells of the line that follows (null if none does)."""
    number, far, cells, moved = 0, None, None, None
    row = yield None
    while True:
        lone, cell_near, cell_far, line_far, own, next_near, following = row
        own = {c["at"]: c["said"] for c in own or []}
        if moved is not None:
            at, said, side = moved
            lone = lone if lone == at else None
            own.setdefault(at, said)
            line_far, moved = max(line_far, side), None
        reply = number
        kept = True
        if lone is not None:
            before = cells is None or cells.get(lone, False)
            after = next_near is None or any(c["said"] for c in following or [] if c["at"] == lone)
            if not (before and after):
                kept = False
                left = float("inf") if before else cell_near - far
                right = float("inf") if after else next_near - cell_far
                if left < right:
                    cells.setdefault(lone, own[lone])
                    far, reply = max(far, line_far), number - 1
                else:
                    moved = lone, own[lone], line_far
        if kept:
            far, cells, number = line_far, own, number + 1
        row = yield reply


def _joined_lines(cells: DataFrame, table: str, along: str, across: str, near: str, far: str) -> DataFrame:
    """cells with lines (values of along) that hold a lone cell moved to a neighbour, and numbered anew."""
    order = F.struct("top", "x0", "box_id")
    said = (F.coalesce("text", F.lit("")) != "").alias("said")
    lines = cells.groupBy(table, along).agg(
        F.min(across).alias("low"), F.max(across).alias("high"), F.min_by(F.struct(F.col(near).alias("near"), F.col(far).alias("far")), order).alias("first"), F.min(near).alias("near"), F.max(far).alias("far")
    )
    wide = cells.groupBy(table).agg((F.count_distinct(across) >= LEAST_LINES).alias("wide"))
    lines = lines.join(wide, table).withColumn("lone", F.when((F.col("low") == F.col("high")) & F.col("wide"), F.col("low")))
    # Of a line's cells only those at places where some line has its lone cell are sent: no more than a table has lines.
    places = lines.filter("lone IS NOT NULL").select(table, F.col("lone").alias(across)).distinct()
    marks = cells.join(places, [table, across]).groupBy(table, along, across).agg(F.min_by(said, order).alias("said"))
    marks = marks.groupBy(table, along).agg(F.collect_list(F.struct(F.col(across).alias("at"), "said")).alias("marks"))
    in_turn = Window.partitionBy(table).orderBy(along)
    sent = lines.join(marks, [table, along], "left").select(
        table, F.col(along).alias("id"), "lone", F.col("first.near").cast("double").alias("a"), F.col("first.far").cast("double").alias("b"), F.col("far").cast("double").alias("c"), "marks",
        F.lead(F.col("near").cast("double")).over(in_turn).alias("d"), F.lead("marks").over(in_turn).alias("e"), F.col(along).alias("o"),
    )
    kind = f"{table} {cells.schema[table].dataType.simpleString()}, id {cells.schema[along].dataType.simpleString()}, number int"
    numbers = _streamed(sent, table, ["o"], _lines, kind).select(table, F.col("id").alias(along), F.col("number").alias("_new"))
    return cells.join(numbers, [table, along]).withColumn(along, F.col("_new")).drop("_new")


def relocated_cells(cells: DataFrame, table: str = "table") -> DataFrame:
    """cells without lone ones: a column whose only filled row has no text beside it on one side at least joins the nearer column of those without,
    then rows likewise. cells: table, box_id, row, column, x0, x1, top, bottom, text.

    Columns are looked at in tables of at least LEAST_LINES rows, rows in tables of so many columns. A cell's text is that of its first box (by top, x0, id).
    Equal distances go to the later line. Lines are numbered from 0 without gaps.
    """
    # Each step reads its cells four times, so they are made once.
    across = checkpointed(_joined_lines(checkpointed(cells), table, "column", "row", "x0", "x1"))
    return _joined_lines(across, table, "row", "column", "top", "bottom")


def _layouts():
    """Sent (kind, score, x0, x1, top, bottom, covered); replies 2 if the layout stands beside the one held, 1 if it replaces it, 0 if it is hidden by it."""
    held = None
    row = yield None
    while True:
        verdict = 2
        if held is not None and row[0] == held[0]:
            w, h = min(row[3], held[3]) - max(row[2], held[2]), min(row[5], held[5]) - max(row[4], held[4])
            least = min((x[3] - x[2]) * (x[5] - x[4]) for x in (row, held))
            if w > 0 and h > 0 and w * h >= HIDDEN * least:
                by = 1 if row[1] and held[1] else 6
                verdict = 0 if held[by] > row[by] else 1
        if verdict:
            held = row
        row = yield verdict


def kept_layouts(layouts: DataFrame, boxes: DataFrame, by: str, band: float = BAND) -> DataFrame:
    """layouts without those that overlap a neighbour of their kind: of two that follow each other (by top, x0, id), one of which covers HIDDEN of the
    other, the one of higher score stays, or, if one has no score, the one that covers more area of boxes; of equals the later one.

    layouts: by, part_id, kind, score, x0, x1, top, bottom; boxes: by, x0, x1, top, bottom. Areas are summed by bands, so a page's boxes do not all meet all its layouts.
    """
    bands = lambda: F.sequence(F.floor(F.col("top") / band), F.floor(F.greatest("top", "bottom") / band))
    a = boxes.select(by, "x0", "x1", "top", "bottom", F.explode(bands()).alias("band")).alias("a")
    b = layouts.select(by, "part_id", "x0", "x1", "top", "bottom", F.explode(bands()).alias("band")).alias("b")
    w = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    h = F.least("a.bottom", "b.bottom") - F.greatest("a.top", "b.top")
    first = F.col("a.band") == F.floor(F.greatest("a.top", "b.top") / band)
    met = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.band") == F.col("b.band")) & (w > 0) & (h > 0) & first)
    covered = met.groupBy(F.col(f"b.{by}").alias(by), F.col("b.part_id").alias("part_id")).agg(F.sum(w * h).alias("covered"))
    sides = [F.col(c).cast("double").alias(n) for c, n in zip(("x0", "x1", "top", "bottom"), "abcd", strict=True)]
    rows = layouts.join(covered, [by, "part_id"], "left").select(by, F.col("part_id").alias("id"), "kind", F.col("score").cast("double").alias("s"), *sides, F.coalesce("covered", F.lit(0.0)).alias("v"), F.col("top").alias("o1"), F.col("x0").alias("o2"), F.col("part_id").alias("o3"))
    kind = f"{by} {layouts.schema[by].dataType.simpleString()}, id {layouts.schema['part_id'].dataType.simpleString()}, number int"
    verdicts = _streamed(rows, by, ["o1", "o2", "o3"], _layouts, kind).withColumnRenamed("id", "part_id").filter("number > 0")
    left = layouts.join(verdicts, [by, "part_id"])
    replaced = F.lead("number").over(Window.partitionBy(by).orderBy("top", "x0", "part_id")) == 1
    return left.withColumn("_replaced", F.coalesce(replaced, F.lit(False))).filter("NOT _replaced").drop("_replaced", "number")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """table, chunk_no, text and _cap of rows (table, text, short, _cap) in order. A short row joins the text before while both stay below SHORT characters."""
    at, number, held, cap, size = None, -1, None, None, 0
    for batch in batches:
        out = []
        for key, text, short, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and key == at and short and size + len(text) < SHORT:
                held.append(text)
                size += len(text) + 1
                continue
            if held is not None:
                out.append((at, number, "\n".join(held), cap))
            at, number = key, number + 1 if held is not None and key == at else 0
            held, cap, size = [text], said, len(text)
        yield _batch(out, batch)
        last = batch
    if held is not None:
        yield _batch([(at, number, "\n".join(held), cap)], last)


def _batch(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    keys, numbers, texts, caps = zip(*rows, strict=True) if rows else ((), (), (), ())
    columns = [pa.array(keys, like.column(0).type), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(caps, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[like.schema.names[0], "chunk_no", "text", "_cap"])


def described_texts(cells: DataFrame, table: str = "table", caption: str | None = None, english: bool = True) -> DataFrame:
    """table, chunk_no and text of a table's body. cells: table, row, column, text, is_header (the row is one of headers), and caption if named.

    A row's cells stand with the nearest header row above, 'header：value; ...'. In tables of at most two columns a row without a header above is
    short: its cells are joined by '：', and neighbouring short rows share a text of fewer than SHORT characters.
    Cells are dealt by table once; all later steps keep to these parts and sort them.
    """
    by_row = Window.partitionBy(table).orderBy("row")
    upwards = lambda w: w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = cells.select(table, "row", "column", "is_header", F.trim(F.coalesce("text", F.lit(""))).alias("_t"), (F.col(caption).cast("string") if caption else F.lit(None).cast("string")).alias("_cap"))
    head = F.last(F.when(F.col("is_header") & F.col("column").isNotNull(), F.struct(F.col("row").alias("r"), F.col("_t").alias("h"))), ignorenulls=True).over(upwards(Window.partitionBy(table, "column").orderBy("row")))
    above = F.last(F.when(F.col("is_header"), F.col("row")), ignorenulls=True).over(upwards(by_row))
    all_ = kept.repartition(table).withColumn("_head", head).withColumns({"_above": above, "_columns": F.max("column").over(Window.partitionBy(table)) + 1})
    body = all_.filter(~F.col("is_header") & (F.col("_t") != "") & F.col(table).isNotNull() & F.col("row").isNotNull())
    # The last header of a cell's column counts only if it is of the header row above.
    named = F.when((F.col("_head.r") == F.col("_above")) & (F.col("_head.h") != ""), F.concat("_head.h", F.lit(PAIR), "_t")).otherwise(F.col("_t"))
    short = F.col("_above").isNull() & (F.col("_columns") <= 2)
    rows = body.groupBy(table, "row", short.alias("short")).agg(F.transform(F.array_sort(F.collect_list(F.struct("column", named.alias("v")))), lambda x: x["v"]).alias("v"), F.first("_cap").alias("_cap"))
    rows = rows.select(table, "row", F.when(F.col("short"), F.array_join("v", PAIR)).otherwise(F.array_join("v", NEXT)).alias("text"), "short", "_cap")
    kind = f"{table} {cells.schema[table].dataType.simpleString()}, chunk_no int, text string, _cap string"
    texts = rows.sortWithinPartitions(table, "row").select(table, "text", "short", "_cap").mapInArrow(_packed, kind)
    if caption:
        said = F.concat("text", F.lit("\t——" + (" in " if english else "来自") + "“"), "_cap", F.lit("”"))
        texts = texts.withColumn("text", F.when(F.coalesce("_cap", F.lit("")) != "", said).otherwise(F.col("text")))
    return texts.drop("_cap")
