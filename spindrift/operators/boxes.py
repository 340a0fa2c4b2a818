"""Layout as relations over boxes: rows, overlaps, columns, spans, cells and rendering.

Boxes are columns x0, top, x1 and bottom. Steps whose state depends on what was merged before are loops over one
page's or image's boxes in Arrow groups; a page's boxes are few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T

from .ordering import numbered

#: Types of table cells by the first pattern that matches (fixed values).
CELLS = (
    (r"^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$", "Dt"),
    (r"^(20|19)[0-9]{2}年$", "Dt"),
    (r"^(20|19)[0-9]{2}[年-][0-9]{1,2}月*$", "Dt"),
    (r"^[0-9]{1,2}[月-][0-9]{1,2}日*$", "Dt"),
    (r"^第*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}年*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}[ABCDE]$", "Dt"),
    (r"^[0-9.,+%/ -]+$", "Nu"),
    (r"^[0-9A-Z/\._~-]+$", "Ca"),
    (r"^[A-Z]*[a-z' -]+$", "En"),
    (r"^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()' -]+$", "NE"),
    (r"^.{1}$", "Sg"),
)
#: How the caption of a figure or table begins (fixed value).
CAPTION = r"^[图表]+[ 0-9:：]{2,}"


def cell_type(text: Column) -> Column:
    """Type by CELLS; else by the number of words of two letters or more: Tx above 3, Lx from 12, Ot."""
    text = F.trim(text)
    words = F.size(F.filter(T.words(text), lambda w: F.length(w) > 1))
    by_words = F.when(words > 11, "Lx").when(words > 3, "Tx").otherwise("Ot")
    return F.coalesce(*[F.when(text.rlike(pattern), kind) for pattern, kind in CELLS], by_words)


def is_caption(text: Column, kind: Column | None = None) -> Column:
    """Whether a box begins like a caption, or its kind names one."""
    found = F.trim(text).rlike(CAPTION)
    return found if kind is None else found | kind.contains("caption")


def base_font(spans: DataFrame, page: str, size: str, default: float = 12.0) -> DataFrame:
    """page and base: the median size of a page's spans; sizes that are null or 0 do not count."""
    return spans.groupBy(page).agg(F.coalesce(F.median(F.when(F.col(size) != 0, F.col(size).cast("double"))), F.lit(default)).alias("base"))


def char_width(x0: Column, x1: Column, text: Column) -> Column:
    return (x1 - x0) / F.greatest(F.length(F.trim(text)), F.lit(1))


def block_height(top: Column, bottom: Column) -> Column:
    return bottom - top


def x_distance(a: Column, b: Column) -> Column:
    """Between the left sides of two blocks."""
    return F.abs(a - b)


def heading_levels(sections: DataFrame, patterns: Sequence[str], text: str = "text", layout: str = "layout") -> DataFrame:
    """sections with level: the first of patterns that the text begins with; their number for other titles; one more for the rest."""
    n = len(patterns)
    body = F.col(text)
    title = F.col(layout).rlike("title|head") & ~T.not_title(F.substring_index(body, "@", 1))
    found = [F.when(body.rlike(rf"^\s*(?:{p})") & ~T.not_bullet(body), i) for i, p in enumerate(patterns)]
    return sections.withColumn("level", F.coalesce(*found, F.when(title, n), F.lit(n + 1)))


def heading_mode(levels: DataFrame, by: str, place: str, n: int) -> DataFrame:
    """by and level: the commonest level of at most n, of equals the one that comes first; n + 1 where no section has one."""
    counts = levels.groupBy(by, "level").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    best = F.max_by(F.when(F.col("level") <= n, F.col("level")), F.when(F.col("level") <= n, F.struct("n", -F.col("first"))))
    return counts.groupBy(by).agg(F.coalesce(best, F.lit(n + 1)).alias("level"))


def element_type(size: Column, base: Column, bold: Column) -> Column:
    ratio = size / base
    return F.when(ratio >= 1.5, "title").when(ratio >= 1.2, "heading").when((ratio >= 1.1) & bold, "subheading").otherwise("text")


def rows(boxes: DataFrame, page: str, tolerance: float) -> DataFrame:
    """boxes with row: a new one where the top differs from the box before by more than tolerance."""
    order = Window.partitionBy(page).orderBy("top", "x0")
    fresh = F.coalesce((F.abs(F.col("top") - F.lag("top").over(order)) > tolerance).cast("int"), F.lit(0))
    return boxes.withColumn("_new", fresh).withColumn("row", F.sum("_new").over(order)).drop("_new")


def clipped(boxes: DataFrame, width: float, height: float, least: float = 3) -> DataFrame:
    """Boxes within the image; those not above least in width or height go."""
    at = lambda c, m: F.greatest(F.lit(0.0), F.least(F.col(c).cast("double"), F.lit(float(m))))
    out = boxes.withColumns({"x0": at("x0", width), "x1": at("x1", width), "top": at("top", height), "bottom": at("bottom", height)})
    return out.filter((F.col("x1") - F.col("x0") > least) & (F.col("bottom") - F.col("top") > least))


def overlap(a: str, b: str) -> Column:
    """Area that two boxes share, over the first one's area."""
    w = F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")
    h = F.least(f"{a}.bottom", f"{b}.bottom") - F.greatest(f"{a}.top", f"{b}.top")
    area = (F.col(f"{a}.x1") - F.col(f"{a}.x0")) * (F.col(f"{a}.bottom") - F.col(f"{a}.top"))
    return F.coalesce(F.try_divide(F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)), area), F.lit(0.0))


def best_overlap(boxes: DataFrame, regions: DataFrame, page: str, least: float = 0.3) -> DataFrame:
    """box_id and the region_id that covers most of the box, at least a share."""
    a, b = boxes.alias("a"), regions.alias("b")
    touch = (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.top") < F.col("b.bottom")) & (F.col("b.top") < F.col("a.bottom"))
    pairs = a.join(b, touch).select(F.col("a.box_id"), F.col("b.region_id"), overlap("a", "b").alias("share")).filter(F.col("share") >= least)
    return pairs.groupBy("box_id").agg(F.max_by(F.struct("region_id", "share"), F.struct("share", -F.col("region_id"))).alias("m")).select("box_id", "m.region_id", "m.share")


def each_group(rows: DataFrame, by: list[str], loop: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """A loop over the rows of each (small) group, such as one page's boxes, as lists in Arrow batches."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    listed = rows.groupBy(*by).agg(F.collect_list(F.struct(*rows.columns)).alias("_rows")).select("_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for group in batch.column(0).to_pylist() for r in loop(group)]
            if found:
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in found])

    return listed.mapInArrow(run, schema)


def suppressed(boxes: DataFrame, image: str, least_score: float = 0.5, most_iou: float = 0.2) -> DataFrame:
    """box_id of a class's boxes kept greedily by score: one that overlaps a kept one by most_iou or more goes."""

    def keep(part: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for r in sorted(part, key=lambda r: (-r["score"], r["box_id"])):
            for k in kept:
                shared = max(min(r["x1"], k["x1"]) - max(r["x0"], k["x0"]), 0) * max(min(r["bottom"], k["bottom"]) - max(r["top"], k["top"]), 0)
                areas = (r["x1"] - r["x0"]) * (r["bottom"] - r["top"]) + (k["x1"] - k["x0"]) * (k["bottom"] - k["top"])
                if shared and shared / (areas - shared) >= most_iou:
                    break
            else:
                kept.append(r)
        return kept

    return each_group(boxes.filter(F.col("score") >= least_score), [image, "kind"], keep, f"{image} long, box_id long, kind string, score double")


def merged_blocks(blocks: DataFrame, page: str, gap: float) -> DataFrame:
    """page, block, text and box of blocks that follow closely: the same kind, overlapping in x, at most gap below the merged box."""

    def merge(part: list[dict]) -> list[dict]:
        out: list[dict] = []
        for r in sorted(part, key=lambda r: (r["top"], r["x0"], r["text"])):
            last = out[-1] if out else None
            if last and last["kind"] == r["kind"] and r["top"] - last["bottom"] <= gap and min(last["x1"], r["x1"]) > max(last["x0"], r["x0"]):
                last.update(text=f"{last['text']} {r['text']}", x0=min(last["x0"], r["x0"]), x1=max(last["x1"], r["x1"]), bottom=max(last["bottom"], r["bottom"]))
            else:
                out.append({**r, "block": len(out)})
        return out

    return each_group(blocks, [page], merge, f"{page} long, block long, kind string, text string, x0 double, top double, x1 double, bottom double")


def reading_order(boxes: DataFrame, page: str, tolerance: float) -> DataFrame:
    """boxes with place: by rows of about one top, then from the left."""
    return rows(boxes, page, tolerance).withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("row", "x0", "top")))


def aligned(parts: DataFrame, table: str, many: int = 4) -> DataFrame:
    """Rows of a table stretched to common left and right: the mean of more than many, else the outermost."""
    all_ = Window.partitionBy(table)
    n = F.count("*").over(all_)
    left = F.when(n > many, F.avg("x0").over(all_)).otherwise(F.min("x0").over(all_))
    right = F.when(n > many, F.avg("x1").over(all_)).otherwise(F.max("x1").over(all_))
    return parts.withColumns({"left": F.least(left, "x0"), "right": F.greatest(right, "x1")})


def header_rows(cells: DataFrame, table: str) -> DataFrame:
    """table, row and share of rows whose cells are mostly header-like: words in a table that is mostly numbers, or flagged."""
    number = cell_type(F.col("text")) == "Nu"
    share = lambda c: F.avg(c.cast("double"))
    # A row's shares for both kinds of tables come first, so that only rows, without texts, are sorted by table.
    rows = cells.groupBy(table, "row").agg(F.count_if(number).alias("_numbers"), F.count(number).alias("_typed"), share(F.col("is_header")).alias("_flagged"), share(F.col("is_header") | ~number).alias("_words"))
    all_ = Window.partitionBy(table)
    numeric = F.try_divide(F.sum("_numbers").over(all_), F.sum("_typed").over(all_)) > 0.5
    chosen = rows.withColumn("share", F.when(F.coalesce(numeric, F.lit(True)), F.col("_words")).otherwise(F.col("_flagged")))
    return chosen.select(table, "row", "share").filter("share > 0.5")


def spans(boxes: DataFrame, columns: DataFrame, table: str) -> DataFrame:
    """box_id with the first and last column whose middle lies inside the box."""
    middle = (F.col("c.x0") + F.col("c.x1")) / 2
    j = boxes.alias("b").join(columns.alias("c"), (F.col(f"b.{table}") == F.col(f"c.{table}")) & (middle >= F.col("b.x0")) & (middle <= F.col("b.x1")))
    return j.groupBy("b.box_id").agg(F.min("c.column").alias("first"), F.max("c.column").alias("last"))


def html_tables(cells: DataFrame, table: str) -> DataFrame:
    """table and html from cells of row, column, text and is_header."""
    tag = F.when(F.col("is_header"), "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), F.coalesce("text", F.lit("")), F.lit("</"), tag, F.lit(">"))
    lines = cells.withColumn("_c", cell).groupBy(table, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "_c"))), lambda s: s["_c"]), "").alias("_l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_l"))), lambda s: F.concat(F.lit("<tr>"), s["_l"], F.lit("</tr>"))), "\n")
    return lines.groupBy(table).agg(F.concat(F.lit("<table>\n"), body, F.lit("\n</table>")).alias("html"))


def described_rows(cells: DataFrame, table: str) -> DataFrame:
    """table, row and text: 'header: value; ...' of each body row."""
    headers = cells.filter("is_header").groupBy(table, "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda s: s["text"]), " ").alias("_h"))
    body = cells.filter(~F.col("is_header") & (F.trim("text") != "")).join(headers, [table, "column"], "left")
    value = F.when(F.col("_h").isNull(), F.col("text")).otherwise(F.concat("_h", F.lit(": "), "text"))
    return body.withColumn("_v", value).groupBy(table, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "_v"))), lambda s: s["_v"]), "; ").alias("text"))


def ctc_decode(steps: DataFrame, item: str, characters: DataFrame) -> DataFrame:
    """item, text and confidence: repeats of the step before and blanks (0) go, the rest become characters. steps: step, index and prob; characters: index and char."""
    before = F.lag("index").over(Window.partitionBy(item).orderBy("step"))
    kept = steps.withColumn("_p", before).filter(F.coalesce(F.col("index") != F.col("_p"), F.lit(True)) & (F.col("index") != 0)).join(characters, "index")
    decoded = kept.groupBy(item).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "char"))), lambda s: s["char"]), "").alias("text"), F.avg("prob").alias("confidence"))
    return steps.select(item).distinct().join(decoded, item, "left").fillna({"text": "", "confidence": 0.0})


def ocr_words(words: DataFrame, page: str, least: float = 60) -> DataFrame:
    """page, text of words above a confidence, and the mean confidence of words that have one."""
    return words.groupBy(page).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("conf") > least) & (F.trim("word") != ""), F.struct("place", "word")))), lambda s: s["word"]), " ").alias("text"),
        F.coalesce(F.avg(F.when(F.col("conf") != -1, F.col("conf"))), F.lit(0.0)).alias("confidence"),
    )


def recogniser_batches(images: DataFrame, size: int = 16) -> DataFrame:
    """images with batch and the batch's largest ratio of width to height: neighbours by ratio."""
    ratio = F.col("width") / F.col("height")
    placed = numbered(images.withColumn("ratio", ratio), "ratio", "image_id").withColumn("batch", F.floor(F.col("number") / size)).drop("number")
    return placed.withColumn("batch_ratio", F.max("ratio").over(Window.partitionBy("batch")))


def resized(width: Column, height: Column, side: int = 960, multiple: int = 32) -> tuple[Column, Column]:
    """Width and height with the longer side at most side, both multiples, at least one."""
    ratio = F.least(F.lit(1.0), side / F.greatest(width, height))
    to = lambda n: F.greatest(F.lit(multiple), (F.bround(n * ratio / multiple) * multiple).cast("int"))
    return to(width), to(height)
