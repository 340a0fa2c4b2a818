"""Headings, numbered questions and chunks that carry the headings above them.

What a line is, its level and its size are columns; only whole numbers of a document's lines enter the loops over them, which
are linear and run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T

# Sets of heading patterns, each from the highest level down.
HEADINGS = (
    (
        r"第[零一二三四五六七八九十百0-9]+(分?编|部分)",
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"第[零一二三四五六七八九十百0-9]+条",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
    ),
    (
        r"第[0-9]+章",
        r"第[0-9]+节",
        r"[0-9]{0,2}[\. 、]",
        r"[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-]",
        r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}",
        r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}",
    ),
    (
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"[零一二三四五六七八九十百]+[ 、]",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
        r"[\(（][0-9]{0,2}[\)）]",
    ),
    (
        r"PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)",
        r"Chapter (I+V?|VI*|XI|IX|X)",
        r"Section [0-9]+",
        r"Article [0-9]+",
    ),
)

# Openings of numbered questions.
QUESTIONS = (
    r"第([零一二三四五六七八九十百0-9]+)问",
    r"第([零一二三四五六七八九十百0-9]+)条",
    r"[\(（]([零一二三四五六七八九十百]+)[\)）]",
    r"第([0-9]+)问",
    r"第([0-9]+)条",
    r"([0-9]{1,2})[\. 、]",
    r"([零一二三四五六七八九十百]+)[ 、]",
    r"[\(（]([0-9]{1,2})[\)）]",
    r"QUESTION (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)",
    r"QUESTION (I+V?|VI*|XI|IX|X)",
    r"QUESTION ([0-9]+)",
)

#: Words with which a question begins (fixed values), tokens from which on a chunk takes no more lines.
ASKS = r"^(?:what|when|where|how|why|which|who|whose|为什么|为啥|哪)"
PACKED = 218


def _begins(line: Column, pattern: str) -> Column:
    return line.rlike(rf"^(?:{pattern})")


def votes(lines: Column, sets: Sequence[Sequence[str]]) -> Column:
    """Of an array of lines: the set of patterns that most lines begin with, the first of equals; -1 if none does."""
    real = F.filter(lines, lambda x: ~T.not_bullet(x))
    counts = F.array(*(F.size(_with(real, patterns)) for patterns in sets))
    most = F.array_max(counts)
    return F.when(most > 0, F.array_position(counts, most).cast("int") - 1).otherwise(-1)


def _with(lines: Column, patterns: Sequence[str]) -> Column:
    any_of = "|".join(f"(?:{p})" for p in patterns)
    return F.filter(lines, lambda x: _begins(x, any_of))


def heading_set(lines: Column) -> Column:
    return votes(lines, HEADINGS)


def question_set(lines: Column) -> Column:
    return votes(lines, [[p] for p in QUESTIONS])


def sections(lines: Column) -> Column:
    """The lines that are neither empty, nor one character, nor a number alone; what follows an @ does not count."""
    own = lambda x: F.trim(F.substring_index(x, "@", 1))
    return F.filter(lines, lambda x: (F.length(own(x)) > 1) & ~own(x).rlike("^[0-9]+$"))


def levels(lines: Column, which: int) -> Column:
    """Of each line its level from the bottom up: 0 for text, 1 for a title that no pattern knows (none here, as lines have no layout), 2 for the last pattern, and so on."""
    patterns = HEADINGS[which]
    n = len(patterns)

    def level(x: Column) -> Column:
        return F.coalesce(*[F.when(_begins(F.trim(x), p), n + 1 - j) for j, p in enumerate(patterns)], F.lit(0))

    return F.transform(lines, level)


def merge_lines(level: Sequence[int], tokens: Sequence[int], n_levels: int, depth: int, most: int = PACKED) -> list[list[int]]:
    """Chunks of lines, as their places. n_levels: 0 to n_levels - 1, text to the highest heading.

    Each text line goes with the nearest heading above it of each level, highest first; a heading that came before a higher one
    is replaced by that. Headings that no line below took are chunks of their own, for the depth lowest levels. Lines that stand
    alone are packed while their tokens stay below most.
    """
    last, chains = [-1] * n_levels, []
    for j, own in enumerate(level):
        chain = [j]
        if own < depth and own != n_levels - 2:
            for above in last[own + 1 :]:
                if above >= 0:
                    if above > chain[-1]:
                        chain.pop()
                    chain.append(above)
        chains.append(chain)
        last[own] = j
    at = [[] for _ in range(n_levels)]
    for j, own in enumerate(level):
        at[own].append(j)
    taken, chunks, room = [False] * len(level), [], 0
    for own in at[:depth]:
        for j in own:
            if taken[j]:
                continue
            chain = chains[j]
            for x in chain:
                taken[x] = True
            if len(chain) > 1:
                chunks.append(chain[::-1])
                room = most
            elif chunks and tokens[j] + room < most:
                chunks[-1].append(j)
                room += tokens[j]
            else:
                chunks.append([j])
                room = tokens[j]
    return chunks


def hierarchical_chunks(docs: DataFrame, depth: int = 5, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, style (the document's set of heading patterns), chunk_index, places (of its lines among the document's sections) and chunk.

    Documents without headings have none. Tokens are words, numbers and signs.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    rows = docs.select(key, F.inline(F.array(F.struct(heading_set(lines).alias("style"), sections(lines).alias("lines"))))).filter((F.col("style") >= 0) & (F.size("lines") > 0))
    level = F.coalesce(*[F.when(F.col("style") == i, levels(F.col("lines"), i)) for i in range(len(HEADINGS))])
    tokens = F.transform("lines", lambda x: F.size(T.tokens(F.regexp_replace(x, r"@@[0-9]+.*", ""))))
    n_levels = F.element_at(F.array(*(F.lit(len(p) + 2) for p in HEADINGS)), F.col("style") + 1)

    @F.pandas_udf("array<array<int>>")
    def merge(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, c in parts:
            yield pd.Series([merge_lines(x, y, z, depth) for x, y, z in zip(a, b, c, strict=True)], dtype=object)

    merged = rows.withColumn("chunks", merge(level, tokens, n_levels))
    each = merged.select(key, "style", "lines", F.posexplode("chunks").alias("chunk_index", "places"))
    chunk = F.array_join(F.transform("places", lambda i: F.element_at("lines", i + 1)), "\n")
    return each.select(key, "style", "chunk_index", "places", chunk.alias("chunk"))


# --- numbered questions


def chinese_numeral(text: Column) -> Column:
    """Number below a thousand in Chinese numerals; null if it is none."""
    value = lambda c: F.translate(c, "零一二三四五六七八九", "0123456789").try_cast("int")
    hundreds = F.regexp_extract(text, "(.)百", 1)
    tens = F.regexp_extract(text, "(.?)十", 1)
    units = F.regexp_extract(text, "([一二三四五六七八九])$", 1)
    placed = F.when(text.contains("百"), value(hundreds) * 100).otherwise(0) + F.when(text.contains("十"), F.coalesce(value(tens), F.lit(1)) * 10).otherwise(0) + F.coalesce(value(units), F.lit(0))
    return F.when(text.rlike("^[零一二三四五六七八九]+$"), value(text)).when(text.rlike("^[零一二三四五六七八九十百]+$"), placed)


class Bullets:
    """The state of a page: what the box before was, the last number, and the mean left side of the questions so far."""

    def __init__(self) -> None:
        self.left = self.top = self.number = None
        self.was_question = self.colon = False
        self.sum, self.n = 0.0, 0

    def take(self, opens: bool, number: int, x0: float, top: float, colon: bool, sure: bool) -> bool:
        """Whether the next box is a question. sure: it ends with a question mark, is a title or begins with a question word."""
        left, above = (x0, top) if self.left is None else (self.left, self.top)
        indented = x0 - left > 10 if self.was_question else x0 >= left and top - above < 20
        mean = self.sum / self.n if self.n else x0
        found = opens and not indented and x0 - mean <= 10 and not self.colon and (not self.number or number >= self.number or sure)
        if found:
            self.number, self.sum, self.n = number, self.sum + x0, self.n + 1
        self.left, self.top, self.was_question, self.colon = x0, top, found, colon
        return found


def question_bullets(boxes: DataFrame, pattern: str, page: str = "page", order: str = "box", text: str = "text", layout: str = "layout") -> DataFrame:
    """page, order, question (whether the box opens a numbered question) and number (its own, else the last one's).

    boxes: x0 and top besides. Boxes are dealt by page, sorted, and streamed through the state of one page at a time. A first box is
    compared with itself, so it opens no question: it is not lower than the box before.
    """
    body = F.coalesce(text, F.lit(""))
    stated = F.regexp_extract(body, rf"^(?:{pattern})", 1)
    rest = F.lower(F.regexp_replace(body, rf"^(?:{pattern})", ""))
    sure = body.rlike("[?？]$") | rest.rlike(ASKS) | (F.coalesce(layout, F.lit("")) == "title")
    rows = boxes.select(
        F.col(page).cast("long").alias("p"), F.col(order).cast("long").alias("b"), _begins(body, pattern).alias("opens"), F.coalesce(T.numeral(stated), chinese_numeral(stated), F.lit(-1)).alias("number"),
        F.col("x0").cast("double").alias("x0"), F.col("top").cast("double").alias("top"), body.rlike("[:：]$").alias("colon"), sure.alias("sure"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, Bullets()
        for batch in batches:
            found, numbers = [], []
            for p, _, *box in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != at:
                    at, state = p, Bullets()
                found.append(state.take(*box))
                numbers.append(state.number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_()), pa.array(numbers, pa.int32())], names=[page, order, "question", "number"])

    return rows.repartition("p").sortWithinPartitions("p", "b").mapInArrow(run, f"{page} long, {order} long, question boolean, number int")
