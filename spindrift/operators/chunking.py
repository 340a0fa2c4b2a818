"""Chunkers: from one text to rows of chunks.

Greedy packing carries state from sentence to sentence, so it is a loop over the sizes of a text's sentences, in Arrow batches;
the other chunkers are slices of a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T

#: Kinds of segments by the first marker that a line has (fixed values).
SEGMENTS = {
    "definition": r"(?i)\b(definition|is defined as|means)\b",
    "example": r"(?i)\b(example|for instance|such as)\b",
    "exercise": r"(?i)\b(exercise|problem|practice)\b",
    "concept": r"(?i)\b(concept|principle|idea)\b",
    "theorem": r"(?i)\b(theorem|lemma|corollary)\b",
    "proof": r"(?i)\b(proof|q\.e\.d)",
}


def chunk_id(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def runs(sizes: list[int], limit: int, mode: str, extra: int = 0) -> list[dict]:
    """Greedy packing of sizes in order, as start, n and size of each run.

    mode: fits, a run takes a part while the sum stays within limit; over, until it is above limit; least, while it is below limit.
    extra: what each further part adds besides its size.
    """
    out: list[dict] = []
    for i, size in enumerate(sizes):
        last = out[-1]["size"] if out else None
        if last is not None and (last + size <= limit if mode == "fits" else last <= limit if mode == "over" else last < limit):
            out[-1]["n"] += 1
            out[-1]["size"] += size + extra
        else:
            out.append({"start": i, "n": 1, "size": size})
    return out


def _packed(parts: Column, sizes: Column, limit: int, mode: str, joiner: str, extra: int = 0) -> Column:
    """Array of text and n: parts packed in order by their sizes. Only the sizes enter Python, and each part is copied once."""

    @F.pandas_udf("array<struct<start: int, n: int, size: bigint>>")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in batches:
            yield pd.Series([None if s is None else runs(s, limit, mode, extra) for s in each], dtype=object)

    # parts is bound outside the inner function, which would else make it anew for each run.
    bound = F.array(F.struct(parts.alias("parts"), pack(sizes).alias("runs")))
    return F.transform(bound, lambda b: F.transform(b["runs"], lambda r: F.struct(F.array_join(F.slice(b["parts"], r["start"] + 1, r["n"]), joiner).alias("text"), r["size"].alias("n"))))[0]


def sentence_chunks(docs: DataFrame, size: int = 512, *, valid_only: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_index, chunk and chunk_id: sentences packed while their lengths sum to at most size."""
    packed = _packed(F.col("_s"), F.transform("_s", F.length), size, "fits", " ")
    rows = docs.select(key, T.sentences(F.col(text)).alias("_s")).select(key, F.posexplode(F.transform(packed, lambda c: c["text"])).alias("chunk_index", "chunk"))
    rows = rows.filter(T.is_valid_chunk(F.col("chunk"))) if valid_only else rows
    return rows.withColumn("chunk_id", chunk_id(F.col("chunk")))


def fixed_chunks(docs: DataFrame, size: int = 512, overlap: int = 50, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of size characters, each overlap before the end of the last; the last ends with the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    rows = docs.filter(n > 0).select(key, text, F.posexplode(starts).alias("chunk_index", "start"))
    return rows.select(key, "chunk_index", "start", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("chunk"))


def fixed_array(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """The chunks of fixed_chunks as an array."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size))))


def word_windows(docs: DataFrame, size: int = 512, step: int = 384, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of words; the last ones may be short."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = docs.select(key, words.alias("_w")).filter(F.size("_w") > 0)
    rows = rows.select(key, "_w", F.posexplode(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))).alias("chunk_index", "start"))
    return rows.select(key, "chunk_index", F.array_join(F.slice("_w", F.col("start") + 1, size), " ").alias("chunk"))


def word_budget_chunks(docs: DataFrame, budget: int = 512, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines packed while their words sum to at most budget."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    packed = _packed(F.col("_l"), F.transform("_l", lambda s: F.size(F.split(F.trim(s), r"\s+"))), budget, "fits", "\n")
    return docs.select(key, lines.alias("_l")).select(key, F.posexplode(packed).alias("chunk_index", "c")).select(key, "chunk_index", "c.text", F.col("c.n").alias("n_words"))


def naive_merge(docs: DataFrame, tokens: int = 128, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines appended to a chunk until it has more than so many tokens."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    packed = _packed(F.col("_l"), F.transform("_l", lambda s: F.size(T.tokens(s))), tokens, "over", "\n")
    return docs.select(key, lines.alias("_l")).select(key, F.posexplode(packed).alias("chunk_index", "c")).select(key, "chunk_index", "c.text", F.col("c.n").alias("n_tokens"))


def merge_small(chunks: Column, least: int = 100) -> Column:
    """Chunks below least characters are joined with the next; the last may stay small."""
    return F.transform(_packed(chunks, F.transform(chunks, F.length), least, "least", " ", extra=1), lambda c: c["text"])


def accumulated_chunks(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep_rest: bool = True) -> DataFrame:
    """Sentences gathered until together they are a valid chunk; keep_rest: what is left at the end is one too."""
    # What a sentence adds to the brackets that are open, whether it ends one, and its length.
    signs = F.transform("_s", lambda s: F.struct(F.length(s).alias("size"), T.is_complete(s).alias("ends"), F.regexp_replace(s, r"[^()\[\]{}]+", "").alias("signs")))

    @F.pandas_udf("array<struct<start: int, n: int>>")
    def gather(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in batches:
            yield pd.Series([None if s is None else accumulated(s, keep_rest) for s in each], dtype=object)

    # Chunks are made before they become rows, as each row would else carry all sentences of its text.
    chunks = F.transform(gather(signs), lambda r: F.array_join(F.slice("_s", r["start"] + 1, r["n"]), " "))
    return docs.select(key, T.sentences(F.col(text)).alias("_s")).select(key, F.posexplode(chunks).alias("chunk_index", "chunk"))


def accumulated(sentences: list[dict], keep_rest: bool, least: int = 50) -> list[dict]:
    """Start and n of runs of sentences that are valid chunks as soon as they are; of size, ends and signs of each."""
    out, start, size, stack = [], 0, -1, []
    for i, s in enumerate(sentences):
        size += s["size"] + 1
        for c in s["signs"]:
            if stack and stack[-1] + c in ("()", "[]", "{}"):
                stack.pop()
            else:
                # A closing sign without its opening one stays below all others: the run is never balanced.
                stack.append(c)
        if size >= least and s["ends"] and not stack:
            out.append({"start": start, "n": i + 1 - start})
            start, size, stack = i + 1, -1, []
    if keep_rest and start < len(sentences):
        out.append({"start": start, "n": len(sentences) - start})
    return out


def lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def segment_runs(docs: DataFrame, kinds: Mapping[str, str] = SEGMENTS, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, segment, kind, first and n_lines: runs of lines of one kind."""
    each = lines(docs, key=key, text=text).withColumn("kind", T.first_match(F.col("line"), kinds, "general"))
    order = Window.partitionBy(key).orderBy("line_no")
    fresh = F.coalesce((F.col("kind") != F.lag("kind").over(order)).cast("int"), F.lit(1))
    runs = each.withColumn("_new", fresh).withColumn("segment", F.sum("_new").over(order))
    return runs.groupBy(key, "segment").agg(F.first("kind").alias("kind"), F.min("line_no").alias("first"), F.count("*").alias("n_lines"))


def syllabus(lines_: DataFrame, order: str = "line_no", line: str = "line") -> DataFrame:
    """topic and items of a text of '# topic' lines with bullets below."""
    topic = F.when(F.col(line).startswith("#"), F.trim(F.regexp_replace(line, "^#+", "")))
    placed = lines_.withColumn("topic", F.last(topic, ignorenulls=True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    items = placed.filter(~F.col(line).startswith("#") & (F.trim(line) != "") & F.col("topic").isNotNull())
    return items.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.trim(F.regexp_replace(line, r"^[-*]\s*", "")).alias("item")))), lambda s: s["item"]).alias("items"))


def hierarchy(lines_: DataFrame, levels: list[str], key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """Lines with level (of the first pattern of levels that they match, else null) and heading_1 ...: the nearest heading above of each level."""
    level = None
    for i, pattern in enumerate(levels, 1):
        level = F.when(F.col(line).rlike(pattern), i) if level is None else level.when(F.col(line).rlike(pattern), i)
    above = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = lines_.withColumn("level", level)
    for i in range(1, len(levels) + 1):
        last = F.last(F.when(F.col("level") <= i, F.struct("level", line)), ignorenulls=True).over(above)
        out = out.withColumn(f"heading_{i}", F.when(last["level"] == i, last[line]))
    return out


def row_batches(rows: DataFrame, key: str, order: str, text: str, size: int = 10) -> DataFrame:
    """Table rows as texts of size rows each, joined by '; '."""
    batch = F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size)
    return rows.withColumn("batch", batch).groupBy(key, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "; ").alias("chunk"))


def educational_chunks(docs: DataFrame, least: int = 100, most: int = 512, overlap: int = 50, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, segment, kind, chunk_index and chunk: windows of words within runs of lines of one kind, each ending with a sentence where one ends between least and most words.

    Where a window ends depends on where the last one did, so it is a loop over each run, in Arrow batches.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    each = lines(docs, key=key, text=text).withColumn("kind", T.first_match(F.col("line"), SEGMENTS, "general"))
    fresh = F.coalesce((F.col("kind") != F.lag("kind").over(order)).cast("int"), F.lit(1))
    runs = each.withColumn("_new", fresh).withColumn("segment", F.sum("_new").over(order))
    runs = runs.groupBy(key, "segment").agg(F.first("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("run"))

    @F.pandas_udf("array<string>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: list(windows(t.split(), least, most, overlap)))

    return runs.select(key, "segment", "kind", F.posexplode(cut("run")).alias("chunk_index", "chunk"))


def windows(words: list[str], least: int, most: int, overlap: int) -> Iterator[str]:
    start = 0
    while start < len(words):
        end = min(start + most, len(words))
        if end < len(words):
            end = next((i for i in range(end, start + least - 1, -1) if words[i - 1][-1] in ".!?"), end)
        yield " ".join(words[start:end])
        if end == len(words):
            break
        start = max(end - overlap, start + 1)
