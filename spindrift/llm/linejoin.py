"""Removes lines that nearly repeat an earlier line, by an exact set-similarity join.

A line is the set of its words, ASCII letters in lower case. Two lines are linked when the Jaccard
similarity of their sets is 0.8 or more. A line is removed when it is linked to, or has the same
set as, an earlier line: of a document with a lower doc_id, or above it in its own. All other lines
stay as they are, also those without words.

A document's n_links is the sum, over its lines, of the lines of other words, in any document, that each is linked
to. Documents are of one class where lines of equal sets or links join them, also by way of others; class_id is the
class's least doc_id. For each removed line, earlier names a document that holds an earlier line that it repeats.

The join. Equal sets are one set first, so a line's copies are never joined with each other. Words are ordered by
rarity (a logarithm of a histogram of all words over BUCKETS hash buckets, then their hash), the same way for every
line. Sets of similarity 0.8 share a word among the first 20 % in that order of the larger one and among the first
11 % of the smaller one; the rows of such a word meet in order of size, so that the length filter is a window.
What passes the positional filter and a comparison of maps of the sets' words (which only drop pairs that cannot reach
0.8) is a candidate. The number of pairs grows with the square of a group's size, so candidates are not listed: a task gives
a spanning forest of its candidates, whose components are the clusters. All links lie within clusters. The words of a
cluster's sets meet in one task (large clusters: in tasks for pairs of blocks), where its candidates are found by the
same filters and verified by their words; what leaves it is a row for each set with the number of its links and its
earliest partner, and a spanning forest of the links. Only candidates of very long lines, for which maps of MOST bits
tell little, are listed and verified pair by pair.

Words are compared by 56 bits of a hash and a step of rarity, and sets are equal when 128 bits of a digest of their words are.

Defined cases: null texts have no line; rows of equal doc_id and text are one document;
lines of rows of equal doc_id and other text come in order of their number, then of a digest; a null doc_id
comes last; very long lines are treated like others; columns besides doc_id and text may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, forest
from .flatwords import Words, chunks, mix, words
from .histogram import BUCKETS, histogram
from .runtime import by_text, discard, frugal, table, written

#: Bits of a word's code: step of rarity, hash. Codes in numeric order are words in order of rarity.
RARITY, HASH = 8, 56
#: Sets of fewer words than this are similar only if equal.
LEAST = 4
#: Bits of the smallest and of the largest map of a set's words. A map of b bits serves pairs that may differ in at most REACH * b words.
FEWEST, MOST, REACH = 128, 1024, 0.3
#: Rows of a rare word that meet in a task, at least; words of more rows, and of more than this part of all, are dealt out in blocks.
HOT, PART = 1 << 14, 1 << 20
#: Rows of rare words that a task sorts at once: at least, and at most where more than TASKS tasks would be needed.
SORTED, MOST_SORTED, TASKS = 1 << 17, 1 << 22, 1 << 12
#: Sets of a cluster that a block holds at least and at most, and blocks that a cluster of fewer is dealt to at most.
BLOCK, LARGEST, BLOCKS = 256, 50_000, 32
#: Candidates and words that a task handles at once: about ten arrays of 64-bit numbers of this length; four times as many words are packed at once.
SPAN = 1 << 18
#: Lines whose words may be asked for by a broadcast (about 40 bytes each); beyond it by a shuffle.
BROADCAST_ROWS = 200_000


def rarity(docs: DataFrame) -> np.ndarray:
    """Step of rarity of each bucket, from a count of all words of the corpus."""
    counts = histogram(by_text(docs.select("text")), lambda texts: (words(raw, at, True).hash & np.uint64(BUCKETS - 1) for _, _, raw, at in chunks(texts)))
    return np.minimum(6 * np.log2(1 + counts), 2**RARITY - 1).astype(np.uint8)


def index_length(n: np.ndarray) -> np.ndarray:
    """Of a set of n words, how many of the rarest a similar set of at least n words shares one of."""
    return n - (8 * n + 8) // 9 + 1


def probe_length(n: np.ndarray) -> np.ndarray:
    """Of a set of n words, how many of the rarest a similar set of at most n words shares one of."""
    return n - (4 * n + 4) // 5 + 1


def needed(n: np.ndarray) -> np.ndarray:
    """Words that two sets of n words together must share for a similarity of 0.8."""
    return (4 * n + 8) // 9


def map_bits(size: np.ndarray) -> np.ndarray:
    """Bits of a set's map: a power of two."""
    wanted = np.maximum(size * 2 / 9 / REACH, FEWEST)
    return np.minimum(2 ** np.ceil(np.log2(wanted)).astype(np.int64), MOST)


@dataclass
class Codes:
    """Words of many lines: codes in order of line and rarity, each once."""

    code: np.ndarray
    first: np.ndarray  # where each line starts
    size: np.ndarray
    line: np.ndarray  # number of each line that has a word


def codes(w: Words, line: np.ndarray, step: np.ndarray) -> Codes:
    """line: the number of each word's line."""
    code = step[w.hash & np.uint64(BUCKETS - 1)].astype(np.uint64) << np.uint64(HASH) | w.hash >> np.uint64(64 - HASH)
    keep = None
    if len(line) and line.max() < 1 << 16:
        # One sort by line and most of the code, unless it leaves different words equal.
        key = line.astype(np.uint64) << np.uint64(48) | code >> np.uint64(16)
        order = np.argsort(key)
        key, sorted_ = key[order], code[order]
        same = key[1:] == key[:-1]
        if not (sorted_[1:][same] != sorted_[:-1][same]).any():
            keep = np.r_[True, ~same]
            code, line = sorted_[keep], (key[keep] >> np.uint64(48)).astype(np.int64)
    if keep is None and len(line):
        order = np.lexsort((code, line))
        code, line = code[order], line[order]
        keep = np.r_[True, (code[1:] != code[:-1]) | (line[1:] != line[:-1])]
        code, line = code[keep], line[keep]
    if len(code):
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    else:
        first = np.zeros(0, np.int64)
    return Codes(code, first, np.diff(np.r_[first, len(code)]), line[first])


def maps(c: Codes, mixed: np.ndarray) -> pa.Array:
    """For each line a map whose bits are the parities of its words' numbers: bits that differ are at most as many as words that do."""
    bits = map_bits(c.size)
    at = np.r_[0, np.cumsum(bits)]
    place = np.repeat(at[:-1], c.size) + (mixed >> np.uint64(16)).astype(np.int64) % np.repeat(bits, c.size)
    flat = np.packbits((np.bincount(place, minlength=at[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.BinaryArray.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer((at // 8).astype(np.int32)), pa.py_buffer(flat)])


#: Columns of sets whose values hardly repeat.
UNLIKE = ("hi", "lo", "map", "rare")


def sets(docs: DataFrame, steps: np.ndarray) -> DataFrame:
    """A row for each line with a word, and one without a line for a text that has none: doc (a number for each row of docs), doc_id, raw, top (whether it is the row's first), line, hi, lo (digest of its set), size, map and rare (codes of its rarest words; none below LEAST)."""
    sent = docs.sparkSession.sparkContext.broadcast(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = sent.value
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for a, b, raw, texts in chunks(batch.column(2)):
                w = words(raw, texts, True)
                lines, before = w.line()
                c = codes(w, lines - lines[0] if len(lines) else lines, step)
                yield _wordless(batch, a, b, w, row)
                if not len(c.line):
                    continue
                number = c.line + lines[0]
                text = np.searchsorted(before, number, "right") - 1
                mixed = mix(c.code)
                n = np.where(c.size < LEAST, 0, probe_length(c.size))
                taken = np.arange(len(c.code)) - np.repeat(c.first, c.size) < np.repeat(n, c.size)
                rows = pa.array(text + a, pa.int64())
                hi, lo = (np.add.reduceat(x, c.first) for x in (mixed, mix(mixed ^ np.uint64(0x9E3779B97F4A7C15))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + a + text, pa.int64()),
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(np.r_[True, text[1:] != text[:-1]], pa.bool_()),
                        pa.array(number - before[text], pa.int32()),
                        pa.array(hi.view(np.int64), pa.int64()),
                        pa.array(lo.view(np.int64), pa.int64()),
                        pa.array(c.size, pa.int32()),
                        maps(c, mixed),
                        pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.r_[0, np.cumsum(n)] * 8).astype(np.int32)), pa.py_buffer(c.code[taken].tobytes())]),
                    ],
                    names=["doc", "doc_id", "raw", "top", "line", "hi", "lo", "size", "map", "rare"],
                )
            row += batch.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc long, doc_id {kind}, raw long, top boolean, line int, hi long, lo long, size int, map binary, rare binary"
    return by_text(docs.select("doc_id", F.xxhash64("text").alias("raw"), "text")).mapInArrow(frugal(run), kinds)


def _wordless(batch: pa.RecordBatch, a: int, b: int, w: Words, row: int) -> pa.RecordBatch:
    none = np.flatnonzero(np.bincount(w.text, minlength=b - a) == 0) + a
    rows = pa.array(none, pa.int64())
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    columns = [pa.array(row + none, pa.int64()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.ones(len(none), bool)), *(pa.nulls(len(none), k) for k in kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "doc_id", "raw", "top", "line", "hi", "lo", "size", "map", "rare"])


#: Where a line stands among all: documents of null ids last, then by id and line; lines that this leaves equal by a digest of the text.
PLACE = ("none", "doc_id", "line", "raw")


def _place() -> list[Column]:
    return [F.col("doc_id").isNull().alias("none"), *(F.col(c) for c in PLACE[1:])]


def indexed(docs: DataFrame, steps: np.ndarray) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines with a word (doc, line, hi, lo), each document once; all rows of docs (doc, doc_id, raw); and a row for each set.

    The sets' columns: id (any number), hi, lo, size, map, rare, n (its lines), and the place and doc of its first line.
    """
    lines = written(sets(docs, steps), UNLIKE)
    held = lines.filter("line IS NOT NULL")
    # Of rows of equal doc_id and text one stays.
    tops = lines.filter("top").select("doc", "doc_id", "raw")
    often = written(tops.groupBy("doc_id", "raw").agg(F.min("doc").alias("least"), F.count("*").alias("n")).filter("n > 1"))
    if not often.isEmpty():
        further = tops.alias("t").join(often.alias("f"), F.col("t.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("t.raw") == F.col("f.raw"))).filter("doc != least").select("doc")
        held = held.join(further, "doc", "left_anti")
    first = F.min(F.struct(*_place(), "doc")).alias("first")
    each = held.groupBy("hi", "lo").agg(first, F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "map", "rare")))
    each = written(each.select(F.monotonically_increasing_id().alias("id"), "hi", "lo", "size", "map", "rare", "n", "first.*"), ("id", *UNLIKE))
    slim, rows = written(held.select("doc", "line", "hi", "lo"), UNLIKE[:2]), written(tops)
    discard(lines, often)
    return slim, rows, each


# --- candidates


@dataclass
class Rows:
    """Rows of words of sets, in order of group and size."""

    group: np.ndarray
    size: np.ndarray
    pos: np.ndarray


def met(rows: Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x < y of rows of one group that pass the prefix, length and positional filters; in parts."""
    key = rows.group.astype(np.int64) << 32 | rows.size
    low = np.searchsorted(key, rows.group.astype(np.int64) << 32 | (4 * rows.size + 4) // 5)
    short = rows.pos < index_length(rows.size)
    smaller = np.flatnonzero(short)
    before = np.r_[0, np.cumsum(short)]
    low = before[low]
    n = before[:-1] - low
    end = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + SPAN, "right")))
        part = n[a:b]
        y = np.repeat(np.arange(a, b), part)
        x = smaller[np.repeat(low[a:b] - np.r_[0, np.cumsum(part)[:-1]], part) + np.arange(len(y))]
        need = needed(rows.size[x] + rows.size[y])
        fine = np.minimum(rows.size[x] - rows.pos[x], rows.size[y] - rows.pos[y]) >= need
        yield x[fine], y[fine]
        a = b


class Maps:
    """Maps of sets of these sizes, one after the other in data; each in its own width and in half of it."""

    def __init__(self, size: np.ndarray, at: np.ndarray, data: np.ndarray) -> None:
        self.width = map_bits(size) // 64
        self.place = np.zeros(len(size), np.int64)
        self.of: dict[int, np.ndarray] = {}
        self.halves: dict[int, np.ndarray] = {}
        for width in np.unique(self.width).tolist():
            which = np.flatnonzero(self.width == width)
            rows = data[at[which][:, None] + np.arange(width)]
            self.of[width] = rows
            self.place[which] = np.arange(len(which))
            if 64 * width > FEWEST:
                # A word's bit in a map of half the width is that place's remainder.
                self.halves[width] = rows[:, : width // 2] ^ rows[:, width // 2 :]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the maps of x and y differ, y of the same width or the next larger one; those of other widths do not differ."""
        out = np.zeros(len(x), np.int64)
        for width in np.unique(self.width[x]).tolist():
            for other in (width, 2 * width):
                which = np.flatnonzero((self.width[x] == width) & (self.width[y] == other))
                if len(which):
                    of = self.of[width] if other == width else self.halves[other]
                    out[which] = np.bitwise_count(self.of[width][self.place[x[which]]] ^ of[self.place[y[which]]]).sum(1)
        return out


def far(total: np.ndarray) -> np.ndarray:
    """Whether sets of so many words together are too large for maps to tell them apart."""
    return total - 2 * needed(total) > REACH * MOST


#: A row of a word of a set.
POSTING = np.dtype([("token", "<u8"), ("id", "<i8"), ("size", "<u4"), ("pos", "<u4")])


def candidates(each: DataFrame) -> DataFrame:
    """u, v and listed: a spanning forest of the candidates of tasks, and all candidates of very long lines (listed)."""

    def buckets(rare: pa.Array) -> Iterator[np.ndarray]:
        yield (_span(rare)[1] % np.uint64(BUCKETS)).astype(np.int64)

    counts = histogram(each.select("rare"), buckets)
    total = int(counts.sum())
    most = max(HOT, total // PART)
    # Rows of a bucket of more are dealt out in blocks.
    sent = each.sparkSession.sparkContext.broadcast(np.maximum(-(-counts // most), 1).astype(np.uint32))
    parts = max(1, total // min(max(SORTED, total // TASKS), MOST_SORTED))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a part of the words are packed before they are shuffled."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.column(3).nbytes // 8
            if n >= 4 * SPAN:
                yield _packed(pa.Table.from_batches(held), sent.value, parts)
                held, n = [], 0
        if held:
            yield _packed(pa.Table.from_batches(held), sent.value, parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for number, body, drawn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != part and held:
                    yield from _met(held)
                    held = []
                part = number
                held.append((body, drawn))
        if held:
            yield from _met(held)

    rows = each.filter(F.octet_length("rare") > 0).select("id", "size", "map", "rare").mapInArrow(frugal(deal), "part int, body binary, maps binary")
    return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(frugal(meet), "u long, v long, listed boolean")


def _packed(sets: pa.Table, blocks: np.ndarray, parts: int) -> pa.RecordBatch:
    """part, body (rows of rare words) and maps (their sets' maps) of a part of the words each."""
    ids, size, drawn, rare = (sets[c].combine_chunks() for c in ("id", "size", "map", "rare"))
    at, token = _span(rare)
    n = np.diff(at)
    own = np.repeat(np.arange(len(n)), n)
    rows = np.empty(len(own), POSTING)
    rows["token"] = token
    rows["id"], rows["size"] = ids.to_numpy()[own], size.to_numpy()[own]
    rows["pos"] = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    k = blocks[(rows["token"] % np.uint64(BUCKETS)).astype(np.int64)].astype(np.int64)
    if (k > 1).any():
        # A row's block is one of k, and it goes to the cells that are pairs of its block and any: two rows meet in one at least.
        other = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        rows, own, k = np.repeat(rows, k), np.repeat(own, k), np.repeat(k, k)
        block = (mix(rows["id"].view(np.uint64)) % k.astype(np.uint64)).astype(np.int64)
        cell = np.minimum(block, other) * k + np.maximum(block, other)
        rows["token"] = np.where(k > 1, mix(rows["token"] + mix(cell.astype(np.uint64))), rows["token"])
    part = (mix(rows["token"]) % np.uint64(parts)).astype(np.int32)
    # Short numbers are sorted in linear time.
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    rows, own, part = rows[order], own[order], part[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    at, data = _span(drawn)
    width = np.diff(at)[own]
    taken = np.repeat(at[own] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
    bodies = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.r_[first, len(rows)] * POSTING.itemsize).astype(np.int32)), pa.py_buffer(rows.tobytes())])
    ends = np.r_[0, np.cumsum(width)][np.r_[first, len(rows)]] * 8
    maps_ = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[taken].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(part[first]), bodies, maps_], names=["part", "body", "maps"])


def _met(held: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """candidates() of one part of the words."""
    rows = np.concatenate([np.frombuffer(body, POSTING) for body, _ in held])
    data = np.concatenate([np.frombuffer(drawn, np.uint64) for _, drawn in held])
    size = rows["size"].astype(np.int64)
    width = map_bits(size) // 64
    at = np.cumsum(width) - width
    if size.max() < 1 << 24:
        # Words that 40 bits take for one meet as well, to no effect.
        key = mix(rows["token"]) >> np.uint64(24) << np.uint64(24) | rows["size"]
        order = np.argsort(key)
        token = key[order] >> np.uint64(24)
    else:
        order = np.lexsort((rows["size"], rows["token"]))
        token = rows["token"][order]
    rows, size, at = rows[order], size[order], at[order]
    group = np.cumsum(np.r_[False, token[1:] != token[:-1]])
    ids, own = np.unique(rows["id"], return_inverse=True)
    drawn = Maps(size, at, data)
    # Edges of the forest so far and listed pairs, by numbers of sets.
    near, long_pairs = np.zeros((2, 0), np.int64), [np.zeros(0, np.int64)]
    for x, y in met(Rows(group, size, rows["pos"].astype(np.int64))):
        total = size[x] + size[y]
        fine = drawn.apart(x, y) <= total - 2 * needed(total)
        x, y, long = own[x[fine]], own[y[fine]], far(total[fine])
        near = np.concatenate([near, [x[~long], y[~long]]], 1)
        near = near[:, forest(near[0], near[1], len(ids))]
        long_pairs.append(np.unique(np.minimum(x[long], y[long]) * len(ids) + np.maximum(x[long], y[long])))
    pairs = np.array(np.divmod(np.unique(np.concatenate(long_pairs)), len(ids)))
    for (x, y), listed in ((near, False), (pairs, True)):
        if len(x):
            u, v = ids[x], ids[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(np.full(len(u), listed))], names=["u", "v", "listed"])


def _dealt(rows: DataFrame) -> DataFrame:
    """rows with block and cell: a row's block is one of k, and it goes to the k cells that are pairs of its block and any; two rows meet in at least one."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.withColumn("cell", (F.least("block", "other") * F.col("k") + F.greatest("block", "other")).cast("int")).drop("other")


# --- links


def shared(code: np.ndarray, first: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words the sets x and y have both. code: words of all sets; first and size: where each set's are."""
    out = np.zeros(len(x), np.int64)
    distinct, code = np.unique(code, return_inverse=True)
    bits = max(1, int(len(distinct)).bit_length())
    end = np.cumsum(size[x] + size[y])
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + SPAN, "right")))
        owner, n = np.tile(np.arange(b - a), 2), np.r_[size[x[a:b]], size[y[a:b]]]
        start = np.r_[first[x[a:b]], first[y[a:b]]]
        at = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        key = np.repeat(owner, n) << bits | code[at]
        key.sort()
        out[a:b] = np.bincount(key[1:][key[1:] == key[:-1]] >> bits, minlength=b - a)
        a = b
    return out


def _span(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row of a column of 64-bit numbers starts, and the numbers."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.uint64) if at[-1] > at[0] else np.zeros(0, np.uint64)
    return (at - at[0]) // 8, data


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a column of sets, where each set's start, and their number."""
    at, data = _span(column)
    return data, at[:-1], np.diff(at)


def spelled(docs: DataFrame, wanted: DataFrame, steps: np.ndarray) -> DataFrame:
    """wanted with words (codes as bytes, in order). wanted: none, doc_id, raw and line name a line."""
    sent = docs.sparkSession.sparkContext.broadcast(steps)
    asked = wanted.select(F.struct("*").alias("w"))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("raw"))
    if wanted.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
        docs = docs.join(F.broadcast(wanted.select(F.col("raw").alias("asked")).distinct()), F.col("raw") == F.col("asked"), "left_semi")
    lines = docs.select("doc_id", "raw", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    found = lines.join(asked, F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("raw") == F.col("w.raw")) & (F.col("line") == F.col("w.line"))).select("w", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, texts in chunks(batch.column(1)):
                w = words(raw, texts, True)
                c = codes(w, w.text, sent.value)
                at = np.r_[0, np.cumsum(np.bincount(c.line, c.size, minlength=b - a))].astype(np.int64) * 8
                cells = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(c.code.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), cells], names=["w", "words"])

    kinds = wanted.schema.simpleString()
    return by_text(found).mapInArrow(frugal(run), f"w {kinds}, words binary").select("w.*", "words")


def within(held: DataFrame) -> DataFrame:
    """u, v, links: for each set of a cluster the number of lines it is linked to and an earlier set it is linked to (or null), and a spanning forest of links (links 0). v < u.

    held: rank (in order of places), n, words and cluster. Links that are far() are left to listed().
    """
    sizes = held.groupBy("cluster").agg(F.count("*").alias("m"))
    k = F.expr(f"cast(greatest(1, least(ceil(m / {BLOCK}), {BLOCKS}), ceil(m / {LARGEST})) AS int)")
    rows = held.join(sizes, "cluster").select("cluster", F.col("rank").alias("id"), "n", "words", k.alias("k"))
    rows = _dealt(rows).select("cluster", "cell", "k", "block", "id", "n", "words").repartition("cluster", "cell").sortWithinPartitions("cluster", "cell", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 20_000:
                whole = pa.Table.from_batches(held).combine_chunks()
                cluster, cell = whole["cluster"].to_numpy(), whole["cell"].to_numpy()
                begin = int(np.flatnonzero((cluster != cluster[-1]) | (cell != cell[-1]))[-1]) + 1 if (cluster[0], cell[0]) != (cluster[-1], cell[-1]) else 0
                if begin:
                    yield from _linked(whole.slice(0, begin))
                    held = whole.slice(begin).combine_chunks().to_batches()
                    n = len(whole) - begin
        if n:
            yield from _linked(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(frugal(run), "u long, v long, links long")


def _linked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """within() for whole cells."""
    cluster, cell, k, block, rank, n = (rows[c].to_numpy() for c in ("cluster", "cell", "k", "block", "id", "n"))
    code, first, size = _flat(rows["words"].combine_chunks() if rows["words"].num_chunks != 1 else rows["words"].chunk(0))
    own = np.cumsum(np.r_[False, (cluster[1:] != cluster[:-1]) | (cell[1:] != cell[:-1])])
    # Blocks of a cell meet in it; rows of one block only in that of the block itself.
    crossed = (cell // k) != (cell % k)
    probe = probe_length(size)
    set_ = np.repeat(np.arange(len(size)), probe)
    pos = np.arange(len(set_)) - np.repeat(np.cumsum(probe) - probe, probe)
    _, token = np.unique(code[first[set_] + pos], return_inverse=True)
    group = own[set_].astype(np.int64) << 32 | token
    order = np.lexsort((size[set_], group))
    set_, pos, group = set_[order], pos[order], group[order]
    group = np.cumsum(np.r_[False, group[1:] != group[:-1]]) if len(group) else group
    links = np.zeros(len(size), np.int64)
    earlier = np.full(len(size), np.iinfo(np.int64).max)
    true_u, true_v = [], []
    found = [np.zeros(0, np.int64)]
    for x, y in met(Rows(group, size[set_], pos)):
        u, v = np.minimum(set_[x], set_[y]), np.maximum(set_[x], set_[y])
        fine = ~far(size[u] + size[v]) & (~crossed[u] | (block[u] != block[v]))
        found.append(np.unique(u[fine] * len(size) + v[fine]))
    pairs = np.unique(np.concatenate(found))
    for a in range(0, len(pairs), SPAN):
        u, v = np.divmod(pairs[a : a + SPAN], len(size))
        fine = shared(code, first, size, u, v) >= needed(size[u] + size[v])
        u, v = u[fine], v[fine]
        links += np.bincount(u, n[v], minlength=len(size)).astype(np.int64) + np.bincount(v, n[u], minlength=len(size)).astype(np.int64)
        # Rows are in order of rank within a cell.
        np.minimum.at(earlier, v, rank[u])
        if len(u):
            kept = forest(u, v, len(size))
            true_u.append(rank[v[kept]])
            true_v.append(rank[u[kept]])
    some = links > 0
    late = earlier < np.iinfo(np.int64).max
    yield pa.RecordBatch.from_arrays([pa.array(rank[some]), pa.array(earlier[some], mask=~late[some]), pa.array(links[some])], names=["u", "v", "links"])
    if true_u:
        u, v = np.concatenate(true_u), np.concatenate(true_v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.zeros(len(u), np.int64))], names=["u", "v", "links"])


def listed(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same of pairs u < v of ranks, by their words."""
    x, y = (held.select(F.col("rank").alias(r), F.col("n").alias(n), F.col("words").alias(w)) for r, n, w in (("u", "m", "a"), ("v", "n", "b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _flat(batch.column(2)), _flat(batch.column(3))
            pair = np.arange(batch.num_rows)
            size = np.r_[a[2], b[2]]
            both = shared(np.r_[a[0], b[0]], np.r_[a[1], b[1] + len(a[0])], size, pair, pair + len(pair))
            yield batch.select(["u", "v", "m", "n"]).filter(pa.array(both >= needed(a[2] + b[2])))

    fine = by_text(pairs.join(x, "u").join(y, "v").select("u", "v", "a", "b", "m", "n")).mapInArrow(frugal(run), "u long, v long, m long, n long")
    return fine.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.col("m").alias("links")), F.struct("u", F.lit(None).cast("long").alias("v"), F.col("n").alias("links")))).alias("r")).select("r.*")


def links(docs: DataFrame, each: DataFrame, steps: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The sets that may have links, with their rank, and u, v and links as within() gives them, of all links."""
    found = written(candidates(each))
    clusters = components(found.filter("NOT listed").select("u", "v")).select(F.col("u").alias("id"), F.col("v").alias("cluster"))
    pairs = found.filter("listed").select("u", "v").distinct()
    wanted = clusters.unionByName(pairs.select(F.col("u").alias("id"), F.lit(None).cast("long").alias("cluster"))).unionByName(pairs.select(F.col("v").alias("id"), F.lit(None).cast("long").alias("cluster")))
    wanted = wanted.groupBy("id").agg(F.max("cluster").alias("cluster")).join(each.drop("map", "rare"), "id")
    ranked = written(wanted.orderBy(*PLACE, "hi", "lo").withColumn("rank", F.monotonically_increasing_id()))
    # Rows of equal doc_id and text give the same line.
    held = written(spelled(docs, ranked, steps).select("rank", "n", "cluster", "words").dropDuplicates(["rank"]), ("words",))
    names = ranked.select("id", "rank")
    pairs = pairs.join(names.withColumnsRenamed({"id": "u", "rank": "r"}), "u").join(names.withColumnsRenamed({"id": "v", "rank": "s"}), "v").select(F.least("r", "s").alias("u"), F.greatest("r", "s").alias("v"))
    out = written(within(held.filter("cluster IS NOT NULL")).unionByName(listed(held, pairs)))
    discard(found, held)
    return ranked, out


# --- documents


@dataclass
class Found:
    """What is known of lines, rows and sets; tables that free() deletes."""

    lines: DataFrame
    rows: DataFrame
    each: DataFrame
    ranked: DataFrame
    links: DataFrame

    def free(self) -> None:
        discard(self.lines, self.rows, self.each, self.ranked, self.links)


def joined(docs: DataFrame) -> Found:
    steps = rarity(docs)
    lines, rows, each = indexed(docs, steps)
    return Found(lines, rows, each, *links(docs, each, steps))


def decide(found: Found) -> DataFrame:
    """Lines whose set stands in several lines or has links: doc, line, links, removed, earlier (a document with an earlier line) and hub (the doc of its set's first line)."""
    state = found.links.groupBy(F.col("u").alias("rank")).agg(F.min("v").alias("v"), F.sum("links").alias("links"))
    partner = found.ranked.select(F.col("rank").alias("v"), F.col("doc_id").alias("partner"))
    state = found.ranked.select("id", "rank").join(state, "rank").join(partner, "v", "left").withColumn("late", F.col("v").isNotNull()).drop("v", "rank")
    known = found.each.select("id", "hi", "lo", "n", F.struct("doc_id", "line", "doc").alias("first")).join(state, "id", "left").filter("n > 1 OR late IS NOT NULL").drop("id", "n")
    rows = found.lines.join(known, ["hi", "lo"])
    repeat = (F.col("doc") != F.col("first.doc")) | (F.col("line") != F.col("first.line"))
    late = F.coalesce("late", F.lit(False))
    earlier = F.when(repeat, F.col("first.doc_id")).otherwise(F.col("partner"))
    return rows.select("doc", "line", F.coalesce("links", F.lit(0)).alias("links"), (repeat | late).alias("removed"), earlier.alias("earlier"), F.col("first.doc").alias("hub"))


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, raw (xxhash64 of the text) and removed (line numbers from 0, in order) of each document that loses a line."""
    found = joined(docs)
    gone = decide(found).filter("removed").groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    out = written(gone.join(found.rows, "doc").select("doc_id", "raw", "removed"))
    found.free()
    return out


def classes(found: Found, lines: DataFrame) -> DataFrame:
    """doc and class: documents that lines of equal or linked sets join, and the least of them. lines: as decide() gives them."""
    # A set's documents are joined to that of its first line, and linked sets by those of theirs.
    first = found.ranked.select("rank", "doc")
    across = found.links.filter("v IS NOT NULL").select("u", "v")
    across = across.join(first.withColumnsRenamed({"rank": "u", "doc": "a"}), "u").join(first.withColumnsRenamed({"rank": "v", "doc": "b"}), "v").select("a", "b")
    edges = lines.filter("doc != hub").select("doc", "hub").unionByName(across.select(F.col("a").alias("doc"), F.col("b").alias("hub"))).filter("doc != hub").distinct()
    return components(edges.toDF("u", "v")).select(F.col("u").alias("doc"), F.col("v").alias("class"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, n_links, class_id, removed (line numbers from 0) and earlier (for each, the document of an earlier line) of every row of docs."""
    found = joined(docs)
    lines = written(decide(found))
    counts = found.lines.groupBy("doc").agg(F.count("*").alias("n_lines"))
    # All of a document's lines in one task, so that their lists are made once.
    gone = lines.repartition("doc").groupBy("doc").agg(F.sum("links").alias("n_links"), F.array_sort(F.collect_list(F.when(F.col("removed"), F.struct("line", "earlier")))).alias("gone"))
    own = classes(found, lines)
    least = written(own.join(found.rows, "doc").groupBy("class").agg(F.min("doc_id").alias("class_id")))
    kept = found.rows.join(counts, "doc").join(gone, "doc", "left").join(own, "doc", "left").join(least, "class", "left")
    class_id = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    # Rows of equal doc_id and text share what is known of the one that stayed.
    kept = kept.select(F.struct("doc_id", "raw", "n_lines", "gone", "n_links", class_id.alias("class_id")).alias("f"))
    both = found.rows.join(kept, F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("raw") == F.col("f.raw")), "left")
    empty = F.array().cast(lines.select(F.array(F.struct("line", "earlier"))).schema[0].dataType)
    out = both.select("doc_id", F.coalesce("f.n_lines", F.lit(0)).alias("n_lines"), F.coalesce("f.n_links", F.lit(0)).alias("n_links"), F.when(F.col("f").isNull(), F.col("doc_id")).otherwise(F.col("f.class_id")).alias("class_id"), F.coalesce("f.gone", empty).alias("gone"))
    out = written(out.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), "n_links", "class_id", F.col("gone.line").alias("removed"), F.col("gone.earlier").alias("earlier")))
    found.free()
    discard(lines, least)
    return out


def remove(docs: DataFrame) -> DataFrame:
    """docs with late lines taken out of text, and n_chars, if there is one, counted anew."""
    gone = decisions(docs).select(F.struct("*").alias("g"))
    # A row's columns lie in a struct, so that their names do not matter.
    rows = docs.select(F.struct("*").alias("r"), F.xxhash64("text").alias("raw"))
    both = rows.join(gone, F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("raw") == F.col("g.raw")), "left")
    left = F.array_join(F.filter(F.split("r.text", "\n"), lambda _, i: ~F.array_contains("g.removed", i)), "\n")
    text = F.when(F.col("g").isNull(), F.col("r.text")).otherwise(left)

    def field(name: str) -> Column:
        old = F.col("r").getField(name)
        if name == "text":
            return text.alias(name)
        if name == "n_chars":
            return F.when(F.col("g").isNull(), old).otherwise(F.length(text).cast(docs.schema[name].dataType)).alias(name)
        return old.alias(name)

    return both.select(*(field(c) for c in docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES: dict[str, str] = {}
