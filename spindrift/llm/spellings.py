"""Groups spelling variants: words one code point apart, and each word's commonest near word.

A word's mask has the parity of each letter's count, a bit for each of the LETTERS. One inserted,
deleted or replaced code point flips one or two bits, so of the mask's three bands at least one
stays. It also leaves the word's first END code points or its last END alone, as words have at
least 2 * END. Words are therefore joined by equal (band, end): six keys a word. A pair is
taken from the first key it shares, if lengths and masks allow one edit, and then verified by
edit distance.

Forms point from a word to a commoner one, by FACTOR at least, so the chain from any word is
short (the logarithm of the counts); pointers double each round until they rest.

Defined cases: a null text has no words, a null id counts as the empty text in the digest. Each
occurrence of a word counts, in repeated rows too. Long runs of letters are one word. No rows or no
frequent word: no rows. Columns but doc_id and text are not read. A word whose neighbours are as
many as may be is joined to them row by row; no group of words is gathered.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table, written

#: Words are maximal runs of these. Each has a bit of its own: letter i is bit i // BANDS of band i % BANDS.
RUN, LETTERS = r"[A-Za-zÀ-ÿ]", string.ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))
BANDS = 3
#: Code points and occurrences that a word has at least; code points at either end of which one edit leaves one end alone.
LEAST_LENGTH, LEAST_COUNT, END = 6, 5, 3
#: One of so many words of a document loses a letter.
DAMAGE = 199
#: A form is so many times as frequent as the word.
FACTOR = 5


def runs(docs: DataFrame) -> DataFrame:
    """doc_id and run of each word of a text of LEAST_LENGTH code points or more."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))


def damaged(found: DataFrame) -> DataFrame:
    """word: the runs, of which some lose a code point by a digest of the document's id and the run."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    hashed = found.select("run", F.inline(F.array(F.struct(h.alias("h")))))
    return hashed.select(F.when(F.col("h") % DAMAGE == 0, shorter).otherwise(F.col("run")).alias("word"))


def frequent(words: DataFrame) -> DataFrame:
    """word and n of the words that are long and frequent enough."""
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def bands(word: Column) -> Column:
    """The parities of a word's letters, an integer for each band."""
    out = []
    for b in range(BANDS):
        bits = F.lit(0)
        for i, letter in enumerate(LETTERS[b::BANDS]):
            odd = (F.length(word) - F.length(F.replace(word, F.lit(letter)))) % 2
            bits = bits + odd * (1 << i)
        out.append(bits)
    return F.array(*out)


def near_pairs(words: DataFrame) -> DataFrame:
    """a and b (words), na and nb (their counts): each pair of near words, in both orders. words: word and n."""
    masked = words.select("word", "n", F.inline(F.array(F.struct(bands(F.col("word")).alias("m"))))).withColumns({"size": F.length("word"), "head": F.substring("word", 1, END), "tail": F.expr(f"right(word, {END})")})
    masked = written(masked)
    # Keys in order: bands with the head, then bands with the tail.
    keys = F.array(*(F.struct(F.lit(side * BANDS + b).alias("k"), F.col("m")[b].alias("band"), F.col(end).alias("end")) for side, end in enumerate(("head", "tail")) for b in range(BANDS)))
    a = masked.select(*(F.col(c).alias(f"{c}_a") for c in masked.columns), F.inline(keys))
    b = masked.select(*(F.col(c).alias(f"{c}_b") for c in masked.columns), F.inline(keys))
    flips = sum((F.bit_count(F.col("m_a")[i].bitwiseXOR(F.col("m_b")[i])) for i in range(BANDS)), F.lit(0))
    # The first key that both share: of several, only that one gives the pair.
    earlier = [(F.col("m_a")[i] == F.col("m_b")[i]) & (F.col(f"{end}_a") == F.col(f"{end}_b")) & (F.col("k") > side * BANDS + i) for side, end in enumerate(("head", "tail")) for i in range(BANDS)]
    first = ~F.coalesce(*[F.when(e, True) for e in earlier], F.lit(False))
    possible = (F.col("word_a") < F.col("word_b")) & (F.abs(F.col("size_a") - F.col("size_b")) <= 1) & (flips <= 2 - F.abs(F.col("size_a") - F.col("size_b"))) & first
    pairs = a.join(b, ["k", "band", "end"]).filter(possible).filter(F.levenshtein("word_a", "word_b", 1) == 1)
    one = pairs.select("word_a", "n_a", "word_b", "n_b")
    both = F.inline(F.array(F.struct(F.col("word_a").alias("a"), F.col("n_a").alias("na"), F.col("word_b").alias("b"), F.col("n_b").alias("nb")), F.struct(F.col("word_b").alias("a"), F.col("n_b").alias("na"), F.col("word_a").alias("b"), F.col("n_a").alias("nb"))))
    return one.select(both)


def groups(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word. words: word and n."""
    words = written(words)
    best = near_pairs(words).groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("minus"), F.col("b").alias("form"))).alias("best"))
    commoner = -F.col("best.minus") >= FACTOR * F.col("n")
    formed = words.join(best, words["word"] == best["a"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(commoner, F.col("best.form")).alias("form"), F.when(commoner, -F.col("best.minus")).alias("form_n"),
    )
    formed = written(formed)
    # Only words with a form point anywhere; the others are roots.
    rooted = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    moved = True
    while moved:
        ahead = rooted.select(F.col("word").alias("w"), F.col("root").alias("r"))
        step = written(rooted.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        moved = not step.filter("moved").isEmpty()
        rooted = step.select("word", "root")
    out = formed.join(rooted, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(frequent(damaged(runs(table(spark, sf_dir, "documents")))))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
#: DuckDB has no crc32; tests compare with a plain version.
ORACLES: dict[str, str] = {}
