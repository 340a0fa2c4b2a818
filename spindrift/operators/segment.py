"""Words of texts without spaces, by a dictionary with frequencies and tags, and terms glued from short tokens.

A text's lattice has an edge for each dictionary word that stands at a place, found by walking a trie, and one for each single
character. Three paths are taken through it: the longest words from the front, the longest from the back, and the path of the best
score. Where no edge spans a place, each path has a cut there, so a text is scored piece by piece.

A word's weight is the logarithm of its share of a million, rounded; the score of a path of n words is their weights' sum, plus
the share of words above one character, plus ONE_WORD / n, so that fewer and longer words win.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word's count is a share of this; what counts for few words; weights of unknown characters, in a scored path and else.
SHARE_OF, ONE_WORD, UNKNOWN, UNSCORED = 1_000_000, 30, -12, 0
#: Words of a dictionary, at most: it is sent to every task.
MOST_WORDS = 2_000_000
#: The trie's key for the word that ends there.
END = ""

Entry = tuple[int, str]


def dictionary(lines: Iterable[str], known: Mapping[str, Entry] | None = None) -> dict[str, Entry]:
    """Weight and tag of each word, from lines of word, count and tag; known is extended. Of a word's entries the heaviest stands. Other lines are skipped."""
    out = dict(known or {})
    for line in lines:
        parts = line.split()
        if len(parts) < 3 or line.startswith("#") or not parts[1].replace(".", "", 1).isdigit() or float(parts[1]) <= 0:
            continue
        # Towards zero, as the weights that dictionaries of this form are made for.
        entry = int(math.log(float(parts[1]) / SHARE_OF) + 0.5), parts[2]
        word = parts[0].lower()
        if word not in out or out[word][0] < entry[0]:
            out[word] = entry
    if len(out) > MOST_WORDS:
        raise ValueError(f"a dictionary has {MOST_WORDS} words at most")
    return out


def count_of(word: str, words: Mapping[str, Entry]) -> int:
    """The count that a word's weight stands for; 0 if it is unknown."""
    found = words.get(word.lower())
    return int(math.exp(found[0]) * SHARE_OF + 0.5) if found else 0


def tag_of(word: str, words: Mapping[str, Entry]) -> str:
    return words.get(word.lower(), (0, ""))[1]


class Lattice:
    """Finds the words of a dictionary in a text."""

    def __init__(self, words: Mapping[str, Entry]):
        self.words, self.trie, self.back = words, {}, {}
        for w in words:
            for root, letters in ((self.trie, w), (self.back, w[::-1])):
                at = root
                for c in letters:
                    at = at.setdefault(c, {})
                at[END] = True

    @staticmethod
    def _lengths(root: dict, letters: Iterable[str]) -> list[int]:
        """Lengths of the words that the letters begin with."""
        out, at = [], root
        for n, c in enumerate(letters, 1):
            at = at.get(c)
            if at is None:
                break
            if END in at:
                out.append(n)
        return out

    def edges(self, s: str) -> list[list[int]]:
        """Of each place the lengths of the words there, 1 among them."""
        found = [self._lengths(self.trie, (s[j] for j in range(i, len(s)))) for i in range(len(s))]
        return [f if f[:1] == [1] else [1, *f] for f in found]

    def forward(self, s: str) -> list[str]:
        out, i = [], 0
        while i < len(s):
            n = max(self._lengths(self.trie, (s[j] for j in range(i, len(s)))), default=1)
            out.append(s[i : i + n])
            i += n
        return out

    def backward(self, s: str) -> list[str]:
        out, i = [], len(s)
        while i:
            n = max(self._lengths(self.back, (s[j] for j in range(i - 1, -1, -1))), default=1)
            out.append(s[i - n : i])
            i -= n
        return out[::-1]

    def score(self, path: Sequence[str], unknown: int = UNKNOWN) -> float:
        weights = sum(self.words.get(w, (unknown, ""))[0] for w in path)
        return ONE_WORD / len(path) + sum(len(w) > 1 for w in path) / len(path) + weights

    def scored(self, s: str) -> list[str]:
        """The best path of each piece; of equal scores the one that is first in order of its words' lengths, longer ones first."""
        out: list[str] = []
        edges, start, reach = self.edges(s), 0, 0
        for i in range(len(s)):
            reach = max(reach, i + edges[i][-1])
            if reach == i + 1:
                out += self._piece(s[start : i + 1], edges[start : i + 1])
                start = i + 1
        return out

    def _piece(self, s: str, edges: list[list[int]]) -> list[str]:
        """Backwards by place: for each number of words, and of those above one character, the best weight and its first word."""
        best: list[dict[tuple[int, int], tuple[int, tuple[int, ...]]]] = [{} for _ in range(len(s) + 1)]
        best[len(s)][0, 0] = 0, ()
        for i in range(len(s) - 1, -1, -1):
            here = best[i]
            for n in edges[i]:
                weight = self.words.get(s[i : i + n], (UNKNOWN, ""))[0]
                for (words, long), (total, lengths) in best[i + n].items():
                    key, value = (words + 1, long + (n > 1)), (total + weight, (n, *lengths))
                    if key not in here or value > here[key]:
                        here[key] = value
            # Of paths of as many words, one with fewer long words counts only if it is heavier.
            for words, long in sorted(here, key=lambda k: (k[0], -k[1])):
                if any((words, more) in here and here[words, more][0] >= here[words, long][0] + (here[words, more][1] < here[words, long][1]) for more in range(long + 1, words + 1)):
                    del here[words, long]
        _, lengths = max((ONE_WORD / w + m / w + total, lengths) for (w, m), (total, lengths) in best[0].items())
        out, i = [], 0
        for n in lengths:
            out.append(s[i : i + n])
            i += n
        return out

    def agreed(self, s: str) -> list[str]:
        """Words of forward and backward where both have the same cuts; between cuts that differ, the scored path."""
        f, b = self.forward(s), self.backward(s)
        if f == b:
            return f
        ends = [set(), set()]
        for e, path in zip(ends, (f, b), strict=True):
            at = 0
            for w in path:
                at += len(w)
                e.add(at)
        out, start = [], 0
        for cut in sorted(ends[0] & ends[1]):
            own = [[x for x in sorted(e) if start < x <= cut] for e in ends]
            out += [s[start:cut]] if own[0] == own[1] else self.scored(s[start:cut])
            start = cut
        return out


METHODS = ("forward", "backward", "scored", "agreed")


def segmenter(words: Mapping[str, Entry], method: str = "agreed") -> Callable[[Column], Column]:
    """Arrow function of a text without spaces: its words. The dictionary is sent with the function."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    lattice: list[Lattice] = []

    @F.pandas_udf("array<string>")
    def segment(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not lattice:
            lattice.append(Lattice(words))
        cut = getattr(lattice[0], method)
        for texts in parts:
            yield texts.map(lambda t: None if t is None else cut(t.lower()))

    return segment


def rejoined(tokens: Sequence[str], words: Mapping[str, Entry], split: str = r"+#&./-", most: int = 5) -> list[str]:
    """Tokens of which up to most neighbours with a splitting sign among them are a dictionary word together, as that word; the longest such word stands."""
    out, i = [], 0
    while i < len(tokens):
        n = next((n for n in range(min(most, len(tokens) - i), 1, -1) if any(c in split for t in tokens[i : i + n] for c in t) and "".join(tokens[i : i + n]).lower() in words), 1)
        out.append("".join(tokens[i : i + n]))
        i += n
    return out


# --- short tokens


def is_short(token: Column) -> Column:
    return (F.length(token) == 1) | token.rlike("^[0-9a-z]{1,2}$")


def merged_tokens(tokens: DataFrame, stop_words: Sequence[str] = (), key: str = "doc_id", place: str = "place", token: str = "token") -> DataFrame:
    """key, term_no and term: neighbouring short tokens as one term, joined by spaces.

    Of a run of short tokens, stop words excluded, pairs are taken while five or more are left, then the rest together. A short token
    that begins a text joins a second one that is longer and does not begin with an ASCII letter or digit.
    """
    order = Window.partitionBy(key).orderBy(place)
    rows = tokens.filter(F.col(token) != "").withColumn("_i", F.row_number().over(order) - 1)
    rows = rows.withColumns({"_second": F.lead(token).over(order), "_before": F.lag(token).over(order)})
    longer = lambda c: (F.length(c) > 1) & ~F.col(c).rlike("^[0-9a-zA-Z]")
    # The first two tokens, where they are one term.
    paired = F.coalesce(F.when(F.col("_i") == 0, is_short(F.col(token)) & longer("_second")).when(F.col("_i") == 1, is_short(F.col("_before")) & longer(token)), F.lit(False))
    short = is_short(F.col(token)) & ~F.col(token).isin(*stop_words) & ~F.col("_paired") if stop_words else is_short(F.col(token)) & ~F.col("_paired")
    rows = rows.withColumn("_paired", paired).withColumn("_short", short)
    new = F.when(F.col("_paired"), F.col("_i") == 0).otherwise(~F.coalesce(F.lag("_short").over(order) & F.col("_short"), F.lit(False)))
    rows = rows.withColumn("_run", F.sum(new.cast("int")).over(order))
    by_run = Window.partitionBy(key, "_run")
    rows = rows.withColumns({"_p": F.row_number().over(by_run.orderBy(place)) - 1, "_n": F.count("*").over(by_run)})
    pairs = F.greatest(F.ceil((F.col("_n") - 4) / 2), F.lit(0))
    rows = rows.withColumn("_part", F.when(F.col("_paired"), 0).otherwise(F.least(F.floor(F.col("_p") / 2), pairs)))
    terms = rows.groupBy(key, "_run", "_part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", token))), lambda x: x[token]), " ").alias("term"), F.min("_i").alias("_first"))
    return terms.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1).alias("term_no"), "term")


# --- weights of terms

# Factors by kind of name and by tag, counts of what is no word of the dictionary, and the corpora's sizes.
KINDS = {"toxic": 2.0, "func": 1.0, "corp": 3.0, "loca": 3.0, "sch": 3.0, "stock": 3.0, "firstnm": 1.0}
TAGS = {"r": 0.3, "c": 0.3, "d": 0.3, "ns": 3.0, "nt": 3.0, "n": 2.0}
N_WORDS, N_DOCS, BY_WORDS, BY_DOCS = 10_000_000, 1_000_000_000, 0.3, 0.7


def weighted_terms(terms: DataFrame, entries: DataFrame, key: str = "doc_id", term: str = "term") -> DataFrame:
    """key, term and weight, of sum 1 for a key: rarity among words and among documents, times the factors of the term's kind and tag.

    entries: term, freq, df, kind and tag (null where not known). An entry that is small enough is broadcast by Spark. Terms of
    digits, and unknown terms of ASCII letters, have fixed counts.
    """
    joined = terms.join(entries.withColumnRenamed("term", "_t"), F.col(term) == F.col("_t"), "left")
    digits, letters = F.col(term).rlike(r"^[0-9. -]{2,}$"), F.col(term).rlike(r"^[a-z. -]+$")
    freq = F.when(digits, 3).when(F.coalesce(F.col("freq"), F.lit(0)) > 0, F.greatest("freq", F.lit(10))).when(letters, 300).otherwise(10)
    df = F.when(digits, 5).when(F.col("df").isNotNull(), F.col("df") + 3).when(letters, 300).otherwise(3)
    by = lambda column, table, other: F.coalesce(*[F.when(column == k, v) for k, v in table.items()], other)
    name = F.when(F.col(term).rlike(r"^[0-9,.]{2,}$"), 2.0).when(F.col(term).rlike(r"^[a-z]{1,2}$"), 0.01).otherwise(by(F.col("kind"), KINDS, F.lit(1.0)))
    tag = by(F.col("tag"), TAGS, F.when(F.col("tag").rlike("^[0-9-]+"), 2.0).otherwise(1.0))
    rarity = lambda n, of: F.log10(10 + (of - n + 0.5) / (n + 0.5))
    weight = (BY_WORDS * rarity(freq, N_WORDS) + BY_DOCS * rarity(df, N_DOCS)) * name * tag
    rows = joined.withColumn("_w", weight)
    return rows.select(key, term, F.try_divide("_w", F.sum("_w").over(Window.partitionBy(key))).alias("weight"))
