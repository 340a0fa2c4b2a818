"""Byte-pair encoding and decoding with the vocabulary of a public tokenizer.

Words are merged in batches: the symbols of all words that a batch of texts holds for the first
time lie in one flat array; each round looks up every neighbouring pair in the sorted pair keys
by binary search, takes the pair of lowest rank in each word, and merges it wherever it stands.
Words without a pair leave the array. A word's ids do not depend on its neighbours, so each
worker keeps a bounded table of words that it has met.

Defined cases: null and empty texts have no ids and decode to the empty text; long texts and
long words are encoded whole; the added tokens' own strings in a text become their ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from .runtime import by_text, frugal, table

#: Words that a worker remembers; beyond it starts afresh. Bounds memory, changes no result.
REMEMBERED = 120_000
#: Code points of text that go into one Arrow batch of results, about.
BATCH_CHARS = 1_000_000
NONE = np.iinfo(np.int64).max
#: Bytes beyond which a word is merged in rounds of its own.
LONG = 512


def byte_symbols() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Merger:
    """Merges the symbols of many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def __call__(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word; words are not empty."""
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_words, done_symbols = [], []
        long = np.flatnonzero(lengths > LONG)
        if len(long):
            # A long word would hold all others back for as many rounds as it has merges of one place.
            for w in long.tolist():
                done_symbols.append(self.alone(symbol[ends[w] - lengths[w] : ends[w]]))
                done_words.append(np.full(len(done_symbols[-1]), w))
            short = lengths[word] <= LONG
            symbol, word = symbol[short], word[short]
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            pair = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.full(len(symbol), NONE)
            found = np.flatnonzero((self.keys[at] == pair) & (word[1:] == word[:-1]))
            rank[found] = self.ranks[at[found]]
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            over = lowest == NONE
            if over.any():
                done_words.append(word[over])
                done_symbols.append(symbol[over])
                left = ~over
                symbol, word, rank, lowest = symbol[left], word[left], rank[left], lowest[left]
            hits = np.flatnonzero(rank == lowest)
            if len(hits):
                # Of overlapping pairs of equal symbols every second merges, from the left.
                opens = np.r_[True, np.diff(hits) != 1]
                run = hits[np.maximum.accumulate(np.where(opens, np.arange(len(hits)), 0))]
                hits = hits[(hits - run) % 2 == 0]
                symbol[hits] = self.merged[rank[hits]]
                keep = np.ones(len(symbol), bool)
                keep[hits + 1] = False
                symbol, word = symbol[keep], word[keep]
        word, symbol = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        return np.split(symbol[order], np.cumsum(np.bincount(word, minlength=len(words)))[:-1])


    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which symbols merge, or NONE."""
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], NONE)

    def alone(self, symbol: np.ndarray) -> np.ndarray:
        """The symbols of one word, in a round for each rank that occurs: a round looks only at the places of its rank."""
        symbol, n = symbol.copy(), len(symbol)
        after, before, live = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            rank = self.rank(symbol[places], symbol[after[places]])
            places, rank = places[rank != NONE], rank[rank != NONE]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else rank
            for r, some in zip(rank[first].tolist(), np.split(places, first[1:]), strict=False):
                if r in waiting:
                    waiting[r].append(some)
                else:
                    waiting[r] = [some]
                    heappush(heap, r)

        wait(np.arange(n - 1))
        while heap:
            r = heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(r)))
            # Places whose symbols have merged since are past.
            places = places[live[places] & (after[places] < n)]
            places = places[self.rank(symbol[places], symbol[after[places]]) == r]
            if not len(places):
                continue
            opens = np.r_[True, places[1:] != after[places[:-1]]]
            run = np.maximum.accumulate(np.where(opens, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run) % 2 == 0]
            gone = after[places]
            symbol[places] = self.merged[r]
            live[gone] = False
            after[places] = after[gone]
            inner = places[after[places] < n]
            before[after[inner]] = inner
            wait(np.unique(np.r_[inner, before[places][before[places] >= 0]]))
        return symbol[live]


class Codec:
    """Encodes and decodes as the tokenizer that a JSON file describes: byte-level BPE with word ends."""

    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+|[\x1c-\x1f]+", re.ASCII)
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    WORDS = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}"))
    #: Beyond these letters the library's own tables of Unicode decide what is a letter, as their version may differ.
    FAR = re.compile("[^\0-\u024f]")

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merge = Merger(vocab, spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = {s: (np.array([i], "<u4").tobytes(), s) for s, i in added.items()}
        # The normalizer needs no vocabulary.
        self.normal = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}})).normalizer
        self.split = pre_tokenizers.Split(Regex(self.PATTERN), "removed", invert=True)
        self.known: dict[str, bytes] = {}
        self.written: dict[str, str] = {}

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ASCII.findall(text.lower())
        if self.FAR.search(text):
            return [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))]
        return self.WORDS.findall(unicodedata.normalize("NFC", text).lower())

    def parts(self, text: str) -> list[str]:
        """Words; an added token stands as a word of its own with a mark before it."""
        if self.special is None or "<" not in text:
            return self.words(text)
        out = []
        for piece in self.special.split(text):
            out += ["\0" + piece] if piece in self.added else self.words(piece)
        return out

    def learn(self, lists: list[list[str]]) -> None:
        if len(self.known) > REMEMBERED:
            self.forget()
        new = list({w for words in lists for w in words} - self.known.keys())
        for start in range(0, len(new), 20_000):
            some = new[start : start + 20_000]
            plain = [w for w in some if w[1:] not in self.added or w[0] != "\0"]
            for w, ids in zip(plain, self.merge([w.encode() for w in plain]) if plain else [], strict=True):
                self.known[w] = ids.astype("<u4").tobytes()
                self.written[w] = " ".join([self.names[i] for i in ids.tolist()])
            for w in set(some).difference(plain):
                self.known[w], self.written[w] = self.added[w[1:]]

    def forget(self) -> None:
        self.known, self.written = {}, {}

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """The ids of each text as little-endian 32-bit integers, and the text that they decode to."""
        lists = [self.parts(t) for t in texts]
        self.learn(lists)
        ids, written = self.known.__getitem__, self.written.__getitem__
        return [b"".join(map(ids, words)) for words in lists], [" ".join(map(written, words)) for words in lists]


_codecs: dict[int, Codec] = {}


def _codec(text: str) -> Codec:
    key = hash(text)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(text)
    return _codecs[key]


def groups(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of rows of about so many code points together."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and decoded of every text.

    tokenizer is the path of a tokenizer's JSON file, which the driver reads.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in groups([len(t) for t in texts], BATCH_CHARS):
                ids, decoded = codec.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])
        del codec
        _codecs.clear()  # the worker lives on for other tasks

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_text(docs.select("doc_id", "text")).mapInArrow(frugal(run), f"doc_id {kind}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), vocabulary()))


QUERIES = {"op8_bpe_round_trip": op8_bpe_round_trip}
ORACLES: dict[str, str] = {}
