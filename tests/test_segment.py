"""Segmentation against an enumeration of all paths, and tokens glued as a plain loop glues them."""

import itertools
import random
import re
from collections import Counter

import pytest

from spindrift.operators import segment as G
from spindrift.operators import terms as K

LINES = ["# a comment", "ab 900 n", "abc 20 v", "bc 5000 ns", "ca 1 r", "cab 300 n", "aab 7 x", "b 10 c", "dddd 50 n", "ab 3 low", "bad line", "x notanumber n"]
WORDS = G.dictionary(LINES)


def paths(s):
    """Every path: words of the dictionary and single characters."""
    if not s:
        yield []
    for n in range(1, len(s) + 1):
        if n == 1 or s[:n] in WORDS:
            for rest in paths(s[n:]):
                yield [s[:n], *rest]


def pieces(s):
    """Parts between the places that no dictionary word spans."""
    cuts = [i for i in range(1, len(s)) if not any(s[a:b] in WORDS for a in range(i) for b in range(i + 1, len(s) + 1))]
    return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]


def test_dictionary():
    assert WORDS["ab"] == (-6, "n") and "bad" not in WORDS and "x" not in WORDS
    assert G.dictionary(["ab 90000 z"], WORDS)["ab"] == (-1, "z")
    assert G.tag_of("BC", WORDS) == "ns" and G.tag_of("q", WORDS) == "" and G.count_of("q", WORDS) == 0 and G.count_of("bc", WORDS) > 0


def test_scored_paths_are_the_best_of_all():
    lattice = G.Lattice(WORDS)
    for n in range(1, 8):
        for letters in itertools.product("abcd", repeat=n):
            s = "".join(letters)
            wanted = [w for p in pieces(s) for w in max(paths(p), key=lambda path: (lattice.score(path), [len(w) for w in path]))]
            assert lattice.scored(s) == wanted, s


def test_longest_matches():
    lattice, draw = G.Lattice(WORDS), random.Random(1)
    for _ in range(2000):
        s = "".join(draw.choice("abcd") for _ in range(draw.randint(0, 14)))
        front, i = [], 0
        while i < len(s):
            n = max([n for n in range(1, len(s) - i + 1) if s[i : i + n] in WORDS], default=1)
            front.append(s[i : i + n])
            i += n
        back, i = [], len(s)
        while i:
            n = max([n for n in range(1, i + 1) if s[i - n : i] in WORDS], default=1)
            back.insert(0, s[i - n : i])
            i -= n
        assert lattice.forward(s) == front and lattice.backward(s) == back
        agreed = lattice.agreed(s)
        assert "".join(agreed) == s and (agreed == front if front == back else True)


def test_long_texts(spark):
    text = "abcab" * 60
    assert "".join(G.Lattice(WORDS).scored(text)) == text
    df = spark.createDataFrame([(1, "ABcab"), (2, None), (3, "")], "i int, t string")
    found = {r["i"]: r["w"] for r in df.select("i", G.segmenter(WORDS)("t").alias("w")).collect()}
    assert found == {1: G.Lattice(WORDS).agreed("abcab"), 2: None, 3: []}
    with pytest.raises(ValueError):
        G.segmenter(WORDS, "other")


def test_rejoined():
    words = G.dictionary(["c++ 10 n", "a/b 10 n", "a/b/c 10 n", "ab 10 n"])
    assert G.rejoined(["c", "+", "+", "x"], words) == ["c++", "x"]
    assert G.rejoined(["a", "/", "b", "/", "c"], words) == ["a/b/c"] and G.rejoined(["a", "b"], words) == ["a", "b"]


def glued(tokens, stop):
    short = lambda t: len(t) == 1 or re.fullmatch("[0-9a-z]{1,2}", t) is not None
    tokens, out = [t for t in tokens if t], []
    if len(tokens) > 1 and short(tokens[0]) and len(tokens[1]) > 1 and not re.match("[0-9a-zA-Z]", tokens[1]):
        out, tokens = [" ".join(tokens[:2])], tokens[2:]
    for is_run, group in itertools.groupby(tokens, key=lambda t: short(t) and t not in stop):
        run = list(group)
        if not is_run:
            out += run
            continue
        while len(run) >= 5:
            out.append(" ".join(run[:2]))
            run = run[2:]
        out.append(" ".join(run))
    return out


def test_short_tokens_are_glued(spark):
    draw, rows, wanted = random.Random(3), [], {}
    for i in range(300):
        tokens = [draw.choice(["a", "b2", "of", "long", "工位", "工", "7", "x", "é", ""]) for _ in range(draw.randint(0, 14))]
        rows += [(i, p, t) for p, t in enumerate(tokens)]
        if any(tokens):
            wanted[i] = glued(tokens, ("of",))
    df = spark.createDataFrame(rows, "doc_id int, place int, token string").repartition(3)
    found = {}
    for r in G.merged_tokens(df, ("of",)).orderBy("doc_id", "term_no").collect():
        found.setdefault(r["doc_id"], []).append(r["term"])
    assert found == wanted


def test_weights(spark):
    terms = spark.createDataFrame([(1, "paris"), (1, "12.5"), (1, "it"), (1, "unknown"), (2, "x1y"), (2, "run")], "doc_id int, term string")
    entries = spark.createDataFrame([("paris", 1000, 50, "loca", "ns"), ("run", 5, None, None, "d"), ("it", 90000, 7, None, "r")], "term string, freq int, df int, kind string, tag string")
    import math

    rarity = lambda n, of: math.log10(10 + (of - n + 0.5) / (n + 0.5))
    weight = lambda freq, df, by: (0.3 * rarity(freq, 10_000_000) + 0.7 * rarity(df, 1_000_000_000)) * by
    raw = {"paris": weight(1000, 53, 9), "12.5": weight(3, 5, 2), "it": weight(90000, 10, 0.01 * 0.3), "unknown": weight(300, 300, 1), "x1y": weight(10, 3, 1), "run": weight(10, 300, 0.3)}
    one, two = sum(raw[t] for t in ("paris", "12.5", "it", "unknown")), raw["x1y"] + raw["run"]
    found = {r["term"]: r["weight"] for r in G.weighted_terms(terms, entries).collect()}
    assert found == pytest.approx({t: w / (two if t in ("x1y", "run") else one) for t, w in raw.items()})


@pytest.mark.parametrize(("bits", "at_once"), [(28, 1 << 22), (28, 50), (11, 50)])
def test_only_frequent_ngrams_are_counted_by_their_words(spark, monkeypatch, bits, at_once):
    """Also where tasks send many blocks, and where the filter has so few bits that rare ones pass."""
    monkeypatch.setattr(K, "FILTER", bits)
    monkeypatch.setattr(K, "SORTED", at_once)
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["A", "b", "c", "é", f"w{draw.randrange(500)}"]) for _ in range(draw.randrange(40))) for _ in range(150)] + [None, "", "a", "a b", "x y z", "x y z x y z x", *["q r s"] * 4]
    wanted = Counter()
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        wanted.update(" ".join(w[i : i + 3]) for i in range(len(w) - 2))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    for more in (3, 12):
        frequent = {g: n for g, n in wanted.items() if n > more}
        assert {r["gram"]: r["n"] for r in K.frequent_ngrams(docs, 3, more).collect()} == frequent
    if bits == 28:
        assert K.passing(docs, 3, 3).count() == sum(n for n in wanted.values() if n > 3) < sum(wanted.values())
    assert K.frequent_ngrams(docs.limit(0), 3, 3).count() == 0
