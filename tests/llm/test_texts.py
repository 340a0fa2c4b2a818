"""Operators that look at one text at a time, against plain versions."""

import hashlib
import json
import math
import random
import re
import sysconfig
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import attention, bpe, flatwords, licenses, pagetext, rules, toxicity, transport

SCHEMA = "doc_id long, text string, lang string, score double, votes string"
ODD = [
    (1, "The first text, with words.\nAnd a line.", "en", 0.1, "a"),
    (2, None, None, None, None),
    (3, "", "en", 0.2, None),
    (4, " \t\n ", "en", 0.2, None),
    (None, "A text without an id.", "en", 0.3, "b"),
    (5, "same text", "fr", 0.3, "b"),
    (5, "same text", "fr", 0.3, "b"),
    (6, "é日本 x\x1cy z\x85", "xx", 0.0, ""),
    (7, "long " * 30000, "en", 0.0, ""),
    (8, "x" * 50000, "en", 0.0, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_of_a_column():
    texts = ["a b  c\n d", None, "", "x", "é\x0bü \x1c ", "  ", "w1 w2 w3", "q"] * 30
    column, found = pa.array(texts).slice(3), []
    for a, _, raw, at in flatwords.chunks(column, 40):
        w = flatwords.words(raw, at)
        found += [(a + t, raw[s:e].tobytes().decode()) for s, e, t in zip(w.start, w.end, w.text, strict=True)]
    assert found == [(i, x) for i, t in enumerate(column.to_pylist()) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def test_equal_words_have_equal_hashes_and_others_not():
    text = " ".join(f"w{i % 500}" for i in range(3000))
    raw = np.frombuffer(text.encode(), np.uint8)
    w = flatwords.words(raw, np.array([0, len(raw)]))
    assert len(set(w.hash.tolist())) == 500 and (w.hash[:500] == w.hash[500:1000]).all()


# --- byte pairs


def test_encodes_as_the_library():
    from tokenizers import Tokenizer

    tokenizer, codec = Tokenizer.from_file(bpe.vocabulary()), bpe.Codec(open(bpe.vocabulary()).read())
    texts = ["Hello  World's 123 é É ﬁ Σας\nfoo<|endoftext|> x!!", "İstanbul <|startoftext|>a", "", "a" * 3000, "ab" * 900, "\0<|endoftext|>", "\x85\xa0 ½² 日本語", "ǅ ẞ ŉ Ω"]
    draw = random.Random(1)
    texts += ["".join(chr(draw.choice([draw.randint(0, 127), draw.randint(0, 0x24F), draw.randint(0, 0xD7FF)])) for _ in range(draw.randint(0, 40))) for _ in range(800)]
    ids, decoded = codec.encode(texts)
    for text, own, back in zip(texts, ids, decoded, strict=True):
        wanted = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own, "<u4").tolist() == wanted and back == tokenizer.decode(wanted, skip_special_tokens=False)


def test_byte_pairs_of_odd_rows(odd, none):
    rows = bpe.digests(bpe.encode(odd, bpe.vocabulary())).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    assert len({r["ids_sha256"] for r in rows if r["doc_id"] == 5}) == 1
    assert bpe.encode(none, bpe.vocabulary()).count() == 0


# --- transport streams


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 150, 162, 163, 176, 177, 346, 4095, 4096, 4097, 8192, 100_000])
def test_stream_round_trip(n):
    text = random.Random(n).randbytes(n)
    stream = transport.read(transport.write(transport.payload_of(text)))
    assert stream.payload == transport.payload_of(text) and stream.breaks == 0 and all(stream.random_access)
    assert stream.stamps == [i * 4096 * 90_000 // 8000 for i in range(len(stream.stamps))]


def test_damage_is_seen():
    media = bytearray(transport.write(transport.payload_of(b"abc" * 2000)))
    assert transport.section_crc(b"123456789") == 0x0376E6E7
    lost = bytes(media[: 188 * 5] + media[188 * 6 :])
    with pytest.raises(ValueError):
        transport.read(lost)
    media[188 * 4 + 3] ^= 3
    assert transport.read(bytes(media)).breaks > 0
    media[0] = 0
    with pytest.raises(ValueError):
        transport.read(bytes(media))


def test_streams_of_odd_rows(odd, none):
    rows = transport.round_trip(odd).collect()
    for r, (_, text, *_) in zip(rows, ODD, strict=True):
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    stored = transport.store(odd).collect()
    assert [hashlib.sha256(r["media"]).hexdigest() for r in stored] == [r["media_sha256"] for r in rows]
    assert transport.round_trip(none).count() == 0


# --- quality rules


def plain_counts(text):
    words, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text or ""), set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
        seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_counts_match_a_plain_version(odd, spark):
    draw = random.Random(2)
    texts = ["\n".join(" ".join(draw.choice(["a", "b", "é#", "$c", "dd"]) for _ in range(draw.randint(0, 9))) for _ in range(draw.randint(0, 12))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in ODD], "doc_id long, text string")
    rows = rules.counted(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert [tuple(r) for r in rows] == [plain_counts(t) for t in texts + [r[1] for r in ODD]]


def test_rules_reject_junk_and_keep_clean_texts(spark, none):
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(900)]
    clean = [" ".join(draw.choice(words) for _ in range(120)) + "." for _ in range(150)]
    junk = [" ".join(draw.choice(words) + "###" for _ in range(120)) for _ in range(8)] + [" | ".join(draw.choice(words) for _ in range(120)) for _ in range(8)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(clean + junk + ["too short", None])], "doc_id long, text string, votes string")
    kept = {r["doc_id"] for r in rules.judge(docs).filter("kept").collect()}
    assert kept == set(range(150))
    passed = rules.keep_good(docs)
    assert passed.columns == docs.columns and {r["doc_id"] for r in passed.collect()} == kept
    assert rules.judge(none).count() == 0 and rules.keep_good(none).count() == 0


# --- licences


def test_licenses(spark, odd, none):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 200)
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore."),
        (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;")),
        (3, "released UNDER the mit licence!"),
        (4, "It was released under the MIT License, they say."),
        (5, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
        (6, None),
    ]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1]["licenses"], found[1]["whole_license"], found[1]["n_notices"]) == ("MIT", None, 1)
    assert found[2]["whole_license"] == "MIT" and found[3]["whole_license"] == "MIT"
    assert found[4]["licenses"] == "" and found[5]["n_notices"] == 2 and found[6]["n_notices"] == 0
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0
    own = spark.createDataFrame([("house", "Our house licence."), ("same", "our HOUSE license")], "license string, text string")
    assert licenses.scan(spark.createDataFrame([(1, "x\nOur house license")], "doc_id long, text string"), own, broadcast_rows=0).first()["licenses"] == "house"


#: As they are published, with their usual line breaks; typed apart from licenses.KNOWN.
MIT_FILE = """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC_FILE = """Copyright 2019 Jane Doe <jane@example.org>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""


def test_published_licenses_are_found_whole(spark):
    texts = [MIT_FILE, ISC_FILE, MIT_FILE.split("Jane Doe\n\n")[1], MIT_FILE.replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT"), MIT_FILE.replace("(c) 2021 Jane", "The Andrew")]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["whole_license"] for r in rows] == ["MIT", "ISC", "MIT", "MIT", "MIT"]


def test_lines_that_state_a_copyright():
    pattern = re.compile(re.sub(r"\[\^([a-z]*)\\P\{L\}\]", r"[^\1\\W\\d_]", licenses.COPYRIGHT_LINE).replace(r"[^\p{L}\p{N}\n]", r"[^\w\n]").replace(r"\p{N}", r"\d"))
    for line in ["copyright (c) 2020 someone", "# copyright 2020, acme", "© acme", "(c) 2020 acme", "copyright andrew", "copyright the regents", "copyright © acme", "copyright: acme"]:
        assert pattern.search(line), line
    for line in ["copyright notice and this permission notice appear", "copyright holders be liable", "copyright  holder", "copyright law.", "(c) you must retain all notices", "copyright"]:
        assert not pattern.search(line), line


def test_licenses_as_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    wanted = con.sql(f"SELECT doc_id, licenses, n_notices FROM ({licenses.ORACLE}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in licenses.op9_license_scan(spark, data).select("doc_id", "licenses", "n_notices").orderBy("doc_id").collect()] == wanted


def plain_estimate(patterns, counts, rounds=200):
    """Expectation-maximisation document by document, rule by rule."""
    k = len(rules.RULES)
    votes = [[int(x) // 3**j % 3 for j in range(k)] for x in patterns]
    prior, good, bad = 0.9, [list(rules.FROM_GOOD) for _ in range(k)], [list(rules.FROM_BAD) for _ in range(k)]
    for _ in range(rounds):
        p = []
        for v, n in zip(votes, counts, strict=True):
            g, b = prior, 1 - prior
            for j in range(k):
                g, b = g * good[j][v[j]], b * bad[j][v[j]]
            p.append(n * g / (g + b))
        total, of_good = sum(counts), sum(p)
        prior = min(max((of_good + 9) / (total + 10), 0.5), 0.99)
        for j in range(k):
            for x in range(3):
                good[j][x] = (sum(a for a, v in zip(p, votes, strict=True) if v[j] == x) + rules.FROM_GOOD[x]) / (of_good + 1)
                bad[j][x] = (sum(n - a for n, a, v in zip(counts, p, votes, strict=True) if v[j] == x) + rules.FROM_BAD[x]) / (total - of_good + 1)
            if good[j][0] > bad[j][0]:
                good[j][0] = bad[j][0] = (good[j][0] * of_good + bad[j][0] * (total - of_good)) / total
    return prior, good, bad


def test_estimates_match_a_plain_version_and_find_the_accuracies(spark):
    draw, k = np.random.default_rng(2), len(rules.RULES)
    n, is_good = 4000, np.random.default_rng(3).random(4000) < 0.8
    # Chances of bad, good and no vote: no rule is near the chances that the estimation starts from.
    of_good, of_bad = draw.dirichlet((1, 12, 6), k), draw.dirichlet((12, 2, 5), k)
    votes = np.array([[draw.choice(3, p=(of_good if g else of_bad)[j]) for j in range(k)] for g in is_good])
    patterns, counts = np.unique((votes * 3 ** np.arange(k)).sum(1), return_counts=True)
    found = rules.estimate(patterns, counts.astype(float))
    prior, good, bad = plain_estimate(patterns.tolist(), counts.tolist())
    assert found.prior == pytest.approx(prior) and np.allclose(found.if_good, good) and np.allclose(found.if_bad, bad)
    assert abs(found.prior - 0.8) < 0.03 and np.abs(np.array(found.if_good) - of_good).max() < 0.05 and np.abs(np.array(found.if_bad) - of_bad).max() < 0.08
    rows = spark.createDataFrame([(int(x),) for x in patterns], "votes long")
    odds = {int(x): prior / (1 - prior) * np.prod([good[j][x // 3**j % 3] / bad[j][x // 3**j % 3] for j in range(k)]) for x in patterns.tolist()}
    for r in rows.select("votes", rules.posterior(F.col("votes"), found).alias("p")).collect():
        assert r["p"] == pytest.approx(odds[r["votes"]] / (1 + odds[r["votes"]]), abs=1e-6)
    # The verdict is no rule that all must pass, nor one that only unanimous documents fail.
    right = np.array([(o >= 1) for o in (odds[int(x)] for x in (votes * 3 ** np.arange(k)).sum(1))]) == is_good
    assert right.mean() > 0.99 and ((votes[is_good] == 0).any(1)).mean() > 0.1


def test_genuine_licences(spark):
    """Licence files that are installed here, of other wraps, titles, holders and list marks than the known texts."""
    names = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    files = [(Path("/usr/share/common-licenses") / n, license) for n, license in names.items()]
    # Files that hold the terms of MIT or ISC and before them at most a title and copyright lines.
    ends = {"MIT": "or the use or other dealings in the software", "ISC": "in connection with the use or performance of this software"}
    begins = {"MIT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal", "ISC": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided"}
    words = {"MIT": 163, "ISC": 113}
    for path in sorted(Path(sysconfig.get_paths()["purelib"]).rglob("LICENSE*")):
        text = path.read_text(errors="replace") if path.is_file() else ""
        plain = " ".join(re.findall(r"[a-z0-9]+", text.lower()))
        for license, end in ends.items():
            at = plain.find(begins[license])
            before = [x for x in text[: text.lower().find("permission")].split("\n") if x.strip() and not re.match(r"(?i)\W*copyright|.*\blicense\b", x)]
            if at >= 0 and plain.endswith(end) and abs(len(plain[at:].split()) - words[license]) <= 1 and not before:
                files.append((path, license))
    rows = [(str(p), p.read_text(errors="replace")) for p, _ in files if p.is_file()]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = {r["doc_id"]: r["whole_license"] for r in licenses.scan(docs).collect()}
    assert len(rows) > 10 and found == {str(p): license for p, license in files if p.is_file()}


# --- pages

HEAD = "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>"


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        (HEAD + "<nav><a>Menu</a></nav><article><h1>Big &amp; bold</h1><p>One <b>two<br>three</p><p>four&nbsp; five</article><footer>F</footer>", "Big & bold\nOne two three\nfour five"),
        (HEAD + "<div class='page-sidebar'><article><p>Body</p></article></div><aside>A</aside>", "Body"),
        (HEAD + "<main><p>Main text</p><form><input>Send</form><div id=comments><p>First!</p></div></main>", "Main text"),
        (HEAD + "<article>a<!-- no --><div class='cookie-notice'>Cookies</div><p>b<p>c<ul><li>d<li>e</ul></article>", "a\nb\nc\nd\ne"),
        (HEAD + "<div><a href=x>Link one</a> <a>Link two</a></div><div><p>Plain words here.</p></div>", "Plain words here."),
        ("no markup at all", "no markup at all"),
        ("<p>1 &lt; 2 &#x41;&eacute;", "1 < 2 Aé"),
        ("", ""),
    ],
)
def test_main_text(page, wanted):
    assert pagetext.extract(page, None, frozenset()) == wanted


def test_constant_nodes_are_template(spark):
    def page(i):
        return f"<body><div class=top>Same on all pages</div><div class=b><p>Text {i} of its own.</p></div><div class=end>Bye bye</div></body>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)] + [(20, "http://small.example/", page(20)), (21, None, page(21)), (22, "http://h.example/n", None), (23, "http://h.example/e", "")]
    found = {r["page_id"]: r["text"] for r in pagetext.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "Text 3 of its own." and found[20] == "Same on all pages\nText 20 of its own.\nBye bye"
    assert found[21].startswith("Same") and found[22] == found[23] == ""
    copies = [(i, "http://c.example/x", "<article><p>A copy.</p></article>") for i in range(9)]
    assert {r["text"] for r in pagetext.texts(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()} == {"A copy."}
    assert pagetext.texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_texts_beside_others_and_on_pages_unlike_the_first(spark):
    """Constant texts among varying siblings, and a block that the first pages lack or word otherwise."""

    def page(i):
        top = "<section>Only here</section>" if i == 1 else "<section>Now in its other wording</section>"
        extra = "<table><tr><td>Subscribe today</td></tr></table>" if i > 3 else ""
        return f"<body>{top}<div>Menu of all</div><div><p>Words {i} alone.</p><p>Share this text.</p></div><div>Footer of all</div>{extra}</body>"

    rows = [(0, "http://h.example/0", "")] + [(i, f"http://h.example/{i}", page(i)) for i in range(1, 40)]
    found = {r["page_id"]: r["text"] for r in pagetext.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[0] == "" and found[1] == "Only here\nWords 1 alone."
    assert all(found[i] == f"Words {i} alone." for i in range(2, 40))
    wrapper = json.loads(pagetext.skeleton("<p>x</p>"))
    assert all(n >= pagetext.PATHS for n, g in pagetext.numbered(wrapper, pagetext.parse("<table><tr><td>y")) if g.kind[0] != "#")


def test_copies_of_an_odd_page_are_no_template(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><p>Words {i}.</p></body>") for i in range(30)]
    rows += [(100 + i, "http://h.example/x", f"<body><p>Copy {i}.</p><pre>Quoted</pre></body>") for i in range(6)]
    found = {r["page_id"]: r["text"] for r in pagetext.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[103] == "Copy 3.\nQuoted"


def test_tree_matching_is_largest():
    import json

    a, b = "<ul><li>1</li></ul><p>x</p><div></div>", "<p>x</p><ul><li>2</li></ul><p>y</p><div></div>"
    size, pairs = pagetext.matched(json.loads(pagetext.skeleton(a)), pagetext.grouped(pagetext.parse(b)))
    assert size == len(pairs) == 5


def plain_size(a, b):
    """Size of a largest matching of [kind, children, number] and a group, by the textbook's table."""
    if tuple(a[0]) != b.kind:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_size(x, y))
    return best[-1][-1] + 1


def random_tree(draw, depth):
    tags = ["div", "ul", "section", "table", "h2"]
    return "".join(f"<{t}>{random_tree(draw, depth - 1) if depth else 'x'}</{t}>" for t in (draw.choice(tags) for _ in range(draw.randint(0, 5))))


def test_tree_matching_matches_a_plain_version():
    draw = random.Random(3)
    for _ in range(150):
        a, b = json.loads(pagetext.skeleton(random_tree(draw, 3))), pagetext.grouped(pagetext.parse(random_tree(draw, 3)))
        size, pairs = pagetext.matched(a, b)
        assert size == len(pairs) == plain_size(a, b)


def test_long_and_broken_pages_take_time_in_proportion():
    parts = "".join(f"<h2>t{i}</h2><p>text {i} <b>x</b></p>" for i in range(20_000))
    page, started = f"<body><div>{parts}</div></body>", time.monotonic()
    text = pagetext.extract(page.replace("<h2>t7<", "<h3>u</h3><h2>t7<"), json.loads(pagetext.skeleton(page)), frozenset([1]))
    assert text.count("\n") == 40_000 and len(page) > 700_000
    for broken in ('<a "', "<a 'x", "<!", "<script ", '<p class="a', "<p ="):
        assert pagetext.extract("<body>hello " + broken * 100_000, None, frozenset()) == "hello"
    assert time.monotonic() - started < 30


@pytest.mark.parametrize(
    "page, wanted",
    [
        ('<div class="article-header"><h1>Title</h1></div><p>Text.</p>', "Title\nText."),
        ('<p class="social-science">Study.</p><p class="ad-slot">Buy</p><div class="cookie-banner">Ok</div><ul class="comment-list"><li>Hm</ul>', "Study."),
        ('<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.</p>', "Energy E=m here."),
        ('<p class="a"">Stray quote</p><p>Next</p>', "Stray quote\nNext"),
    ],
)
def test_names_and_marks(page, wanted):
    assert pagetext.extract(page, None, frozenset()) == wanted


def test_pages_with_clashing_columns_and_repeats(spark):
    rows = [(1, "http://a/1", "<p>One</p>", "h"), (1, "http://a/1", "<p>One</p>", "h"), (None, None, None, None), (2, "", "", "x"), (3, "http://a/2", "<p>" + "w " * 200_000 + "</p>", "s")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = [(r["page_id"], len(r["text"])) for r in pagetext.texts(docs).collect()]
    assert sorted(found, key=str) == sorted([(1, 3), (1, 3), (None, 0), (2, 0), (3, 399_999)], key=str)


# --- classifiers


def test_attention_learns_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = attention.op1_quality_attention(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    right = sum((r["predicted"] == r["quality"]) for r in rows)
    assert docs.count() == 1000 and right / len(rows) > 0.9


def test_attention_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (8, None), (None, 1)], "doc_id long, quality int")
    model = attention.learn(odd, labels)
    rows = attention.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1 and attention.score(none, model).count() == 0
    nothing = attention.learn(odd, labels.filter("false"))
    assert {r["score"] for r in attention.score(odd, nothing).collect()} == {0.5}


def plain_score(p, bag):
    """Gated attention of one bag, passage by passage."""
    hidden = [[math.tanh(sum(x * p["W"][i][j] for i, x in enumerate(row)) + p["b"][j]) for j in range(len(p["b"]))] for row in bag]
    gates = []
    for h in hidden:
        inner = lambda m, k: sum(v * m[j][k] for j, v in enumerate(h))  # noqa: B023, E731
        gates.append(sum(p["w"][k] * math.tanh(inner(p["V"], k)) / (1 + math.exp(-inner(p["U"], k))) for k in range(len(p["w"]))))
    share = [math.exp(g) / sum(map(math.exp, gates)) for g in gates]
    z = [sum(a * h[j] for a, h in zip(share, hidden, strict=True)) for j in range(len(p["b"]))]
    return 1 / (1 + math.exp(-(sum(c * v for c, v in zip(p["c"], z, strict=True)) + p["d"][0])))


def test_attention_as_plain_loops():
    draw = np.random.default_rng(3)
    shape = {"W": (5, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": (1,)}
    for _ in range(20):
        p = {k: draw.normal(0, 1, s) for k, s in shape.items()}
        bags = draw.integers(1, 7, 6)
        x = draw.normal(0, 1, (bags.sum(), 5))
        found = attention.forward(p, x, bags)["score"]
        parts = np.split(x, np.cumsum(bags)[:-1])
        assert found == pytest.approx([plain_score(p, part) for part in parts])


def test_steps_go_down_the_slopes_that_differences_show(monkeypatch):
    """Adam's first step moves every weight by RATE against its slope: held against finite differences of the penalised loss."""
    draw = np.random.default_rng(5)
    bags = draw.integers(1, 5, 30)
    x = draw.normal(0, 1, (bags.sum(), 6))
    x[:, 0] = 1
    y = np.r_[0.0, 1.0, draw.integers(0, 2, 28)]
    weight = draw.uniform(0.5, 2, 30)

    def after(steps):
        monkeypatch.setattr(attention, "EPOCHS", steps)
        return attention.fit(x, bags, y, weight)

    model, moved = after(0), after(1).weights
    p, rows = model.weights, (x - model.mean) / model.scale

    def loss(q):
        s = attention.forward(q, rows, bags)["score"]
        own = -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()
        return own + sum(attention.DECAY / len(q) * (v**2).sum() / 2 for k, v in q.items() if k not in "bd")

    seen = 0
    for k, v in p.items():
        for at in np.ndindex(v.shape):
            slope = 0.0
            for h in (1e-5, -1e-5):
                q = {n: u.copy() for n, u in p.items()}
                q[k][at] += h
                slope += loss(q) / (2 * h)
            if abs(slope) > 1e-6:
                seen += 1
                assert moved[k][at] - v[at] == pytest.approx(-attention.RATE * np.sign(slope), rel=0.02), (k, at)
    assert seen > 300


def test_bags_are_bounded_and_whole():
    text = " ".join(f"w{i}" for i in range(10_000))
    raw = np.frombuffer(text.encode(), np.uint8)
    x, bags = attention.encode(raw, np.array([0, len(raw)]))
    assert bags[0] <= attention.MOST_PASSAGES and round(float(np.expm1(x[:, 1]).sum())) == 10_000


def plain_kernel(a, b):
    def weights(word):
        letters, _ = toxicity.spelled([word])
        out = {}
        for i in range(len(letters)):
            for j in range(i + 1, len(letters)):
                for k in range(j + 1, len(letters)):
                    if k - i < toxicity.SPAN:
                        key = (letters[i], letters[j], letters[k])
                        out[key] = out.get(key, 0) + toxicity.GAP ** (k - i - 2)
        return out, len(letters)

    (x, n), (y, m) = weights(a), weights(b)
    return (sum(v * y.get(k, 0) for k, v in x.items()) / np.prod(toxicity.norms(np.array([n, m])))) ** toxicity.POWER


def test_kernel_matches_a_plain_version():
    marks, words = ["idiot", "réeuxment", "aaa"], ["idiot", "id-iot", "idxiot", "ment", "a", "!!", "aaaa", "éé"]
    found = toxicity.Landmarks.of(marks).kernel(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert found[i, j] == pytest.approx(plain_kernel(w, m))
    assert found[1, 0] == pytest.approx(found[0, 0]) and 0 < found[2, 0] < found[0, 0]


def test_toxic_texts_are_caught(spark, odd, none):
    draw = random.Random(5)
    words = ["".join(draw.choice("lmnoprstuvae") for _ in range(draw.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1200):
        text, toxic = [draw.choice(words) for _ in range(40)], i % 4 == 0
        if toxic:
            for insult in draw.sample(["bigjerk", "dumbface", "foulwit"], 2):
                text[draw.randrange(40)] = insult
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.learn(docs, marks)
    trials = ["bigjerk", "big-jerk", "bigjerkk", "b i g j e r k", "harmless"]
    tried = spark.createDataFrame([(i, " ".join(words[:30] + [w, w.upper() + "!"])) for i, w in enumerate(trials)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(tried, machine).collect()}
    assert scores[0] > 0.7 and scores[1] > 0.7 and scores[3] > 0.7 and scores[4] < 0.3 and scores[2] > scores[4]
    assert len(toxicity.score(odd, machine).collect()) == len(ODD) and toxicity.score(none, machine).count() == 0
    assert toxicity.score(odd, toxicity.learn(odd, marks.filter("false"))).filter("score != 0").count() == 0


def test_long_words_match_the_library():
    draw = random.Random(5)
    with open(bpe.vocabulary(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    library, started = Tokenizer.from_file(bpe.vocabulary()), time.monotonic()
    for n, letters in ((513, "ab"), (600, "é日a"), (5_000, "a"), (20_000, "abcde"), (300_000, "abcdefghijklmnopqrstuvwxyz")):
        word = "".join(draw.choice(letters) for _ in range(n))
        text = f"some {word} words {word[:700]}"
        ids, decoded = codec.encode([text])
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids[0], "<u4").tolist() == wanted and decoded[0] == library.decode(wanted, skip_special_tokens=False)
    assert time.monotonic() - started < 20


def test_a_batch_of_texts_takes_little_memory_to_encode():
    import tracemalloc

    codec = bpe._codec(open(bpe.vocabulary(), encoding="utf-8").read())
    texts = [" ".join(f"w{(i * 37 + j) % 500}" for j in range(2000)) for i in range(400)]
    codec.encode(texts[:3])
    tracemalloc.start()
    n = sum(len(codec.encode(texts[a:b])[0]) for a, b in bpe.groups([len(t) for t in texts], bpe.BATCH_CHARS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400 and peak < 30_000_000
