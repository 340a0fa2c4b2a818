"""Operators over a whole corpus, against plain versions, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from spindrift.llm import components, flatwords, linejoin, mixing, nearcopies
from tests.llm.test_texts import ODD, SCHEMA


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- mixing


def test_mix_as_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    columns = "doc_id, size, source_size, taken, target"
    wanted = con.sql(f"SELECT {columns} FROM ({mixing.ORACLE}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in mixing.op4_mix_sources(spark, data).selectExpr(*columns.split(", ")).orderBy("doc_id").collect()] == wanted


@pytest.fixture(scope="module")
def sources(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(["w"] * draw.randint(0, 60)), None if i % 10 == 0 else f"s{i % 7 if i % 3 else 0}", i) for i in range(1500)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id here", "s1", 0), (5000, None, "s2", 0)], "doc_id long, text string, source string, target long").repartition(3)


def test_targets_are_met(sources):
    rows = mixing.copies(mixing.sized(sources)).collect()
    taken, targets, sizes = defaultdict(int), {}, {}
    for r in rows:
        assert 0 <= r["n_copies"] <= 2
        taken[r["source"]] += r["size"] * r["n_copies"]
        targets[r["source"]], sizes[r["source"]] = r["target"], r["source_size"]
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - t) <= 60 and t <= 2 * sizes[s] for s, t in targets.items())
    # Sources below twice their size share by weight 3, 1, 2 in order, null last.
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    free = {round(t / weights[s], 6) for s, t in targets.items() if t < 2 * sizes[s]}
    assert len(free) == 1


def test_mix_repeats_rows(sources):
    out = mixing.mix(sources)
    wanted = mixing.copies(mixing.sized(sources)).selectExpr("sum(n_copies) AS n").first()["n"]
    assert out.columns == sources.columns and out.count() == wanted
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(sources.repartition(5)).collect()))


def test_mix_of_odd_rows(odd, none):
    docs = odd.withColumnRenamed("lang", "source")
    assert mixing.copies(mixing.sized(docs)).count() == len(ODD) and mixing.mix(docs).filter("text IS NULL OR trim(text) = ''").count() == 0
    empty = none.withColumnRenamed("lang", "source")
    assert mixing.copies(mixing.sized(empty)).count() == 0 and mixing.mix(empty).count() == 0


# --- lines


def variants(draw, words, n):
    """Lines, many of them changed copies of a few."""
    base = [[draw.choice(words) for _ in range(draw.randint(1, 30))] for _ in range(12)]
    out = []
    for _ in range(n):
        line = list(draw.choice(base)) if draw.random() < 0.7 else [draw.choice(words) for _ in range(draw.randint(1, 30))]
        for _ in range(draw.choice([0, 0, 1, 2, 4])):
            line[draw.randrange(len(line))] = draw.choice(words)
        out.append(" ".join(line))
    return out


def test_lines_match_a_plain_version(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["The", "THE", "the", "é"]
    rows = [(i, "\n".join(variants(draw, words, draw.randint(0, 9)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n \n"), (None, rows[0][1]), rows[5]]
    lower, first, lines = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), {}, []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(x for x in re.split(r"[\x20\x09-\x0D]+", line.translate(lower)) if x)
            if s:
                lines.append((i, k, s))
                first.setdefault(s, (i is None, i or 0, k))
    wanted = defaultdict(list)
    for i, k, s in lines:
        here = (i is None, i or 0, k)
        if first[s] != here or any(first[x] < here and 9 * len(s & x) >= 4 * (len(s) + len(x)) for x in first if x != s):
            wanted[i].append(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["removed"] for r in linejoin.decisions(docs).collect()}
    assert {i: r for i, r in found.items() if r} == dict(wanted)


def plain_lines(rows):
    """n_links, class id and removed lines of each id, by comparing all lines."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(x for x in re.split(r"[\x20\x09-\x0D]+", line.translate(lower)) if x)
            if s:
                lines.append((i, k, s))
    n_links, removed, parent = defaultdict(int), defaultdict(list), {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, k, s) in enumerate(lines):
        late = False
        for b, (j, _, x) in enumerate(lines):
            if 9 * len(s & x) >= 4 * (len(s) + len(x)):
                n_links[i] += s != x
                late |= b < a
                parent[root(i)] = root(j)
        if late:
            removed[i].append(k)
    groups = defaultdict(list)
    for i in parent:
        groups[root(i)].append(i)
    classes = {i: min((x for x in g if x is not None), default=None) for g in groups.values() for i in g}
    return n_links, classes, removed


def line_rows(seed, n=100):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["The", "THE", "the", "é"]
    rows = [(i, "\n".join(variants(draw, words, draw.randint(0, 3)))) for i in range(n)]
    line = [f"v{i}" for i in range(20)]
    rows += [(300 + i, " ".join(line[:i] + line[i + 1 :])) for i in range(6)] + [(400, " ".join(line)), (401, "no other line"), (402, None), (403, ""), (404, "\n \n"), (None, " ".join(line)), rows[5]]
    return rows


def held_against_plain(docs, rows):
    n_links, classes, removed = plain_lines(rows)
    found = linejoin.report(docs).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["n_links"] for r in found} == {i: n_links[i] for i, _ in rows}
    assert {r["doc_id"]: r["class_id"] for r in found} == classes
    assert {r["doc_id"]: r["removed"] for r in found if r["n_removed"]} == removed
    assert all(len(r["earlier"]) == len(r["removed"]) for r in found)
    assert all(x is None or r["doc_id"] is None or x <= r["doc_id"] for r in found for x in r["earlier"])
    return n_links


def test_all_links_of_lines_are_counted(spark):
    rows = line_rows(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n_links = held_against_plain(docs, rows)
    assert n_links[300] == 7 and n_links[400] == 6
    removed = {r["doc_id"]: r["removed"] for r in linejoin.decisions(docs).collect()}
    assert removed == plain_lines(rows)[2]


def test_blocks_of_hot_words_and_large_clusters_lose_no_link(spark, monkeypatch):
    for name, value in (("HOT", 5), ("SORTED", 64), ("BLOCK", 3), ("LARGEST", 7), ("SPAN", 50), ("BROADCAST_ROWS", 3)):
        monkeypatch.setattr(linejoin, name, value)
    rows = line_rows(8, 60)
    held_against_plain(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_pairs_that_maps_cannot_tell_apart_are_listed(spark, monkeypatch):
    monkeypatch.setattr(linejoin, "REACH", 0.02)
    monkeypatch.setattr(linejoin, "MOST", 128)
    rows = line_rows(9, 60)
    held_against_plain(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_query_of_lines(spark, tmp_path):
    """The query itself, with null ids and columns whose names clash."""
    rows = line_rows(10, 40)
    names = "doc_id long, text string, r long, g string, raw int, w string, gone string, line string, id long, `a.b` string"
    wide = [(i, t, 1, "x", 2, "y", "z", "l", 3, "d") for i, t in rows]
    spark.createDataFrame(wide, names).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["n_links"] for r in linejoin.op2_line_dedup(spark, str(tmp_path)).collect()}
    n_links = plain_lines(rows)[0]
    assert found == {i: n_links[i] for i, _ in rows}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = linejoin.remove(docs)
    assert out.columns == docs.columns and out.count() == len(rows) and {r["a.b"] for r in out.collect()} == {"d"}


def test_very_long_lines_keep_their_link(spark):
    """Two lines of 360,000 words, of a similarity of exactly 0.8, and one a word short of it."""
    both = [f"w{i}" for i in range(320_000)]
    own = [[f"{c}{i}" for i in range(40_000)] for c in "ab"]
    rows = [(1, " ".join(both + own[0])), (2, " ".join(both + own[1])), (3, " ".join(both[1:] + ["x"] + [f"c{i}" for i in range(40_000)]))]
    found = {r["doc_id"]: r["n_links"] for r in linejoin.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 0}


def test_removing_lines(spark, odd, none):
    rows = [(1, "Keep this line of text.\n\nAlso this one here.", 40, "x"), (2, "keep THIS line of text.\nNew words only.\n", 40, "x"), (3, None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, raw string")
    out = {r["doc_id"]: r for r in linejoin.remove(docs).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "New words only.\n" and out[2]["n_chars"] == 16 and out[3]["text"] is None
    assert linejoin.remove(odd).columns == odd.columns and linejoin.remove(odd).count() == len(ODD) and linejoin.remove(none).count() == 0


# --- near copies


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (102, 103), (7, 7)]
    found = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in range(1, 41)} == {0} and {found[i] for i in (101, 102, 103)} == {100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_take_no_round_once_edges_are_stars(spark, monkeypatch):
    kept, made = components.checkpoint, []
    monkeypatch.setattr(components, "checkpoint", lambda df: made.append(1) or kept(df))
    found = components.components(spark.createDataFrame([(i, i % 3) for i in range(50)], "u long, v long")).collect()
    assert {r["u"]: r["v"] for r in found} == {i: i % 3 for i in range(50)} and len(found) == 50
    assert len(made) == 1


def test_words_and_lines_as_python_splits_them():
    draw = random.Random(9)
    texts = ["", "\n", "a\n\nb", "\na b\n", "c"] + ["".join(draw.choice("ab\n \t\x0b\x1c\u00e9\x7f") for _ in range(draw.randrange(30))) for _ in range(200)]
    raw, wanted, line = "".join(texts).encode(), [], 0
    for t in texts:
        for part in t.split("\n"):
            wanted += [(w, line) for w in re.findall(r"[^\x20\x09-\x0D]+", part)]
            line += 1
    at = np.cumsum([0] + [len(t.encode()) for t in texts])
    w = flatwords.words(np.frombuffer(raw, np.uint8), at)
    lines, first = w.line()
    assert [(raw[a:b].decode(), i) for a, b, i in zip(w.start, w.end, lines)] == wanted
    assert first.tolist() == np.cumsum([0] + [t.count("\n") + 1 for t in texts])[:-1].tolist()
    assert len({h for h in w.hash.tolist()}) == len({t for t, _ in wanted})


def edited(draw, text, share):
    return " ".join(f"e{draw.randrange(10**6)}" if draw.random() < share else w for w in text.split())


@pytest.mark.parametrize("strength", [0.25, 1.0])
def test_near_copies_match_a_plain_version(spark, strength):
    draw = random.Random(6)
    base = [" ".join(f"w{draw.randrange(3000)}" for _ in range(draw.randint(3, 200))) for _ in range(40)]
    texts = base + [edited(draw, draw.choice(base), draw.choice([0, 0.005, 0.01, 0.03, 0.1])) for _ in range(150)] + [edited(draw, base[0], 0.004) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, ""), (903, "one two"), (904, "ONE two"), (None, base[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folded = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def bag(text):
        words = [w.translate(folded) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()

    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))
    df = Counter(s for b in bags for s in b)
    # So small a corpus lists all shingles.
    idf = {s: 1 + strength * np.log(len(rows) / n) / np.log(len(rows)) for s, n in df.items()}

    def similarity(a, b):
        both = sum(min(a[s], b[s]) * idf[s] for s in a.keys() & b.keys())
        return both / (sum(n * idf[s] for s, n in a.items()) + sum(n * idf[s] for s, n in b.items()) - both)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1] or "", rows[j][1] or ""
            if a == b or (bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8):
                parent[root(i)] = root(j)
    groups = defaultdict(set)
    for i in range(len(rows)):
        groups[root(i)].add(rows[i][0])
    wanted = {i: min(x for x in g if x is not None) for g in groups.values() for i in g}
    assert {r["doc_id"]: r["class_id"] for r in nearcopies.near_copies(docs, strength).collect()} == wanted
    if strength != nearcopies.STRENGTH:
        return
    kept = nearcopies.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(wanted.values())


def test_counts_beyond_16_bits_are_exact(spark):
    """One shingle 100,000 times in both texts, and 10,000 others in each."""
    run = "again " * 100_000
    texts = [run + " ".join(f"{c}{i}" for i in range(10_000)) for c in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = nearcopies.bags(docs, docs.select(nearcopies._node(docs))).collect()
    flat = nearcopies.Frequencies(np.zeros(0, np.uint64), np.zeros(0), 1.0, np.zeros(nearcopies.BUCKETS, bool))
    assert nearcopies.similarity(held[0]["shingles"], held[0]["counts"], held[1]["shingles"], held[1]["counts"], flat) == pytest.approx(100_000 / 120_000, abs=0.001)


def test_near_copies_of_odd_rows(odd, none):
    rows = nearcopies.near_copies(odd).collect()
    assert len(rows) == len(ODD) and {r["class_size"] for r in rows if r["doc_id"] == 5} == {2}
    assert {r["class_id"] for r in rows if r["doc_id"] in (2, 3)} == {2} and nearcopies.near_copies(none).count() == 0
    assert nearcopies.keep_first(odd).count() == 8 and nearcopies.keep_first(none).columns == none.columns


def test_frequencies_weigh_common_shingles_less(spark, monkeypatch):
    """Exact above the bound, as the rarest listed below it."""
    rows = [(i, "all of these five words " + (" and half of the texts" if i % 2 else "") + f" own{i} a b c d") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda idf, text: float(idf.of(nearcopies._bags(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[1])[0])
    idf = nearcopies.frequencies(docs)
    assert of(idf, "all of these five words") == 1 and of(idf, "and half of the texts") == pytest.approx(1 + nearcopies.STRENGTH * np.log(2) / np.log(64))
    assert of(idf, "own7 a b c d") == 1 + nearcopies.STRENGTH
    monkeypatch.setattr(nearcopies, "LISTED", 64)
    idf = nearcopies.frequencies(docs)
    assert len(idf.shingle) <= 64 and of(idf, "all of these five words") == 1 and 1 < of(idf, "and half of the texts") < of(idf, "own7 a b c d") == 1 + nearcopies.STRENGTH


def test_no_more_shingles_are_listed_than_the_bound(spark, monkeypatch):
    """19 shingles of one document each: with a bound of 10, those of a single document are too many."""
    docs = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(23)))], "doc_id long, text string")
    assert len(nearcopies.frequencies(docs).shingle) == 19
    monkeypatch.setattr(nearcopies, "LISTED", 10)
    assert len(nearcopies.frequencies(docs).shingle) == 0


def test_rows_with_clashing_names(spark):
    """Columns of the names that operators use themselves."""
    names = ["_i", "_n", "_node", "_size", "_k", "_copy", "_raw", "_gone", "r", "tie", "size", "first", "own", "node", "id", "n_copies", "target"]
    rows = [(i, f"some words of text number {i} and more\nsame line in all of these", "s", *range(len(names))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for out in (linejoin.remove(docs), nearcopies.keep_first(docs), mixing.mix(docs)):
        found = out.collect()
        assert out.columns == docs.columns and found and all(tuple(r)[3:] == tuple(range(len(names))) for r in found)


def test_samples_agree_as_often_as_weights_are_similar():
    sample, draw = nearcopies.Sampler(), np.random.default_rng(0)
    shingle = np.sort(draw.choice(2**52, 400, replace=False).astype(np.uint64))
    x, y = draw.uniform(1, 3, 400), draw.uniform(1, 3, 400)
    y[:300] = x[:300]
    wanted = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    text = np.repeat([0, 1], 400)
    agree = []
    for i in range(60):
        moved = (shingle + np.uint64(i * 977)) % np.uint64(2**52)
        _, keys = sample(text, np.r_[moved, moved], np.r_[x, y])
        agree.append((keys[0] == keys[1]).mean())
    assert np.mean(agree) == pytest.approx(wanted**nearcopies.ROWS, abs=0.06)


# --- the pipeline


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, counts = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[0] == counts[1] > counts[2]
    wanted = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == wanted


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, data, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, copies and clashing columns, through all stages."""
    import corpus_pipeline

    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()]
    good_ids = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1").collect()}
    clean = [r for r in docs if r[0] in good_ids and len((r[1] or "").split()) > 60][:30]
    long = "\n".join(t for _, t, _ in docs if t) + "\n" + " ".join(f"word{i % 977} is number {i}." for i in range(60_000))
    draw = random.Random(4)
    near = [(9000 + i, edited(draw, t, 0.002), s) for i, (_, t, s) in enumerate(clean[:5])]
    rows = docs + near + [(9100 + i, t, s) for i, (_, t, s) in enumerate(clean[5:10])] + [clean[10]] * 3
    rows += [(None, None, None), (9200, None, "src1"), (9201, "", None), (9202, " \t\n", "src1"), (9203, long, "src1"), (9203, long, "src1"), (None, clean[11][1] + " and more", None)]
    df = spark.createDataFrame([(*r, 1, 2, 3, None) for r in rows], "doc_id long, text string, source string, size int, node int, r int, target double")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    stage, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = spark.createDataFrame(function(spark, stage, str(tmp_path)).collect(), df.schema)
        kept.append(Counter((r["doc_id"], r["text"]) for r in stage.collect()))
        assert stage.filter("size = 1 AND node = 2 AND r = 3 AND target IS NULL").count() == sum(kept[-1].values())
    ids = [{i for i, _ in k} for k in kept]
    good, lines, groups, mix = kept
    assert not {9200, 9201, 9202} & ids[0] and {i for i, *_ in clean} <= ids[0]
    # Whole rows are judged alike, and lines go without rows.
    assert good[tuple(clean[10][:2])] == 4 and sum(good.values()) == sum(lines.values())
    assert all(len(t or "") <= max((len(u or "") for i, u in good if i == j), default=0) for j, t in lines)
    texts = [t for _, t in groups.elements()]
    assert len(texts) == len(set(texts)) and set(groups) <= set(lines) and set(mix) <= set(groups)
    # Every text that went has one like it that stayed.
    folded = {t: Counter(" ".join(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(len(w) - 4, 1))) for _, t in lines}
    stayed = set(texts)
    for _, t in set(lines) - set(groups):
        best = max((sum((folded[t] & folded[u]).values()) / max(1, sum((folded[t] | folded[u]).values())) for u in stayed if abs(len(u or "") - len(t or "")) < 0.3 * len(t or "x") + 1), default=0)
        assert t in stayed or best > 0.7
    # Copies are rows of their own in the mix; each is encoded.
    found = Counter((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert Counter(i for i, _ in found.elements()) == Counter(i for i, _ in mix.elements())


def test_pairs_of_one_large_group_take_little_memory():
    import tracemalloc

    n = 3000
    rows = linejoin.Rows(np.zeros(n, np.int64), np.full(n, 20, np.int64), np.zeros(n, np.int64))
    tracemalloc.start()
    found = sum(len(x) for x, _ in linejoin.met(rows))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n * (n - 1) // 2
    assert most < 30e6
