"""Reply trees, spelling variants and whitening against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import replies, spellings, whitening
from tests.llm.test_texts import ODD, SCHEMA

# --- reply trees

NODES = "tree int, node int, parent int, role string, text string, score double, place string, leaf int"
TEXTS = ["</s>[INST] ok [/INST]", "a", "", None, "<\\s>", "<<s>><</SYS>", "\\[INST]\\", "[\\\\/ROLE][TEXT]", "é日\n\nx" * 50, "<", "[", "[ROLE]user[TEXT]"]


def trees(draw, n):
    """Nodes of several trees with missing parents, circles, repeated ids and nulls."""
    rows = []
    for t in [None, *range(5)]:
        for i in range(n):
            parent = draw.choice([None, draw.randrange(n), *([i - 1] * 6 if i else [None])])
            if draw.random() < 0.05:
                parent = n + 7
            rows.append((t, i if draw.random() < 0.97 else draw.choice([None, i // 2]), parent, draw.choice(["user", "assistant", "system", "tool", "[TEXT]", None]), draw.choice(TEXTS), draw.choice([None, 0.0, 1.0, 2.5]), "x", 1))
    return [*rows, rows[3], (9, 1, 2, "user", "circle", 1.0, "", 0), (9, 2, 1, "user", "circle", 1.0, "", 0), (9, 3, 1, "user", "below", 1.0, "", 0)]


def plain_branches(rows):
    """Of each tree the branches by falling mean score: (score, leaf, ids), and the turn of each node."""
    links, turns, out = {}, {}, {}
    order = lambda v: (v is not None, v or 0)
    for t, i, parent, role, text, score, *_ in rows:
        link, turn = (order(parent), score or 0.0, parent), (role or "", text or "")
        links[t, i] = min(links.get((t, i), link), link)
        turns[t, i] = min(turns.get((t, i), turn), turn)
    up = {k: (k[0], v[2]) if v[2] is not None and (k[0], v[2]) in links else None for k, v in links.items()}
    inner = {p for p in up.values() if p} | {(t, v[2]) for (t, _), v in links.items() if v[2] is not None}
    for key in links:
        path, at = [], key
        while at and at not in path:
            path.append(at)
            at = up[at]
        if at or key in inner:
            continue
        path.reverse()
        out.setdefault(key[0], []).append((sum(links[k][1] for k in path) / len(path), key[1], [k[1] for k in path]))
    for found in out.values():
        found.sort(key=lambda b: (-round(b[0], 9), b[1] is None, b[1] or 0))
    return out, turns


@pytest.mark.parametrize("n,keep", [(12, 1), (40, 3)])
def test_branches_as_a_plain_version(spark, n, keep):
    rows = trees(random.Random(n), n)
    wanted, turns = plain_branches(rows)
    nodes = spark.createDataFrame(rows, NODES).repartition(3)
    found = defaultdict(list)
    for r in replies.paths(nodes, keep).collect():
        found[r["tree"], r["rank"]].append((r["place"], r["node"], r["leaf"], r["score"]))
    assert set(found) == {(t, k + 1) for t, b in wanted.items() for k in range(min(keep, len(b)))}
    for (t, k), path in found.items():
        score, leaf, ids = wanted[t][k - 1]
        assert sorted(path) == [(p, i, leaf, pytest.approx(score)) for p, i in enumerate(ids)] if None not in ids else len(path) == len(ids)
    out = replies.conversations(nodes, keep).withColumns({"turns": replies.read_back(F.col("text")), "said": replies.under_mask(F.col("text"), F.col("loss"))}).collect()
    assert len(out) == len(found)
    for r in out:
        ids = wanted[r["tree"]][r["rank"] - 1][2]
        said = [turns[r["tree"], i] for i in ids]
        assert [tuple(t) for t in r["turns"]] == said
        assert r["said"] == "".join(text for role, text in said if role == "assistant")


def test_long_paths_and_no_rows(spark):
    nodes = spark.range(700).selectExpr("1 AS tree", "id AS node", "IF(id > 0, id - 1, NULL) AS parent", "'user' AS role", "CAST(id AS STRING) AS text", "0D AS score")
    rows = replies.paths(nodes).orderBy("place").collect()
    assert [(r["place"], r["node"], r["leaf"]) for r in rows] == [(i, i, 699) for i in range(700)]
    assert replies.conversations(nodes.limit(0)).count() == 0


def test_marks_in_texts_come_back(spark):
    draw = random.Random(2)
    parts = [*replies.CONTROLS, "<", "[", "\\", ">", "]", "s>", "/", "INST]", " ", "é"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 9))) for _ in range(3000)] + ["<" + "\\" * 5000 + "s>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", replies.escaped(F.col("t"))).withColumn("back", replies.unescaped(F.col("e"))).collect()
    for r in rows:
        assert r["back"] == r["t"] and not any(m in r["e"] for m in replies.CONTROLS)


def test_conversations_as_sql(spark, data, tmp_path):
    odd = [(1, 0, "user", TEXTS[5], 1), (1, 1, "assistant", TEXTS[0], 1), (1, 1, "assistant", TEXTS[0], 1), (1, 2, "to[ROLE]ol", TEXTS[7], 1), (1, 3, None, None, 1), (None, 0, "user", "q", 1), (None, None, "assistant", "", 1), (2, 6, "assistant", "a\nb" * 9000, 1), (2, 5, "", "[ROLE", 1)]
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string, place int").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    for folder, path in ((data, f"{data}/conversations.parquet"), (str(tmp_path), f"{tmp_path}/conversations.parquet/*.parquet")):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
        columns = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"
        wanted = con.sql(f"SELECT {columns} FROM ({replies.ORACLE})").fetchall()
        found = [tuple(r) for r in replies.op11_reply_trees(spark, folder).selectExpr(*columns.split(", ")).collect()]
        assert sorted(found, key=str) == sorted(wanted, key=str)
    alone = replies.op11_reply_trees(spark, f"{tmp_path}/none").collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in alone] == [(-1, 2, 21)]
    assert alone[0]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


# --- spelling variants


def plain_counts(rows):
    lower, counts = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :])


def plain_variants(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return rows


def test_variants_as_a_plain_version(spark, tmp_path):
    draw, rows = random.Random(3), list(ODD)
    base = ["".join(draw.choice("abcdeéÀ÷ß") for _ in range(draw.randint(5, 9))) for _ in range(40)] + ["abcabc", "bcabca", "aaaaaa", "aaaaaaa", "x" * 300]
    weights = [draw.choice([1, 1, 5, 40]) for _ in base]
    for i in range(400):
        words = []
        for w in draw.choices(base, weights, k=30):
            if draw.random() < 0.3:
                p = draw.randrange(len(w) + 1)
                w = draw.choice([w[:p] + draw.choice("abÀz") + w[p:], w[:p] + w[p + 1 :], w[:p] + draw.choice("abÀz") + w[p + 1 :]])
            words.append(draw.choice([w, w.upper() if w.isascii() else w]))
        rows.append((i, draw.choice([" ", "-", "\n", "1"]).join(words), "en", 0.0, "v"))
    rows += [(700 + i, w, None, None, None) for i, w in enumerate(["deeper", "deepers", "deepen"] * 7 + ["deepers"] * 60 + ["deepersé"] * 600)]
    wanted = plain_variants(plain_counts(rows))
    spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit(1), "n": F.lit("n"), "run": F.lit(2)}).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in spellings.op12_spelling_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    assert any(f and f != root for _, f, root, *_ in wanted) and len(wanted) > 200


def test_variants_of_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert spellings.op12_spelling_variants(spark, str(tmp_path)).count() == 0


def test_masks_flip_one_or_two_bits(spark):
    draw = random.Random(5)
    pairs = []
    for _ in range(500):
        w = "".join(draw.choice(spellings.LETTERS) for _ in range(draw.randint(6, 12)))
        p, c = draw.randrange(len(w)), draw.choice(spellings.LETTERS)
        pairs += [(w, w[:p] + w[p + 1 :], 1), (w, w[:p] + c + w[p:], 1), (w, w[:p] + c + w[p + 1 :], 2)]
    rows = spark.createDataFrame(pairs, "a string, b string, most int").select("a", "b", "most", spellings.bands(F.col("a")).alias("x"), spellings.bands(F.col("b")).alias("y")).collect()
    for r in rows:
        flips = sum((x ^ y).bit_count() for x, y in zip(r["x"], r["y"], strict=True))
        assert flips in ((1,) if r["most"] == 1 else (0, 2)) and any(x == y for x, y in zip(r["x"], r["y"], strict=True))


# --- whitening


def plain_whitened(rows):
    good = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    sizes = Counter(len(v) for _, v in good)
    size = max(sizes, key=lambda s: (sizes[s], s))
    good = [(i, v) for i, v in good if len(v) == size]
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    exact = np.array([[n * c - s for c, s in zip(row, sums, strict=True)] for row in x], object)
    centred = (exact / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in good], n, [int(d) for d in (exact**2).sum(1)], centred, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("size", [5, 19, 64])
def test_whitened_as_numpy(spark, size):
    rng = np.random.default_rng(size)
    mix = rng.normal(size=(size, size))
    rows = [(i, (rng.normal(size=size) @ mix + 3).tolist(), 7, "w") for i in range(400)]
    rows += [rows[0], (None, rows[1][1], 7, None), (500, None, 1, ""), (501, [1.0, None] + [0.0] * (size - 2), 1, ""), (502, [float("nan")] + [0.0] * (size - 1), 1, ""), (503, [float("-inf")] + [0.0] * (size - 1), 1, ""), (504, [], 1, ""), (505, [1.0] * (size + 1), 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, whitened string").repartition(3)
    out = whitening.whitened_rows(df).toPandas()
    ids, n, deviations, centred, values, vectors = plain_whitened(rows)
    k = min(32, size)
    assert len(out) == n * k and set(out["n"]) == {n} == {402}
    assert out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-9
    assert sorted(out.loc[out["component"] == 1, "deviation"]) == sorted(deviations)
    wanted = centred @ vectors[:, :k] / np.sqrt(values[:k])
    for c, part in out.groupby("component"):
        assert part["explained"].iloc[0] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        by_id = part.dropna(subset="vec_id").drop_duplicates("vec_id").set_index("vec_id")["whitened"]
        own = np.array([by_id[i] for i in ids if i is not None])
        plain = np.array([w for i, w in zip(ids, wanted[:, c - 1], strict=True) if i is not None])
        assert np.allclose(own * np.sign(own @ plain), plain, atol=1e-8)


def test_whitening_without_variance_or_rows(spark):
    kind = "vec_id long, embedding array<float>"
    flat = whitening.whitened_rows(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(9)], kind)).toPandas()
    assert flat.groupby("component")["whitened"].apply(lambda w: w.notna().all()).tolist() == [True, False, False] and flat["identity_error"][0] < 1e-9
    one = whitening.whitened_rows(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, None), (2, 0, None, None)]
    assert whitening.whitened_rows(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitened_rows(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0


# --- quality rules


def test_contrary_rules_tell_nothing():
    """Rules that find fault with good documents more often than with bad ones have equal chances in both classes, which sum to one."""
    from spindrift.llm import rules

    draw, k, votes = random.Random(11), len(rules.RULES), Counter()
    for _ in range(4000):
        good = draw.random() < 0.8
        pattern = 0
        for j in range(k):
            faulty = (good and draw.random() < 0.3) if j < 3 else (not good and draw.random() < 0.8)
            pattern += (0 if faulty else 2) * 3**j
        votes[pattern] += 1
    known = rules.estimate(np.array(list(votes)), np.array(list(votes.values()), float))
    for j in range(k):
        assert sum(known.if_good[j]) == pytest.approx(1) and sum(known.if_bad[j]) == pytest.approx(1)
        if j < 3:
            assert [known.log_odds(j, v) for v in range(3)] == pytest.approx([0, 0, 0])
        else:
            assert known.log_odds(j, 0) < 0
