"""Packing, hierarchical chunks and numbered questions against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import chunking as C
from spindrift.operators import outline as O


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(4)
    parts = ["A short one.", "One (with a bracket", "closed) here.", "Longer sentence number five is here, with some words.", "No end", "x", "Why? Because.", "[", "]", "", "  ", "1 2 3"]
    rows = [(i, draw.choice(["\n", " ", "\n\n"]).join(draw.choice(parts) for _ in range(draw.randint(0, 30)))) for i in range(80)]
    return spark.createDataFrame([*rows, (900, None), (901, "word " * 20000)], "doc_id long, text string").repartition(3)


def grouped(df, *columns):
    out = {}
    for r in df.orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


def packed(parts, size, full, joiner):
    chunks = []
    for p in parts:
        if chunks and not full(chunks[-1][1], size(p)):
            chunks[-1] = (chunks[-1][0] + joiner + p, chunks[-1][1] + size(p))
        else:
            chunks.append((p, size(p)))
    return chunks


def test_packed_lines(docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    lines = {i: [x for x in t.split("\n") if x.strip(" ")] for i, t in texts.items()}
    tokens = lambda s: len(re.findall(r"\d+(?:\.\d+)?|\w+|[^\s\w]", s.lower()))
    wanted = {i: packed(ls, lambda s: len(s.split()), lambda t, n: t + n > 9, "\n") for i, ls in lines.items() if ls}
    assert grouped(C.word_budget_chunks(docs, 9), "text", "n_words") == wanted
    wanted = {i: packed(ls, tokens, lambda t, n: t > 12, "\n") for i, ls in lines.items() if ls}
    assert grouped(C.naive_merge(docs, 12), "text", "n_tokens") == wanted


def test_accumulated_and_small(docs):
    rows = docs.select("doc_id", T.sentences(F.col("text")).alias("s")).collect()

    def balanced(text):
        stack = []
        for c in re.findall(r"[()\[\]{}]", text):
            if stack and stack[-1] + c in ("()", "[]", "{}"):
                stack.pop()
            else:
                stack.append(c)
        return not stack

    wanted = {}
    for r in rows:
        chunks, now = [], None
        for s in r["s"] or []:
            now = s if now is None else now + " " + s
            if len(now) >= 50 and re.search(r"[.!?]\s*$", now.strip()) and balanced(now):
                chunks.append(now)
                now = None
        if chunks + ([now] if now else []):
            wanted[r["doc_id"]] = chunks + ([now] if now else [])
    assert grouped(C.accumulated_chunks(docs), "chunk") == wanted
    small = docs.select("doc_id", C.merge_small(T.sentences(F.col("text")), 30).alias("m")).collect()
    for r, own in zip(sorted(rows, key=lambda r: r["doc_id"]), sorted(small, key=lambda r: r["doc_id"]), strict=True):
        merged = []
        for s in r["s"] or []:
            if merged and len(merged[-1]) < 30:
                merged[-1] += " " + s
            else:
                merged.append(s)
        assert (own["m"] or []) == merged


# --- headings


def plain_chunks(level, tokens, n_levels, depth, most):
    """Every line's headings are looked up by scanning back from it."""
    seen, found = set(), []
    for own in range(min(depth, n_levels)):
        for j in [i for i, x in enumerate(level) if x == own]:
            if j in seen:
                continue
            chain = [j]
            if own != n_levels - 2:
                for above in range(own + 1, n_levels):
                    before = [i for i in range(j) if level[i] == above]
                    if before:
                        if before[-1] > chain[-1]:
                            chain = chain[:-1]
                        chain = [*chain, before[-1]]
            seen |= set(chain)
            found.append(chain[::-1])
    chunks, room = [], 0
    for c in found:
        if len(c) == 1 and chunks and tokens[c[0]] + room < most:
            chunks[-1] += c
            room += tokens[c[0]]
        else:
            chunks.append(list(c))
            room = tokens[c[0]] if len(c) == 1 else most
    return chunks


def test_merged_lines_as_a_plain_version():
    draw = random.Random(6)
    for _ in range(3000):
        n_levels, n = draw.randint(3, 8), draw.randint(0, 14)
        level, tokens = [draw.randrange(n_levels) if draw.random() < 0.6 else 0 for _ in range(n)], [draw.choice([1, 90, 217, 300]) for _ in range(n)]
        depth = draw.randint(1, 8)
        assert O.merge_lines(level, tokens, n_levels, depth) == plain_chunks(level, tokens, n_levels, depth, 218)
    assert len(O.merge_lines([0, 2] * 100_000, [1] * 200_000, 6, 5)) == 100_000 + 1


def test_hierarchical_chunks_of_texts(spark):
    text = "PART ONE\nintro line\nChapter II\nSection 1 first\nbody one\nbody two\nSection 2 second\nbody three\n7\nx\nPART TWO\nlast line"
    docs = spark.createDataFrame([(1, text), (2, "no headings\nat all"), (3, None), (4, ""), (5, "第一章 开始\n内容在这里\n第二节 中间\n内容还有")], "doc_id long, text string")
    found = {}
    for r in O.hierarchical_chunks(docs).orderBy("chunk_index").collect():
        found.setdefault((r["doc_id"], r["style"]), []).append(r["chunk"].split("\n"))
    one = found[1, 3]
    assert ["PART ONE", "intro line"] in one and ["PART ONE", "Chapter II", "Section 1 first", "body one"] in one
    assert ["PART ONE", "Chapter II", "Section 2 second", "body three"] in one and ["PART TWO", "Section 2 second", "last line"] in one
    assert set(found) == {(1, 3), (5, 0)}


@pytest.mark.parametrize(("lines", "wanted"), [(["第三章", "第一节"], 0), (["1. a", "2. b", "x"], 1), (["PART ONE", "Section 3"], 3), (["plain"], -1), (["0", "12 34"], -1), ([], -1), (["第3章"], 0)])
def test_heading_sets(spark, lines, wanted):
    df = spark.createDataFrame([(lines,)], "l array<string>")
    assert df.select(O.heading_set(F.col("l")).alias("x")).first()["x"] == wanted


@pytest.mark.parametrize(("text", "wanted"), [("三", 3), ("十", 10), ("十二", 12), ("二十", 20), ("九十九", 99), ("一百零五", 105), ("三百二十", 320), ("一二", 12), ("x", None), ("", None)])
def test_chinese_numerals(spark, text, wanted):
    assert spark.range(1).select(O.chinese_numeral(F.lit(text)).alias("x")).first()["x"] == wanted


def plain_questions(boxes):
    """boxes: text, layout, x0, top of one page in order."""
    out, lefts, last, number, was = [], [], None, None, False
    for text, layout, x0, top in boxes:
        m = re.match(r"([0-9]{1,2})[\. 、]", text)
        before = last or ("", "", x0, top)
        ok = m is not None
        if ok and was and x0 - before[2] > 10:
            ok = False
        if ok and not was and x0 >= before[2] and top - before[3] < 20:
            ok = False
        if ok and lefts and x0 - sum(lefts) / len(lefts) > 10:
            ok = False
        if ok and before[0][-1:] in (":", "："):
            ok = False
        if ok and number and int(m[1]) < number:
            ok = text[-1] in "?？" or layout == "title" or re.match("what|when|where|how|why|which|who|whose|为什么|为啥|哪", text[m.end() :].lower()) is not None
        if ok:
            lefts.append(x0)
            number = int(m[1])
        out.append((ok, number))
        last, was = (text, layout, x0, top), ok
    return out


def test_questions_as_a_plain_loop(spark):
    draw, rows, wanted = random.Random(8), [], {}
    for page in range(120):
        boxes = []
        for _ in range(draw.randint(1, 25)):
            text = draw.choice(["%d. " % draw.randint(0, 12), "", "plain "]) + draw.choice(["What now", "how?", "text", "text:", "why？", "哪里", "a b"])
            boxes.append((text, draw.choice(["text", "title"]), float(draw.choice([10, 12, 19, 21, 40])), float(draw.randint(0, 60))))
        for i, b in enumerate(boxes):
            rows.append((page, i, *b))
        for i, w in enumerate(plain_questions(boxes)):
            wanted[page, i] = w
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "page long, box long, text string, layout string, x0 double, top double").repartition(4)
    found = {(r["page"], r["box"]): (r["question"], r["number"]) for r in O.question_bullets(df, O.QUESTIONS[5]).collect()}
    assert found == wanted and sum(q for q, _ in wanted.values()) > 100


def test_long_texts_are_split_once(spark):
    """Rows of chunks do not carry their whole text, and a text is not split again for each of its chunks."""
    import time

    df = spark.createDataFrame([(1, " ".join(f"Sentence number {i} (of many) goes on for a while, until it stops." for i in range(6000)))], "doc_id long, text string")
    carried = re.findall(r"Generate posexplode.*, \[([^\]]*)\], false, \[chunk_index", C.accumulated_chunks(df)._jdf.queryExecution().executedPlan().toString())
    assert carried and all("_s#" not in c for c in carried)
    for chunks in (C.accumulated_chunks(df), C.sentence_chunks(df, 60)):
        start = time.time()
        assert chunks.agg({"chunk": "count"}).first()[0] == 6000
        assert time.time() - start < 30
