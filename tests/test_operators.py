"""Golden values on small tables, and loops that folds are held against."""

import math

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vector as V
from spindrift.functions.embed import embedder, hashing_vector
from spindrift.operators import boxes as B
from spindrift.operators import chunking as C
from spindrift.operators import feedback as A
from spindrift.operators import graph as G
from spindrift.operators import neighbours as N
from spindrift.operators import search as S
from spindrift.operators import store as W
from spindrift.operators import terms as K
from spindrift.sources import files as X

CORPUS = [
    (1, "Machine learning is a subset of artificial intelligence.", "AI"),
    (2, "Deep learning models require significant computational resources.", "AI"),
    (3, "Natural Language Processing (NLP) helps computers understand human language.", "AI"),
    (4, "Python is widely used in data science and machine learning.", "Programming"),
    (5, "TensorFlow and PyTorch are popular deep learning frameworks.", "Programming"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string, category string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_keyword_scores(corpus):
    hits = {r["doc_id"]: r["score"] for r in S.keyword_search(corpus, "machine learning python", 10).collect()}
    assert hits == {4: 1.0, 1: 2 / 3, 2: 1 / 3, 5: 1 / 3}
    exact = S.keyword_search(corpus, "deep learning", 10).filter("exact_match").select("doc_id").collect()
    assert sorted(r[0] for r in exact) == [2, 5]
    with pytest.raises(ValueError):
        S.keyword_search(corpus, "  ", 3)


def test_index_gives_the_same_scores(corpus):
    direct = S.keyword_search(corpus, "learning machine learning", 10).select("doc_id", "score").collect()
    assert direct == S.index_search(S.inverted_index(corpus), "learning machine learning", 10).collect()


def test_vectors(spark):
    a, b, c = V.literal([1, 0, 0]), V.literal([0, 1, 0]), V.literal([1 / math.sqrt(2), 1 / math.sqrt(2), 0])
    assert one(spark, V.cosine(a, b)) == 0 and one(spark, V.cosine(a, a)) == 1
    assert one(spark, V.cosine(a, c)) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, V.euclidean(a, b)) == pytest.approx(math.sqrt(2))
    assert one(spark, V.normalized(V.literal([3, 4]))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.cosine(V.literal([1e-10] * 3), V.literal([1e10] * 3))) == pytest.approx(1)
    assert one(spark, V.cosine(a, V.literal([0, 0, 0]))) is None
    assert one(spark, V.fused([V.literal([1, 0]), F.lit(None).cast("array<double>"), V.literal([0, 1])], [0.4, 0.3, 0.3])) == pytest.approx([4 / 7, 3 / 7])
    with pytest.raises(ValueError):
        V.similarity(a, b, "unknown")


def test_hybrid_search(spark, corpus):
    vectors = spark.createDataFrame([(i, hashing_vector(t, 64)) for i, t, _ in CORPUS], "vec_id long, embedding array<float>")
    hits = S.hybrid_search(corpus, vectors, "deep learning", hashing_vector("deep learning", 64), 3, filters={"category": "Programming"}, explain=True).collect()
    assert hits[0]["doc_id"] == 5 and hits[0]["explanation"]["semantic_weight"] == 0.7
    for weights in ((0.9, 0.3), (-0.1, 1.1)):
        with pytest.raises(ValueError):
            S.hybrid_search(corpus, vectors, "x", [0.0] * 64, 3, semantic_weight=weights[0], keyword_weight=weights[1])
    embedded = corpus.select(embedder(64)(F.col("text")).alias("v")).first()["v"]
    assert embedded == pytest.approx(hashing_vector(CORPUS[0][1], 64))


def test_batch_search_finds_itself_first(spark):
    rows = [(i, [float(i % 7), float(i % 5) + 1, float(i % 3)]) for i in range(50)] + [(99, [0.0, 0.0, 0.0]), (100, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = S.batch_search(vectors, [(1, rows[11][1]), (2, rows[20][1])], 3).orderBy("query_id", "rank").collect()
    assert len(found) == 6 and found[0]["score"] == pytest.approx(1) and found[3]["score"] == pytest.approx(1)


def test_cleaning(spark):
    assert one(spark, T.collapsed(F.lit("Text  with \t multiple\n\nspaces"))) == "Text with multiple spaces"
    assert one(spark, T.sanitized(F.lit("<p>Hello</p> with @#$ special chars!"))) == "Hello with special chars!"
    assert one(spark, T.without_tags(F.lit("<p>This has <b>HTML</b> tags.</p>"))) == "This has HTML tags."
    assert one(spark, T.truncated(F.lit("a long text indeed"), 10)) == "a long ..."
    assert one(spark, T.nfkc(F.lit("ﬁ①"))) == "fi1"
    assert one(spark, T.sentences(F.lit("Dr. Who came. He left! drive on. Mrs. X? Yes"))) == ["Dr. Who came.", "He left! drive on.", "Mrs. X?", "Yes"]
    assert one(spark, T.snake_case(F.lit("someName here"))) == "some_name_here"
    assert one(spark, T.camel_case(F.lit("some_name here"))) == "someNameHere"
    assert one(spark, T.half_width(F.lit("Ａｂ１　x"))) == "Ab1 x"


@pytest.mark.parametrize(("text", "wanted"), [("(a[b]{c})", True), ("(a]", False), (")(", False), ("", True), ("((", False)])
def test_brackets(spark, text, wanted):
    assert one(spark, T.is_balanced(F.lit(text))) is wanted


@pytest.mark.parametrize(("text", "wanted"), [("12", 12), ("iv", 4), ("MCMXC", 1990), ("seven", 7), ("x-", None)])
def test_numerals(spark, text, wanted):
    assert one(spark, T.numeral(F.lit(text))) == wanted


def test_sentence_chunks_match_a_loop(spark):
    text = " ".join(f"Sentence number {i} {'word ' * (i % 9)}ends here." for i in range(60))
    parts, wanted, n = one(spark, T.sentences(F.lit(text))), [], 0
    for p in parts:
        if wanted and n + len(p) <= 120:
            wanted[-1] += " " + p
            n += len(p)
        else:
            wanted.append(p)
            n = len(p)
    rows = C.sentence_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 120).orderBy("chunk_index").collect()
    assert [r["chunk"] for r in rows] == wanted


def test_fixed_chunks_reassemble(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "short")], "doc_id long, text string")
    rows = C.fixed_chunks(docs, 100, 20).orderBy("doc_id", "chunk_index").collect()
    own = [r["chunk"] for r in rows if r["doc_id"] == 1]
    assert own[0] + "".join(c[20:] for c in own[1:]) == text and all(len(c) <= 100 for c in own)
    assert [r["chunk"] for r in rows if r["doc_id"] == 3] == ["short"]
    with pytest.raises(ValueError):
        C.fixed_chunks(docs, 10, 10)


def test_educational_chunks_end(spark):
    docs = spark.createDataFrame([(1, "word " * 700 + "end.\n" + "For example this. " * 90)], "doc_id long, text string")
    rows = C.educational_chunks(docs).collect()
    assert {r["kind"] for r in rows} == {"general", "example"} and max(len(r["chunk"].split()) for r in rows) <= 512


def test_merge_small(spark):
    assert one(spark, C.merge_small(F.array(*map(F.lit, ["ab", "cd", "e" * 120, "z"])), 100)) == ["ab cd " + "e" * 120, "z"]


def test_rate_limit_windows(spark):
    times = [0, 10, 59, 60, 61, 130, 200]
    events = spark.createDataFrame([("q", t) for t in times], "op string, s long").select("op", F.timestamp_seconds("s").alias("ts"))
    rows = A.fixed_windows(events, "op", "ts", 60, 2).orderBy("window_start").collect()
    assert [(r["n"], r["allowed"], r["rejected"]) for r in rows] == [(4, 2, 2), (1, 1, 0), (1, 1, 0), (1, 1, 0)]


def test_graph_with_a_cycle_ends(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "node string, prerequisite string")
    found = {(r["node"], r["ancestor"]): r["depth"] for r in G.ancestors(edges, 6).collect()}
    assert found[("c", "a")] == 2 and found[("x", "x")] == 2


def test_store(spark):
    old = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"a": "3"})], "id long, metadata map<string,string>")
    new = spark.createDataFrame([(1, {"b": "9"}), (3, {"c": "4"})], "id long, metadata map<string,string>")
    assert {r["id"]: r["metadata"] for r in W.merge_metadata(old, new, "id").collect()} == {1: {"a": "1", "b": "9"}, 2: {"a": "3"}}
    assert {r["id"] for r in W.upsert(old, new, "id").collect()} == {1, 2, 3}


def test_segmenter_and_stems(spark):
    assert one(spark, K.segmenter({"ab": 5, "abc": 1, "cd": 9, "d": 1})(F.lit("abcd"))) == ["ab", "cd"]
    assert [one(spark, K.stemmed(F.lit(w))) for w in ("running", "cities", "glass", "is")] == ["runn", "city", "glass", "is"]


def test_suppression(spark):
    rows = [(1, 1, "a", 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, "a", 0.8, 1.0, 1.0, 11.0, 11.0), (1, 3, "a", 0.7, 50.0, 0.0, 60.0, 10.0), (1, 4, "b", 0.6, 0.0, 0.0, 10.0, 10.0)]
    boxes = spark.createDataFrame(rows, "page long, box_id long, kind string, score double, x0 double, top double, x1 double, bottom double")
    assert {r["box_id"] for r in B.suppressed(boxes, "page").collect()} == {1, 3, 4}


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("café  x\r\ny ".encode("cp1252"))
    (tmp_path / "sub" / "b.md").write_text("# T\n\nline")
    (tmp_path / "c.bin").write_bytes(b"\0\1")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    name = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{name}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>there</w:t></w:r></w:p></w:body></w:document>')
    rows = {r["path"].rsplit("/", 1)[1]: r for r in X.documents(X.scan(spark, str(tmp_path))).collect()}
    assert rows["a.txt"]["text"] == "café x\ny" and rows["b.md"]["n_lines"] == 3 and rows["d.docx"]["text"] == "Hello\nthere"
    assert rows["c.bin"]["error"] == "unsupported: bin" and rows["broken.docx"]["error"].startswith("BadZipFile")
    assert X.dialect("a;b;c\n1;2;3\n")["sep"] == ";"


def test_spreadsheet(spark, tmp_path):
    import zipfile

    name = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{name}"><si><t>col1</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{name}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    assert X.sheets(X.scan(spark, str(tmp_path), ["xlsx"])).first()["cells"] == ["col1", "", "5"]


def nearest(rows, queries, k):
    """(query, key) and cosine of the k nearest of each query, by brute force."""
    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    good = [(i, v) for i, v in rows if v is not None and any(v)]
    return {(q, i): s for q, u in good if q in queries for s, i in sorted(((cosine(u, v), i) for i, v in good), key=lambda x: (-x[0], x[1]))[:k]}


def vectors_of(n):
    import random

    draw = random.Random(n)
    return [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(n)] + [(20 * n, [0.0] * 8), (20 * n + 20, None)]


def test_blocks_of_queries_find_what_brute_force_finds(spark):
    rows = vectors_of(300)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    wanted = nearest(rows, range(0, 10_000, 20), 5)
    found = N.vector_join(vectors, vectors.filter("vec_id % 20 = 0"), 5, block_rows=70, block_queries=4).collect()
    assert len(found) == len(wanted) == 75 and {(r["query_id"], r["vec_id"]): r["score"] for r in found} == pytest.approx(wanted)
    assert N.vector_join(vectors, vectors.filter("false"), 5).count() == 0
    assert N.vector_join(vectors.filter("false"), vectors, 5).count() == 0


def test_every_twentieth_vector_is_a_query(spark, data):
    from spindrift.plans import catalog

    catalog.load()
    ids = {r[0] for r in spark.read.parquet(f"{data}/embeddings.parquet").filter("vec_id % 20 = 0").select("vec_id").collect()}
    assert {r["query_id"] for r in catalog.QUERIES["batch_vector_topk_all"](spark, data).collect()} == ids


def test_all_pieces_cite_what_brute_force_finds(spark):
    from spindrift.operators import matching as M
    from spindrift.plans import matching

    rows = vectors_of(200)
    rows += [(1000 + i, [x + i / 100 for x in rows[40 * (i % 4)][1]]) for i in range(24)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    pairs = [(q, i, s) for (q, i), s in nearest(rows, range(0, 10_000, 20), len(rows)).items() if q != i]
    wanted = M.citations(spark.createDataFrame(pairs, "piece long, chunk long, similarity double")).collect()
    found = matching.cited(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    assert len({r["piece"] for r in wanted}) > 4 and len(found) == len(wanted)
    assert {(r["piece"], r["chunk"]): r["similarity"] for r in found} == pytest.approx({(r["piece"], r["chunk"]): r["similarity"] for r in wanted})


def test_prompts_hold_whole_texts(spark):
    from spindrift.plans import texts

    text = "".join(chr(97 + i % 26) for i in range(1200))
    docs = spark.createDataFrame([(1, text, "en"), (2, "short", "fr"), (3, "", "fr"), (4, None, "fr")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["prompt"] for r in texts.prompts(docs).collect()}
    chunks = [r["chunk"] for r in C.fixed_chunks(docs.filter("doc_id = 1")).orderBy("chunk_index").collect()]
    assert len(chunks) == 3 and chunks[-1].endswith(text[-100:])
    assert found[1] == "Context: en\nQuestion: " + text + "\n" + "\n\n".join(f"Chunk {i + 1}:\n{c}" for i, c in enumerate(chunks))
    assert found[2] == "Context: fr\nQuestion: short\nChunk 1:\nshort" and found[3] == found[4] == "Context: fr\nQuestion: \n"


def test_coverage_of_all_items(spark, data):
    import re

    from spindrift.plans import texts

    items, docs = (spark.read.parquet(f"{data}/{t}.parquet").collect() for t in ("benchmark", "documents"))
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    held = {r["doc_id"]: words(r["text"]) for r in docs}
    wanted = {(r["item_id"], i): len(k & w) / len(k) for r in items for k in [words(r["text"])] for i, w in held.items() if k and len(k & w) / len(k) > 0.3}
    found = {(r["item_id"], r["doc_id"]): r["coverage"] for r in texts.coverage_all(spark, data).collect()}
    assert found == pytest.approx(wanted, abs=1e-6) and max(i for i, _ in found) >= 5


def test_events_of_files_in_any_order_count_once(spark, tmp_path):
    import os

    from spindrift.plans import streams

    folder = f"{tmp_path}/events.parquet"
    for i, day in enumerate((9, 5, 1)):  # files are read by their time of change
        spark.sql(f"SELECT id AS event_id, timestamp'2024-01-0{day}' + make_interval(0, 0, 0, 0, 0, cast(id AS int)) AS ts, 1L AS user_id, 'view' AS event_type FROM range({100 * i}, {100 * i + 100})").coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet") and os.path.getmtime(f"{folder}/{f}") > 10_000_000:
                os.utime(f"{folder}/{f}", (1_000_000 * (i + 1),) * 2)
    assert [r["n"] for r in streams.stream_dedup(spark, str(tmp_path)).collect()] == [300]
