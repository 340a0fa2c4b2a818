"""Single functions that no registered query calls, with their results by hand."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions import audio as S
from spindrift.functions import text as T
from spindrift.functions import vector as V
from spindrift.operators import boxes as B
from spindrift.operators import registry as R
from spindrift.operators import rerank as K
from spindrift.operators import search
from spindrift.operators import validation as L
from spindrift.sources import files as X
from spindrift.streaming import events as E


@pytest.mark.parametrize(
    ("column", "wanted"),
    [
        (lambda: T.without_special(F.lit("a@b, c#!")), "ab, c!"),
        (lambda: T.mended_breaks(F.lit("one\ntwo\n\n\n\nThree")), "one two\n\nThree"),
        (lambda: T.cleaned_document(F.lit("<b>See</b> https://x.org now"), lower=True), "see now"),
        (lambda: T.is_email(F.lit("a.b@c.org")), True),
        (lambda: T.is_email(F.lit("a.b@c")), False),
        (lambda: T.is_url(F.lit("https://a.org:80/x")), True),
        (lambda: T.is_scientific(F.lit("-1.5e-3")), True),
        (lambda: T.is_scientific(F.lit("1.5f")), False),
        (lambda: T.extract_summary(F.lit("A. B. C. D."), 2), "A. B"),
        (lambda: T.cjk_share(F.lit("ab第一")), 0.5),
        (lambda: T.highlighted(F.lit("A cat, cats"), ["cat"]), "A <em>cat</em>, cats"),
        (lambda: T.tight(F.lit(None).cast("string")), ""),
        (lambda: T.reversed_script(F.lit("אב 12 ג")), "ג 12 בא"),
        (lambda: T.fine_grained(F.lit("The cat, 3 mats!"), ["the"]), "cat 3 mats"),
        (lambda: T.grown_keywords(F.array(F.lit("deep cat"), F.lit("a"))), ["deep cat", "a", "deep", "cat"]),
        (lambda: T.is_date(F.lit("2024-02-30")), False),
        (lambda: T.is_date(F.lit("29/02/2024"), "dd/MM/yyyy"), True),
        (lambda: T.not_bullet(F.lit("12 34")), True),
        (lambda: T.not_bullet(F.lit("1. One")), False),
        (lambda: T.not_title(F.lit("第三条, a long article")), False),
        (lambda: T.not_title(F.lit("One, two")), True),
        (lambda: T.not_title(F.lit("A title")), False),
        (lambda: V.decay_weights(F.lit(4)), [1.0, 0.75, 0.5, 0.25]),
        (lambda: L.in_range(F.lit(3), 1, 3), True),
        (lambda: L.has_keys(F.create_map(F.lit("a"), F.lit(1)), ["a", "b"]), False),
        (lambda: L.has_extension(F.lit("x/y.PDF"), [".pdf"]), True),
        (lambda: K.adapted_level(F.lit("beginner")), "basic"),
        (lambda: B.is_caption(F.lit("图 1: x")), True),
        (lambda: B.is_caption(F.lit("x"), F.lit("table caption")), True),
        (lambda: B.cell_type(F.lit("2021年第一季度")), "Ot"),
        (lambda: B.cell_type(F.lit("2021年一季度")), "Dt"),
        (lambda: B.cell_type(F.lit("2021")), "Nu"),
        (lambda: B.element_type(F.lit(18.0), F.lit(12.0), F.lit(False)), "title"),
        (lambda: B.char_width(F.lit(0.0), F.lit(10.0), F.lit(" ")), 10.0),
        (lambda: S.peak_normalised(F.array(F.lit(1.0), F.lit(-4.0))), [0.25, -1.0]),
        (lambda: S.segments(F.sequence(F.lit(1), F.lit(5)), 2), [[1, 2], [3, 4], [5]]),
        (lambda: S.signal_to_noise(F.array().cast("array<double>"), 4, 2), 0.0),
        (lambda: S.quantile(F.array(F.lit(1.0), F.lit(3.0)), 0.25), 1.5),
    ],
)
def test_values(spark, column, wanted):
    assert spark.range(1).select(column().alias("x")).first()["x"] == wanted


def test_requests_and_pages():
    assert search.request_filters({"kb_ids": ["a"], "doc_ids": [], "available_int": 1}) == {"kb_id": ["a"], "available_int": 1}
    assert search.has_next(21, 2, 10) and not search.has_next(20, 2, 10)


def test_relaxed_search(spark):
    docs = spark.createDataFrame([(1, "red"), (2, "blue")], "doc_id long, text string")
    query = "red green black white"
    assert search.full_text(docs, query, 0.5).isEmpty()
    assert [r["doc_id"] for r in search.relaxed(docs, query, 0.5, 0.1).collect()] == [1]


def test_occurrences_are_whole_words(spark):
    docs = spark.createDataFrame([("The theme: the_x the, THE-2",), ("",), (None,)], "text string")
    found = [r["x"] for r in docs.select(search.occurrences(F.col("text"), ["the", "them", "2"]).alias("x")).collect()]
    assert found == [["the", "the", "the", "2"], [], None]


def test_reranking(spark):
    hits = spark.createDataFrame([(1, 1.0, 0.5, 0.1, "x", None)], "doc_id long, score double, token_score double, rank_score double, text string, level string")
    assert K.by_context(hits, F.lit(0.5)).first()["score"] == pytest.approx(1.1)
    assert K.by_model(hits, lambda q, t: F.when(q == t, 1.0).otherwise(0.0), "x").first()["score"] == pytest.approx(0.88)
    assert K.with_defaults(hits, {"level": "basic"}).first()["level"] == "basic"


def test_prerequisites_of_a_common_topic(spark):
    docs = spark.createDataFrame([(i, ["a", "a"] if i else None) for i in range(50)], "doc_id long, topics array<string>")
    results = spark.createDataFrame([(7, ["a", "b"]), (8, []), (9, None)], "doc_id long, prerequisites array<string>")
    assert sorted((r["doc_id"], r["found"], r["rank"]) for r in K.prerequisite_hits(results, docs).collect()) == [(7, 1, 1), (7, 2, 2)]


def test_heading_mode(spark):
    rows = [(1, 0, "Part one", "text"), (1, 1, "1. a", "text"), (1, 2, "2. b", "text"), (1, 3, "Name", "title"), (2, 0, "body text, long", "title")]
    sections = spark.createDataFrame(rows, "doc_id long, place long, text string, layout string")
    levels = B.heading_levels(sections, ["Part", "[0-9]+\\."])
    assert [r["level"] for r in levels.orderBy("doc_id", "place").collect()] == [0, 1, 1, 2, 3]
    assert {r["doc_id"]: r["level"] for r in B.heading_mode(levels, "doc_id", "place", 2).collect()} == {1: 1, 2: 3}


def test_chains(spark):
    df = spark.range(3)
    assert R.chained(df, lambda d: d.filter("id > 0"), lambda d: d.limit(1)).count() == 1
    assert R.chained(df, lambda _: None, lambda d: d.limit(1)) is None
    assert R.with_fallback(lambda: df.select("nothing"), lambda: df).count() == 3


def test_files_round_trip(spark, tmp_path):
    X.write_json(spark.range(3), str(tmp_path / "j"), gzip=True)
    assert X.read_json(spark, str(tmp_path / "j"), "id long", multi_line=False).count() == 3
    (tmp_path / "a.csv").write_text('id,text\n1,"a\nb"\n2,c\n')
    assert [tuple(r) for r in X.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [(1, "a\nb"), (2, "c")]
    X.snapshot(spark.range(4).withColumn("k", F.col("id") % 2), str(tmp_path / "s"), ["k"])
    assert spark.read.parquet(str(tmp_path / "s")).filter("k = 1").count() == 2
    X.compacted(spark.range(10), str(tmp_path / "c"), 1)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 1


def test_rate_limit_keeps_state_between_batches(spark, tmp_path):
    for i, seconds in enumerate(([59, 0, 10], [60, 61, 130])):
        rows = spark.createDataFrame([("q", s) for s in seconds], "op string, s long")
        rows.select("op", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    out = E.run_available(E.rate_limited(E.stream_of(spark, str(tmp_path / "events"), 10), "op", 60, 2), str(tmp_path / "run"))
    assert [(r["ts"].timestamp() % 1000, r["allowed"]) for r in out.orderBy("ts").collect()] == [(0, True), (10, True), (59, False), (60, False), (61, True), (130, True)]
