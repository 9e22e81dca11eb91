import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from palimpsest.functions import ai, bands, fixed, text
from palimpsest.operators import segments as seg
from palimpsest.plans import ai as ai_plan
from palimpsest.plans import quality


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("raw,want", [
    (None, ""), ("   \t", ""), ("Học-viện,  NGÂN HÀNG!", "học viện ngân hàng"),
    ("a b_c", "a b c"), ("x²y", "x²y"), ("été", "e te"), ("𝒳 ok 😀 da", "𝒳 ok da"),
])
def test_normalize(spark, raw, want):
    assert one(spark, raw, text.normalize) == want


def test_cut_takes_the_furthest_late_occurrence(spark):
    body = "x" * 80 + " References here " + "y" * 5 + " phụ lục z"
    assert one(spark, body, text.cut_bibliography) == body[: body.index("phụ lục")]
    early = "references " + "x" * 100
    assert one(spark, early, text.cut_bibliography) == early
    # exactly at 70 percent does not count, one character later does
    at = "x" * 70 + "references" + "y" * 20
    assert one(spark, at, text.cut_bibliography) == at
    assert one(spark, "x" + at[:-1], text.cut_bibliography) == "x" * 71
    twice = "x" * 75 + "references" + "references" + "z" * 5
    assert one(spark, twice, text.cut_bibliography) == "x" * 75 + "references"
    assert one(spark, " \n ", text.cut_bibliography) == ""


def test_segments_and_classes(spark):
    body = "...Một hai ba. Hai từ! \n\n??? Theo quy định của pháp luật, điều này đúng. -- ; --"
    rows = seg.segments(spark.createDataFrame([(1, body)], "id int, content string")).orderBy("pos").collect()
    assert [r.raw for r in rows] == brute.segments(body)
    assert [(r.n_words, r.is_noise, r.is_excluded, r.reason) for r in rows] == [
        (3, False, False, None), (2, True, False, fixed.REASON_TOO_SHORT), (0, True, False, None),
        (9, False, True, fixed.REASON_COMMON_PHRASE), (0, True, False, None),
    ]


def test_ngrams_and_jaccard(spark):
    assert one(spark, "a b a b a", lambda c: text.ngrams(c, 2)) == ["a b", "b a"]
    assert one(spark, "a b", lambda c: text.ngrams(c, 3)) == []
    pair = lambda a, b: text.jaccard(text.ngrams(F.lit(a), 3), text.ngrams(F.lit(b), 3))
    assert one(spark, "", lambda c: pair("a b c d", "b c d e")) == pytest.approx(100 / 3)
    assert one(spark, "", lambda c: pair("a b", "a b")) == 0.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab .\n,é", max_size=30), st.text("ab .\n,é", max_size=30)), min_size=1, max_size=20))
def test_jaccard_is_symmetric_and_bounded(spark, pairs):
    frame = spark.createDataFrame(pairs, "a string, b string")
    grams = frame.select("a", "b", text.ngrams(F.col("a"), 2).alias("x"), text.ngrams(F.col("b"), 2).alias("y"))
    for row in grams.select("a", "b", text.jaccard(F.col("x"), F.col("y")).alias("p"), text.jaccard(F.col("y"), F.col("x")).alias("q")).collect():
        mine, theirs = brute.grams(row.a, 2), brute.grams(row.b, 2)
        want = len(mine & theirs) / len(mine | theirs) * 100 if mine and theirs else 0.0
        assert row.p == row.q == pytest.approx(want)
        assert 0 <= row.p <= 100


def test_sentences_and_queries(spark):
    assert one(spark, "Short one. This is long enough! ok\nDone here now?", text.sentences) == [
        "This is long enough!", "ok\nDone here now?"]
    assert one(spark, "  This sentence is long enough \n. no! Another sentence that counts?", text.sentences_plain) == [
        "This sentence is long enough", "Another sentence that counts"]
    found = one(spark, "a b c d e f g h. x y. 1 2 3 4 5! p q r s t? u v w x y z. six six six six six", text.search_queries)
    assert found == ["a b c d e f g", "1 2 3 4 5", "p q r s t", "u v w x y z"]


@pytest.mark.parametrize("score,want", [(20.125, 20.12), (20.135, 20.14), (33.333, 33.33), (0.005, 0.0)])
def test_round2_half_to_even(spark, score, want):
    assert one(spark, "", lambda c: text.round2(F.lit(score))) == want


def test_bands_at_their_edges(spark):
    told = lambda s, scale: one(spark, "", lambda c: bands.risk_band(F.lit(s), scale))
    assert [told(s, "report") for s in (30.01, 30, 15, 14.99)] == ["high", "medium", "medium", "low"]
    assert [told(s, "ai") for s in (70, 70.1, 40)] == ["Medium", "High", "Low"]
    assert one(spark, "", lambda c: bands.highlight(F.lit(15.0), F.lit(False))) == "plain"
    assert one(spark, "", lambda c: bands.highlight(F.lit(61.0), F.lit(False))) == "highlight-high"


def words(n):
    return " ".join(["từ"] * n)


@pytest.mark.parametrize("sentence,want", [
    (words(4), 10.0), (words(5), 35.0), (words(15), 35.0), (words(16), 50.0), (words(24), 50.0), (words(25), 35.0),
    ("Tuy nhiên, do đó " + words(20), 60.0), ("tuy nhiên do đó hơn nữa ngoài ra tóm lại vì vậy " + words(5), 80.0),
    ("abcdefghijk " + words(15), 45.0),
])
def test_sentence_score(spark, sentence, want):
    assert one(spark, sentence, ai.sentence_score) == want


def test_document_score_and_json(spark):
    long = (words(20) + ". ") * 4
    rows = spark.createDataFrame([(1, "  "), (2, words(20) + "."), (3, long), (4, "ab")], "id int, content string")
    got = {r.doc_id: r for r in ai_plan.score_ai(rows).collect()}
    assert (got[1].ai_probability, got[1].detection_level, got[1].summary, got[1].sentences) == (0.0, "Low", "", [])
    assert got[2].ai_probability == 40.0 and got[2].detection_level == "Low"
    assert len(long) >= 200 and got[3].ai_probability == 50.0 and got[3].detection_level == "Medium"
    assert got[4].ai_probability == 0.0 and got[4].summary == fixed.AI_SUMMARY_LOW
    stored = ai_plan.score_ai(rows).select(ai.to_stored(F.lit("2024-01-02").cast("timestamp_ntz")).alias("s"), "doc_id")
    back = {r.doc_id: r.r for r in stored.select("doc_id", ai.from_stored(F.col("s")).alias("r")).collect()}
    assert back[3].ai_probability == 50.0 and len(back[3].sentences) == 4
    assert one(spark, "", ai.from_stored) is None


def test_quality_of_a_structured_text(spark):
    body = (
        "Giới thiệu: nghiên cứu này phân tích dữ liệu.\n\nTuy nhiên, do đó kết quả có ý nghĩa. Tuy nhiên vẫn còn.\n\n"
        "Kết luận: mô hình tốt. Tài liệu tham khảo: một cuốn sách."
    )
    rows = quality.score_quality(spark.createDataFrame([(1, body, "Tên"), (2, "", " ")], "id int, content string, title string"))
    got = {r.doc_id: r for r in rows.collect()}
    full = got[1]
    assert full.paragraph_count == 3 and full.has_introduction and full.has_conclusion and full.has_references
    assert full.transitions == 3 and full.coherence == 50.0
    assert full.format_score == 15 + 20 + 20 + 15 + 10 and full.has_proper_structure
    assert full.academic_terms == ["nghiên cứu", "phân tích", "kết quả", "mô hình", "dữ liệu"]
    assert [i.severity for i in full.issues] == ["Medium", "Low"]
    assert full.issues[0].description == f"Bài viết quá ngắn ({full.word_count} từ)"
    assert full.key_phrases[:2] == ["Giới", "thiệu:"] and len(full.key_phrases) == 10
    empty = got[2]
    assert (empty.format_score, empty.content_score, empty.quality_score, empty.quality_level) == (0, 0, 0.0, "Kém")
    assert len(empty.issues) == 7 and empty.suggestions[0].startswith("🔴 Ưu tiên: Khắc phục 3 ")
    assert empty.key_phrases == []


def test_words_of_a_document_are_dealt_once(spark):
    """Texts are shuffled by document and never as rows of words; rows of one id count together."""
    from palimpsest.plans import quality

    docs = spark.createDataFrame([(1, "a b b c"), (1, "c c"), (2, "x"), (None, "y y")], "id long, content string")
    rows = quality.key_phrase_rows(docs, k=1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert {(r.doc_id, r.word, r.n, r.first_at) for r in rows.collect()} == {(1, "c", 3, 0), (2, "x", 1, 0), (None, "y", 2, 0)}
