"""Score the writing quality of every document in one narrow pass; key phrases shuffle words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import fixed, quality, text
from palimpsest.operators.copies import top_rows


def features(docs: DataFrame, id_col: str = "id", text_col: str = "content", title_col: str = "title"):
    """Counts and flags the scores are made of.  No text column is kept."""
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(title_col, F.lit("")).alias("title"),
        F.coalesce(text_col, F.lit("")).alias("content"),
    )
    split = base.withColumns(
        {
            "low": F.lower("content"),
            "words": text.tokenize(F.col("content")),
            "parts": text.paragraphs(F.col("content")),
            "n_pieces": F.regexp_count("content", F.lit(" ")) + 1,
            "sentence_count": F.size(text.sentences(F.col("content"))),
        }
    )
    counted = split.select(
        "doc_id",
        F.size("words").alias("word_count"),
        F.size(F.array_distinct("words")).alias("unique_words"),
        F.size("parts").alias("paragraph_count"),
        "sentence_count",
        "n_pieces",
        (~text.blank(F.col("title"))).alias("has_title"),
        quality.has_any(quality.paragraph_at(F.col("parts"), 1), fixed.INTRODUCTION_KEYWORDS).alias(
            "has_introduction"
        ),
        quality.has_any(quality.paragraph_at(F.col("parts"), -1), fixed.CONCLUSION_KEYWORDS).alias(
            "has_conclusion"
        ),
        text.contains_any(F.col("low"), fixed.REFERENCE_KEYWORDS).alias("has_references"),
        quality.occurrences(F.col("low"), fixed.TRANSITION_PHRASES).alias("transitions"),
        quality.present(F.col("low"), fixed.ACADEMIC_TERMS).alias("academic_terms"),
    )
    words, sentences = F.col("word_count"), F.col("sentence_count")
    return counted.withColumns(
        {
            "avg_sentence_length": quality.ratio(words, sentences),
            "avg_paragraph_length": quality.ratio(words, F.col("paragraph_count")),
            "lexical_diversity": quality.ratio(F.col("unique_words"), words),
            "readability": quality.readability(F.col("n_pieces"), sentences),
            "coherence": quality.coherence(F.col("transitions"), F.col("paragraph_count")),
        }
    ).withColumn("richness", quality.vocabulary_richness(F.col("lexical_diversity")))


def scores(found: DataFrame) -> DataFrame:
    return (
        found.withColumns(
            {"format_score": quality.format_score(), "content_score": quality.content_score()}
        )
        .withColumns(
            {
                "has_proper_structure": F.col("format_score") >= quality.PROPER_STRUCTURE,
                "quality_score": quality.quality_score(),
                "issues": quality.issues(),
            }
        )
        .withColumns(
            {
                "quality_level": quality.quality_level(F.col("quality_score")),
                "suggestions": quality.suggestions(),
            }
        )
    )


def key_phrase_rows(docs: DataFrame, id_col: str = "id", text_col: str = "content", k: int = 10):
    """``doc_id, word, n, first_at, place``: the most frequent words, ties by first appearance.

    The texts are dealt by document once; words are counted and ranked where they arrive, as both
    steps are within a document.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartition("doc_id")
    words = texts.select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word")).filter("word <> ''")
    counts = words.groupBy("doc_id", "word").agg(
        F.count("*").alias("n"), F.min("at").alias("first_at")
    )
    return top_rows(counts, ["doc_id"], [F.desc("n"), F.col("first_at")], k)


def key_phrases(docs: DataFrame, id_col: str = "id", text_col: str = "content", k: int = 10):
    rows = key_phrase_rows(docs, id_col, text_col, k)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "first_at", "word")))
    lists = rows.groupBy("doc_id").agg(ordered.alias("list"))
    return lists.select("doc_id", F.col("list.word").alias("key_phrases"))


def score_quality(
    docs: DataFrame, id_col: str = "id", text_col: str = "content", title_col: str = "title"
) -> DataFrame:
    """The whole analysis, one row per document."""
    scored = scores(features(docs, id_col, text_col, title_col))
    phrases = key_phrases(docs, id_col, text_col)
    none = F.array().cast("array<string>")
    return scored.join(phrases, "doc_id", "left").withColumn(
        "key_phrases", F.coalesce("key_phrases", none)
    )
