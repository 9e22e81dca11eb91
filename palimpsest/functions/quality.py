"""Writing-quality rules.  They work on the raw text, split on the single space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import fixed, text


def present(low: Column, phrases: Sequence[str]) -> Column:
    """Those of ``phrases`` that stand in the lower-cased text, in list order."""
    return F.filter(
        F.array(*[F.lit(p) for p in phrases]), lambda phrase: F.contains(low, phrase)
    )


def occurrences(low: Column, phrases: Sequence[str]) -> Column:
    """How often the phrases stand in the lower-cased text, each counted without overlap."""
    total = F.lit(0)
    for phrase in phrases:
        removed = F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))
        total = total + (removed / len(phrase)).cast("int")
    return total


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def between(value: Column, low: float, high: float) -> Column:
    return (value >= low) & (value <= high)


def readability(n_pieces: Column, n_sentences: Column) -> Column:
    """``n_pieces`` counts the empty pieces of the split as well."""
    average = n_pieces / n_sentences
    return (
        F.when(n_sentences == 0, F.lit(0.0))
        .when(between(average, 15, 25), F.lit(80.0))
        .when(between(average, 10, 30), F.lit(60.0))
        .otherwise(F.lit(40.0))
    )


def coherence(n_transitions: Column, n_paragraphs: Column) -> Column:
    return F.least(F.lit(100.0), ratio(n_transitions, n_paragraphs) * 50)


def vocabulary_richness(diversity: Column) -> Column:
    return F.least(F.lit(100.0), diversity * 200)


# --- fixed values: points of the format score
FORMAT_POINTS = {
    "has_title": 15, "has_introduction": 20, "has_conclusion": 20, "has_references": 15,
    "enough_paragraphs": 10, "enough_words": 10, "good_sentence_length": 10,
}
PROPER_STRUCTURE = 60


def format_score() -> Column:
    tests = {
        "enough_paragraphs": F.col("paragraph_count") >= 3,
        "enough_words": F.col("word_count") >= 500,
        "good_sentence_length": between(F.col("avg_sentence_length"), 15, 25),
    }
    score = F.lit(0)
    for name, points in FORMAT_POINTS.items():
        score = score + F.when(tests.get(name, F.col(name)), points).otherwise(0)
    return score


def content_score() -> Column:
    parts = F.col("readability") + F.col("coherence") + F.col("richness")
    return (parts / 3).cast("int")


def quality_score() -> Column:
    return F.col("format_score") * F.lit(0.4) + F.col("content_score") * F.lit(0.6)


def quality_level(score: Column) -> Column:
    result = None
    for threshold, label in fixed.QUALITY_LEVELS:
        result = (F.when if result is None else result.when)(score >= threshold, F.lit(label))
    return result.otherwise(F.lit(fixed.QUALITY_LOWEST))


def issues() -> Column:
    """List of ``(type, severity, description, suggestion)`` of the rules that apply."""
    rules = {
        "no_title": ~F.col("has_title"),
        "no_introduction": ~F.col("has_introduction"),
        "no_conclusion": ~F.col("has_conclusion"),
        "no_references": ~F.col("has_references"),
        "too_short": F.col("word_count") < 500,
        "poor_vocabulary": F.col("richness") < 30,
        "short_sentences": F.col("avg_sentence_length") < 10,
        "long_sentences": F.col("avg_sentence_length") > 30,
    }
    found = []
    for name, applies in rules.items():
        kind, severity, description, suggestion = fixed.ISSUES[name]
        told = F.lit(description)
        if "%d" in description:
            told = F.format_string(description, F.col("word_count"))
        issue = F.struct(
            F.lit(kind).alias("type"),
            F.lit(severity).alias("severity"),
            told.alias("description"),
            F.lit(suggestion).alias("suggestion"),
        )
        found.append(F.when(applies, issue))
    return F.filter(F.array(*found), lambda issue: issue.isNotNull())


def suggestions() -> Column:
    severe = F.size(F.filter(F.col("issues"), lambda issue: issue["severity"] == "High"))
    told = fixed.SUGGESTIONS
    found = F.array(
        F.when(severe > 0, F.format_string(told["severe_issues"], severe)),
        F.when(F.col("word_count") < 1000, F.lit(told["longer"])),
        F.when(F.size("academic_terms") < 5, F.lit(told["more_terms"])),
        F.when(F.col("coherence") < 60, F.lit(told["coherence"])),
        F.when(~F.col("has_references"), F.lit(told["references"])),
    )
    return F.filter(found, lambda s: s.isNotNull())


def paragraph_at(parts: Column, index: int) -> Column:
    """First (1) or last (-1) paragraph, empty when there is none."""
    return F.coalesce(F.try_element_at(parts, F.lit(index)), F.lit(""))


def has_any(value: Column, phrases: Sequence[str]) -> Column:
    return text.contains_any(F.lower(value), phrases)
