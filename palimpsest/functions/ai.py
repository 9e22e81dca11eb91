"""Machine-text rules per sentence and document, without any random part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import fixed, text
from palimpsest.functions.bands import risk_band

RESULT = (
    "ai_probability double, detection_level string,"
    " sentences array<struct<text:string,ai_probability:double,is_likely_ai:boolean>>,"
    " summary string, checked_date timestamp_ntz"
)


def sentence_score(sentence: Column, transitions: Sequence[str] = fixed.AI_TRANSITIONS) -> Column:
    words = text.word_count(sentence)
    low = F.lower(sentence)
    score = F.lit(30) + F.when((words > 15) & (words < 25), 15).otherwise(0)
    for phrase in transitions:
        score = score + F.when(F.contains(low, F.lit(phrase)), 5).otherwise(0)
    score = score + F.when(sentence.rlike(fixed.AI_LONG_WORD_PATTERN), 0).otherwise(5)
    return F.when(words < 5, 10).otherwise(F.least(F.lit(98), score)).cast("double")


def sentence_results(content: Column) -> Column:
    def judged(sentence: Column) -> Column:
        return text.let(
            sentence_score(sentence),
            lambda score: F.struct(
                sentence.alias("text"),
                text.round2(score).alias("ai_probability"),
                (score > 60).alias("is_likely_ai"),
            ),
        )

    return F.transform(text.sentences(content), judged)


def document_score(results: Column, content: Column) -> Column:
    """Mean sentence score, lowered for short texts; not rounded."""
    total = F.aggregate(results, F.lit(0.0), lambda acc, r: acc + r["ai_probability"])
    mean = F.when(F.size(results) > 0, total / F.size(results)).otherwise(F.lit(0.0))
    return mean * F.when(F.length(content) < 200, F.lit(0.8)).otherwise(F.lit(1.0))


def summary(score: Column) -> Column:
    return (
        F.when(score > 75, F.lit(fixed.AI_SUMMARY_HIGH))
        .when(score > 50, F.lit(fixed.AI_SUMMARY_MEDIUM))
        .otherwise(F.lit(fixed.AI_SUMMARY_LOW))
    )


def level(score: Column) -> Column:
    return risk_band(score, "ai")


def to_stored(as_of: Column) -> Column:
    """JSON text of a scored row, as kept with the check."""
    return F.to_json(
        F.struct(
            "ai_probability", "detection_level", "sentences", "summary", as_of.alias("checked_date")
        )
    )


def from_stored(stored: Column) -> Column:
    """Nested result from its JSON text; null and empty text give null."""
    return F.from_json(F.when(stored != "", stored), RESULT)
