"""Machine-text score of every document: one narrow pass, sentences stay inside the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import ai, text


def score_ai(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``doc_id, ai_probability, detection_level, sentences, summary``."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("content"))
    judged = base.withColumn("sentences", ai.sentence_results(F.col("content")))
    scored = judged.withColumns(
        {"blank": text.blank(F.col("content")), "score": ai.document_score(F.col("sentences"), F.col("content"))}
    )
    return scored.select(
        "doc_id",
        F.when(F.col("blank"), 0.0).otherwise(text.round2(F.col("score"))).alias("ai_probability"),
        F.when(F.col("blank"), "Low").otherwise(ai.level(F.col("score"))).alias("detection_level"),
        F.when(F.col("blank"), F.array().cast("array<struct<text:string,ai_probability:double,is_likely_ai:boolean>>"))
        .otherwise(F.col("sentences"))
        .alias("sentences"),
        F.when(F.col("blank"), "").otherwise(ai.summary(F.col("score"))).alias("summary"),
    )
