"""Segments of source documents and normalised contents of corpus documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import fixed, text


def segments(
    docs: DataFrame,
    id_col: str = "id",
    text_col: str = "content",
    phrases: Sequence[str] = fixed.COMMON_PHRASES,
    keywords: Sequence[str] = fixed.BIBLIOGRAPHY_KEYWORDS,
) -> DataFrame:
    """One row per segment: ``src_id, pos, raw, clean, n_words, is_noise, is_excluded, reason``.

    A narrow transformation: every document is cut, split and classified where it is read.
    """
    raw = docs.select(
        F.col(id_col).alias("src_id"),
        F.posexplode(
            text.segment_array(text.cut_bibliography(F.col(text_col), keywords))
        ).alias("pos", "raw"),
    )
    clean = raw.withColumn("clean", text.normalize(F.col("raw")))
    counted = clean.withColumn("n_words", text.word_count(F.col("clean")))
    short = F.col("n_words") < fixed.MIN_SEGMENT_WORDS
    common = ~short & text.contains_any(F.col("clean"), phrases)
    return counted.select(
        "src_id",
        "pos",
        "raw",
        "clean",
        "n_words",
        short.alias("is_noise"),
        common.alias("is_excluded"),
        F.when(F.col("n_words") == 0, F.lit(None).cast("string"))
        .when(short, F.lit(fixed.REASON_TOO_SHORT))
        .when(common, F.lit(fixed.REASON_COMMON_PHRASE))
        .alias("reason"),
    )


def counted_segments(segs: DataFrame) -> DataFrame:
    return segs.filter(~F.col("is_noise") & ~F.col("is_excluded"))


def contents(
    docs: DataFrame,
    id_col: str = "id",
    text_col: str = "content",
    keywords: Sequence[str] = fixed.BIBLIOGRAPHY_KEYWORDS,
) -> DataFrame:
    """``doc_id, clean``: the corpus side, cut and normalised."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        text.normalize(text.cut_bibliography(F.col(text_col), keywords)).alias("clean"),
    )
