"""Sentence against sentence: the first compare sentence with enough common trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators.copies import numbered, text_key
from palimpsest.operators.setsim import HOT_DF, topk_jaccard
from palimpsest.scratch import stage_packed as stage


def plain_sentences(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``doc_id, pos, sentence``."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.posexplode(text.sentences_plain(F.col(text_col))).alias("pos", "sentence"),
    )


def sentence_offsets(rows: DataFrame) -> DataFrame:
    """Running start: previous start + previous length + 1.  A group is one document."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("sentence") + 1).over(before), F.lit(0))
    return rows.withColumn("start_position", start).withColumn(
        "end_position", F.col("start_position") + F.length("sentence")
    )


def sentence_match(
    sources: DataFrame,
    compare: DataFrame,
    min_percent: float = 50.0,
    hot_df: int = HOT_DF,
    id_col: str = "id",
    text_col: str = "content",
) -> DataFrame:
    """``doc_id, pos, start_position, end_position, compare_id, compare_pos, score``.

    For every sentence of the sources the first compare sentence, in order of document and place,
    whose trigram overlap is above ``min_percent``.
    """
    left = sentence_offsets(plain_sentences(sources, id_col, text_col)).withColumn(
        "clean", text.normalize(F.col("sentence"))
    )
    left = stage(left.drop("sentence"), "sentences").withColumn("lid", text_key(F.col("clean")))
    right = plain_sentences(compare, id_col, text_col).select(
        F.struct("doc_id", "pos").alias("at"), text.normalize(F.col("sentence")).alias("clean")
    )
    # Of equal sentences the first one is the one that would be found.
    right = right.groupBy("clean").agg(F.min("at").alias("rid"))
    texts = left.groupBy("lid").agg(F.first("clean").alias("clean"))
    tokens = text.tokenize(F.col("clean"))
    texts, right = texts.withColumn("tokens", tokens), right.withColumn("tokens", tokens)
    grams = text.gram_keys(F.col("tokens"), 3).alias("grams")
    sets = stage(numbered(texts.select("lid", grams)), "sentence-left")
    found = topk_jaccard(
        sets.select(F.col("nid").alias("lid"), "grams"),
        stage(right.select("rid", grams), "sentence-right"),
        1, min_percent, order="first", hot_df=hot_df, tag="sentence",
    )
    found = found.withColumnRenamed("lid", "nid").join(sets.select("nid", "lid"), "nid")
    return left.join(found, "lid").select(
        "doc_id", "pos", "start_position", "end_position",
        F.col("rid.doc_id").alias("compare_id"), F.col("rid.pos").alias("compare_pos"), "score",
    )
