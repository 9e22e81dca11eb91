"""The language stage of the pipeline when no row has a label."""

import corpus_pipeline
from palimpsest.llm import pieces


def test_texts_with_letters_stay_without_labels(spark):
    rows = [(1, "plain words", None), (2, "12 !", None), (3, None, None), (4, "Δ", None), (5, "", None), (6, "line\nđ", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]
    found = pieces.identify(docs, pieces.train(docs)).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in found) == [(i, "und", 0.0) for i in range(1, 7)]
