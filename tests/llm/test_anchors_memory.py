"""What the passage steps hold at once does not follow the size of the batches that Spark hands over."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from palimpsest.llm import anchors, words


@pytest.fixture(scope="module")
def batch():
    """24 MB of text of which no passage repeats."""
    rng = random.Random(1)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(50000)]
    bodies = [" ".join(rng.choices(pool, k=400)).encode() for _ in range(11000)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(bodies))), pa.array(bodies, pa.binary())], names=["doc_id", "body"])


def peak(work):
    tracemalloc.start()
    for _ in work:
        pass
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_the_index_holds_the_words_of_few_texts(batch):
    assert peak(anchors.index_rows(iter([batch]), anchors.Layout(1 << 22))) < 75


def test_the_probes_hold_the_words_of_few_texts(batch):
    layout = anchors.Layout(1 << 22)
    bits = SimpleNamespace(value=np.zeros(layout.buckets * layout.width // 8, np.uint8))
    assert peak(anchors.passage_rows(iter([batch]), layout, bits)) < 40


def test_texts_are_cut_in_small_slices(batch):
    assert max(len(x) * 2200 for x in words.slices(batch.column("body"))) < 4 << 20


def test_a_filter_is_held_once(spark):
    bits = np.arange(1 << 16, dtype=np.int64).astype(np.uint8)
    shared = words.Shared(spark, bits)
    assert (shared.value == bits).all() and not shared.value.flags.owndata
    assert words.Shared(spark, {"a": 1}).value == {"a": 1}


def test_the_pipeline_hands_texts_over_in_small_batches(spark):
    name = corpus_pipeline.BATCH_SETTING
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string").repartition(1)
    before = spark.conf.getAll.get(name)
    try:
        spark.conf.unset(name)
        assert corpus_pipeline.repeated_passages(spark, docs, "").count() == 2
        assert spark.conf.get(name) == "1000"
        spark.conf.set(name, "7")
        assert corpus_pipeline.repeated_passages(spark, docs, "").count() == 2
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
