"""The queries of this package and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import (
    anchors, binpack, bwt, centroids, forest, hmm, host_rules, interleave, licenses, minhash, pieces, setjoin, whitening,
)
from palimpsest.sources.tables import read_table


def over_documents(build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(read_table(spark, sf_dir, "documents"))


def with_benchmark(build: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def over_embeddings(build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merged_bwt": over_documents(bwt.op1),
    "op2_host_rules": over_documents(host_rules.op2),
    "op3_block_anchors": over_documents(anchors.op3),
    "op4_hmm_likelihood": over_documents(hmm.op4),
    "op5_license_rules": over_documents(licenses.op5),
    "op6_piece_langid": over_documents(pieces.op6),
    "op7_variable_packing": over_documents(binpack.op7),
    "op8_prefix_set_join": with_benchmark(setjoin.op8),
    "op9_interleave_shards": over_documents(interleave.op9),
    "op10_bbit_minhash": over_documents(minhash.op10),
    "op11_projection_forest": over_embeddings(forest.op11),
    "op12_mean_ordered_search": over_embeddings(centroids.op12),
    "op13_secular_whitening": over_embeddings(whitening.op13),
}

ORACLES: dict[str, str] = {
    "op2_host_rules": host_rules.OP2_SQL,
    "op3_block_anchors": anchors.OP3_SQL,
    "op8_prefix_set_join": setjoin.OP8_SQL,
    "op9_interleave_shards": interleave.OP9_SQL,
    "op10_bbit_minhash": minhash.OP10_SQL,
    "op12_mean_ordered_search": centroids.OP12_SQL,
}
