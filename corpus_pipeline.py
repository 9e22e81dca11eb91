"""From raw documents to packed training sequences.

Five stages, each over all rows that the one before kept.  Every stage but the last returns the columns
of ``documents``, further columns included.  Between stages the rows are written as Parquet and read again.
In all stages texts are worked on whole, however long, and an empty table gives an empty table.  Texts go
to Python ``BATCH`` rows at a time, unless the session names a number itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import anchors, binpack, minhash, pieces, setjoin
from palimpsest.scratch import fresh_path
from palimpsest.sources.tables import read_table

BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH = 1000  # whole texts; ten thousand, Spark's own number, fill tens of MB in each task of both the JVM and Python


def small_batches(spark: SparkSession) -> None:
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts in none of the languages that the labelled rows teach.

    These are null and empty texts, texts without a letter, and texts of 50 letters or more whose likelihood
    a letter is below that of evenly drawn letters.  Without any label only those without a letter go.
    Repeated rows share their fate; a tie between languages decides nothing.
    """
    small_batches(spark)
    return pieces.speaking(docs, pieces.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Null texts and texts without a word are in no group and stay.  Repeated rows of one id become one (of
    different texts the one that sorts first).  Rows without an id stay once for each text.
    """
    small_batches(spark)
    return minhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 words or more that also stand in a document with a smaller id.

    A document all of whose words are cut is left out; null texts and texts without a word stay as they are.
    Passages that only repeat within one document or between rows of one id are left alone.  ``n_chars``
    follows the new text.
    """
    small_batches(spark)
    return anchors.cut(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents in which a window of ten words of a benchmark item stands (a shorter item: all of it).

    Null texts and texts without a word stay, and so does everything when the benchmark is empty.
    """
    small_batches(spark)
    return setjoin.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of the permitted lengths; one row per piece of a document.

    A null or empty text is its end mark alone, one token.  Repeated rows are packed each by itself.  Pieces
    of equal length go in order of their rows, so which bin they share follows the layout of the table.
    """
    return binpack.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained language models and greedy packing are beyond SQL; tests/llm/test_pipeline.py has a plain Python version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
