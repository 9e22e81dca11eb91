"""Row filters of the reports.  All of them reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_only(df: DataFrame) -> DataFrame:
    return df.filter("is_active")


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for those options that are given; ``None`` and ``""`` mean no filter."""
    for column, value in wanted.items():
        if value is not None and value != "":
            df = df.filter(F.col(column) == value)
    return df


def reference_corpus(docs: DataFrame, source_id: int | None = None) -> DataFrame:
    """Active public documents, without the checked one."""
    corpus = docs.filter("is_active AND is_public")
    return corpus if source_id is None else corpus.filter(F.col("id") != source_id)


def row_scope(
    df: DataFrame, user_id: int, role: str, restricted: str = "all", user_col: str = "user_id"
) -> DataFrame:
    """Rows a caller may see.  ``restricted="all"``: everyone but Admin sees only their own rows;
    ``"students"``: only Students are restricted."""
    limited = role != "Admin" if restricted == "all" else role == "Student"
    return df.filter(F.col(user_col) == user_id) if limited else df


def text_search(df: DataFrame, query: str, *columns: str, collation: str | None = None) -> DataFrame:
    """Rows where one of the columns holds the text, upper or lower case, in one pass.

    With ``collation`` (such as ``UNICODE_CI`` or ``UNICODE_CI_AI``) that decides what is equal."""
    if collation is None:
        tests = [F.contains(F.lower(column), F.lit(query.lower())) for column in columns]
    else:
        tests = [F.contains(F.collate(F.col(column), collation), F.collate(F.lit(query), collation)) for column in columns]
    return df.filter(reduce(Column.__or__, tests, F.lit(False)))


def lookup(df: DataFrame, **key) -> DataFrame:
    """The rows with the given key, active or not."""
    for column, value in key.items():
        df = df.filter(F.col(column) == value)
    return df


def document_content(docs: DataFrame, doc_id: int) -> DataFrame:
    return docs.filter(F.col("id") == doc_id).select("content")
