"""Integrity rules between the tables, as joins over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.scratch import stage


def unique_violations(df: DataFrame, relation: str, column: str) -> DataFrame:
    """Values that stand in more than one row."""
    groups = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return groups.filter("n > 1").select(F.lit(relation).alias("relation"), "value", "n")


def orphans(child: DataFrame, key: str, parent: DataFrame, relation: str, id_col: str = "id") -> DataFrame:
    """Rows whose key is set but has no parent."""
    rows = child.filter(F.col(key).isNotNull()).select(
        F.lit(relation).alias("relation"),
        F.col(id_col).cast("string").alias("row_id"),
        F.col(key).cast("long").alias("missing_key"),
    )
    ids = parent.select(F.col("id").cast("long").alias("missing_key"))
    return rows.join(ids, "missing_key", "left_anti").select("relation", "row_id", "missing_key")


def orphan_report(tables: dict[str, DataFrame]) -> DataFrame:
    relations = [
        ("departments", "faculty_id", "faculties", "id"),
        ("subjects", "department_id", "departments", "id"),
        ("users", "faculty_id", "faculties", "id"),
        ("users", "department_id", "departments", "id"),
        ("documents", "user_id", "users", "id"),
        ("documents", "subject_id", "subjects", "id"),
        ("checks", "source_document_id", "documents", "id"),
        ("checks", "user_id", "users", "id"),
        ("matches", "check_id", "checks", "check_id"),
        ("matches", "matched_document_id", "documents", "check_id"),
    ]
    parts = [
        orphans(tables[child], key, tables[parent], f"{child}.{key}", id_col)
        for child, key, parent, id_col in relations
        if child in tables and parent in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def _named(keys: DataFrame, name: str) -> DataFrame:
    return keys.select(F.col("id").alias(name)).distinct()


def _held(edges: DataFrame, leaving: DataFrame) -> DataFrame:
    """Ids that an edge ``s -> d`` from a row that stays holds, directly or through others that it holds.

    Each round goes one edge further, and only from the ids found last.
    """
    edges = stage(edges, "delete-edges")
    found = stage(edges.join(leaving.select(F.col("id").alias("s")), "s", "left_anti").select(F.col("d").alias("id")).distinct(), "delete-held")
    last = found
    while not last.isEmpty():
        onward = edges.join(last.select(F.col("id").alias("s")), "s").select(F.col("d").alias("id")).distinct()
        last = stage(onward.join(found, "id", "left_anti"), "delete-last")
        found = stage(found.unionByName(last), "delete-held")
    return found


def delete_documents(
    docs: DataFrame, checks: DataFrame, matches: DataFrame, keys: DataFrame, same_batch: bool = False
) -> dict[str, DataFrame]:
    """Remove documents with their checks and those checks' matches.

    A document that a match of another document's check points to stays and is reported.  With
    ``same_batch`` only checks that stay count: documents that are only referred to by each other's
    checks go together, and one that stays holds what its checks refer to.
    """
    source = checks.select(F.col("id").alias("check_id"), "source_document_id")
    targets = (
        matches.join(_named(keys, "matched_document_id"), "matched_document_id", "left_semi")
        .select("check_id", "matched_document_id").join(source, "check_id")
        .filter("source_document_id <> matched_document_id")
        .select(F.col("matched_document_id").alias("id")).distinct()
    )
    present = docs.select("id").join(keys.select("id").distinct(), "id", "left_semi")
    if same_batch:
        present = stage(present, "delete-present")
        edges = matches.join(_named(present, "matched_document_id"), "matched_document_id", "left_semi").select(
            "check_id", F.col("matched_document_id").alias("d")).join(source, "check_id").select(
            F.col("source_document_id").alias("s"), "d").filter("s <> d").distinct()
        targets = _held(edges, present)
    blocked = present.join(targets, "id", "left_semi")
    gone = present.join(targets, "id", "left_anti")
    gone_checks = checks.join(_named(gone, "source_document_id"), "source_document_id", "left_semi").select("id")
    return {
        "documents": docs.join(gone, "id", "left_anti"),
        "checks": checks.join(gone_checks, "id", "left_anti"),
        "matches": matches.join(_named(gone_checks, "check_id"), "check_id", "left_anti"),
        "blocked": blocked,
        "deleted_documents": gone,
        "deleted_checks": gone_checks,
    }


def delete_parents(
    parents: DataFrame,
    keys: DataFrame,
    blocking: list[tuple[DataFrame, str]] = (),
    clearing: dict[str, tuple[DataFrame, str]] | None = None,
) -> dict[str, DataFrame]:
    """Remove rows that no ``blocking`` table refers to; ``clearing`` tables get a null key.

    Faculties are blocked by departments and clear users, departments are blocked by subjects and
    clear users, subjects clear documents, users are blocked by documents and checks.
    """
    present = parents.select("id").join(keys.select("id").distinct(), "id", "left_semi")
    in_use = [child.select(F.col(key).alias("id")) for child, key in blocking]
    blocked = present.limit(0) if not in_use else present.join(
        reduce(DataFrame.unionAll, in_use).distinct(), "id", "left_semi"
    )
    gone = present.join(blocked, "id", "left_anti")
    result = {"kept": parents.join(gone, "id", "left_anti"), "deleted": gone, "blocked": blocked}
    for name, (child, key) in (clearing or {}).items():
        marks = gone.select(F.col("id").alias(key), F.lit(True).alias("_gone"))
        cleared = F.when(F.col("_gone").isNull(), F.col(key))
        result[name] = child.join(marks, key, "left").withColumn(key, cleared).drop("_gone")
    return result
