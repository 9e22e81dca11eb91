"""Lists, history, detail and statistics.

Small tables are not hinted: Spark broadcasts a side when its size statistics are below the
threshold, and AQE does so after measuring it; a larger one is shuffled and skewed keys are split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.ai import from_stored
from palimpsest.functions.bands import remaining_checks
from palimpsest.operators.filters import optional_filters


def document_list(docs: DataFrame, users: DataFrame, subjects: DataFrame) -> DataFrame:
    """Documents with the name of their user (required) and subject (optional)."""
    named = docs.join(users.select(F.col("id").alias("user_id"), F.col("full_name").alias("user_name")), "user_id")
    return named.join(
        subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name")),
        "subject_id",
        "left",
    )


def check_history(checks: DataFrame, docs: DataFrame, users: DataFrame) -> DataFrame:
    titles = docs.select(F.col("id").alias("source_document_id"), F.col("title").alias("source_title"))
    names = users.select(F.col("id").alias("user_id"), F.col("full_name").alias("user_name"))
    return checks.join(titles, "source_document_id").join(names, "user_id")


def user_list(users: DataFrame, faculties: DataFrame, departments: DataFrame) -> DataFrame:
    faculty = faculties.select(F.col("id").alias("faculty_id"), F.col("name").alias("faculty_name"))
    department = departments.select(
        F.col("id").alias("department_id"), F.col("name").alias("department_name")
    )
    named = users.join(faculty, "faculty_id", "left").join(department, "department_id", "left")
    if {"daily_check_limit", "checks_used_today"} <= set(users.columns):
        left = remaining_checks(F.col("daily_check_limit"), F.col("checks_used_today"))
        named = named.withColumn("remaining_checks", left)
    return named


def with_parent_name(rows: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
    """Departments with their faculty, subjects with their department."""
    return rows.join(parents.select(F.col("id").alias(key), F.col("name").alias(name)), key)


def check_detail(
    checks: DataFrame, docs: DataFrame, users: DataFrame, matches: DataFrame, ordered: bool = True
) -> tuple[DataFrame, DataFrame]:
    """One header row per check, and one row per match of these checks with its title, ordered by ``pos``.

    Nothing is nested, so a check may have any number of matches at any position; one without
    matches has its header only.  A stored machine-text result is parsed into ``ai_analysis``.  What
    works on with the matches takes them unordered, without the sort of the whole table.
    """
    head = check_history(checks, docs, users)
    if "ai_detection_json" in checks.columns:
        head = head.withColumn("ai_analysis", from_stored(F.col("ai_detection_json")))
    titles = docs.select(F.col("id").alias("matched_document_id"), F.col("title").alias("matched_title"))
    found = matches.join(titles, "matched_document_id").join(
        head.select(F.col("id").alias("check_id")), "check_id", "left_semi"
    )
    rows = found.select(
        "check_id", "pos", "matched_document_id", "matched_title", "matched_text", "start_position",
        "end_position", "similarity_score",
    )
    return head, rows.orderBy("check_id", "pos", "matched_document_id") if ordered else rows


def history_top_n(checks: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = checks.orderBy(F.desc("check_date"), F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def high_risk(checks: DataFrame, threshold: float = 50, limit: int = 10) -> DataFrame:
    """Completed checks at or above the threshold, highest first."""
    found = checks.filter((F.col("status") == "Completed") & (F.col("overall_similarity") >= threshold))
    return found.orderBy(F.desc("overall_similarity"), F.desc("check_date"), F.desc("id")).limit(limit)


def sorted_list(df: DataFrame, column: str, descending: bool = False, collation: str | None = None) -> DataFrame:
    """In binary order, or that of ``collation`` (such as ``UNICODE_CI``); the id splits ranges of equal values."""
    key = F.col(column) if collation is None else F.collate(F.col(column), collation)
    return df.orderBy(key.desc() if descending else key.asc(), "id")


def completed(checks: DataFrame, user_id: int | None = None) -> DataFrame:
    done = checks.filter("status = 'Completed'")
    return done if user_id is None else done.filter(F.col("user_id") == user_id)


def with_subject(checks: DataFrame, docs: DataFrame) -> DataFrame:
    keys = docs.select(F.col("id").alias("source_document_id"), "subject_id")
    return checks.join(keys, "source_document_id")


def stats_summary(
    checks: DataFrame, docs: DataFrame, user_id: int | None = None, subject_id: int | None = None
) -> DataFrame:
    """Counts, average and report bands of completed checks in one pass; zeros when none."""
    done = completed(checks, user_id)
    if subject_id is not None:
        done = with_subject(done, docs).filter(F.col("subject_id") == subject_id)
    score = F.col("overall_similarity")
    (_, high, _), (_, medium, _), _ = fixed.BANDS["report"]
    return done.agg(
        F.count("*").alias("total_checks"),
        F.coalesce(
            F.round(F.sum(score).cast("double") / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0)
        ).alias("average_similarity"),
        F.count_if(score > high).alias("high_risk"),
        F.count_if((score >= medium) & (score <= high)).alias("medium_risk"),
        F.count_if(score < medium).alias("low_risk"),
    )


def stats_by_subject(checks: DataFrame, docs: DataFrame, subjects: DataFrame, user_id: int | None = None):
    """Checks and average per subject.

    Summed per document before the document's subject is joined, and per subject before the name
    is, so a document checked very often crosses the shuffle as one row per task.
    """
    per_document = completed(checks, user_id).groupBy("source_document_id").agg(
        F.count("*").alias("n"), F.sum("overall_similarity").alias("total")
    )
    known = with_subject(per_document, docs).filter("subject_id is not null")
    average = F.sum("total").cast("double") / F.sum("n")
    sums = known.groupBy("subject_id").agg(
        F.sum("n").alias("document_count"), F.round(average, 4).alias("average_similarity")
    )
    named = sums.join(
        subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name")), "subject_id"
    )
    return named.orderBy(F.desc("average_similarity"), "subject_id")


def entity_counts(docs: DataFrame, users: DataFrame, faculties: DataFrame, subjects: DataFrame):
    """One row of counts: a partial count per table, gathered by one aggregate."""
    counts = {
        "total_documents": docs.filter("is_active"),
        "total_users": users,
        "total_students": users.filter("role = 'Student'"),
        "total_faculties": faculties,
        "total_subjects": subjects,
    }
    rows = [df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name)) for name, df in counts.items()]
    return reduce(DataFrame.unionByName, rows).agg(
        *[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in counts]
    )


def distinct_matched(matches: DataFrame) -> DataFrame:
    """Every matched document of a check once."""
    return matches.select("check_id", "matched_document_id").dropDuplicates()


def history(
    checks: DataFrame, docs: DataFrame, users: DataFrame,
    user_id: int | None = None, document_id: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Latest checks with their names.  Cut to ``limit`` before anything is joined."""
    wanted = optional_filters(checks, user_id=user_id, source_document_id=document_id)
    return check_history(history_top_n(wanted, limit), docs, users).orderBy(F.desc("check_date"), F.desc("id"))


def statistics(
    checks: DataFrame, docs: DataFrame, users: DataFrame, faculties: DataFrame, subjects: DataFrame,
    user_id: int | None = None,
) -> dict[str, DataFrame]:
    """The parts of the statistics page; each is a small table."""
    return {
        "summary": stats_summary(checks, docs, user_id),
        "entities": entity_counts(docs, users, faculties, subjects),
        "subjects": stats_by_subject(checks, docs, subjects, user_id),
    }
