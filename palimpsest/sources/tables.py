"""Schemas of the domain tables and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG = "created_date timestamp_ntz, updated_date timestamp_ntz"
SCHEMAS = {
    "faculties": f"id int, code string, name string, description string, is_active boolean, {CATALOG}",
    "departments": "id int, code string, name string, description string, faculty_id int,"
    f" is_active boolean, {CATALOG}",
    "subjects": "id int, code string, name string, description string, credits int,"
    f" department_id int, is_active boolean, {CATALOG}",
    "users": "id int, username string, full_name string, email string, phone_number string,"
    " role string, student_id string, lecturer_id string, faculty_id int, department_id int,"
    " is_active boolean, created_date timestamp_ntz, last_login_date timestamp_ntz,"
    " daily_check_limit int, checks_used_today int, last_check_reset_date timestamp_ntz",
    "documents": "id int, title string, document_type string, content string,"
    " original_file_name string, file_path string, file_size bigint, user_id int, subject_id int,"
    " semester string, year int, upload_date timestamp_ntz, is_public boolean, is_active boolean",
    "checks": "id int, source_document_id int, user_id int, check_date timestamp_ntz,"
    " overall_similarity decimal(5,2), status string, total_matched_documents int, notes string,"
    " ai_probability decimal(5,2), ai_detection_level string, ai_detection_json string",
    "matches": "id int, check_id int, matched_document_id int, matched_text string,"
    " start_position int, end_position int, similarity_score decimal(5,2)",
}


def read_domain(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A domain table with its declared schema: no inference, columns pruned by the scan."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Split a scan of few, small files over all cores before costly text work.

    A table of many splits is returned as it is, without a shuffle.  For scans only: asking a plan
    with a shuffle for its partitions would run that shuffle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
