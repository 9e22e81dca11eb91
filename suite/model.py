"""The given tables read as the tables of the data model, in Spark and in SQL.

``Model`` builds DataFrames, ``CTES`` holds the same definitions for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.tables import read_table, spread


class Model:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def faculties(self) -> DataFrame:
        return self.raw("region").selectExpr(
            "r_regionkey AS id",
            "concat('F', r_regionkey) AS code",
            "r_name AS name",
            "length(r_name) < 8 AS is_active",
        )

    def departments(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "n_nationkey AS id",
            "concat('D', n_nationkey) AS code",
            "n_name AS name",
            "n_regionkey AS faculty_id",
            "n_name <> 'NATION_3' AS is_active",
        )

    def subjects(self) -> DataFrame:
        return self.raw("part").select("p_brand").distinct().selectExpr(
            "cast(substring(p_brand, 7) AS int) AS id",
            "upper(p_brand) AS code",
            "p_brand AS name",
            "3 AS credits",
            "cast(substring(p_brand, 7) AS int) AS department_id",
            "true AS is_active",
        )

    def users(self) -> DataFrame:
        role = (
            "CASE c_mktsegment WHEN 'BUILDING' THEN 'Admin' WHEN 'MACHINERY' THEN 'Lecturer'"
            " ELSE 'Student' END"
        )
        return self.raw("customer").selectExpr(
            "c_custkey AS id",
            "lower(replace(c_name, '#', '')) AS username",
            "c_name AS full_name",
            "concat(lower(replace(c_name, '#', '.')), '@example.org') AS email",
            f"{role} AS role",
            "c_nationkey % 5 AS faculty_id",
            "CASE WHEN c_nationkey > 5 THEN c_nationkey END AS department_id",
            "c_acctbal >= 0 AS is_active",
            "CASE WHEN c_mktsegment = 'BUILDING' THEN 999 ELSE 5 END AS daily_check_limit",
            "c_custkey % 7 AS checks_used_today",
        )

    def papers(self) -> DataFrame:
        """Document rows without text, for the reports."""
        return self.raw("part").selectExpr(
            "p_partkey AS id",
            "p_name AS title",
            "CASE p_type WHEN 'ECONOMY' THEN 'Essay' WHEN 'STANDARD' THEN 'Thesis'"
            " ELSE 'Research' END AS document_type",
            "cast(p_size AS bigint) AS file_size",
            "p_partkey AS user_id",
            "CASE WHEN p_size <= 40 THEN cast(substring(p_brand, 7) AS int) END AS subject_id",
            "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, p_size) AS upload_date",
            "p_size >= 5 AS is_public",
            "p_size <= 45 AS is_active",
        )

    def checks(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id",
            "o_custkey AS source_document_id",
            "o_custkey AS user_id",
            "o_orderdate AS check_date",
            "cast(floor(o_totalprice / 50) / 100 AS decimal(5,2)) AS overall_similarity",
            "CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Processing'"
            " ELSE 'Failed' END AS status",
            "cast(substring(o_orderpriority, 1, 1) AS int) AS total_matched_documents",
        )

    def matches(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS check_id",
            "l_linenumber AS pos",
            "l_partkey AS matched_document_id",
            "concat(l_returnflag, l_linestatus) AS matched_text",
            "0 AS start_position",
            "cast(l_quantity AS int) AS end_position",
            "cast(round(l_discount * 100) AS decimal(5,2)) AS similarity_score",
        )

    def documents(self) -> DataFrame:
        """Documents with text.  A row labelled toxic is inactive, one of low quality not public."""
        labels = self.raw("labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
        docs = spread(self.raw("documents")).select(
            F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source"
        )
        return docs.join(labels, "id", "left").selectExpr(
            "id",
            "concat('doc-', id) AS title",
            "content",
            "lang",
            "source",
            "coalesce(toxic, 0) = 0 AS is_active",
            "coalesce(quality, 1) = 1 AS is_public",
        )

    def requests(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS request_id",
            "user_id",
            "cast(floor(value) AS bigint) AS document_id",
            "ts",
        )

    def uploads(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS id",
            "user_id % 5 AS user_id",
            "event_type AS file_name",
            "cast(floor(value / 100) AS bigint) AS file_size",
            "ts",
        )


CTES = {
    "faculties": """SELECT r_regionkey AS id, 'F' || r_regionkey AS code, r_name AS name,
        length(r_name) < 8 AS is_active FROM region""",
    "departments": """SELECT n_nationkey AS id, 'D' || n_nationkey AS code, n_name AS name,
        n_regionkey AS faculty_id, n_name <> 'NATION_3' AS is_active FROM nation""",
    "subjects": """SELECT DISTINCT CAST(substr(p_brand, 7) AS int) AS id, upper(p_brand) AS code,
        p_brand AS name, 3 AS credits, CAST(substr(p_brand, 7) AS int) AS department_id,
        true AS is_active FROM part""",
    "users": """SELECT c_custkey AS id, lower(replace(c_name, '#', '')) AS username,
        c_name AS full_name, lower(replace(c_name, '#', '.')) || '@example.org' AS email,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'Admin' WHEN 'MACHINERY' THEN 'Lecturer'
        ELSE 'Student' END AS role, c_nationkey % 5 AS faculty_id,
        CASE WHEN c_nationkey > 5 THEN c_nationkey END AS department_id,
        c_acctbal >= 0 AS is_active,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 999 ELSE 5 END AS daily_check_limit,
        c_custkey % 7 AS checks_used_today FROM customer""",
    "papers": """SELECT p_partkey AS id, p_name AS title, CASE p_type WHEN 'ECONOMY' THEN 'Essay'
        WHEN 'STANDARD' THEN 'Thesis' ELSE 'Research' END AS document_type,
        CAST(p_size AS bigint) AS file_size, p_partkey AS user_id,
        CASE WHEN p_size <= 40 THEN CAST(substr(p_brand, 7) AS int) END AS subject_id,
        TIMESTAMP '2024-01-01 00:00:00' + to_days(p_size) AS upload_date,
        p_size >= 5 AS is_public, p_size <= 45 AS is_active FROM part""",
    "checks": """SELECT o_orderkey AS id, o_custkey AS source_document_id, o_custkey AS user_id,
        o_orderdate AS check_date,
        CAST(floor(o_totalprice / 50) / 100 AS decimal(5,2)) AS overall_similarity,
        CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Processing'
        ELSE 'Failed' END AS status,
        CAST(substr(o_orderpriority, 1, 1) AS int) AS total_matched_documents FROM orders""",
    "matches": """SELECT l_orderkey AS check_id, l_linenumber AS pos,
        l_partkey AS matched_document_id, l_returnflag || l_linestatus AS matched_text,
        0 AS start_position, CAST(l_quantity AS int) AS end_position,
        CAST(round(l_discount * 100) AS decimal(5,2)) AS similarity_score FROM lineitem""",
    "docs": """SELECT d.doc_id AS id, 'doc-' || d.doc_id AS title, d.text AS content, d.lang, d.source,
        coalesce(l.toxic, 0) = 0 AS is_active, coalesce(l.quality, 1) = 1 AS is_public
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "requests": """SELECT event_id AS request_id, user_id,
        CAST(floor(value) AS bigint) AS document_id, ts FROM events""",
    "uploads": """SELECT event_id AS id, user_id % 5 AS user_id, event_type AS file_name,
        CAST(floor(value / 100) AS bigint) AS file_size, ts FROM events""",
}


def with_tables(names: str, body: str, **more: str) -> str:
    """``WITH`` the named model tables and further steps, then ``body``."""
    steps = [(n, CTES[n]) for n in names.split()] + list(more.items())
    head = ",\n".join(f"{name} AS ({sql})" for name, sql in steps)
    return f"WITH {head}\n{body}" if head else body
